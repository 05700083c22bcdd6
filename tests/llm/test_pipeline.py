"""The pipeline's stages against brute force, on a small corpus with planted cases."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from genoframe.llm import decontaminate, mixing, suffix_dedup

STAGES = dict(corpus_pipeline.STAGES)
VOWELS = {"en": "aei", "xx": "ouy"}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(21)
    prose = lambda lang, n: " ".join("".join(rng.choice("bdklmnrst") + rng.choice(VOWELS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    items = [(i, prose("en", 30)) for i in range(6)]
    shared = prose("en", 70)
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "xx"
        rows.append([i, prose(lang, rng.choice([40, 90, 300])), lang, f"s{i % 4}"])
    for i in range(20):  # one passage of the benchmark in each, in short and in long texts
        body = words(prose("en", 60 if i % 2 else 1200))
        cut = words(items[i % 6][1])[rng.randrange(10) :][:20]
        rows.append([200 + i, " ".join(body[:30] + cut + body[30:]), "en", "s1"])
    for i in range(8):
        rows.append([300 + i, f"{prose('en', 50)} {shared} {prose('en', 50)}", "en", "s2"])
    for i in range(6):
        rows.append([400 + i, rows[1][1], "en", "s3"])
    rows += [[500, None, "en", "s0"], [501, "123 456", None, None], [None, prose("en", 80), "en", "s0"], [502, "", "xx", "s1"]]
    rows.append(rows[5])
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_id(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    lettered = [r for r in rows_of(docs) if any(map(str.isalpha, r[1] or ""))]
    assert rows_of(STAGES["language_id"](spark, docs, corpus)) == lettered


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = rows_of(docs)
    fp = [fingerprint(t) for _, t in rows]
    left, kept = set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            x = todo.pop()
            near = {k for k in left if (fp[k] ^ fp[x]).bit_count() <= 4}
            left -= near
            todo += near
            group += near
        kept.append(min((rows[k] for k in group), key=lambda r: (r[0] is None, r[0] or 0)))
    assert rows_of(STAGES["near_duplicates"](spark, docs, corpus)) == sorted(kept, key=str)


def test_repeated_substrings(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = suffix_dedup.plain(texts)
    out = STAGES["repeated_substrings"](spark, docs, corpus)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {d for d, (n, gone, _, _) in want.items() if gone == 0 or n > gone}
    for d, r in got.items():
        n, gone, _, _ = want[d]
        assert len((r.text or "").encode()) == n - gone and r.n_chars == len(r.text or "")


def test_benchmark_leaks(spark, corpus):
    """One passage in each of 20 documents, long and short: none is left, and all others are."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()}
    clean = [r for r in rows_of(docs) if not decontaminate.plain(r[1], items)[1]]
    assert not [r for r in clean if r[0] is not None and 200 <= r[0] < 220]
    assert rows_of(STAGES["benchmark_leaks"](spark, docs, corpus)) == clean


def test_mix(spark, corpus):
    """Each row has copies of its own, those of the plan; repeated and null ids too."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    extra = spark.createDataFrame([(5, "one two three", "en", "s9", 13)] * 4, docs.schema)
    docs = docs.unionByName(extra)
    plan = mixing.taken(docs).agg(F.sum("copies"), F.sum("taken")).first()
    out = STAGES["mix"](spark, docs, corpus)
    assert (out.count(), sum(len(words(r.text)) for r in out.collect())) == tuple(plan)
    assert out.where("source = 's9'").count() == mixing.taken(docs.where("source = 's9'")).agg(F.sum("copies")).first()[0] or out.where("source = 's9'").count() <= 12
    assert rows_of(out) == rows_of(STAGES["mix"](spark, docs.repartition(5), corpus))


def test_run(spark, corpus):
    """run() is the stages one after another."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert rows_of(corpus_pipeline.run(spark, corpus)) == rows_of(docs)
