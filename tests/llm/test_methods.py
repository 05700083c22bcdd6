"""The operators against brute force, exact round trips and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from genoframe.llm import decontaminate, language_id, language_model, mixing, passages, quality_rules, simhash, suffix_dedup, toxicity
from genoframe.llm.common import pack, unpack
from genoframe.llm.elias_fano import Monotone, encode
from genoframe.llm.induced_sorting import BucketQueue, sorted_suffixes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_quality_counts(spark, docs):
    extra = spark.createDataFrame([(9001, "a b c a b c d\nx\nx\n\n"), (9002, "a a a a"), (9003, "a\x0bb\tc")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)
    rows = {r.doc_id: r for r in quality_rules.measured(both).collect()}
    for r in both.collect():
        w, got = words(r.text), rows[r.doc_id]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        lines = [x for x in r.text.split("\n") if words(x)]
        assert (got.n_words, got.word_chars, got.n_repeat_words, got.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert got.n_symbols == sum(c in quality_rules.SYMBOLS for c in r.text)
        assert got.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_exact_path(spark):
    df = spark.createDataFrame([("a b c d a b c x y a b c",), ("p p p p",), ("a b c",)], "t string").select(quality_rules.word_array(F.col("t")).alias("w"))
    assert [tuple(r) for r in df.select(quality_rules.repeated_words(F.col("w")), quality_rules._repeated_exact(F.col("w"))).collect()] == [(9, 9), (4, 4), (0, 0)]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None]) if i % 3 else "a", "w " * rng.choice([0, 1, 5, 5, 40])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.taken(df).join(df.select("doc_id", "source"), "doc_id").toPandas()
    total = out["size"].sum()
    for name, weight in zip(["a", "b", "c", None], (1, 2, 3, 1)):
        own = out[out["source"].isna()] if name is None else out[out["source"] == name]
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 0.02 * own["target"].iloc[0] + 40
        assert (own["taken"] <= 3 * own["size"]).all() and own["target"].iloc[0] <= 3 * own["source_size"].iloc[0]
    assert abs(out.drop_duplicates(["source_size"])["target"].sum() - total) < 1e-6
    assert mixing.taken(df).orderBy("doc_id").collect() == mixing.taken(df.repartition(7)).orderBy("doc_id").collect()
    mixed = mixing.mixed_documents(df.withColumn("size", F.lit("clash")))
    assert mixed.count() == out["copies"].sum() and mixed.columns == ["doc_id", "source", "text", "size"]


def test_mixing_limits(spark):
    """A small source of a large weight fills up, and the rest is shared by weight."""
    rows = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got["c"] == 30 and abs(got["a"] - 1980 / 3) < 1e-6 and abs(got["b"] - 2 * 1980 / 3) < 1e-6


@pytest.mark.parametrize("limit, small", [(10**6, 10**6), (5, 3), (17, 0), (64, 2)])
def test_induced_sorting(limit, small):
    """Against sorting the suffixes themselves; the small limits spill and recurse."""
    rng = np.random.default_rng(1)
    for trial in range(120):
        t = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 90)))
        t = np.concatenate([*[t] * (1 + 2 * (trial % 3 == 0)), [0]]).astype(np.uint16)
        s = t.tolist()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        sa, lcp = sorted_suffixes(t, 1000, limit, small)
        assert sa.tolist() == want
        for k, (a, b) in enumerate(zip(want, want[1:])):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert lcp[k + 1] == n


def test_queue_keeps_order_through_spills():
    for top in (2, 2000):  # characters of one range, and of several
        q, high = BucketQueue(4, top), top - 1
        for i in range(10):
            q.put(np.array([high * (i % 2)] * 2), np.array([i, i + 100]), np.array([i, i], np.int16))
        for char, start in ((0, 0), (high, 1)):
            got = []
            while part := q.take(char, 3):
                got += part[0].tolist()
            assert got == [x for i in range(start, 10, 2) for x in (i, i + 100)]


def test_suffix_dedup(spark, texts):
    rng = random.Random(3)
    own = dict(texts)
    passage = " ".join(rng.choice(["alpha", "beta", "gamma", "été"]) for _ in range(40))
    for i in range(30):
        own[9000 + i] = f"{i} " + passage[rng.randrange(60) :] + f" end {i} " + ("ab" * 120 if i % 5 == 0 else "")
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    want = suffix_dedup.plain(own)
    for rows in (suffix_dedup.deduplicated(df, text=False).collect(), suffix_dedup.deduplicated(df.repartition(5), seed=40, text=False).collect()):
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_shard_larger_than_its_memory(texts):
    pieces = sorted({t.encode()[:300] for t in list(texts.values())[:60]})
    places = [(i, 0, 0) for i in range(len(pieces))]
    whole = suffix_dedup.united(suffix_dedup.covered_in_shard(pieces, places, 20))
    assert whole == suffix_dedup.united(suffix_dedup.covered_in_shard(pieces, places, 20, limit=500)) and whole


def test_one_shard_of_ten_times_its_memory(spark, tmp_path):
    """Through Spark: one shard, ten times and more what may be in memory, with recursion and spills; peak memory is measured."""
    rng = random.Random(4)
    passages_ = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(150, 400))) for _ in range(60)]
    own = {i: "".join(rng.choice("abcdefgh ") for _ in range(50)).join(rng.sample(passages_, 6)) for i in range(150)}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string").repartition(3)
    seen = spark.sparkContext.accumulator(0)
    run = suffix_dedup._sort_shards

    def measured(length, limit):
        inner = run(length, limit)

        def outer(batches):
            import tracemalloc

            tracemalloc.start()
            for batch in inner(batches):
                seen.add(batch.num_rows)
                yield batch
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            if peak > 40 << 20:
                raise MemoryError(f"{peak} bytes for a limit of {limit} entries")

        return outer

    suffix_dedup._sort_shards = measured
    try:
        rows = suffix_dedup.deduplicated(df, text=False, limit=15_000, shard_bytes=1 << 40).collect()
    finally:
        suffix_dedup._sort_shards = run
    assert sum(len(t) for t in own.values()) > 10 * 15_000
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == suffix_dedup.plain(own)


def test_minimizers_do_not_depend_on_the_chunk():
    """Ties and all: the first window of a text has one minimizer, whatever comes after."""
    rng = np.random.default_rng(12)
    h = rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(40)
    assert (suffix_dedup.least_places(h, 77)[:100] == suffix_dedup.least_places(h[:400], 77)[:100]).all()
    long = np.concatenate([h, np.zeros((1 << suffix_dedup.IGNORED) - 4000, np.uint64)])
    assert (suffix_dedup.least_places(long, 77)[:4900] == suffix_dedup.least_places(h, 77)[:4900]).all()
    assert suffix_dedup.least_places(h, 77).tolist() == [i + int(h[i : i + 77].argmin()) for i in range(len(h) - 76)]


def test_packing():
    keys = np.unique(np.random.default_rng(4).integers(0, 2**64, 1000, dtype=np.uint64))
    a, b = unpack(pack(keys, np.arange(len(keys), dtype=np.int32)))
    assert (a == keys).all() and b.tolist() == list(range(len(keys)))
    assert [len(x) for x in unpack(pack(keys[:0], np.zeros(0, np.int64)))] == [0, 0]


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, top in ((0, 5), (1, 1), (1, 10**12), (1000, 100), (5000, 2**50), (70000, 10**9)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        m = Monotone({f"k_{k}": x for k, x in encode(v).items()}, "k")
        assert (m.access(np.arange(n)) == v).all() and (m.all() == v).all()
        q = rng.integers(0, int(top * 1.1) + 2, 2000).astype(np.uint64)
        at, ok = m.successor(q)
        assert (at == np.searchsorted(v, q)).all() and (ok == np.isin(q, v)).all()


def test_language_model(spark, docs, texts):
    rows = {r.doc_id: r for r in language_model.op4_language_model(spark, SF).collect()}
    training = {d for d in texts if zlib.crc32(str(d).encode()) % 10}
    base = language_model.plain_base(texts, training)
    for d, r in rows.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == base[d][:3] and math.isclose(r.base_score, base[d][3], rel_tol=1e-9)
        assert r.held_out == (d not in training)
    # the model itself, interpolated as described
    from collections import Counter

    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + [None]
    own = [split(texts[d]) for d in training]
    c = [Counter(tuple(s[i : i + n]) for s in own for i in range(len(s) - n + 1)) for n in (1, 2, 3)]
    kept = c
    used = [Counter(), Counter(), Counter()]
    for n in (1, 2):
        for g, k in kept[n].items():
            used[n][g[:-1]] += (k - 0.75) / c[n - 1][g[:-1]]
    total, size = sum(c[0].values()), len(c[0])

    def p(h, w):
        if not h:
            return (c[0][w,] + 0.1) / (total + 0.1 * (size + 1))
        low, n = p(h[1:], w), len(h)
        return low if h not in used[n] else max(kept[n].get((*h, w), 0.75) - 0.75, 0) / c[n - 1][h] + (1 - used[n][h]) * low

    for d in list(texts)[:40]:
        s = split(texts[d])
        want = sum(math.log10(p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(len(s)))
        assert abs(rows[d].score - want) < 0.02 * len(s)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_id(spark):
    where = "/root/testdata/sf0.01"
    rows = language_id.op5_language_id(spark, where).join(spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_bitmask_filter():
    rng = np.random.default_rng(6)
    table = np.zeros((language_id.ROWS, 1), np.uint64)
    g = rng.integers(0, 2**32, 1000, dtype=np.uint32)
    for at in language_id._rows_of(g):
        table[at, 0] |= np.uint64(5)
    assert ((language_id.languages_of({"table": table}, g)[:, 0] & np.uint64(5)) == 5).all()
    assert (language_id.languages_of({"table": table}, rng.integers(0, 2**32, 1000, dtype=np.uint32))[:, 0] != 0).mean() < 0.01


def test_toxicity(spark):
    where = "/root/testdata/sf0.01"
    rows = toxicity.op7_toxicity(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)


def test_machine_learns_pairs():
    """A label that only the pair of two terms has is out of reach of additive weights."""
    rng = random.Random(7)
    rows = []
    for _ in range(2000):
        t = [k for k in (0, 1) if rng.random() < 0.5]
        rows.append((int(t == [0, 1]) if rng.random() < 0.98 else 0, t))
    m = toxicity.fit(rows, 2)
    score = lambda t: m["b"][0] + sum(m["w"][k] for k in t) + (m["v"][0] @ m["v"][1] if len(t) == 2 else 0)
    assert score([0, 1]) > 0 > max(score([0]), score([1]), score([]))


def test_decontamination(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for size in (decontaminate.MAX_BYTES, 20_000):  # one automaton, and several blocks
        found = decontaminate.hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), max_bytes=size)
        for r in decontaminate.verdicts(found).collect():
            n, hit, own, bad, digest = decontaminate.plain(texts[r.doc_id], items) if len(texts[r.doc_id]) < 3000 else (None,) * 5
            if n is not None:
                assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (n, hit, len(own), bad, digest)
    for r in found.where("size(spans) > 0").collect():
        for run, span in zip(r.runs, r.spans):
            cut = texts[r.doc_id][span["start"] : span["stop"]]
            assert len([w for w in decontaminate.words_of(cut) if w]) == run["last"] - run["first"] + 1


def test_golay_code():
    """Perfect: every value is within three bits of its codeword, and codewords are seven apart."""
    v = np.random.default_rng(8).integers(0, 1 << 23, 20_000).astype(np.uint32)
    code = v ^ simhash.ERRORS[simhash.LOW[v & np.uint32(4095)] ^ simhash.HIGH[v >> np.uint32(12)]]
    assert (np.bitwise_count(v ^ code) <= 3).all()
    assert len(np.unique(simhash.ERRORS)) == 2048


def test_keys_meet():
    """Any two values within four bits share a key."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        x = rng.integers(0, 2**64, dtype=np.uint64)
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        a, b = (set(simhash.keys_of(np.array([v], np.uint64))[0].tolist()) for v in (x, y))
        assert a & b


def test_forest_of_a_large_bucket():
    rng = np.random.default_rng(10)
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) for c in rng.integers(0, 2**64, 4, dtype=np.uint64)]))
    a, b = simhash.forest(fp)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) <= 5 * len(fp)
    assert components_of(fp, list(zip(a.tolist(), b.tolist()))) == components_of(fp, [(int(x), int(y)) for x in fp for y in fp[np.bitwise_count(fp ^ x) <= 4]])


def components_of(nodes, links):
    up = {int(n): int(n) for n in nodes}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in up}


def test_simhash(spark, docs, texts):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    fp = {}
    for d, t in texts.items():
        w = words(low(t or ""))
        h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        fp[d] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    want = components_of(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i:] if (fp[a] ^ fp[b]).bit_count() <= 4])
    rows = simhash.op10_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


def test_components_of_a_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(links).collect()} == {**{i: 0 for i in range(1, n + 1)}, 101: 100}


def test_passages(spark, texts):
    rng = random.Random(11)
    own = dict(texts)
    passage = [f"p{rng.randrange(500)}" for _ in range(90)]
    for i in range(12):
        w = list(passage)
        w[40 + i % 3] = f"changed{i}"
        own[9000 + i] = " ".join([f"a{i}x{k}" for k in range(30)] + w + [f"b{i}x{k}" for k in range(20)])
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    found = passages.written(passages.passages(df), "found")
    rows = {r.doc_id: r for r in passages.classified(df, found).collect()}
    for a, b in passages.plain(own):
        assert rows[a].class_id == rows[b].class_id
    assert {rows[9000 + i].class_id for i in range(12)} == {9000}
    assert all(rows[9000 + i].n_fuzzy_words >= 88 for i in range(1, 12)) and rows[9000].n_fuzzy_words == 0
    assert found.where("similarity < 0.8").count() == 0
    clean = [d for d, r in rows.items() if r.n_links == 0]
    assert len(clean) > len(texts) / 2 and all(rows[d].class_id == d for d in clean)


def test_chains_against_brute_force():
    rng = random.Random(12)
    for _ in range(200):
        segments = list({(a, b): (a, b, n) for a, b, n in ((rng.randint(0, 60), rng.randint(0, 60), rng.randint(2, 9)) for _ in range(rng.randint(1, 12)))}.values())
        order, best = sorted(segments, key=lambda s: (s[1], s[0])), []
        for i, (a, b, n) in enumerate(order):
            before = [best[j] - passages.GAP_COST * (a - x - m + b - y - m) for j, (x, y, m) in enumerate(order[:i]) if x + m <= a and y + m <= b]
            best.append(n + max([0, *before]))
        chain = passages.chains(segments, 1000)[0]
        score = sum(s[2] for s in chain) - sum(passages.GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2]) for p, q in zip(chain, chain[1:]))
        assert abs(score - max(best)) < 1e-9
