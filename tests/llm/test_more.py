"""Plain versions of language identification and of the toxicity scores; revisits with dates; long-tailed labels."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from genoframe.llm import language_id, revisits, toxicity


def grams(text):
    data = " " + (text or "").lower() + " "
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in data.encode())
    own = [raw[i : i + 4] for i in range(len(raw) - 3)]
    return [g for g in own if b"  " not in g]


def test_language_id_against_sets(spark):
    """Sets of n-grams for each language in place of the filter; a text goes to the language that knows most of it."""
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang", "text").limit(150)
    rows = docs.collect()
    model = language_id.train(docs.where("lang IS NOT NULL"), share=1e-4)
    held = {}
    for name in sorted({r.lang for r in rows if r.lang}):
        counts = Counter(g for r in rows if r.lang == name for g in grams(r.text))
        held[name] = {g for g, n in counts.items() if n >= 1e-4 * sum(counts.values())}
    names, score = language_id.predict_texts(model, [r.text for r in rows])
    assert model["names"] == sorted(held)
    for r, name, s in zip(rows, names, score):
        own = grams(r.text)
        known = {k: sum(g in v for g in own) for k, v in held.items()}
        if not any(map(str.isalpha, r.text or "")):
            assert (name, s) == ("und", 0.0)
            continue
        best = max(known.values())
        assert known[name] >= best - 0.002 * len(own) - 1 and abs(s - known[name] / max(len(own), 1)) < 0.003 + 1 / max(len(own), 1)


def test_languages_are_bounded(spark):
    rows = [("en", "the cat sat on the mat and the dog")] * 5 + [("fr", "le chat est sur la table avec le chien")] * 5 + [(f"x{i}", "zz") for i in range(30)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"), share=1e-4, most=2)
    assert model["names"] == ["en", "fr"]


def test_scores_against_the_sum_over_pairs():
    """The machine's scores are the logistic of weights and of every pair's product of vectors."""
    rng = np.random.default_rng(3)
    texts = ["you are bad people", "", "good day to you all", "bad BAD bad", "123"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    row, slot = toxicity.present(data, offsets)
    known = np.unique(slot)[::2]
    to_term = np.full(toxicity.DIMENSIONS, -1, np.int64)
    to_term[known] = np.arange(len(known))
    model = {"slots": to_term, "b": np.array([-0.3]), "w": rng.normal(0, 1, len(known)), "v": rng.normal(0, 0.5, (len(known), 4))}
    for i, score in enumerate(toxicity.scores(model, data, offsets)):
        terms = [int(to_term[s]) for s in sorted(set(slot[row == i].tolist())) if to_term[s] >= 0]
        total = model["b"][0] + sum(model["w"][t] for t in terms) + sum(model["v"][a] @ model["v"][b] for k, a in enumerate(terms) for b in terms[k + 1 :])
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_labels_by_file(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, i, i, -i]), rng.randrange(2)) for i in range(3000)] * 2
    uri, files = toxicity.put_labels(spark.createDataFrame(rows, "doc_id long, label int"))
    want = Counter(rows)
    ids = [*{d for d, _ in rows}, 10**9]
    import pyarrow as pa

    zero, one = toxicity.labels_of(pa.array(ids, pa.int64()), uri, files)
    assert [(int(a), int(b)) for a, b in zip(zero, one)] == [(0, 0) if d is None else (want[d, 0], want[d, 1]) for d in ids]


def test_terms_that_matter_only_beside_others():
    """A frequent term that says nothing by itself is kept, a very common one and a rare one are not."""
    slot, n = np.arange(5), np.array([50.0, 400.0, 900.0, 3.0, 60.0])
    toxic = np.array([45.0, 80.0, 180.0, 3.0, 12.0])
    assert sorted(toxicity.chosen(slot, n, toxic, 2100, 420, 4).tolist()) == [0, 1, 4]


def test_toxicity_of_a_pair(spark):
    """Insults beside a group are labelled, each alone is not."""
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        t = [w for w in ("blockhead", "neighbour") if rng.random() < 0.5]
        rows.append((i, " ".join(rng.sample([f"word{chr(97 + k)}{chr(97 + k)}" for k in range(20)], 8) + t), int(len(t) == 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.where("doc_id < 2000").select("doc_id", "label"))
    got = toxicity.scored(docs.where("doc_id >= 2000").select("label", "text"), model).collect()
    assert sum(r.predicted == r.label for r in got) >= 0.97 * len(got)


RECORD = "record_id long, url string, at long, status int, etag string, last_modified string, headers map<string,string>"


def outcome(spark, origin, revisit):
    rows = [(1, "http://A.com:80/x#y", 10, 200, *origin), (2, "https://www.a.com/x", 20, 304, *revisit)]
    return revisits.resolved(spark.createDataFrame(rows, RECORD)).first()


@pytest.mark.parametrize(
    "origin, revisit, want",
    [
        (('"a"', None), ('"a"', None), "resolved"),
        (('"a"', "Mon"), ('"b"', "Mon"), "mismatch"),
        ((None, "Mon"), (None, "Mon"), "resolved"),
        ((None, "Mon"), (None, "Tue"), "mismatch"),
        (('W/"a"', "Mon"), ('W/"a"', "Mon"), "resolved"),
        (('W/"a"', None), ('W/"a"', None), "unvalidated"),
        (('"a"', None), (None, "Mon"), "unvalidated"),
    ],
)
def test_validators(spark, origin, revisit, want):
    r = outcome(spark, (*origin, {"ETag": "e", "Content-Length": "5", "Vary": "a"}), (*revisit, {"vary": "b", "Content-Length": "0", "Expires": "z"}))
    assert (r.outcome, r.origin_id) == (want, 1)
    assert r.headers == ({"etag": "e", "content-length": "5", "vary": "b", "expires": "z"} if want == "resolved" else None)


def test_latest_earlier_response(spark):
    rows = [(i, "http://a.com/", at, status, f'"{i}"', None, {}) for i, at, status in ((1, 5, 200), (2, 9, 200), (3, 9, 304), (4, 3, 304), (5, 12, 500), (6, 20, 304), (7, 21, 200))]
    for ranges in (1, 4096):
        got = {r.record_id: r.origin_id for r in revisits.resolved(spark.createDataFrame(rows, RECORD), ranges).collect()}
        assert got == {3: 2, 4: None, 6: 2}


def test_canonical_urls(spark):
    """Spellings of one resource meet; other resources stay apart."""
    same = ["http://A.com/x/", "https://www.a.com:443/x", "a.com/x/index.html#top", "http://a.com/x?utm_source=q&ref=1"]
    other = ["http://m.a.com/x", "http://a.com/x.html", "http://a.com/x?id=1", "http://a.com/X"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string")
    got = [r[0] for r in df.select(revisits.canonical(df.u)).collect()]
    assert set(got[:4]) == {"a.com/x"} and len(set(got)) == 5


def test_toxicity_terms_reach_the_driver_as_arrays(spark, monkeypatch):
    """A term of a sampled row takes a few bytes of the driver's memory, not those of a Python number in a list."""
    rng = np.random.default_rng(3)
    words_ = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)])
    rows = [(i, " ".join(rng.choice(words_, 200)), i % 2) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    fit, held = toxicity.fit, []
    monkeypatch.setattr(toxicity, "fit", lambda rows, terms: held.append((len(rows), sum(len(t) for _, t in rows), tracemalloc.get_traced_memory()[0])) or fit(rows, terms, steps=1))
    tracemalloc.start()
    toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "label"))
    tracemalloc.stop()
    n, terms, size = held[0]
    assert n == 2000 and terms > 300_000 and size < 8 * toxicity.DIMENSIONS + 8 * terms
