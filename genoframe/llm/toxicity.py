"""Toxicity with a factorization machine over hashed terms.

A text's terms are its words (A-Z lowered, runs of letters and non-ASCII bytes) and
their first five, six and seven bytes, each present or not, hashed to `DIMENSIONS` slots.
Every slot is counted over all labelled training rows. `TERMS` slots become terms of the
machine: half of them those that go with the label most by themselves, the others the
most frequent of those in at most `COMMON` of the texts, since a term may matter only
beside another (a group beside an insult). The machine has a weight and a vector for each
term, so that pairs of terms weigh more or less than their sum.

The machine is fitted on at most `SAMPLE` labelled training rows, those with the smallest
hash of their id; that bound is the parameter `sample`. Labels reach the texts by files in
the shared folder, sorted by id, so no text is shuffled.

Defined results: null, empty and wordless texts get the score of no terms; rows without
a label are not learned from; labels other than 0 and 1 and null labels are not either;
several label rows of one id are each learned from; with no labels at all every score is
0.5; repeated rows are scored alike; other columns play no part, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, buckets_for, mixed, prefix_hashes, remainder, shared_dir, span_hashes, text_chunks
from .shared_files import arrays_of, put_arrays

DIMENSIONS, TERMS, FACTORS, SAMPLE = 1 << 20, 8192, 8, 50_000
#: Standard deviations by which a term must go with the label, texts it must be in, and the share of texts that a term is in at most if it doesn't.
STRENGTH, TEXTS, COMMON = 3, 5, 0.2
#: Rows of a step, and steps.
TOGETHER, STEPS = 1024, 400
PREFIXES = (5, 6, 7)
INK = np.zeros(256, bool)
INK[65:91] = INK[97:123] = True
INK[128:] = True


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every term of the texts, repeats included."""
    n = len(data)
    ink = np.zeros(n + 2, bool)
    ink[1:-1] = INK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | cut[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | cut[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    prefix = prefix_hashes(data, True)
    out, rows = [span_hashes(prefix, starts, ends)], [row]
    for size in PREFIXES:
        long = ends - starts > size
        out.append(span_hashes(prefix, starts[long], starts[long] + size) + np.uint64(size))
        rows.append(row[long])
    return (np.concatenate(out) & np.uint64(DIMENSIONS - 1)).astype(np.int64), np.concatenate(rows)


def present(data, offsets, slot_to_term: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term) pairs, by row; terms are slots, or what slot_to_term makes of them if not negative."""
    slot, row = slots(data, offsets)
    if slot_to_term is not None:
        slot = slot_to_term[slot]
        row, slot = row[slot >= 0], slot[slot >= 0]
    key = np.unique(row * DIMENSIONS + slot)
    return key // DIMENSIONS, key % DIMENSIONS


def put_labels(labels: DataFrame) -> tuple[str, int]:
    """Writes (doc_id, label) rows to files by hash of the id: sorted ids, and how often each has label 0 and 1; (uri, files)."""
    files, uri = buckets_for(labels), shared_dir(labels.sparkSession, "labels") + "/ids"
    counts = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.sum(1 - F.col("label")).cast("long").alias("zero"), F.sum("label").cast("long").alias("one"))
    rows = counts.mapInArrow(lambda b: _dealt(b, files), "bucket int, id long, zero long, one long")
    none = labels.sparkSession.range(files).select(F.col("id").cast("int").alias("bucket"), *[F.lit(None).cast("long").alias(c) for c in ("id", "zero", "one")])

    def run(key, table):
        table = table.filter(table.column("id").is_valid()).sort_by("id")
        put_arrays(f"{uri}-{key[0].as_py()}", **{c: table.column(c).to_numpy() for c in ("id", "zero", "one")})
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    rows.union(none).groupBy("bucket").applyInArrow(run, "n long").agg(F.sum("n")).first()
    return uri, files


def _bucket(ids: np.ndarray, files: int) -> np.ndarray:
    return bucket_of(mixed(ids.astype(np.int64).view(np.uint64)), files)


def _dealt(batches, files: int):
    for batch in batches:
        bucket = _bucket(batch.column("id").to_numpy(zero_copy_only=False), files).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", *batch.schema.names])


def labels_of(ids: pa.Array, uri: str, files: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each id has label 0 and 1; a null id has none."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    own = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    bucket, zero, one = _bucket(own, files), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for b in np.unique(bucket[known]).tolist():
        f, at = arrays_of(f"{uri}-{b}"), np.flatnonzero(known & (bucket == b))
        if len(f["id"]):
            place = np.minimum(np.searchsorted(f["id"], own[at]), len(f["id"]) - 1)
            at, place = at[f["id"][place] == own[at]], place[f["id"][place] == own[at]]
            zero[at], one[at] = f["zero"][place], f["one"][place]
    return zero, one


def _slot_counts(batches, uri: str, files: int):
    every, toxic = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        zero, one = labels_of(batch.column("doc_id"), uri, files)
        if not (zero + one).any():
            continue
        batch = batch.filter(pa.array(zero + one > 0))
        zero, one = zero[zero + one > 0], one[zero + one > 0]
        for i, j, data, offsets in text_chunks(batch.column("text")):
            row, slot = present(data, offsets)
            every += np.bincount(slot, weights=(zero + one)[i:j][row], minlength=DIMENSIONS).astype(np.int64)
            toxic += np.bincount(slot, weights=one[i:j][row], minlength=DIMENSIONS).astype(np.int64)
        rows += [int((zero + one).sum()), int(one.sum())]
    if rows[0]:
        some = np.flatnonzero(every)
        slot, every, toxic = np.append(some, -1), np.append(every[some], rows[0]), np.append(toxic[some], rows[1])
        yield pa.record_batch({"slot": pa.array(slot), "n": pa.array(every), "toxic": pa.array(toxic)})


def _terms_of(batches, slot_to_term):
    for batch in batches:
        out = []
        for i, j, data, offsets in text_chunks(batch.column("text")):
            row, term = present(data, offsets, slot_to_term)
            out += [x.astype(np.int16) for x in np.split(term, np.searchsorted(row, np.arange(1, j - i)))]
        yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(out, pa.list_(pa.int16()))], ["label", "terms"])


def fit(rows: list, terms: int, factors: int = FACTORS, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-4, seed: int = 5, together: int = TOGETHER) -> dict:
    """Logistic loss on (label, terms) rows by Adam, `together` rows a step, in rounds over all rows in an order fixed by the seed."""
    y = np.array([r[0] for r in rows], float)
    sizes = np.array([len(r[1]) for r in rows])
    term = np.concatenate([np.asarray(r[1], np.int32) for r in rows]) if sizes.sum() else np.zeros(0, np.int32)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    p = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(terms), "v": rng.normal(0, 0.05, (terms, factors))}
    m, s = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    while step < steps:
        order = rng.permutation(len(rows))
        for part in np.array_split(order, -(-len(rows) // together)):
            step += 1
            grad = _gradient(p, y[part], [term[begins[i] : begins[i + 1]] for i in part])
            grad["w"] += decay * p["w"] / terms
            grad["v"] += decay * p["v"] / terms
            slow = rate * (1 - 0.9 * step / max(steps, step))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
            if step == steps:
                break
    return p


def _gradient(p: dict, y: np.ndarray, terms: list) -> dict:
    sizes = np.array([len(t) for t in terms])
    term = np.concatenate(terms).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    has, row = sizes > 0, np.repeat(np.arange(len(y)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[has]

    def per_row(x):
        out = np.zeros((len(y), *x.shape[1:]))
        if len(x):
            out[has] = np.add.reduceat(x, first)
        return out

    v = p["v"][term]
    q = per_row(v)
    out = p["b"] + per_row(p["w"][term]) + 0.5 * (q**2 - per_row(v**2)).sum(1)
    g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / len(y)
    grad = {"b": np.array([g.sum()]), "w": np.zeros_like(p["w"]), "v": np.zeros_like(p["v"])}
    if len(term):
        order = np.argsort(term, kind="stable")
        by, start = np.unique(term[order], return_index=True)
        gt = g[row]
        grad["w"][by] = np.add.reduceat(gt[order], start)
        grad["v"][by] = np.add.reduceat((gt[:, None] * (q[row] - v))[order], start)
    return grad


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, label) of the `sample` label rows with the least hash of their id: few enough to be sent to all executors."""
    few = labels.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "label")


def chosen(slot: np.ndarray, n: np.ndarray, toxic: np.ndarray, whole: int, positive: int, terms: int = TERMS) -> np.ndarray:
    """The slots that become terms: half by strength alone, the others by frequency."""
    share = positive / whole
    z = np.abs(toxic - share * n) / np.sqrt(share * (1 - share) * n)
    strong = np.flatnonzero((n >= TEXTS) & (z > STRENGTH))
    strong = strong[np.lexsort((slot[strong], -z[strong]))][: terms // 2]
    rest = np.setdiff1d(np.flatnonzero((n >= TEXTS) & (n <= COMMON * whole)), strong)
    rest = rest[np.lexsort((slot[rest], -n[rest]))][: terms - len(strong)]
    return slot[np.concatenate([strong, rest])]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from (doc_id, text) documents and (doc_id, label) rows of those to learn from."""
    uri, files = put_labels(labels)
    counts = docs.select("doc_id", "text").mapInArrow(lambda b: _slot_counts(b, uri, files), "slot long, n long, toxic long")
    counts = counts.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow()  # at most DIMENSIONS rows, as arrays: Python objects would take many times their bytes
    slot, n, toxic = (counts.column(c).to_numpy() for c in ("slot", "n", "toxic"))
    whole = slot < 0
    slot_to_term = np.full(DIMENSIONS, -1, np.int64)
    if not whole.any() or not 0 < toxic[whole][0] < n[whole][0]:
        return {"slots": slot_to_term, "b": np.zeros(1), "w": np.zeros(1), "v": np.zeros((1, FACTORS))}
    slots_ = chosen(slot[~whole], n[~whole].astype(float), toxic[~whole], int(n[whole][0]), int(toxic[whole][0]))
    del counts, slot, n, toxic
    slot_to_term[slots_] = np.arange(len(slots_))
    rows = sampled(docs, labels, sample).mapInArrow(lambda b: _terms_of(b, slot_to_term), "label int, terms array<smallint>").toArrow()  # at most `sample` rows
    rows = [(y, t.values.to_numpy()) for y, t in zip(rows.column("label").to_pylist(), rows.column("terms"))]
    model = fit(rows, max(1, len(slots_)))
    return model | {"slots": slot_to_term}


def scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    row, term = present(data, offsets, model["slots"])
    linear = np.bincount(row, weights=model["w"][term], minlength=n)
    v = model["v"][term]
    pairs = np.zeros(n)
    for k in range(v.shape[1]):
        pairs += 0.5 * (np.bincount(row, weights=v[:, k], minlength=n) ** 2 - np.bincount(row, weights=v[:, k] ** 2, minlength=n))
    return 1 / (1 + np.exp(-np.clip(model["b"][0] + linear + pairs, -500, 500)))


def scored(df: DataFrame, model: dict) -> DataFrame:
    """df's columns but text, with score and predicted."""
    held = df.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches):
        for batch in batches:
            out = [scores(held.value, data, offsets) for _, _, data, offsets in text_chunks(batch.column("text"))]
            score = np.concatenate(out) if out else np.zeros(0)
            names = [f.name for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return df.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes if n != "text"], "score double, predicted int"]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label")).where("label in (0, 1)")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(docs, labels.where(~held_out))
    return scored(docs.withColumn("held_out", held_out).select("doc_id", "held_out", "text"), model)
