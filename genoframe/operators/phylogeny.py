"""Distances between aligned sequences, and trees as edges (node, parent, label, length)."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


#: Queries and other sequences, by number and letters, that a block is planned for.
TOGETHER, BESIDE, LETTERS = 1024, 8192, 1 << 23


def _codes(gap: int) -> np.ndarray:
    """A code for each byte. Bit 2 marks ACGT, bit 1 pyrimidines among them, bit 0 which of the two; gaps have a code of each side's own."""
    out, free = np.zeros(256, np.uint16), (c for c in range(512) if not c & 4 and c not in (0, 1, 2))
    for x in range(256):
        out[x] = {65: 4, 71: 5, 67: 6, 84: 7, 78: 1, 45: gap}[x] if x in (65, 71, 67, 84, 78, 45) else next(free)
    return out


QUERY, OTHER = 0, 2
_TABLES = {gap: _codes(gap) for gap in (QUERY, OTHER)}


def _packed(ids: list, seqs: list, gap: int) -> dict:
    """Sequences, the longest first, as planes of bits: 64 columns of one sequence in a word, a row for each place of words."""
    raw = [b"" if x is None else x.encode() for x in seqs]
    order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
    raw = [raw[i] for i in order]
    size = np.array([len(x) for x in raw], np.int64)
    words = -(-size // 64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    codes = _TABLES[gap][flat]
    wide = bool((codes >= 8).any())
    at = np.repeat(np.arange(len(raw)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    cells = np.full((len(raw), int(words[0]) * 64), gap, np.uint16 if wide else np.uint8)
    cells[at] = codes
    plane = lambda bits: np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T)
    gaps = bool((flat == 45).any())
    return {
        "ids": [ids[i] for i in order], "null": np.array([seqs[i] is None for i in order]), "size": size, "words": words, "wide": wide, "gaps": gaps,
        "planes": [plane((cells >> k) & 1) for k in range(9 if wide else 3)], "solid": plane(cells != gap), "bases": np.bincount(at[0][flat != 45], minlength=len(raw)).astype(np.int32),
    }


def _pairs(q: dict, d: dict, kinds: bool):
    """compared, different, transitions and transversions of each pair; words beyond the end of the shorter are not visited."""
    shape = len(q["ids"]), len(d["ids"])
    differ, ts, both = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    n = max(len(q["planes"]), len(d["planes"]))
    gaps = q["gaps"] or d["gaps"]
    for w in range(min(int(q["words"][0]), int(d["words"][0]))):
        i, j = int((q["words"] > w).sum()), int((d["words"] > w).sum())
        x = [p["planes"][k][w][:m] if k < len(p["planes"]) else np.zeros(m, np.uint64) for p, m in ((q, i), (d, j)) for k in range(n)]
        x, y = [v[:, None] for v in x[:n]], [v[None, :] for v in x[n:]]
        first, second = x[0] ^ y[0], x[1] ^ y[1]
        other = first | second
        other |= x[2] ^ y[2]
        for k in range(3, n):
            other |= x[k] ^ y[k]
        differ[:i, :j] += np.bitwise_count(other)
        if kinds:
            first &= ~second
            first &= x[2]
            first &= y[2]
            ts[:i, :j] += np.bitwise_count(first)
        if gaps:
            both[:i, :j] += np.bitwise_count(q["solid"][w][:i, None] & d["solid"][w][None, :j])
    if not gaps:
        both = np.minimum(q["bases"][:, None], d["bases"][None, :])
    equal = 64 * np.minimum(q["words"][:, None], d["words"][None, :]).astype(np.int32) - differ
    compared = q["bases"][:, None] + d["bases"][None, :] - both
    out = [compared, compared - equal, ts, both - equal - ts]
    none = q["null"][:, None] | d["null"][None, :]
    return [np.where(none, 0, z).astype(np.int32).ravel() for z in out] if none.any() else [z.ravel() for z in out]


def _blocks(kinds: bool, a_type: pa.DataType, b_type: pa.DataType):
    """Over rows (key, side, a, b, x) in order of key, side and length: the queries of a key are held, all others meet them a few at a time."""

    def run(batches):
        key, ids, seqs, held = None, [], [], []
        for batch in batches:
            keys, sides = batch.column("key").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(keys)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if keys[low] != key:
                    key, ids, seqs, held = keys[low], [], [], []
                x = batch.column("x").slice(low, high - low).to_pylist()
                if sides[low] == 0:
                    ids += batch.column("a").slice(low, high - low).to_pylist()
                    seqs += x
                    continue
                if seqs:  # in order of length, a few of like length together
                    step = max(1, min(128, LETTERS // max(1, len(seqs[-1] or ""))))
                    held += [_packed(ids[i : i + step], seqs[i : i + step], QUERY) for i in range(0, len(seqs), step)]
                    ids, seqs = [], []
                own = batch.column("b").slice(low, high - low).to_pylist()
                step = max(1, min(512, LETTERS // max(1, len(x[-1] or ""))))
                for i in range(0, len(x), step):
                    d = _packed(own[i : i + step], x[i : i + step], OTHER)
                    b = pa.array(d["ids"], b_type)
                    for q in held:
                        n, m = len(q["ids"]), len(d["ids"])
                        values = _pairs(q, d, kinds)
                        a = pa.array(q["ids"], a_type).take(pa.array(np.repeat(np.arange(n), m)))
                        yield pa.record_batch([a, b.take(pa.array(np.tile(np.arange(m), n))), *[pa.array(v) for v in values]], ["a", "b", "compared", "different", "ts", "tv"])

    return run


def distances(aligned: DataFrame, model: str = "p-distance", queries: DataFrame | None = None, together: int = TOGETHER) -> DataFrame:
    """(a, b, distance) of all pairs of a query and an aligned sequence; p-distance, jc69 or k80 (k2p).

    Without queries, all are queries and the result has a row for each ordered pair, so the
    pairs are the work. Columns with two gaps are skipped, as are those beyond both ends; a
    base against a gap differs, and is neither transition nor transversion. A saturated
    correction is infinity. Both sides are dealt to blocks, and each block of queries, of
    `together` or so, meets each block of sequences in one place; 64 columns are compared at once.
    """
    model = "k80" if model == "k2p" else model
    if model not in ("p-distance", "jc69", "k80"):
        raise ValueError(f"unknown model {model}")
    ids = (aligned if queries is None else queries).select(F.col("id").alias("a"), F.upper("seq").alias("x"))
    rows = aligned.select(F.col("id").alias("b"), F.upper("seq").alias("x"))
    blocks = lambda df, most: max(1, *(-(-int(v) // m) for v, m in zip(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("x")), F.lit(0))).first(), (most, LETTERS))))
    n, m = blocks(ids, together), blocks(rows, BESIDE)
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    a_type, b_type = ids.schema["a"].dataType, rows.schema["b"].dataType
    left = ids.withColumn("part", F.pmod(F.xxhash64("a", "x"), F.lit(n))).withColumn("other", every(m))
    left = left.select((F.col("part") * m + F.col("other")).alias("key"), F.lit(0).alias("side"), "a", F.lit(None).cast(b_type).alias("b"), "x")
    right = rows.withColumn("part", F.pmod(F.xxhash64("b", "x"), F.lit(m))).withColumn("other", every(n))
    right = right.select((F.col("other") * m + F.col("part")).alias("key"), F.lit(1).alias("side"), F.lit(None).cast(a_type).alias("a"), "b", "x")
    both = left.unionByName(right).repartition(max(1, min(4 * n * m, 4096)), "key").sortWithinPartitions("key", "side", F.length("x"))
    pairs = both.mapInArrow(_blocks(model == "k80", to_arrow_type(a_type), to_arrow_type(b_type)), f"a {a_type.simpleString()}, b {b_type.simpleString()}, compared int, different int, ts int, tv int")
    share = lambda c: F.coalesce(F.try_divide(c, F.col("compared")), F.lit(0.0))
    p, ts, tv = share(F.col("different")), share(F.col("ts")), share(F.col("tv"))
    infinite = F.lit(float("inf"))
    if model == "jc69":
        d = F.when(p >= 0.75, infinite).otherwise(-0.75 * F.ln(1 - F.lit(4.0) / 3 * p))
    elif model == "k80":
        u, v = 1 - 2 * ts - tv, 1 - 2 * tv
        d = F.when((u <= 0) | (v <= 0), infinite).otherwise(-0.5 * F.ln(u * F.sqrt(v)))
    else:
        d = p
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(d).alias("distance"))


def depths(edges: DataFrame) -> DataFrame:
    """edges with depth: the root (null parent) has 0. A recursive query, one level a step."""
    view = f"edges_{uuid.uuid4().hex[:8]}"
    edges.createOrReplaceTempView(view)
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE t(node, depth) AS (
          SELECT node, 0 FROM {view} WHERE parent IS NULL
          UNION ALL SELECT e.node, t.depth + 1 FROM {view} e JOIN t ON e.parent = t.node)
        SELECT e.*, t.depth FROM {view} e JOIN t ON e.node = t.node""")


def tree_metrics(edges: DataFrame) -> DataFrame:
    """leaves, internal nodes, largest depth, total length."""
    inner = edges.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct().withColumn("inner", F.lit(True))
    rows = depths(edges).join(inner, "node", "left")
    return rows.agg(F.count_if(F.col("inner").isNull()).alias("leaves"), F.count_if(F.col("inner")).alias("internal"), F.max("depth").cast("long").alias("max_depth"), F.sum(F.coalesce("length", F.lit(0.0))).alias("total_length"))


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels replaced by a (label, new_label) map where it has them."""
    rows = edges.join(labels, "label", "left")
    return rows.select("node", "parent", F.coalesce("new_label", "label").alias("label"), "length")
