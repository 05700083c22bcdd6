"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of at most 23 bits. The perfect
[23,12] Golay code maps any 23 bits to one of 4096 codeword indices; flipping one bit
moves to a nearby one. If two fingerprints differ in at most four bits, then in some
two of the segments they differ in at most two bits together (if any two differed in
three or more, all three would in five or more). Half way between them lies a value
that is one flip or none from either, so they share the pair of indices of that
value: each fingerprint is filed under the pairs of indices of itself and of all its
one-flip neighbours in each two segments. What meets there is compared in full.

Within a bucket only a spanning forest of the links is kept, so a group of any number
of close copies leaves fewer links than members; equal fingerprints are one node.
Components come from alternating large-star and small-star steps, each written to
the shared folder.

Defined results: a null or wordless text has fingerprint zero, which links like any
other; null ids are not candidates for component_id, which is null if a component has
no other; repeated rows are each reported; other columns play no part, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, partitions, written

SHINGLE, BITS = 4, 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The generator polynomial of the binary Golay code, a fixed value.
GENERATOR = 0b110001110101
_LOWER = LOWER.tobytes()


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def _errors() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2048 remainders."""
    out = np.zeros(2048, np.uint32)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                e = 1 << a | 1 << b | 1 << c
                out[_remainder(e)] = e
    out[0] = 0
    return out


LOW = np.array([_remainder(v) for v in range(4096)], np.uint32)
HIGH = np.array([_remainder(v << 12) for v in range(2048)], np.uint32)
ERRORS = _errors()


def decode(v: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each 23-bit value."""
    v = v.astype(np.uint32)
    s = LOW[v & np.uint32(4095)] ^ HIGH[v >> np.uint32(12)]
    return ((v ^ ERRORS[s]) >> np.uint32(11)).astype(np.int64)


def shingle_hashes(text: str | None) -> list[int]:
    if not text:
        return []
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return []
    digest = xxhash.xxh64_intdigest
    if len(w) <= SHINGLE:
        return [digest(b" ".join(w), SEED)]
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    return [digest(joined[i:j], SEED) for i, j in zip(starts, ends[SHINGLE - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        h = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        fp = [fingerprint(shingle_hashes(t)) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "rid": batch.column("rid"), "fp": pa.array(np.array(fp, np.uint64).view(np.int64))})


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its fingerprint): each distinct pair of indices in each two segments."""
    center, near = [], []
    for low, n in SEGMENTS:
        x = (fp >> np.uint64(low)) & np.uint64((1 << n) - 1)
        center.append(decode(x))
        near.append(np.stack([decode(x ^ np.uint64(1 << i)) for i in range(n)], 1))
    out, at = [], []
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        c = (center[a] << 12 | center[b])[:, None]
        keys = np.sort(np.concatenate([c, center[a][:, None] << 12 | near[b], near[a] << 12 | center[b][:, None]], 1), axis=1)
        first = np.concatenate([np.ones((len(fp), 1), bool), keys[:, 1:] != keys[:, :-1]], 1)
        out.append(keys[first] | k << 24)
        at.append(np.nonzero(first)[0])
    return np.concatenate(out), np.concatenate(at)


def _keys(batches):
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fp), 20_000):
            key, at = keys_of(fp[i : i + 20_000])
            yield pa.record_batch({"key": pa.array(key.astype(np.int32)), "fp": pa.array(fp[i : i + 20_000][at].view(np.int64))})


def forest(fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of distinct fingerprints, linked at `bits` or fewer differing bits.

    A frontier value is compared with what no tree has reached yet. Large sets are first
    cut by their equal bands (five, of which four errors leave one clean), whose forests
    together connect the same values.
    """
    if len(fp) > 4096 and bits == BITS:
        parts = []
        for low, n in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)):
            band = (fp >> np.uint64(low)) & np.uint64((1 << n) - 1)
            order = np.argsort(band, kind="stable")
            cuts = np.flatnonzero(np.diff(band[order])) + 1
            parts += [_grown(fp[x], bits) for x in np.split(order, cuts) if len(x) > 1]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in (0, 1))
    return _grown(fp, bits)


def _grown(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rest, a, b = fp, [], []
    frontier: list = []
    while len(rest):
        if not frontier:
            frontier, rest = [rest[0]], rest[1:]
        x = frontier.pop()
        near = np.bitwise_count(rest ^ x) <= bits
        if near.any():
            new = rest[near]
            a.append(np.full(len(new), x, np.uint64))
            b.append(new)
            frontier += list(new)
            rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def links_in(key: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys."""
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cuts)
    size = np.repeat(sizes, sizes)
    a, b = [], []
    for d in range(1, 8):  # runs of up to 8: all their pairs at once
        ok = (key[d:] == key[:-d]) & (size[d:] <= 8)
        if not ok.any():
            break
        x, y = fp[:-d][ok], fp[d:][ok]
        near = np.bitwise_count(x ^ y) <= bits
        a.append(x[near])
        b.append(y[near])
    for k in np.flatnonzero(sizes > 8):
        x, y = forest(fp[cuts[k] : cuts[k + 1]], bits)
        a.append(x)
        b.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(batches):
    """Over rows sorted by key; the last run of a batch waits for the next batch."""
    key, fp = np.zeros(0, np.int32), np.zeros(0, np.uint64)

    def rows(k, f):
        a, b = links_in(k, f)
        pairs = np.unique(np.stack([np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))], 1), axis=0)
        return pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(key) and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))
            yield rows(key[:cut], fp[:cut])
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield rows(key, fp)


#: Rows of a key from which its least value is broadcast.
HOT = 256


def with_least(rows: DataFrame, key: str, value: str, name: str, total: int) -> DataFrame:
    """rows with the least `value` of their key as `name`.

    Keys of HOT rows or more, and of a thousandth of all `total` rows or more, of which there
    are a thousand at most, get it by a broadcast, so their rows are not gathered.
    """
    bound = max(HOT, total // 1000)
    low = rows.groupBy(F.col(key).alias("__k")).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(low.where(F.col("__n") >= bound).select(F.col("__k").alias("__h"), F.col(name).alias("__m")))
    marked = rows.join(hot, F.col(key) == F.col("__h"), "left")
    columns = [F.col(c) for c in rows.columns]
    few = marked.where("__h is null").select(*columns).join(low.where(F.col("__n") < bound), F.col(key) == F.col("__k"))
    return marked.where("__h is not null").select(*columns, F.col("__m").alias(name)).union(few.select(*columns, name))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b) with a < b: the smallest node each can reach, for all nodes with links.

    Every step writes its links to the shared folder; no node's neighbours are gathered.
    """
    links = written(links.distinct(), "links")
    last, total = None, links.count()
    while True:
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = with_least(both, "u", "v", "m", 2 * total).withColumn("m", F.least("u", "m"))
        large = least.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()  # m <= u < v
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(down, "u", "v", "m", total).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b")
        links = written(small.union(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        last, total = now, now[0]


def rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, fp, root) for each row: rid is a hash of the text, root names the component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"), "text")
    fps = written(rows.mapInArrow(_fingerprints, "doc_id long, rid long, fp long"), "fingerprints")
    n = partitions(docs.sparkSession)
    keys = fps.select("fp").distinct().mapInArrow(_keys, "key int, fp long")
    links = keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    return fps.join(components(links), fps["fp"] == F.col("node"), "left").select("doc_id", "rid", "fp", F.coalesce("root", "fp").alias("root"))


def clustered(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row."""
    rows = written(rooted(docs), "roots")
    return with_least(rows, "root", "doc_id", "component_id", rows.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their components: the smallest doc_id, null last, and of its rows one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "rid"))
    kept = rooted(docs).groupBy("root").agg(first.alias("kept")).select(F.col("kept.id").alias("__id"), F.col("kept.rid").alias("__rid")).distinct()
    rows = docs.withColumn("__r", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__r") == F.col("__rid")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__r"]).drop("__r")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clustered(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
