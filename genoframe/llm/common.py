"""Helpers that the text operators share: shared storage, text buffers, hashing, packed rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is handled alone or in slices.
CHUNK = 2 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
#: A random value for each byte, and an odd base: the word hash is a polynomial over these, modulo 2**64.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset (tests), below a temporary one."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top:
        held = context._jsc.sc().getCheckpointDir()
        top = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='genoframe-')}"
    ensure_checkpoints(spark, top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoints(spark: SparkSession, top: str | None = None) -> None:
    """Sets the folder for checkpoint() from spark.checkpoint.dir, or a temporary one where that is unset."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        top = top or spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='genoframe-')}"
        context.setCheckpointDir(top)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(n))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input (as files hold them) for each bucket of keys that one task merges.
BUCKET_INPUT = 256 << 20


def input_bytes(df: DataFrame) -> int:
    """The size of the files that df reads; where the plan has no estimate, BUCKET_INPUT for each shuffle partition."""
    size = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        size += int(str(leaves.apply(i).stats().sizeInBytes()))
    return size if size < 1 << 58 else BUCKET_INPUT * partitions(df.sparkSession)


def buckets_for(df: DataFrame) -> int:
    """How many buckets keys from df are dealt to: the shuffle partitions, or more if the input is large."""
    return max(partitions(df.sparkSession), -(-input_bytes(df) // BUCKET_INPUT))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data, offsets


def text_chunks(column, limit: int = CHUNK):
    """(first row, end row, bytes, offsets from 0) for runs of rows of about limit bytes; no text is split."""
    data, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+ of the concatenated texts."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ink = np.zeros(n + 2, bool)
    np.logical_not(WHITE[data], out=ink[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | cut[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        out = []
        for b in (BASE, INVERSE):
            x = np.full(max(n + 1, CHUNK + 4096), b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray, lower: bool) -> np.ndarray:
    """P with P[j] - P[i] = BASE**i times the hash of data[i:j]."""
    values = BYTE_VALUE[LOWER] if lower else BYTE_VALUE
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as one compressed value; a sorted first array of 64-bit keys is kept as differences."""
    head, parts = [], []
    for k, a in enumerate(arrays):
        if k == 0 and a.dtype == np.uint64 and len(a):
            a = np.diff(a, prepend=np.uint64(0))
        head += [a.dtype.str.encode(), str(len(a)).encode()]
        parts.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    raw = b"".join(parts)
    return b",".join(head) + b"," + str(len(raw)).encode() + b"\n" + pa.compress(raw, "zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    cut = value.index(b"\n")
    *head, size = value[:cut].split(b",")
    raw = pa.decompress(value[cut + 1 :], int(size), "zstd", asbytes=True) if int(size) else b""
    out, at = [], 0
    for k in range(0, len(head), 2):
        kind, n = np.dtype(head[k].decode()), int(head[k + 1])
        a = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        a = np.ascontiguousarray(a.T).reshape(-1).view(kind) if n else np.zeros(0, kind)
        at += n * kind.itemsize
        out.append(np.cumsum(a) if k == 0 and kind == np.uint64 else a)
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


class Counts:
    """Counts of 64-bit keys within a bounded number of entries; what exceeds it leaves as packed rows by bucket."""

    def __init__(self, buckets: int, limit: int = 1_500_000):
        self.buckets, self.limit = buckets, limit
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.held += len(keys)
        if self.held > self.limit:
            self.merge()
            if self.held > self.limit // 2:
                yield from self.flush()

    def merge(self):
        if self.keys:
            keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [keys], [counts], len(keys)

    def flush(self):
        self.merge()
        if self.keys and len(self.keys[0]):
            yield from packed_rows(self.keys[0], self.buckets, self.counts[0].astype(np.uint32 if self.counts[0].max() < 2**32 else np.int64))
        self.keys, self.counts, self.held = [], [], 0


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of uniform 64-bit keys: equal ranges of their top 32 bits, so buckets are ranges of keys."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def packed_rows(keys: np.ndarray, buckets: int, *more: np.ndarray):
    """One record batch of (bucket, packed) rows for sorted keys."""
    b = bucket_of(keys, buckets)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)]))
    rows = [(int(b[i]), pack(keys[i:j], *(m[i:j] for m in more))) for i, j in zip(cuts[:-1], cuts[1:])]
    yield pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})


PACKED = "bucket int, packed binary"


def with_all(packed: DataFrame, buckets: int, *more: np.ndarray) -> DataFrame:
    """Rows of PACKED with one more for every bucket, so that each has a file, written by the task that merges it."""
    none = pack(np.zeros(0, np.uint64), *(more or (np.zeros(0, np.uint32),)))
    return packed.unionByName(packed.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(none).alias("packed")))


def segment_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
