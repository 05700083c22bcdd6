"""Exact substring deduplication by suffix arrays of shards.

A byte goes if it is covered by a string of `length` bytes that also starts earlier
(in a smaller doc_id, or earlier in the same document). Texts are UTF-8 bytes.

Sharding. Every window of `length` bytes has a minimizer, the `seed`-byte string in it
with the least hash; equal windows have equal minimizers at equal places. Consecutive
windows with one minimizer form a piece. Hashes are counted over the whole corpus; a
window whose minimizer occurs once has no equal, so only pieces of repeated minimizers
go on, to the shard of their hash. Equal windows therefore always meet in one shard.

Hot passages. Pieces that are equal as a whole are merged before they are shuffled and
again in the shard, within a bounded memory: the earliest stays, the others are covered
from end to end.

In the shard. A shard's rows come in order, a batch at a time, and its pieces go to
scratch files. In order of occurrence they are one string whose suffixes are sorted by
external induced sorting (induced_sorting.py) with common-prefix values; runs of suffixes
with common prefixes of `length` or more are equal windows, of which all but the first
occurrence are covered. Strings, suffix tuples and prefix values beyond `limit` entries
are on disk, so shards may be larger than memory; what is held in memory for each piece
are the five numbers of its place.

Defined results: a null text is empty; texts shorter than `length` lose nothing; rows
that share doc_id and text are one document and get equal results; rows that share only
the doc_id are ordered by a hash of their texts; a null doc_id is the smallest; other
columns play no part, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, PACKED, Counts, bucket_of, buckets_for, mixed, pack, partitions, powers, prefix_hashes, shared_dir, summed, text_bytes, unpack, with_all, written
from .induced_sorting import IN_MEMORY, blocks, scratch, sorted_suffixes
from .shared_files import member, put, scratch_folder

LENGTH, SEED_BYTES = 100, 24
#: Bytes of pieces that one shard is planned for, and that a task gathers before it sends them.
SHARD_BYTES, HELD_BYTES = 4 << 20, 24 << 20
#: Sorts before every doc_id.
NO_ID = -(2**63)


#: Low bits of a hash that do not count when minimizers are compared, at any length of the array.
IGNORED = 24


def least_places(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least of each w consecutive hashes by their upper bits, the leftmost of equal ones.

    How many bits count is fixed, so equal windows have their minimizers at equal places
    whatever else is in the array. Shorter arrays keep the place in the other bits.
    """
    bits, have = np.uint64(IGNORED), 1
    short = len(h) <= 1 << IGNORED
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64) if short else h >> bits
    out = key if short else np.arange(len(h))
    while have < w:
        step = min(have, w - have)
        left, right = out[: len(out) - step], out[step:]
        out = np.minimum(left, right) if short else np.where(key[right] < key[left], right, left)
        have += step
    return (out & np.uint64((1 << IGNORED) - 1)).astype(np.int64) if short else out


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """(row, first byte, end byte, hash) of each piece; the arrays' bytes are within `data`."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    prefix = prefix_hashes(data, False)
    count = n - seed + 1
    h = mixed((prefix[seed:] - prefix[:count]) * powers(n)[1][:count])
    place = least_places(h, length - seed + 1)  # by first byte of the window
    windows = np.arange(n - length + 1)
    row = np.searchsorted(offsets, windows, "right") - 1
    inside = windows + length <= offsets[row + 1]
    windows, row, place = windows[inside], row[inside], place[inside]
    if not len(windows):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((new[1:], [len(windows)])) - 1
    return row[new], windows[new], windows[last] + length, h[place[new]]


def slices(column, length: int):
    """(row, first byte in the text, bytes, offsets) for runs of texts, long ones in overlapping parts."""
    data, offsets = text_bytes(column)
    rows, first, cuts = [], [], []
    size = 0
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a < length:
            continue
        for at in range(a, b - length + 1, CHUNK):
            end = min(b, at + CHUNK + length - 1)
            rows.append(i)
            first.append(at - a)
            cuts.append((at, end))
            size += end - at
            if size >= CHUNK:
                yield _joined(data, rows, first, cuts)
                rows, first, cuts, size = [], [], [], 0
    if rows:
        yield _joined(data, rows, first, cuts)


def _joined(data, rows, first, cuts):
    parts = [data[a:b] for a, b in cuts]
    return np.array(rows), np.array(first), np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _count_seeds(batches, buckets: int, length: int, seed: int):
    counts = Counts(buckets)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text"), length):
            yield from counts.add(pieces_of(data, offsets, length, seed)[3])
    yield from counts.flush()


def _repeated(uri: str):
    def run(key, table):
        """Keeps the hashes of a bucket that occur twice or more, as a sorted file."""
        bucket = key[0].as_py()
        parts = [unpack(x) for x in table.column("packed").to_pylist()]
        keys, sums = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        put(f"{uri}-{bucket}", keys[sums >= 2].tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "pieces": pa.array([int(sums[sums >= 2].sum())], pa.int64())})

    return run


class Pieces:
    """Distinct pieces with their earliest places; what is covered from end to end by an earlier equal one."""

    def __init__(self):
        self.earliest: dict[bytes, tuple] = {}
        self.covered: list[tuple] = []
        self.size = 0

    def add(self, content: bytes, place: tuple) -> None:
        """place: (doc_id, row hash, first byte)."""
        old = self.earliest.setdefault(content, place)
        if old is place:
            self.size += len(content) + 160
        elif place < old:
            self.earliest[content] = place
            self.covered.append((*old, len(content)))
        elif place > old:
            self.covered.append((*place, len(content)))
            if not len(self.covered) & 0xFFFF:
                self.size += 1 << 20


def united(marks: list[tuple]) -> list[tuple]:
    """(doc, row hash, start, stop) without overlaps, from (doc, row hash, start, size)."""
    out: list[list] = []
    for doc, rid, start, size in sorted(marks):
        if out and out[-1][0] == doc and out[-1][1] == rid and start <= out[-1][3]:
            out[-1][3] = max(out[-1][3], start + size)
        else:
            out.append([doc, rid, start, start + size])
    return out


SENT = "shard int, packed binary, doc long, rid long, start long, stop long"
_SENT = pa.schema([("shard", pa.int32()), ("packed", pa.binary()), ("doc", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
MARKS = "doc long, rid long, start long, stop long"


def _mark_batch(marks: list, schema: pa.Schema) -> pa.RecordBatch:
    n = len(marks)
    columns = {k: pa.array([m[i] for m in marks], pa.int64()) for i, k in enumerate(("doc", "rid", "start", "stop"))}
    columns |= {"shard": pa.nulls(n, pa.int32()), "packed": pa.nulls(n, pa.binary())}
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def _send(held: dict[int, Pieces]):
    rows = []
    for shard, p in held.items():
        places = list(p.earliest.values())
        fields = [np.array([x[k] for x in places], np.int64) for k in range(3)]
        sizes = np.array([len(c) for c in p.earliest], np.int32)
        rows.append((shard, pack(*fields, sizes), pack(np.frombuffer(b"".join(p.earliest), np.uint8))))
    n = len(rows)
    body = [len(a).to_bytes(8, "little") + a + b for _, a, b in rows]
    empty = [pa.nulls(n, pa.int64())] * 4
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(body, pa.binary()), *empty], schema=_SENT)
    marks = united([m for p in held.values() for m in p.covered])
    for i in range(0, len(marks), 50_000):
        yield _mark_batch(marks[i : i + 50_000], _SENT)


def _send_pieces(batches, uri: str, buckets: int, shards: int, length: int, seed: int):
    held: dict[int, Pieces] = {}
    for batch in batches:
        docs, rids = batch.column("doc").to_pylist(), batch.column("rid").to_pylist()
        for rows, first, data, offsets in slices(batch.column("text"), length):
            part, start, stop, h = pieces_of(data, offsets, length, seed)
            keys, back = np.unique(h, return_inverse=True)
            keep = np.flatnonzero(member(uri, keys, buckets, bucket_of(keys, buckets))[back])
            raw = data.tobytes()
            shard = bucket_of(mixed(h[keep]), shards).tolist()
            within = (start[keep] - offsets[part[keep]] + first[part[keep]]).tolist()
            for s, r, a, b, w in zip(shard, rows[part[keep]].tolist(), start[keep].tolist(), stop[keep].tolist(), within):
                if s not in held:
                    held[s] = Pieces()
                held[s].add(raw[a:b], (docs[r], rids[r], w))
            if sum(p.size for p in held.values()) > HELD_BYTES:
                yield from _send(held)
                held = {}
    if held:
        yield from _send(held)


class Shard:
    """The pieces of a shard: contents in a scratch file, and of each piece doc, row hash, first byte, size and place in the file."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.file, self.end = tempfile.TemporaryFile(dir=scratch_folder()), 0
        self.held, self.places = Pieces(), []

    def add(self, content: bytes, place: tuple) -> None:
        self.held.add(content, place)

    def full(self) -> bool:
        return self.held.size > 8 * self.limit

    def flush(self) -> list[tuple]:
        """Contents go to the file; gives what equal pieces cover."""
        if self.held.earliest:
            sizes = np.array([len(c) for c in self.held.earliest], np.int64)
            table = np.empty((len(sizes), 5), np.int64)
            for k in range(3):
                table[:, k] = [x[k] for x in self.held.earliest.values()]
            table[:, 3], table[:, 4] = sizes, self.end + np.cumsum(sizes) - sizes
            self.places.append(table)
            self.file.seek(self.end)
            self.file.write(b"".join(self.held.earliest))
            self.end += int(sizes.sum())
        covered, self.held = self.held.covered, Pieces()
        return covered

    def marks(self):
        """Lists of (doc, row hash, start, size): what equal pieces, and equal windows of earlier pieces, cover."""
        yield self.flush()
        if not self.places:
            return
        places = np.concatenate(self.places)
        places = places[np.lexsort((places[:, 2], places[:, 1], places[:, 0]))]
        sizes = places[:, 3]
        begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))  # a separator after each piece
        n = int(sizes.sum()) + len(sizes) + 1
        raw = np.memmap(self.file, np.uint8, "r", shape=(self.end,)) if self.end else np.zeros(0, np.uint8)
        text = scratch(n, np.uint16, self.limit)
        at = 0
        cuts = np.flatnonzero(np.diff(begins // max(1, self.limit))) + 1  # pieces of about limit bytes together
        for own in np.split(places[:, 3:], cuts):
            block = np.frombuffer(b"".join(raw[i : i + size].tobytes() + b"\0" for size, i in own.tolist()), np.uint8).astype(np.uint16) + np.uint16(2)
            block[np.cumsum(own[:, 0] + 1) - 1] = 1
            text[at : at + len(block)] = block
            at += len(block)
        starts = covered_starts(text, begins, sizes, self.length, self.limit)
        yield from _spans(starts, places, begins, self.length, self.limit)


def covered_starts(text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, length: int, limit: int) -> np.ndarray:
    """Whether each place starts a window of `length` that lies in one piece and has an equal one earlier."""
    sa, lcp = sorted_suffixes(text, length, limit)
    out = scratch(len(text), bool, limit)
    run, least, number = 0, -1, -1  # the run so far, the earliest place of run `number`, which isn't marked
    for i, j in blocks(0, len(sa), max(1, limit // 8)):
        at = np.asarray(sa[i:j]).astype(np.int64)
        runs = run + np.cumsum(lcp[i:j] < length)
        run = int(runs[-1])
        piece = np.maximum(np.searchsorted(begins, at, "right") - 1, 0)
        valid = at + length <= begins[piece] + sizes[piece]
        at, runs = at[valid], runs[valid]
        if not len(at):
            continue
        if number == runs[0]:  # goes on from the block before
            at, runs = np.concatenate(([least], at)), np.concatenate(([number], runs))
        cuts = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
        first = np.minimum.reduceat(at, cuts)
        out[at[at != np.repeat(first, np.diff(np.concatenate((cuts, [len(at)]))))]] = True
        least, number = int(first[-1]), int(runs[-1])
    return out


def _spans(starts: np.ndarray, places: np.ndarray, begins: np.ndarray, length: int, limit: int):
    """Lists of (doc, row hash, start, size) of the bytes that marked windows cover."""
    size = max(length, limit // 8)
    for i, j in blocks(0, len(starts), size):
        low = max(0, i - length + 1)
        ahead = np.cumsum(np.concatenate(([0], starts[low:j])), dtype=np.int64)
        at = np.arange(i, j) - low + 1
        inside = np.diff(np.concatenate(([0], (ahead[at] > ahead[np.maximum(at - length, 0)]).astype(np.int8), [0])))
        a, b = np.flatnonzero(inside == 1) + i, np.flatnonzero(inside == -1) + i
        k = np.searchsorted(begins, a, "right") - 1
        yield list(zip(places[k, 0].tolist(), places[k, 1].tolist(), (places[k, 2] + a - begins[k]).tolist(), (b - a).tolist()))


def covered_in_shard(contents: list[bytes], places: list[tuple], length: int, limit: int = IN_MEMORY) -> list[tuple]:
    """(doc, row hash, start, size) of what equal windows of earlier pieces cover, for distinct pieces."""
    shard = Shard(length, limit)
    for content, place in zip(contents, places):
        shard.add(content, place)
    return [m for part in shard.marks() for m in part]


def _sort_shards(length: int, limit: int):
    schema = pa.schema([("doc", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def sent(marks: list):
        marks = united(marks)
        for i in range(0, len(marks), 50_000):
            yield _mark_batch(marks[i : i + 50_000], schema)

    def run(batches):
        """Over rows sorted by shard."""
        shard, number = None, None
        for batch in batches:
            for key, value in zip(batch.column("shard").to_pylist(), batch.column("packed")):
                if shard is not None and key != number:
                    for part in shard.marks():
                        yield from sent(part)
                if key != number:
                    shard, number = Shard(length, limit), key
                value = value.as_py()
                n = int.from_bytes(value[:8], "little")
                doc, rid, start, sizes = unpack(value[8 : 8 + n])
                raw, at = unpack(value[8 + n :])[0].tobytes(), 0
                for d, r, s, size in zip(doc.tolist(), rid.tolist(), start.tolist(), sizes.tolist()):
                    shard.add(raw[at : at + size], (d, r, s))
                    at += size
                    if shard.full():
                        yield from sent(shard.flush())
        if shard is not None:
            for part in shard.marks():
                yield from sent(part)

    return run


def covered(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES, limit: int = IN_MEMORY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, rid, spans): for documents that lose bytes, the sorted [start, stop) pieces of what they lose.

    At most about shard_bytes of pieces go to one shard, and of a shard's string `limit` entries are in memory.
    """
    spark = docs.sparkSession
    buckets = buckets_for(docs)
    texts = keyed(docs).select("doc", "rid", "text")
    uri = shared_dir(spark, "seeds") + "/keys"
    counted = texts.select("text").mapInArrow(lambda b: _count_seeds(b, buckets, length, seed), PACKED)
    found = with_all(counted, buckets).groupBy("bucket").applyInArrow(_repeated(uri), "bucket int, pieces long").agg(F.sum("pieces")).first()[0] or 0
    shards = max(buckets, -(-int(found) * (length + 40) // shard_bytes))
    sent = written(texts.mapInArrow(lambda b: _send_pieces(b, uri, buckets, shards, length, seed), SENT), "pieces")
    dealt = sent.where("shard is not null").select("shard", "packed").repartition(min(shards, max(buckets, partitions(spark))), "shard").sortWithinPartitions("shard")
    sorted_ = dealt.mapInArrow(_sort_shards(length, limit), MARKS)
    marks = sent.where("shard is null").select("doc", "rid", "start", "stop").union(sorted_)
    return marks.groupBy("doc", "rid").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with text never null, and the document's key: doc and rid."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text", text).withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("rid", F.xxhash64(text))


def cleared(data: bytes, spans: list) -> tuple[bytes, int, int]:
    """What is left, bytes gone, maximal runs gone; spans are sorted by start."""
    kept, at, runs, gone = [], 0, 0, 0
    stop_before = -1
    for span in spans or ():
        start, stop = span["start"], span["stop"]
        if start > stop_before:
            runs += 1
        if stop > at:
            kept.append(data[at : max(at, start)])
            gone += stop - max(at, start)
            at = stop
        stop_before = max(stop_before, stop)
    kept.append(data[at:])
    return b"".join(kept), gone, runs


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED_BYTES, text: bool = True, limit: int = IN_MEMORY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256; the text is what is left of it, or dropped.

    Where a cut falls inside a character, its remaining bytes leave the text too.
    """
    marks = covered(docs, length, seed, limit, shard_bytes).select(F.col("doc").alias("__doc"), F.col("rid").alias("__rid"), "spans")
    rows = keyed(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    rows = rows.join(marks, (rows["doc"] == marks["__doc"]) & (rows["rid"] == marks["__rid"]), "left")
    kind = docs.schema
    others = [n for n in docs.columns if n != "text"]

    def run(batches):
        for batch in batches:
            texts, spans = batch.column("__text").to_pylist(), batch.column("spans").to_pylist()
            out = [cleared(t.encode("utf-8", "surrogatepass"), s) + (len(t.encode("utf-8", "surrogatepass")),) for t, s in zip(texts, spans)]
            columns = {n: batch.column(f"__{k}") for k, n in enumerate(others)}
            more = [
                pa.array([x[3] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                pa.array([hashlib.sha256(x[0]).hexdigest() for x in out], pa.string()),
            ]
            kept = [pa.array([x[0].decode("utf-8", "ignore") for x in out], pa.string())] if text else []
            yield pa.RecordBatch.from_arrays([*columns.values(), *kept, *more], [*columns, *["text"] * text, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    fields = [f"`{n}` {kind[n].dataType.simpleString()}" for n in others]
    picked = [F.col("row")[n].alias(f"__{k}") for k, n in enumerate(others)]
    return rows.select(*picked, F.col("text").alias("__text"), "spans").mapInArrow(run, ", ".join([*fields, *["text string"] * text, DIGEST]))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs, text=False)


def plain(texts: dict, length: int = LENGTH) -> dict:
    """Brute force, for tests: doc_id -> (n_bytes, n_removed, n_spans, digest of what is left)."""
    seen, out = set(), {}
    for doc in sorted(texts):
        data = (texts[doc] or "").encode("utf-8", "surrogatepass")
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
