"""Benchmark decontamination with one Aho-Corasick automaton.

Text and items are normalised alike: A-Z lowered, words are runs of digits, letters
and non-ASCII characters, joined by one blank. Every window of an item's words goes
into the automaton between blanks, and each normalised text runs through it once.
Matches are mapped back to words, and to code points of the original.

The windows are written to the shared folder by executors. Up to `max_bytes` of them make
one automaton, built once per executor process. A larger benchmark is dealt by the hash
of the window to blocks of that size at most, each with its automaton: the documents are
still read once, and every task runs each run of rows through all blocks and unites what
they find row by row, so the size of the benchmark changes no result and rows are never
grouped. A process keeps the automata it used last, `HELD` at most.

Defined results: a null or wordless text has no words, no hits, no items; an item
without words has no window; null item ids count as the text ''; items with equal
windows are all reported; other columns play no part; repeated rows are each reported;
an empty benchmark or table gives no hits or no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, shared_dir
from .shared_files import exists, mapped, put

WINDOW = 13
#: At most this many bytes of windows in one automaton.
MAX_BYTES = 16 << 20
#: Automata that a process keeps, and bytes of text that go through all of them together.
HELD, RUN_BYTES = 4, 32 << 20
NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58] = np.arange(48, 58)
NORMAL[65:91] = LOWER[65:91]
NORMAL[97:123] = np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)
TABLE = NORMAL.tobytes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split(b" ") if text else []


def windows_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    w = [x for x in words_of(text) if x]
    if not w:
        return set()
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}


def _windows(batches, window: int):
    for batch in batches:
        ids, out, texts = [], [], []
        for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            for w in windows_of(t, window):
                ids.append("" if i is None else str(i))
                texts.append(w)
        yield pa.record_batch({"item": pa.array(ids, pa.string()), "window": pa.array(texts, pa.binary())})


class Automaton:
    """Windows to items; made of pairs (window, item)."""

    def __init__(self, pairs):
        import ahocorasick

        items: dict[bytes, list] = {}
        for w, item in pairs:
            items.setdefault(bytes(w), []).append(item)
        self.machine = ahocorasick.Automaton()
        for w, own in items.items():
            self.machine.add_word(f" {w.decode('latin-1')} ", (len(w) + 2, tuple(own)))
        self.machine.make_automaton()
        self.empty = not items

    def matches(self, joined: bytes):
        """(first byte, end byte, items) of each match in b' w w w '."""
        if not self.empty:
            for end, (n, items) in self.machine.iter(joined.decode("latin-1")):
                yield end + 1 - n, end + 1, items


def scanned(machine: Automaton, text: str | None) -> tuple[int, np.ndarray, set]:
    """Number of words, which words are hit, items that occur."""
    w = [x for x in words_of(text) if x]
    hit, items = np.zeros(0, bool), set()
    if w:
        joined = b" " + b" ".join(w) + b" "
        blanks = None
        for start, end, own in machine.matches(joined):
            if blanks is None:
                blanks = np.cumsum(np.frombuffer(joined, np.uint8) == 32)
                hit = np.zeros(len(w), bool)
            hit[blanks[start] - 1 : blanks[end - 1] - 1] = True
            items.update(own)
    return len(w), hit, items


def original_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points [start, end) of the original that runs of hit words cover."""
    raw = text.encode("utf-8", "surrogatepass")
    ink = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], ink, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1))]


def _put_block(uri: str):
    def run(key, table):
        """A block's file: (bytes of window, bytes of item, window, item) for each pair."""
        parts, block = [], key[0].as_py()
        for w, item in zip(table.column("window").to_pylist(), table.column("item").to_pylist()):
            raw = item.encode("utf-8", "surrogatepass")
            parts += [len(w).to_bytes(4, "little"), len(raw).to_bytes(4, "little"), w, raw]
        put(f"{uri}-{block}", b"".join(parts))
        return pa.table({"block": pa.array([block], pa.int32())})

    return run


def _pairs(data: bytes):
    at = 0
    while at < len(data):
        n, m = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        yield data[at : at + n], data[at + n : at + n + m].decode("utf-8", "surrogatepass")
        at += n + m


def blocks_of(benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> tuple[str, int]:
    """Writes the windows to files uri-0, uri-1, ...; (uri, how many)."""
    pairs = benchmark.select("item_id", "text").mapInArrow(lambda b: _windows(b, window), "item string, window binary").distinct()
    total = int(pairs.agg(F.sum(F.length("window") + 24)).first()[0] or 0)
    n = 1 if total <= max_bytes else 2 * -(-total // max_bytes)  # blocks by hash are uneven: half full on average
    uri = shared_dir(benchmark.sparkSession, "windows") + "/block"
    block = F.pmod(F.xxhash64("window"), F.lit(n)).cast("int").alias("block")
    pairs.select(block, "window", "item").groupBy("block").applyInArrow(_put_block(uri), "block int").count()
    for k in range(n):
        if not exists(f"{uri}-{k}"):
            put(f"{uri}-{k}", b"")
    return uri, n


_MACHINES: OrderedDict[str, Automaton] = OrderedDict()


def machine_of(uri: str) -> Automaton:
    """The automaton of a block's file; the last HELD ones stay in the process."""
    if uri not in _MACHINES:
        while len(_MACHINES) >= HELD:
            _MACHINES.popitem(last=False)
        _MACHINES[uri] = Automaton(_pairs(mapped(uri).tobytes()))
    _MACHINES.move_to_end(uri)
    return _MACHINES[uri]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES, keep: tuple = ("doc_id",)) -> DataFrame:
    """keep's columns with n_words, the hit runs of words, their code points in the original, and the items."""
    uri, blocks = blocks_of(benchmark, window, max_bytes)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    kept = [f"`{n}` {t}" for n, t in rows.select(*keep).dtypes]
    schema = ", ".join([*kept, "n_words long, runs array<struct<first:int,last:int>>, spans array<struct<start:int,stop:int>>, items array<string>"])

    def found(batch):
        """One record batch, its rows run through every block."""
        texts = batch.column("__text").to_pylist()
        counts, hit, items = [0] * len(texts), {}, {}
        for k in range(blocks):
            machine = machine_of(f"{uri}-{k}")
            for i, t in enumerate(texts):
                n, own_hit, own = scanned(machine, t)
                counts[i] = n
                if own:
                    hit[i] = own_hit | hit[i] if i in hit else own_hit
                    items.setdefault(i, set()).update(own)
        runs, spans = [], []
        for i, t in enumerate(texts):
            edge = np.diff(np.concatenate(([False], hit[i], [False])).astype(np.int8)) if i in hit else np.zeros(0, np.int8)
            runs.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            spans.append([{"start": a, "stop": b} for a, b in original_spans(t, hit[i])] if i in hit else [])
        pair = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
        more = [pa.array(counts, pa.int64()), pa.array(runs, pair("first", "last")), pa.array(spans, pair("start", "stop")), pa.array([sorted(items.get(i, ())) for i in range(len(texts))], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *more], [*batch.schema.names[: len(keep)], "n_words", "runs", "spans", "items"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= RUN_BYTES or blocks <= HELD:
                yield from map(found, pa.Table.from_batches(held).combine_chunks().to_batches())
                held, size = [], 0
        if held:
            yield from map(found, pa.Table.from_batches(held).combine_chunks().to_batches())

    return rows.mapInArrow(run, schema)


def verdicts(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from what hits() found."""
    inside = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    n_hit = F.size(F.array_distinct(inside)).cast("long")
    joined = F.array_join(F.array_sort("items"), ",")
    rest = [c for c in found.columns if c not in ("n_words", "runs", "spans", "items")]
    out = found.select(*rest, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return verdicts(hits(docs, benchmark))


#: Windows as joined words, in DuckDB's SQL.
OP8_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
iw AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, n, array_to_string(words[k:k + n - 1], ' ') AS w
       FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS k FROM b WHERE len(words) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
dw AS (SELECT r, n, k, array_to_string(words[k:k + n - 1], ' ') AS w FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
m AS (SELECT DISTINCT r, dw.n, k, item FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r
"""


def plain(doc: str | None, items: dict, window: int = WINDOW) -> tuple:
    """Brute force, for tests: (n_words, n_hit, item ids, contaminated)."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lowered = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = pattern.findall(lowered(doc))
    hit, found = set(), set()
    for item, text in items.items():
        v = pattern.findall(lowered(text))
        for i in range(max(1, len(v) - window + 1) if v else 0):
            part = v[i : i + window]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    return len(w), len(hit), found, bool(hit) and 20 * len(hit) >= len(w), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
