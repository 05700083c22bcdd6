"""N-gram language model in an Elias-Fano trie.

The trie is in files of the shared folder, written by executors and mapped into memory
where texts are scored. The first level holds the sorted hashes of all words seen in
training, in files of hash ranges; a word's id is its rank. The levels of two and three
words are in files of ranges of (first word, second word), which are even in the tokens
that they take: a frequent first word has several files. In a file the children of a node
are the ids that follow it, in order: pointers to each node's range, and children made
monotone by adding the last value of the range before, are both Elias-Fano coded. A child
is found by successor search for its id, relative to its context's range. Counts of words
are kept as ranks in the table of distinct counts; discounted probabilities and the weights
that they leave are quantised to 256 values for each file.

Smoothing is interpolated absolute discounting, put together when queried: P(w|h) =
(c(hw) - D) / c(h) + L(h) P(w|h'), L(h) being what the children leave; the lowest order is
the add-0.1 unigram model. All n-grams of training are kept; `least` prunes those of three
words seen less often, and is 1, which prunes none.

Training reads the texts twice: for the words, then for three words at each token (a last
one without a third), whose counts also make those of two words.

Words are known by 64-bit hashes: with 10**9 words, a word not seen in training is taken
for a seen one once in 10**10 look-ups.

Defined results: a null, empty or blank text is one end token; if nothing is trained on,
every token has probability 1 of being unknown, log10 0; a null id counts as the text ''
for the split; repeated rows count each in training and get equal scores; other columns
play no part, whatever their names; an empty table gives an empty table. Memory grows
with the longest text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, Counts, bucket_of, input_bytes, pack, prefix_hashes, remainder, shared_dir, span_hashes, summed, text_chunks, unpack, with_all, words
from .elias_fano import Monotone, encode
from .shared_files import arrays_of, put_arrays

LEAST, DISCOUNT, ADD = 1, 0.75, 0.1
#: Bytes of training input (as files hold them) for each file of the trie.
FILE_INPUT = 12 << 20
#: Tokens that a task counts together, and bytes of text that are scored together.
HELD_TOKENS, SCORED_BYTES = 2_000_000, 4 << 20
#: Stands for the end of a text.
END = np.uint64(0x3A7C15F39CC0605D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token: words with A-Z lowered, and an end for each text."""
    starts, ends, row = words(data, offsets)
    n = len(offsets) - 1
    out = np.empty(len(starts) + n, np.uint64)
    rows = np.empty(len(out), np.int64)
    at = np.arange(len(starts)) + row
    out[at] = span_hashes(prefix_hashes(data, True), starts, ends)
    rows[at] = row
    last = np.cumsum(np.bincount(row, minlength=n)) + np.arange(n)
    out[last], rows[last] = END, np.arange(n)
    return out, rows


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook of up to 256 values): quantiles of the values, or all of them if there are few."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    book = np.unique(values.astype(np.float32))
    if len(book) > 256:
        book = np.unique(np.quantile(values, (np.arange(256) + 0.5) / 256).astype(np.float32))
    codes = np.searchsorted((book[1:] + book[:-1]) / 2, values)
    return codes.astype(np.uint8), book


def count_codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, codes = np.unique(counts, return_inverse=True)
    return codes.astype(np.uint16 if len(table) <= 65536 else np.uint32), table.astype(np.int64)


class Trie:
    """The files below one folder.

    words: the first id of each file of words; ranges: the first key (first word * wide + second
    word) of each file of n-grams; nodes: the first node of two words of each; hot: log10 of what
    the first words that several files share leave.
    """

    def __init__(self, uri: str, total: int, words_: np.ndarray, ranges: np.ndarray, nodes: np.ndarray, hot: dict[int, float]):
        self.uri, self.total, self.words, self.ranges, self.nodes, self.hot = uri, total, words_, ranges, nodes, hot
        self.wide = np.uint64(self.size + 1)
        self.held: dict = {}

    @property
    def size(self) -> int:
        return int(self.words[-1])

    def file(self, name: str) -> dict:
        a = arrays_of(f"{self.uri}/{name}")
        if self.held.get(name, (None,))[0] is not a:
            self.held[name] = a, {k[:-4]: Monotone(a, k[:-4]) for k in a if k.endswith("_low")} | a
            while len(self.held) > HELD_FILES:
                self.held.pop(next(iter(self.held)))
        return self.held[name][1]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.total + ADD * (self.size + 1)))

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        files = len(self.words) - 1
        for b, own in _runs(bucket_of(hashes, files)):
            f = self.file(f"words-{b}")
            at, ok = f["keys"].successor(hashes[own] - first_hash(b, files))
            ids[own][ok] = at[ok] + self.words[b]
            counts[own][ok] = f["table"][f["codes"][at[ok]]]
        return ids, counts

    def pairs(self, keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted keys first * wide + second, the second not known where known is false: node or -1, log10 of its share and of what the first word leaves."""
        first, second = (keys // self.wide).astype(np.int64), (keys % self.wide).astype(np.int64)
        node, share, rest = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for b, own in _runs(np.searchsorted(self.ranges, keys, "right") - 1):
            low = int(self.ranges[b] // self.wide)
            at, share[own], rest[own] = _children(self.file(f"ngrams-{b}"), "2", first[own] - low, second[own], known[own])
            node[own] = np.where(at >= 0, at + self.nodes[b], -1)
        for w, weight in self.hot.items():
            i, j = np.searchsorted(first, [w, w + 1])
            rest[i:j] = weight
        return node, share, rest

    def triples(self, contexts: np.ndarray, third: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted nodes of two words and a third: whether it is there, log10 of its share and of what the node leaves."""
        there, share, rest = np.zeros(len(contexts), bool), np.zeros(len(contexts)), np.zeros(len(contexts))
        for b, own in _runs(np.searchsorted(self.nodes, contexts, "right") - 1):
            at, share[own], rest[own] = _children(self.file(f"ngrams-{b}"), "3", contexts[own] - self.nodes[b], third[own], known[own])
            there[own] = at >= 0
        return there, share, rest


#: Files of the trie that a process keeps open.
HELD_FILES = 2048


def _runs(of: np.ndarray):
    """(value, slice) of runs of equal values."""
    cuts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]))
    return ((int(of[i]), slice(i, j)) for i, j in zip(cuts[:-1], cuts[1:]) if i < j)


def _children(f: dict, level: str, contexts: np.ndarray, words_: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending contexts of one file and words: the child's place or -1, log10 of its share, and of what the context leaves."""
    n = len(contexts)
    node, share = np.full(n, -1, np.int64), np.zeros(n)
    new = np.concatenate(([True], contexts[1:] != contexts[:-1]))  # the range of each distinct context once
    each, which = contexts[new], np.cumsum(new) - 1
    rest = f[f"rest{level}_book"][f[f"rest{level}"][each]].astype(float)[which]
    ends = f[f"pointers{level}"].access(np.concatenate([each, each + 1])).astype(np.int64)
    lo, hi = ends[: len(each)], ends[len(each) :]
    base = np.zeros(len(each), np.uint64)
    inner = np.flatnonzero((lo < hi) & (lo > 0))
    base[inner] = f[f"keys{level}"].access(lo[inner] - 1) + np.uint64(1)
    some = np.flatnonzero((lo < hi)[which] & known)
    at, ok = f[f"keys{level}"].successor(base[which[some]] + words_[some].astype(np.uint64))
    ok &= at < hi[which[some]]  # a value beyond the last of this range is in the next one
    node[some[ok]] = at[ok]
    share[some[ok]] = f[f"p{level}_book"][f[f"p{level}"][at[ok]]]
    return node, share, rest


def first_hash(bucket: int, buckets: int) -> np.uint64:
    """The least hash of a bucket: see bucket_of."""
    return np.uint64(-(-(bucket << 32) // buckets) << 32)


def _ids(trie: Trie, data, offsets):
    """ids, counts, rows of the tokens of a chunk."""
    hashes, rows = tokens(data, offsets)
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = trie.word_ids(distinct)
    return ids[back], counts[back], rows


def scores(trie: Trie, ids: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log10 P of each token after the two before it; pairs and triples are looked up once for each that occurs."""
    n = len(ids)
    p = 10.0 ** trie.unigram(counts)
    node = np.full(n, -1, np.int64)
    at = np.flatnonzero(np.concatenate(([False], (rows[1:] == rows[:-1]) & (ids[:-1] >= 0))))
    if len(at):
        # a second word that isn't known has a key of its own after all ids
        second = np.where(ids[at] >= 0, ids[at], trie.size).astype(np.uint64)
        keys, back = np.unique(ids[at - 1].astype(np.uint64) * trie.wide + second, return_inverse=True)
        found, share, rest = trie.pairs(keys, keys % trie.wide < np.uint64(trie.size))
        node[at] = found[back]
        p[at] = np.where(found >= 0, 10.0**share, 0.0)[back] + (10.0**rest)[back] * p[at]
    at = np.flatnonzero(np.concatenate(([False, False], (rows[2:] == rows[:-2]) & (node[1:-1] >= 0)))[:n])
    if len(at):
        context, third = node[at - 1], np.where(ids[at] >= 0, ids[at], trie.size)
        order = np.lexsort((third, context))
        context, third = context[order], third[order]
        new = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (third[1:] != third[:-1]))))
        there, share, rest = trie.triples(context[new], third[new], third[new] < trie.size)
        back = np.empty(len(at), np.int64)
        back[order] = np.repeat(np.arange(len(new)), np.diff(np.concatenate((new, [len(at)]))))
        p[at] = np.where(there, 10.0**share, 0.0)[back] + (10.0**rest)[back] * p[at]
    return np.log10(p)


def _count_words(batches, files: int):
    counts = Counts(files)
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column("text")):
            yield from counts.add(tokens(data, offsets)[0])
    yield from counts.flush()


def _named(prefix: str, arrays: dict) -> dict:
    return {f"{prefix}_{k}": v for k, v in arrays.items()}


def put_words(uri: str, bucket: int, files: int, keys: np.ndarray, counts: np.ndarray) -> None:
    codes, table = count_codes(counts)
    put_arrays(f"{uri}/words-{bucket}", codes=codes, table=table, **_named("keys", encode(keys - first_hash(bucket, files))))


def _totals(key: np.ndarray, third: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, third) in order, with the sums of their counts."""
    order = np.lexsort((third, key))
    key, third, count = key[order], third[order], count[order]
    del order
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (third[1:] != third[:-1])))) if len(key) else np.zeros(0, np.int64)
    return key[new], third[new], np.add.reduceat(count, new, dtype=np.int64) if len(new) else count.astype(np.int64)


def _count_triples(batches, trie: Trie):
    """Counts of (first * wide + second, third) by file; the third of the last two tokens of a text is trie.size."""
    held, n, kind = [], 0, np.uint32 if trie.size < 2**32 - 1 else np.uint64

    def sent():
        key, third, count = _totals(*(np.concatenate([x[k] for x in held]) for k in range(3)))
        rows = [(b, pack(key[own], third[own], count[own].astype(np.uint32))) for b, own in _runs(np.searchsorted(trie.ranges, key, "right") - 1)]
        return pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column("text")):
            ids, _, rows = _ids(trie, data, offsets)
            at = np.flatnonzero(rows[1:] == rows[:-1])
            third = np.concatenate((ids[2:], [trie.size])).astype(kind)
            third[:-1][rows[2:] != rows[1:-1]] = trie.size
            held.append((ids[at].astype(np.uint64) * trie.wide + ids[at + 1].astype(np.uint64), third[at], np.ones(len(at), np.uint32)))
            n += len(at)
            if n >= HELD_TOKENS:
                yield sent()
                held, n = [], 0
    if n:
        yield sent()


def _level(level: str, contexts: np.ndarray, child: np.ndarray, counts: np.ndarray, own: np.ndarray) -> dict:
    """The arrays of a level: children by context, with their counts, and the counts of all contexts."""
    n = len(own)
    pointers = np.searchsorted(contexts, np.arange(n + 1))
    sizes = np.diff(pointers)
    rest = np.where(sizes > 0, 1 - np.bincount(contexts, weights=counts - DISCOUNT, minlength=n) / np.maximum(own, 1), 1.0) if n else np.zeros(0)
    # children made monotone: each range goes on from the last value of the one before, plus one
    lasts = np.zeros(n, np.uint64)
    full = sizes > 0
    lasts[full] = child[pointers[1:][full] - 1].astype(np.uint64) + np.uint64(1)
    base = np.concatenate(([np.uint64(0)], np.cumsum(lasts)[:-1])) if n else np.zeros(0, np.uint64)
    values = child.astype(np.uint64) + base[contexts] if len(child) else np.zeros(0, np.uint64)
    p, book = quantised(np.log10((counts - DISCOUNT) / np.maximum(own, 1)[contexts]) if len(child) else np.zeros(0))
    left, left_book = quantised(np.log10(np.maximum(rest, 1e-9)))
    out = {f"p{level}": p, f"p{level}_book": book, f"rest{level}": left, f"rest{level}_book": left_book}
    return out | _named(f"keys{level}", encode(values)) | _named(f"pointers{level}", encode(pointers))


def put_ngrams(trie: Trie, bucket: int, key: np.ndarray, third: np.ndarray, count: np.ndarray, seen: dict[int, int], least: int) -> list[tuple]:
    """Writes a file of n-grams; (first word, children) of those first words that other files share."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    pairs, n_pair = key[first], np.add.reduceat(count, first) if len(first) else count
    low = int(trie.ranges[bucket] // trie.wide)
    high = int((trie.ranges[bucket + 1] - np.uint64(1)) // trie.wide) if bucket + 1 < len(trie.ranges) else trie.size - 1
    context = (pairs // trie.wide).astype(np.int64) - low
    own = np.bincount(context, weights=n_pair, minlength=max(0, high - low + 1)).astype(np.int64)
    for w, c in seen.items():
        if low <= w <= high:
            own[w - low] = c
    shared = [(w, int((context == w - low).sum())) for w in seen if low <= w <= high]
    keep = np.flatnonzero((third < trie.size) & (count >= least))
    node = (np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1)[keep] if len(key) else np.zeros(0, np.int64)
    arrays = _level("2", context, (pairs % trie.wide).astype(np.int64), n_pair, own) | _level("3", node, third[keep].astype(np.int64), count[keep], n_pair)
    put_arrays(f"{trie.uri}/ngrams-{bucket}", **arrays)
    return [(-1, len(pairs)), *shared]


def train(texts: DataFrame, least: int = LEAST, file_input: int = FILE_INPUT) -> Trie:
    """The trie of a table with a text column."""
    uri, files = shared_dir(texts.sparkSession, "trie"), max(1, -(-input_bytes(texts) // file_input))

    def put_bucket(key, table):
        """Writes a file of words; its size and tokens, and the words with an eighth of them or more."""
        b = key[0].as_py()
        parts = [unpack(x) for x in table.column("packed").to_pylist()]
        keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        put_words(uri, b, files, keys, counts)
        many = np.flatnonzero(8 * counts >= counts.sum()) if len(counts) else np.zeros(0, np.int64)
        rank, n = np.concatenate(([-1], many)), np.concatenate(([len(keys)], counts[many]))
        return pa.table({"bucket": pa.array(np.full(len(rank), b, np.int32)), "word": pa.array(rank), "n": pa.array(n), "total": pa.array(np.full(len(rank), counts.sum(), np.int64))})

    counted = texts.select("text").mapInArrow(lambda b: _count_words(b, files), PACKED)
    rows = with_all(counted, files).groupBy("bucket").applyInArrow(put_bucket, "bucket int, word long, n long, total long").collect()  # nine rows for each file at most
    sizes = sorted((r for r in rows if r.word < 0), key=lambda r: r.bucket)
    bases, total = np.concatenate(([0], np.cumsum([r.n for r in sizes]))), sum(r.total for r in sizes)
    if int(bases[-1]) >= 2**32 - 1:
        raise ValueError("too many words for 64-bit keys of two")
    seen = {int(bases[r.bucket] + r.word): r.n for r in rows if r.word >= 0 and 2 * files * r.n > total}
    trie = Trie(uri, total, bases, np.zeros(1, np.uint64), np.zeros(2, np.int64), {})
    # ranges of even weight: a frequent first word takes several, by its second
    wide, starts = int(trie.wide), {int(b) * int(trie.wide) for b in bases[:-1]}
    for w, n in seen.items():
        parts = -(-files * n // total)
        starts |= {w * wide + k * wide // parts for k in range(parts)} | {(w + 1) * wide}
    trie.ranges = np.array(sorted(x for x in starts if x == 0 or x < int(bases[-1]) * wide), np.uint64)
    several = {w: n for w, n in seen.items() if np.searchsorted(trie.ranges, np.uint64(w * wide + wide - 1), "right") - np.searchsorted(trie.ranges, np.uint64(w * wide), "right") > 0}

    def put_range(key, table):
        b = key[0].as_py()
        parts = [unpack(x.as_py()) for x in table.column("packed")]
        merged = _totals(*(np.concatenate([p.pop(0) for p in parts]) for _ in range(3)))
        rows = put_ngrams(trie, b, *merged, several, least)
        return pa.table({"bucket": pa.array([b] * len(rows), pa.int32()), "word": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64())})

    counted = texts.select("text").mapInArrow(lambda b: _count_triples(b, trie), PACKED)
    counted = with_all(counted, len(trie.ranges), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
    rows = counted.groupBy("bucket").applyInArrow(put_range, "bucket int, word long, n long").collect()  # one for each file, and for each word in it that others share
    children: dict[int, int] = {}
    for r in rows:
        if r.word >= 0:
            children[r.word] = children.get(r.word, 0) + r.n
    nodes = [r.n for r in sorted((r for r in rows if r.word < 0), key=lambda r: r.bucket)]
    return Trie(uri, total, bases, trie.ranges, np.concatenate(([0], np.cumsum(nodes))), {w: math.log10(DISCOUNT * n / several[w]) if n else 0.0 for w, n in children.items()})


def scored(df: DataFrame, trie: Trie) -> DataFrame:
    """df's columns but text, with n_tokens, n_known, train_tokens, base_score and score."""
    made = trie.uri, trie.total, trie.words, trie.ranges, trie.nodes, trie.hot

    def run(batches):
        own = Trie(*made)
        for batch in batches:
            out = [[], [], [], []]
            for i, j, data, offsets in text_chunks(batch.column("text"), SCORED_BYTES):
                ids, counts, rows = _ids(own, data, offsets)
                n = j - i
                base, score = own.unigram(counts), scores(own, ids, counts, rows)
                for k, v in enumerate((np.bincount(rows, minlength=n), np.bincount(rows, weights=counts > 0, minlength=n), np.bincount(rows, weights=base, minlength=n), np.bincount(rows, weights=score, minlength=n))):
                    out[k].append(v)
            made_ = [np.concatenate(x) if x else np.zeros(0) for x in out]
            names = [f.name for f in batch.schema if f.name != "text"]
            more = [pa.array(made_[0].astype(np.int64)), pa.array(made_[1].astype(np.int64)), pa.array(np.full(len(made_[0]), own.total, np.int64)), pa.array(made_[2].astype(float)), pa.array(made_[3].astype(float))]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *more], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = [f"`{n}` {t}" for n, t in df.dtypes if n != "text"]
    return df.mapInArrow(run, ", ".join([*fields, "n_tokens long, n_known long, train_tokens long, base_score double, score double"]))


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.withColumn("held_out", remainder(F.col("doc_id"), 10) == 0)
    trie = train(rows.where(~F.col("held_out")).select("text"))
    return scored(rows.select("doc_id", "held_out", "text"), trie)


def plain_base(texts: dict, training: set) -> dict:
    """Brute force, for tests: doc_id -> (n_tokens, n_known, N, base score)."""
    from collections import Counter

    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w] + [None]
    c = Counter(w for d in training for w in split(texts[d]))
    n, v = sum(c.values()), len(c)
    return {d: (len(s := split(t)), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + ADD) / (n + ADD * (v + 1))) for w in s)) for d, t in texts.items()}
