"""Language identification with bit-sliced Bloom filters over byte n-grams.

Every row of the filter is a mask with one bit per language. The rows that an
n-gram hashes to, and-ed, give all languages whose filter holds it. A text's
popcounts per language, less what false positives are expected to add, decide.

An n-gram is in a language's filter if its share of that language's n-grams is
`share` or more, so a language has at most 1 / share of them, whatever the size of
the corpus. Of dirty labels the `MOST` with the most n-grams are learned.

Defined results: a null text, or one without a letter, is `und` with score 0; a text
with letters but no known n-gram gets the first language in order with score 0; if
nothing can be learned, every text is `und`; rows with null or unknown ids and repeated
rows are predicted alike, by their text only; other columns play no part, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, mixed, remainder

GRAM = 4
#: Rows of the filter, a power of two, and hashes of each n-gram.
ROWS, HASHES = 1 << 20, 3
SHARE = 2e-5
#: Languages that are learned at most.
MOST = 1024
#: Bytes other than letters count as blanks; those of other scripts stay.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def pieces(texts):
    """(row, bytes) of each lower-cased text between blanks, in slices that share GRAM - 1 bytes."""
    for row, text in enumerate(texts):
        if text:
            data = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
            for i in range(0, max(1, len(data) - GRAM + 1), CHUNK):
                yield row, data[i : i + CHUNK + GRAM - 1]


def gram_chunks(texts):
    """(grams, row of each) for runs of pieces of about CHUNK bytes."""
    held, rows, n = [], [], 0
    for row, data in pieces(texts):
        held.append(data)
        rows.append(row)
        n += len(data)
        if n >= CHUNK:
            yield grams(held, rows)
            held, rows, n = [], [], 0
    if held:
        yield grams(held, rows)


def grams(held, rows):
    data = LETTERS[np.frombuffer(b"".join(held), np.uint8)]
    sizes = np.array([len(x) for x in held])
    wide = data.astype(np.uint32)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    out = wide[:n].copy()
    for k in range(1, GRAM):
        out = (out << np.uint32(8)) | wide[k : n + k]
    row = np.repeat(np.array(rows), sizes)[:n]
    ends = np.cumsum(sizes)
    keep = np.ones(n, bool)
    for k in range(1, GRAM):  # not across pieces
        at = ends - k
        keep[at[(at >= 0) & (at < n)]] = False
    blank = data == 32
    keep &= ~(blank[:n] & blank[1 : n + 1]) & ~(blank[1 : n + 1] & blank[2 : n + 2]) & ~(blank[2 : n + 2] & blank[3 : n + 3])
    return out[keep], row[keep]


def _count_grams(batches):
    held: dict[str, list] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        by: dict[str, list] = {}
        for lang, text in zip(langs, texts):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            for g, _ in gram_chunks(own):
                keys, n = np.unique(g, return_counts=True)
                old = held.get(lang)
                if old is not None:
                    keys = np.concatenate([old[0], keys])
                    n = np.concatenate([old[1], n])
                    order = np.argsort(keys, kind="stable")
                    keys, n = keys[order], n[order]
                    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    keys, n = keys[first], np.add.reduceat(n, first)
                held[lang] = [keys, n]
    for lang, (keys, n) in held.items():
        if len(keys):
            yield pa.record_batch({"lang": pa.array([lang] * len(keys)), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def train(labelled: DataFrame, share: float = SHARE, most: int = MOST) -> dict:
    """The filter from (lang, text) rows: names, table, and what false positives add per language."""
    counts = labelled.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(most)
    counts = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= share * F.col("total"))  # `most` rows
    rows = counts.select("lang", "gram").toPandas()  # at most 1 / share for each language
    names = sorted(rows["lang"].unique())
    table = np.zeros((ROWS, max(1, -(-len(names) // 64))), np.uint64)
    for k, name in enumerate(names):
        for at in _rows_of(rows.loc[rows["lang"] == name, "gram"].to_numpy().astype(np.uint32)):
            table[at, k // 64] |= np.uint64(1 << (k % 64))
    false = [float((table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) ** HASHES for k in range(len(names))]
    return {"names": names, "table": table, "false": np.array(false)}


def _rows_of(g: np.ndarray):
    h = mixed(g.astype(np.uint64) + np.uint64(0x51ED270B))
    return [((h >> np.uint64(20 * j)) & np.uint64(ROWS - 1)).astype(np.int64) for j in range(HASHES)]


def languages_of(model: dict, g: np.ndarray) -> np.ndarray:
    """The mask words of the languages that hold each n-gram."""
    out = None
    for at in _rows_of(g):
        out = model["table"][at] if out is None else out & model["table"][at]
    return out


def predict_texts(model: dict, texts: list) -> tuple[list, np.ndarray]:
    names, rows = model["names"], len(texts)
    hits, total = np.zeros((len(names), rows)), np.zeros(rows)
    for g, row in gram_chunks(texts):
        if not len(g) or not names:
            continue
        masks = languages_of(model, g)
        total += np.bincount(row, minlength=rows)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        for k in range(len(names)):
            bit = (masks[:, k // 64] >> np.uint64(k % 64)).astype(np.uint8) & 1
            np.add.at(hits[k], row[first], np.add.reduceat(bit, first, dtype=np.int64))
    if not names:
        return ["und"] * rows, np.zeros(rows)
    false = model["false"][:, None]
    true = np.maximum(0, (hits - total * false) / (1 - false))
    best = true.argmax(0)
    score = np.clip(true.max(0) / np.maximum(total, 1), 0, 1)
    lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    return [names[k] if ok else "und" for k, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def predicted(df: DataFrame, model: dict) -> DataFrame:
    """df's columns and lang_pred, score. df needs a text column."""
    held = df.sparkSession.sparkContext.broadcast(model)  # ROWS masks: a fixed size

    def run(batches):
        for batch in batches:
            lang, score = predict_texts(held.value, batch.column("text").to_pylist())
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "text"]
            names = [f.name for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    rest = [f"`{n}` {t}" for n, t in df.dtypes if n != "text"]
    return df.mapInArrow(run, ", ".join([*rest, "lang_pred string", "score double"]))


def learned(docs: DataFrame) -> dict:
    """The model from documents whose crc32(doc_id) mod 3 is not 1 and whose lang is known."""
    return train(docs.where((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = (remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    return predicted(docs.select("doc_id", held_out, "text"), learned(docs))
