"""A corpus pipeline of five stages over the documents table.

Each stage takes the documents that the one before kept, and all but the last return the
columns of documents. Between stages the documents are written as Parquet.

Defined results: documents with null columns, empty or very long texts, repeated rows and
further columns pass through the stages as their operators define; an empty table gives
an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm.common import written
from genoframe.llm.decontaminate import WINDOW, hits, verdicts
from genoframe.llm.language_id import learned, predicted
from genoframe.llm.mixing import mixed_documents
from genoframe.llm.simhash import one_of_each
from genoframe.llm.suffix_dedup import deduplicated

#: Texts of which a smaller share of n-grams is known in any language are rejected.
LEAST_SCORE = 0.1


def held(docs: DataFrame) -> DataFrame:
    """The whole rows in one column beside their texts, so no column's name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: without letters, or of hardly any known n-gram."""
    out = predicted(held(docs).select("doc", "text"), learned(docs))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints."""
    return one_of_each(docs).select(*docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; documents of which nothing else is left go."""
    rest = [c for c in docs.columns if c != "text"]
    out = deduplicated(docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), "doc_id", "text"))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    made = {c: F.col("doc").getField(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a full window of a benchmark item, however long they are.

    Training on one leaked question is enough to spoil it, so the share of words that the
    operator's own verdict asks for counts only for items shorter than a window.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = hits(held(docs), benchmark, keep=("doc",))
    full = F.exists("runs", lambda r: r["last"] - r["first"] + 1 >= WINDOW)
    found = found.withColumn("doc", F.struct("doc", full.alias("full")))
    return verdicts(found).where(~F.col("contaminated") & ~F.col("doc.full")).select("doc.doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the target proportions of their sources, each as often as it is taken."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_leaks", benchmark_leaks),
    ("mix", mix),
]

#: Shingle hashing, suffix sorting and the n-gram filter have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
