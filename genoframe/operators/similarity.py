"""Operators on similarity hits (query, subject, identity, length, evalue, bits) and on domain hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("query").alias("queries"), F.count_distinct("subject").alias("subjects"), F.min("evalue").alias("min_evalue"), F.max("bits").alias("max_bits"), F.avg("identity").alias("mean_identity")
    )


def best_hits(hits: DataFrame, max_evalue: float = 1e-5, min_identity: float = 0.0) -> DataFrame:
    """The best hit of each query: least evalue, then most bits, identity and length, then the first subject.

    A minimum by a struct, so hits are reduced before the shuffle.
    """
    rows = hits.where((F.col("evalue") <= max_evalue) & (F.col("identity") >= min_identity))
    order = F.struct(F.col("evalue"), (-F.col("bits")).alias("b"), (-F.col("identity")).alias("i"), (-F.col("length")).alias("l"), F.col("subject"))
    best = rows.groupBy("query").agg(F.min(order).alias("o"))
    return best.select("query", "o.subject", "o.evalue", (-F.col("o.b")).alias("bits"), (-F.col("o.i")).alias("identity"), (-F.col("o.l")).alias("length"))


def reciprocal(forward: DataFrame, reverse: DataFrame, max_evalue: float = 1e-5, min_identity: float = 0.0) -> DataFrame:
    """(query, subject) that are each other's best hits, with the forward evalue and bits."""
    f, r = best_hits(forward, max_evalue, min_identity), best_hits(reverse, max_evalue, min_identity)
    back = r.select(F.col("query").alias("subject"), F.col("subject").alias("query"))
    return f.join(back, ["query", "subject"], "left_semi").select("query", "subject", "evalue", "bits")


def domain_counts(domains: DataFrame) -> DataFrame:
    """(source, accession, n, sequences)."""
    return domains.groupBy("source", "accession").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence").alias("sequences"))
