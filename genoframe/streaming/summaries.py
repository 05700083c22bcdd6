"""Streaming forms: the additive summaries over event-time windows, and first-occurrence rules within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, keys, n, total, low, high) for each window, kept open for late rows."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, size), *keys)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total", "low", "high")


def read_quality(reads: DataFrame, offset: int = 33) -> DataFrame:
    """Running totals of reads, bases and quality, as a complete-mode aggregate; ratios are taken where they are read."""
    q = F.aggregate(F.filter(F.split("qual", ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c) - offset)
    return reads.groupBy().agg(F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"), F.sum(q).alias("quality"))


def first_within(rows: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row for each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
