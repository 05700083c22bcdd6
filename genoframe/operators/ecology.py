"""Diversity of taxa, barcodes of spots, peaks of spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .enrichment import ranked


def alpha_diversity(taxa: DataFrame) -> DataFrame:
    """Per sample of (sample, taxon, n): richness, Shannon index (ln), Pielou evenness (null for one taxon)."""
    own = taxa.where("n > 0").groupBy("sample", "taxon").agg(F.sum("n").alias("n"))
    totals = own.groupBy("sample").agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    out = own.join(totals, "sample").groupBy("sample").agg(F.count(F.lit(1)).alias("richness"), (-F.sum(p * F.ln(p))).alias("shannon"))
    return out.withColumn("evenness", F.when(F.col("richness") > 1, F.col("shannon") / F.ln("richness")))


def top_taxa(taxa: DataFrame, n: int = 5) -> DataFrame:
    return taxa.groupBy("taxon").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "taxon").limit(n)


def barcode_ranks(spots: DataFrame) -> DataFrame:
    """(rank, barcode, counts, genes) of (barcode, gene, n): by counts descending, then barcode; each with its own number of genes."""
    totals = spots.where("n > 0").groupBy("barcode", "gene").agg(F.sum("n").alias("n")).groupBy("barcode").agg(F.sum("n").alias("counts"), F.count(F.lit(1)).alias("genes"))
    order = ranked(totals.select(F.col("barcode").alias("gene_id"), F.col("counts").cast("double").alias("score")))
    return totals.join(order, totals["barcode"] == order["gene_id"]).select("rank", "barcode", "counts", "genes")


def barcode_percentiles(spots: DataFrame, fractions=(0.25, 0.5, 0.75)) -> DataFrame:
    """(fraction, counts): nearest rank, at round((n - 1) * fraction) of the ascending counts."""
    by_rank = barcode_ranks(spots)
    n = by_rank.agg(F.count(F.lit(1)).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), (F.col("n") - F.round((F.col("n") - 1) * F.lit(f)).cast("long")).alias("rank")) for f in fractions])).alias("w")
    return n.select(wanted).select("w.*").join(by_rank, "rank").select("fraction", "counts")


def local_maxima(trace: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose value is above 0, above the one before and not below the next; the ends of a trace are none."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = trace.withColumn("__a", F.lag("value").over(w)).withColumn("__b", F.lead("value").over(w))
    return rows.where((F.col("value") > 0) & (F.col("value") > F.col("__a")) & (F.col("value") >= F.col("__b"))).drop("__a", "__b")
