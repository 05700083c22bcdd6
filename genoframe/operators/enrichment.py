"""Enrichment of gene lists and ranked lists in terms."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import bh_adjusted, hypergeometric_tail
from .prefix import running, value_bin


def overrepresentation(genes: DataFrame, associations: DataFrame, min_overlap: int = 1) -> DataFrame:
    """(term_id, overlap, term_n, drawn, fold, p, padj) of the terms of (gene_id, term_id) rows; the universe is their genes."""
    a = associations.select("gene_id", "term_id").distinct()
    total = a.agg(F.count_distinct("gene_id")).first()[0]
    mapped = genes.select("gene_id").distinct().join(a.select("gene_id").distinct(), "gene_id", "left_semi")
    drawn = mapped.agg(F.count(F.lit(1)).alias("drawn"))
    marked = a.join(mapped.withColumn("hit", F.lit(True)), "gene_id", "left")
    terms = marked.groupBy("term_id").agg(F.count_if(F.col("hit")).alias("overlap"), F.count(F.lit(1)).alias("term_n")).where(F.col("overlap") >= min_overlap)
    rows = hypergeometric_tail(terms.crossJoin(drawn), total)  # one row
    fold = (F.col("overlap") / F.col("drawn")) / (F.col("term_n") / F.lit(total))
    return bh_adjusted(rows.withColumn("fold", fold), "p", "term_id").select("term_id", "overlap", "term_n", "drawn", "fold", "p", "padj")


def mapping(genes: DataFrame, associations: DataFrame) -> DataFrame:
    """input, mapped and unmapped genes."""
    known = associations.select("gene_id").distinct().withColumn("known", F.lit(True))
    rows = genes.select("gene_id").distinct().join(known, "gene_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("input"), F.count_if(F.col("known")).alias("mapped"), F.count_if(F.col("known").isNull()).alias("unmapped"))


def ranked(scores: DataFrame, exponent: float = 1.0) -> DataFrame:
    """(gene_id, score, rank, weight): by score descending, then id; weight is (|s| / max |s|) to the exponent.

    Rows are put in order within bins of the score, whose sizes are carried on.
    """
    top = scores.agg(F.max(F.abs("score")).alias("top"))
    rows = scores.withColumn("__bin", -value_bin(F.col("score")))
    rows = running(rows, [], "__bin", [F.desc("score"), F.asc("gene_id")], {"rank": ("sum", F.lit(1).cast("long"))}, inclusive=True).crossJoin(top)  # one row
    weight = F.pow(F.abs("score") / F.nullif(F.col("top"), F.lit(0.0)), F.lit(exponent))
    return rows.select("gene_id", "score", "rank", F.coalesce(weight, F.lit(0.0)).alias("weight"))


def enrichment_scores(scores: DataFrame, sets: DataFrame, exponent: float = 1.0, min_size: int = 15, max_size: int = 500) -> DataFrame:
    """(term_id, size, es, peak_rank): the weighted running sum's largest deviation.

    Between hits the sum only falls, so its extremes are just after and just before hits;
    only the hits of a term, max_size at most, are put in order.
    """
    r = ranked(scores, exponent)
    n = r.agg(F.count(F.lit(1)).alias("n"))
    hits = sets.select("gene_id", "term_id").distinct().join(r, "gene_id")
    sizes = hits.groupBy("term_id").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("sum_w")).where(F.col("size").between(min_size, max_size))
    w = Window.partitionBy("term_id").orderBy("rank")
    rows = hits.join(sizes, "term_id").crossJoin(n)
    share = F.when(F.col("sum_w") > 0, F.col("weight") / F.col("sum_w")).otherwise(1.0 / F.col("size"))
    rows = rows.withColumn("j", F.row_number().over(w)).withColumn("up", F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("share", share)
    miss = (F.col("rank") - F.col("j")) / F.greatest(F.col("n") - F.col("size"), F.lit(1))
    rows = rows.withColumn("after", F.col("up") - miss).withColumn("before", F.col("up") - F.col("share") - miss)
    best = rows.groupBy("term_id", "size").agg(F.max("after").alias("hi"), F.max_by("rank", F.struct("after", (-F.col("rank")).alias("r"))).alias("hi_rank"), F.min("before").alias("lo"), F.min_by(F.col("rank") - 1, F.struct("before", "rank")).alias("lo_rank"))
    positive = F.abs("hi") + 64 * 2.220446049250313e-16 >= F.abs("lo")
    return best.select("term_id", "size", F.when(positive, F.col("hi")).otherwise(F.col("lo")).alias("es"), F.when(positive, F.col("hi_rank")).otherwise(F.col("lo_rank")).cast("long").alias("peak_rank"))


def leading_edge(scores: DataFrame, sets: DataFrame, **how) -> DataFrame:
    """(term_id, gene_id): hits up to the peak of a positive score, after it of a negative one."""
    es = enrichment_scores(scores, sets, **how)
    hits = sets.select("gene_id", "term_id").distinct().join(ranked(scores, how.get("exponent", 1.0)), "gene_id")
    rows = hits.join(es, "term_id")
    return rows.where(((F.col("es") >= 0) & (F.col("rank") <= F.col("peak_rank"))) | ((F.col("es") < 0) & (F.col("rank") > F.col("peak_rank")))).select("term_id", "gene_id")


def permuted_pvalues(scores: DataFrame, sets: DataFrame, permutations: int = 1000, seed: int = 0, exponent: float = 1.0, **limits) -> DataFrame:
    """(term_id, es, p, fdr): p is (as extreme + 1) / (same sign + 1) over random sets of the same size.

    Each term has its own random numbers from the seed and its name; the weights by rank,
    one double for each gene of the list, are sent to the executors, up to 10 million.
    """
    es = enrichment_scores(scores, sets, exponent, **limits)
    r = ranked(scores, exponent)
    rows = r.orderBy("rank").limit(10_000_001).select("weight").toPandas()
    if len(rows) > 10_000_000:
        raise ValueError("too long a ranked list for permutations")
    held = scores.sparkSession.sparkContext.broadcast(rows["weight"].to_numpy())

    def one(size: int, rng, weight) -> float:
        at = np.sort(rng.choice(len(weight), size, replace=False))
        w = weight[at]
        share = w / w.sum() if w.sum() > 0 else np.full(size, 1 / size)
        miss = (at + 1 - np.arange(1, size + 1)) / max(len(weight) - size, 1)
        after = np.cumsum(share) - miss
        hi, lo = after.max(), (after - share).min()
        return hi if abs(hi) + 64 * np.finfo(float).eps >= abs(lo) else lo

    def run(batches):
        for pdf in batches:
            p = []
            for term, size, score in zip(pdf["term_id"], pdf["size"], pdf["es"]):
                rng = np.random.default_rng([seed, zlib.crc32(str(term).encode())])
                made = np.array([one(int(size), rng, held.value) for _ in range(permutations)])
                same = made[(made >= 0) == (score >= 0)]
                p.append((int((np.abs(same) >= abs(score)).sum()) + 1) / (len(same) + 1))
            yield pd.DataFrame({"term_id": pdf["term_id"], "es": pdf["es"], "p": p})

    tested = es.select("term_id", "size", "es").repartition("term_id").mapInPandas(run, "term_id string, es double, p double")
    return bh_adjusted(tested, "p", "term_id", "fdr")
