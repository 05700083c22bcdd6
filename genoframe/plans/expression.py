"""Queries on expression matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as op
from .catalog import query
from .views import matrix, sql, table


def _rounded(df, column="value", digits=6):
    return df.withColumn(column, F.round(column, digits))


@query("expr_qc_samples", sql("matrix", "SELECT sample, count(value) AS numeric, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value <> 0) AS detected, sum(value) AS total, sum(value) / count(value) AS mean FROM matrix GROUP BY 1"))
def qc_samples(spark, d):
    return op.qc_samples(matrix(spark, d))


@query("expr_qc_total", sql("matrix", "SELECT count(DISTINCT feature) AS features, count(DISTINCT sample) AS samples, count(*) AS cells, 100.0::DOUBLE * count(*) FILTER (value = 0) / count(value) AS zero_percent, count(*) FILTER (value < 0) AS negative FROM matrix"))
def qc_total(spark, d):
    return op.qc_total(matrix(spark, d))


@query("expr_cpm", sql("matrix", "SELECT feature, sample, value * 1e6::DOUBLE / sum(value) OVER (PARTITION BY sample) AS value FROM matrix"))
def cpm(spark, d):
    return op.cpm(matrix(spark, d))


@query("expr_log2cpm", sql("matrix", "SELECT feature, sample, round(log2(value * 1e6::DOUBLE / sum(value) OVER (PARTITION BY sample) + 1.0::DOUBLE), 6) AS value FROM matrix"))
def log2cpm(spark, d):
    return _rounded(op.cpm(matrix(spark, d), log=True))


@query("expr_median_ratio", sql("matrix", """
WITH n AS (SELECT count(DISTINCT sample) AS n FROM matrix), g AS (SELECT feature, avg(ln(value)) AS g FROM matrix WHERE value > 0 GROUP BY 1 HAVING count(*) = (SELECT n FROM n)),
f AS (SELECT sample, median(value / exp(g)) AS f FROM matrix JOIN g USING (feature) GROUP BY 1) SELECT feature, sample, round(value / f, 4) AS value FROM matrix JOIN f USING (sample)"""))
def median_ratio(spark, d):
    return _rounded(op.median_ratio(matrix(spark, d)), digits=4)


@query("expr_zscore", sql("matrix", "SELECT feature, sample, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0), 6) + 0.0 AS value FROM matrix WINDOW w AS (PARTITION BY feature)"))
def zscore(spark, d):
    return _rounded(op.row_scaled(matrix(spark, d))).withColumn("value", F.col("value") + F.lit(0.0))


@query("expr_top_variable", sql("matrix", "SELECT feature, round(var_samp(value), 4) AS variance FROM matrix GROUP BY 1 ORDER BY var_samp(value) DESC, feature LIMIT 10"))
def top_variable(spark, d):
    return _rounded(op.top_variable(matrix(spark, d), 10), "variance", 4)


@query("expr_heatmap_distances", sql("matrix", """WITH t AS (SELECT feature FROM matrix GROUP BY 1 ORDER BY var_samp(value) DESC, feature LIMIT 10), m AS (SELECT * FROM matrix WHERE feature IN (SELECT feature FROM t))
SELECT x.feature AS a, y.feature AS b, round(1 - corr(x.value, y.value), 6) AS distance FROM m x JOIN m y ON x.sample = y.sample AND x.feature < y.feature GROUP BY 1, 2"""))
def heatmap(spark, d):
    m = matrix(spark, d)
    return _rounded(op.correlation_distances(m.join(op.top_variable(m, 10), "feature", "left_semi")), "distance")


@query("expr_pca")
def pca(spark, d):
    return op.pca(spark, matrix(spark, d))


@query("expr_kmeans")
def kmeans(spark, d):
    return op.kmeans(spark, matrix(spark, d))


@query("volcano_classes", """WITH v AS (SELECT p_partkey AS feature, p_size - 25.0::DOUBLE AS lfc, (p_retailprice::BIGINT % 100) / 100.0::DOUBLE AS padj FROM part)
SELECT feature, CASE WHEN padj <= 0.05 AND abs(lfc) >= 1 AND lfc > 0 THEN 'up' WHEN padj <= 0.05 AND abs(lfc) >= 1 THEN 'down' ELSE 'not-significant' END AS class FROM v""")
def volcano(spark, d):
    p = table(spark, d, "part")
    return op.volcano(p.select(F.col("p_partkey").alias("feature"), (F.col("p_size") - 25.0).alias("lfc"), (F.round("p_retailprice").cast("long") % 100 / F.lit(100.0)).alias("padj")), "feature")


@query("expr_adjacency", sql("matrix", """SELECT x.feature AS a, y.feature AS b, round(abs(corr(x.value, y.value)) ** 6, 6) AS weight FROM matrix x JOIN matrix y ON x.sample = y.sample AND x.feature < y.feature GROUP BY 1, 2"""))
def adjacency(spark, d):
    return _rounded(op.adjacency(matrix(spark, d)), "weight")
