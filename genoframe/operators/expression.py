"""Operators on matrices in long form (feature, sample, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def qc_samples(matrix: DataFrame) -> DataFrame:
    """Per sample: numeric, missing and detected (not 0) values, total and mean."""
    v = F.col("value")
    return matrix.groupBy("sample").agg(
        F.count("value").alias("numeric"), F.count_if(v.isNull()).alias("missing"), F.count_if(v != 0).alias("detected"), F.sum("value").alias("total"), F.try_divide(F.sum("value"), F.count("value")).alias("mean")
    )


def qc_total(matrix: DataFrame) -> DataFrame:
    """features, samples, cells, zero % of numeric values, negative values."""
    v = F.col("value")
    return matrix.agg(
        F.count_distinct("feature").alias("features"), F.count_distinct("sample").alias("samples"), F.count(F.lit(1)).alias("cells"),
        F.try_divide(F.lit(100.0) * F.count_if(v == 0), F.count("value")).alias("zero_percent"), F.count_if(v < 0).alias("negative"),
    )


def cpm(matrix: DataFrame, log: bool = False, pseudocount: float = 1.0) -> DataFrame:
    """Counts per million of their sample, or log2 of these plus the pseudocount; a sample without counts is an error."""
    totals = matrix.groupBy("sample").agg(F.sum("value").alias("t"))
    t = F.when(F.col("t") == 0, F.raise_error(F.lit("sample without counts"))).otherwise(F.col("t"))
    value = F.col("value") * 1e6 / t
    return matrix.join(totals, "sample").select("feature", "sample", (F.log2(value + pseudocount) if log else value).alias("value"))


def median_ratio(matrix: DataFrame) -> DataFrame:
    """Values divided by the sample's median ratio to the features' geometric means, over features positive in all samples."""
    samples = matrix.agg(F.count_distinct("sample").alias("n_samples"))
    means = matrix.groupBy("feature").agg(F.avg(F.ln(F.nullif(F.greatest("value", F.lit(0.0)), F.lit(0.0)))).alias("g"), F.count_if(F.col("value") > 0).alias("c"))
    means = means.crossJoin(samples).where("c = n_samples").select("feature", "g")
    factors = matrix.join(means, "feature").groupBy("sample").agg(F.median(F.col("value") / F.exp("g")).alias("f"))
    return matrix.join(factors, "sample").select("feature", "sample", (F.col("value") / F.col("f")).alias("value"))


def row_scaled(matrix: DataFrame, z: bool = True) -> DataFrame:
    """Centred rows, or z-scores with n - 1; rows without spread are 0."""
    w = matrix.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.sum("value").alias("t"))
    centred = F.col("value") - F.col("m")
    value = F.when(F.coalesce(F.col("s"), F.lit(0.0)) <= 1e-12, 0.0).otherwise(centred / F.col("s")) if z else centred
    return matrix.join(w, "feature").select("feature", "sample", value.alias("value"))


def top_variable(matrix: DataFrame, n: int = 50) -> DataFrame:
    """The features of the largest variance."""
    return matrix.groupBy("feature").agg(F.var_samp("value").alias("variance")).orderBy(F.desc("variance"), "feature").limit(n)


def gram(matrix: DataFrame) -> DataFrame:
    """(a, b, g): inner products of the centred samples, of which there are few."""
    c = row_scaled(matrix, z=False)
    a, b = c.select("feature", F.col("sample").alias("a"), F.col("value").alias("x")), c.select("feature", F.col("sample").alias("b"), F.col("value").alias("y"))
    return a.join(b, "feature").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))


def pca(spark: SparkSession, matrix: DataFrame, components: int = 2, most_samples: int = 2000) -> DataFrame:
    """(sample, component, score, explained): from the samples' Gram matrix, which the driver decomposes.

    The sign makes the score of largest size positive. More samples than most_samples are an error.
    """
    rows = gram(matrix).limit(most_samples**2 + 1).collect()
    if len(rows) > most_samples**2:
        raise ValueError("too many samples for one Gram matrix")
    names = sorted({r.a for r in rows})
    index = {n: i for i, n in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    for r in rows:
        g[index[r.a], index[r.b]] = r.g
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    out = []
    for k in range(min(components, len(names))):
        value, v = max(values[-1 - k], 0.0), vectors[:, -1 - k]
        v = v if v[np.abs(v).argmax()] > 0 else -v
        out += [(names[i], k + 1, float(v[i] * np.sqrt(value)), float(value / max(values.sum(), 1e-300))) for i in range(len(names))]
    return spark.createDataFrame(out, "sample string, component int, score double, explained double")


def kmeans_rows(x: np.ndarray, k: int, most: int = 100) -> np.ndarray:
    """Clusters from the row of largest norm, then the farthest each time; ties to the lower index."""
    centres = [x[(x**2).sum(1).argmax()]]
    while len(centres) < k:
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    c, label = np.array(centres), None
    for _ in range(most):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        new = d.argmin(1)
        for empty in sorted(set(range(k)) - set(new.tolist())):
            new[d[np.arange(len(x)), new].argmax()] = empty
        if label is not None and (new == label).all():
            break
        label = new
        c = np.array([x[label == i].mean(0) for i in range(k)])
    return label


#: Samples of a clustered matrix, and features that all pairs are made of, at most.
MOST_SAMPLES, MOST_FEATURES = 10_000, 20_000


def kmeans(spark: SparkSession, matrix: DataFrame, k: int = 4, most: int = 100) -> DataFrame:
    """(feature, cluster) by exact k-means as kmeans_rows() has it: features are vectors of their samples, missing values 0.

    The features stay on the executors: each step sends the k centres out and brings back
    one row for each cluster.
    """
    names = sorted(r[0] for r in matrix.select("sample").distinct().limit(MOST_SAMPLES + 1).collect())
    if len(names) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    held = F.map_from_entries(F.collect_list(F.struct("sample", F.coalesce("value", F.lit(0.0)).alias("value"))))
    rows = matrix.groupBy("feature").agg(held.alias("m")).select("feature", F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in names]).alias("x")).persist()

    def far(c) -> Column:
        return F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)

    first = lambda value: rows.select("feature", "x", value.alias("v")).orderBy(F.desc("v"), "feature").limit(1).collect()
    start = first(far([0.0] * len(names)))
    if not start:
        return spark.createDataFrame([], "feature string, cluster int")
    centres = [start[0].x]
    while len(centres) < min(k, rows.count()):
        centres.append(first(F.least(*[far(c) for c in centres]) if len(centres) > 1 else far(centres[0]))[0].x)
    last = None
    for _ in range(most):
        distances = F.array(*[far(c) for c in centres])
        made = rows.select("feature", "x", distances.alias("d")).select("feature", "x", F.array_min("d").alias("v"), (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("cluster"))
        empty = sorted(set(range(len(centres))) - {r[0] for r in made.select("cluster").distinct().collect()})
        moved = {r.feature: e for r, e in zip(made.orderBy(F.desc("v"), "feature").limit(len(empty)).collect(), empty)} if empty else {}
        cluster = F.col("cluster")
        for f, e in moved.items():
            cluster = F.when(F.col("feature") == f, e).otherwise(cluster)
        made = made.select("feature", "x", cluster.cast("int").alias("cluster"))
        means = made.groupBy("cluster").agg(F.sum(F.xxhash64("feature").cast("decimal(38,0)")).alias("h"), *[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(names))]).orderBy("cluster").collect()  # k rows
        now = [(r.cluster, r.h) for r in means]
        if now == last:
            break
        last, by = now, {r.cluster: [r[f"m{i}"] for i in range(len(names))] for r in means}
        centres = [by.get(i, centres[i]) for i in range(len(centres))]
    return made.select("feature", "cluster")


def _few(matrix: DataFrame) -> DataFrame:
    """matrix, unless it has more than MOST_FEATURES features."""
    if matrix.select("feature").distinct().limit(MOST_FEATURES + 1).count() > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features: choose the most variable ones first")
    return matrix


def correlation_distances(matrix: DataFrame) -> DataFrame:
    """(a, b, distance): 1 - Pearson correlation of features a < b; the result has a row for each pair, of MOST_FEATURES features at most."""
    matrix = _few(matrix)
    x, y = matrix.select(F.col("feature").alias("a"), "sample", F.col("value").alias("x")), matrix.select(F.col("feature").alias("b"), "sample", F.col("value").alias("y"))
    rows = x.join(y, "sample").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))
    return rows.select("a", "b", (1 - F.col("r")).alias("distance"))


def volcano(df: DataFrame, order: str, padj: float = 0.05, log2_fold_change: float = 1.0, max_points: int | None = None) -> DataFrame:
    """(feature, class): up, down or not significant, of rows with finite values and padj in 0..1; max_points cuts in the order."""
    rows = df.orderBy(order).limit(max_points) if max_points else df
    ok = F.col("lfc").isNotNull() & ~F.isnan("lfc") & (F.abs("lfc") != float("inf")) & F.col("padj").between(0, 1)
    strong = (F.col("padj") <= padj) & (F.abs("lfc") >= log2_fold_change)
    return rows.where(ok).select("feature", F.when(strong & (F.col("lfc") > 0), "up").when(strong, "down").otherwise("not-significant").alias("class"))


def adjacency(matrix: DataFrame, power: int = 6) -> DataFrame:
    """(a, b, weight): |correlation| to a power between features a < b, as a soft-threshold network has it."""
    return correlation_distances(matrix).select("a", "b", F.pow(F.abs(1 - F.col("distance")), power).alias("weight"))

