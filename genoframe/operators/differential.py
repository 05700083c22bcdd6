"""Differential expression of counts by negative-binomial models and Wald tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import bh_adjusted

#: Samples of a design, and features whose dispersions the trend is fitted to, at most.
MOST_SAMPLES, TREND_FEATURES = 5_000, 200_000
LOW, HIGH = 1e-8, 10.0


def size_factors(counts: DataFrame) -> dict:
    """Each sample's median ratio to the features' geometric means, over features positive in all samples."""
    n = counts.select("sample").distinct().count()
    if n > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples")
    means = counts.groupBy("feature").agg(F.avg(F.ln(F.nullif("value", F.lit(0.0)))).alias("g"), F.count_if(F.col("value") > 0).alias("c")).where(F.col("c") == n)
    rows = counts.join(means, "feature").groupBy("sample").agg(F.median(F.col("value") / F.exp("g")).alias("f")).collect()
    if len(rows) < n:
        raise ValueError("no feature is positive in all samples")
    return {r["sample"]: float(r.f) for r in rows}


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _loglik(y: np.ndarray, mu: np.ndarray, alpha: float) -> float:
    r = 1 / alpha
    return float((_LGAMMA(y + r) - math.lgamma(r) - _LGAMMA(y + 1) + r * np.log(r / (r + mu)) + np.where(y > 0, y * np.log(mu / (r + mu)), 0)).sum())


def fitted(y: np.ndarray, x: np.ndarray, factors: np.ndarray, alpha: float, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients on the log scale, means and covariance of a negative-binomial model with a dispersion, by reweighted least squares."""
    mu = np.maximum(y, 0.5)
    beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 1e-6
    for _ in range(steps):
        w = mu / (1 + alpha * mu)
        z = np.log(mu / factors) + (y - mu) / mu
        new = np.linalg.solve((x.T * w) @ x + ridge, (x.T * w) @ z)
        mu = np.maximum(factors * np.exp(np.clip(x @ new, -30, 30)), 1e-6)
        done, beta = np.abs(new - beta).max() < 1e-8, new
        if done:
            break
    w = mu / (1 + alpha * mu)
    return beta, mu, np.linalg.inv((x.T * w) @ x + ridge)


def dispersion(y: np.ndarray, x: np.ndarray, factors: np.ndarray, prior: tuple[float, float] | None = None, alpha: float = 0.1) -> float:
    """The dispersion of largest adjusted profile likelihood, with a log-normal prior (mean of the log, variance) if given."""
    _, mu, _ = fitted(y, x, factors, alpha)

    def value(t: float) -> float:
        a = math.exp(t)
        w = mu / (1 + a * mu)
        out = _loglik(y, mu, a) - 0.5 * np.linalg.slogdet((x.T * w) @ x)[1]
        return out - ((t - prior[0]) ** 2 / (2 * prior[1]) if prior else 0.0)

    low, high, golden = math.log(LOW), math.log(HIGH), (math.sqrt(5) - 1) / 2
    grid = np.linspace(low, high, 24)
    best = int(np.argmax([value(t) for t in grid]))
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    for _ in range(24):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if value(a) > value(b) else (a, high)
    return math.exp((low + high) / 2)


def trend(mean: np.ndarray, alpha: np.ndarray) -> tuple[float, float]:
    """(a0, a1) of dispersion = a0 + a1 / mean: a gamma fit by reweighted least squares over what is not far off it."""
    a0, a1 = 0.1, 1.0
    ok = alpha > 100 * LOW
    for _ in range(20):
        expected = a0 + a1 / mean
        use = ok & (alpha / expected > 1e-4) & (alpha / expected < 15)
        if use.sum() < 3:
            break
        w = 1 / expected[use] ** 2
        x = np.stack([np.ones(use.sum()), 1 / mean[use]], 1)
        b = np.linalg.lstsq(x * np.sqrt(w)[:, None], alpha[use] * np.sqrt(w), rcond=None)[0]
        new = max(float(b[0]), 1e-6), max(float(b[1]), 1e-6)
        if abs(math.log(new[0] / a0)) + abs(math.log(new[1] / a1)) < 1e-6:
            break
        a0, a1 = new
    return a0, a1


def wald(counts: DataFrame, design: DataFrame, reference: str, most_trend: int = TREND_FEATURES) -> DataFrame:
    """(feature, base_mean, log2_fold_change, lfc_se, stat, p, padj) of (feature, sample, value) counts and a (sample, condition) design of two conditions.

    Each feature has a dispersion by adjusted profile likelihood, pulled to a trend over means
    (fitted on `most_trend` features at most, those with the least hash), and a Wald test of
    the other condition against the reference. A feature is a row of its samples, so a task
    holds one at a time; features without counts have null results and no part in padj.
    """
    spark = counts.sparkSession
    condition = {r["sample"]: r.condition for r in design.select("sample", "condition").limit(MOST_SAMPLES + 1).collect()}
    levels = sorted(set(condition.values()))
    if len(levels) != 2 or reference not in levels:
        raise ValueError("the design needs two conditions, one of them the reference")
    counts = counts.where(F.col("sample").isin(*condition)).select("feature", "sample", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    factors = size_factors(counts)
    samples = sorted(factors)
    f = np.array([factors[s] for s in samples])
    x = np.stack([np.ones(len(samples)), np.array([condition[s] != reference for s in samples], float)], 1)
    if len(samples) <= 2 or min(x[:, 1].sum(), (1 - x[:, 1]).sum()) < 1:
        raise ValueError("each condition needs samples, and there must be three or more")
    held = F.map_from_entries(F.collect_list(F.struct("sample", "value")))
    rows = counts.groupBy("feature").agg(held.alias("m")).select("feature", F.array(*[F.coalesce(F.try_element_at("m", F.lit(s)), F.lit(0.0)) for s in samples]).alias("y"))
    kind = counts.schema["feature"].dataType.simpleString()

    def own(batches):
        for pdf in batches:
            y = [np.asarray(v, float) for v in pdf["y"]]
            alpha = [dispersion(v, x, f) if v.any() else float("nan") for v in y]
            yield pd.DataFrame({"feature": pdf["feature"], "y": pdf["y"], "mean": [float((v / f).mean()) for v in y], "alpha": alpha})

    single = rows.mapInPandas(own, f"feature {kind}, y array<double>, mean double, alpha double").persist()
    picked = single.where("mean > 0").orderBy(F.xxhash64("feature")).limit(most_trend).select("mean", "alpha").toPandas()
    if not len(picked):
        a0, a1, variance = 0.1, 1.0, 1.0
    else:
        a0, a1 = trend(picked["mean"].to_numpy(), picked["alpha"].to_numpy())
        off = np.log(picked["alpha"]) - np.log(a0 + a1 / picked["mean"])
        off = off[picked["alpha"] > 100 * LOW]
        spread = (1.4826 * float(np.median(np.abs(off - np.median(off))))) ** 2 if len(off) else 1.0
        # the sampling variance of a log dispersion, about 2 / degrees of freedom, is not the prior's
        variance = max(0.25, spread - 2 / (len(samples) - 2))

    def tested(batches):
        for pdf in batches:
            out = []
            for feature, values, mean, alpha in zip(pdf["feature"], pdf["y"], pdf["mean"], pdf["alpha"]):
                y = np.asarray(values, float)
                if not mean > 0:
                    out.append((feature, 0.0, None, None, None, None))
                    continue
                a = dispersion(y, x, f, (math.log(a0 + a1 / mean), variance), alpha)
                beta, _, covariance = fitted(y, x, f, a)
                se = math.sqrt(covariance[1, 1])
                out.append((feature, mean, beta[1] / math.log(2), se / math.log(2), beta[1] / se, math.erfc(abs(beta[1] / se) / math.sqrt(2))))
            yield pd.DataFrame(out, columns=["feature", "base_mean", "log2_fold_change", "lfc_se", "stat", "p"])

    made = single.mapInPandas(tested, f"feature {kind}, base_mean double, log2_fold_change double, lfc_se double, stat double, p double").persist()
    adjusted = bh_adjusted(made.where("p IS NOT NULL"), "p", "feature")
    return adjusted.unionByName(made.where("p IS NULL").withColumn("padj", F.lit(None).cast("double")))
