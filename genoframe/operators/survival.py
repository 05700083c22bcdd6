"""Kaplan-Meier estimates, the log-rank test and proportional hazards."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running

#: Groups that a log-rank test compares at most, and covariates of one model.
MOST_GROUPS, MOST_COVARIATES = 100, 50


def curve(cohort: DataFrame) -> DataFrame:
    """(group, time, at_risk, events, survival) at each time of (group, time, event) with an event.

    Rows are counted by time first; the windows are over distinct times.
    """
    times = cohort.groupBy("group", "time").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("events"))
    onward = Window.partitionBy("group").orderBy("time").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    upto = Window.partitionBy("group").orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = times.withColumn("at_risk", F.sum("n").over(onward)).where("events > 0")
    kept = 1 - F.col("events") / F.col("at_risk")
    dead = F.max(F.when(kept <= 0, 1).otherwise(0)).over(upto)
    survival = F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.when(kept > 0, F.ln(kept)).otherwise(0.0)).over(upto)))
    return rows.select("group", "time", "at_risk", "events", survival.alias("survival"))


def medians(cohort: DataFrame) -> DataFrame:
    """(group, n, events, median): the first time at which survival is a half or less, null if it never is."""
    sizes = cohort.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("events"))
    half = curve(cohort).where(F.col("survival") <= 0.5 + 1e-12).groupBy("group").agg(F.min("time").alias("median"))
    return sizes.join(half, "group", "left").select("group", "n", "events", "median")


def chi_square_tail(x: float, df: int) -> float:
    """The chance of x or more with df degrees of freedom, by the recurrence from one or two."""
    if x <= 0 or df < 1:
        return 1.0
    a, h = (0.5, math.erfc(math.sqrt(x / 2))) if df % 2 else (1.0, math.exp(-x / 2))
    while a < df / 2:
        h += math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1))
        a += 1
    return min(1.0, h)


def at_risk(cohort: DataFrame) -> DataFrame:
    """(group, time, d, n, dt, nt) at each time with an event: events and members at risk of the group, and of all groups."""
    names = [r[0] for r in cohort.select("group").distinct().limit(MOST_GROUPS + 1).collect()]
    if len(names) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    counts = cohort.groupBy("group", "time").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("event").cast("long")).alias("d"))
    kind = cohort.schema["group"].dataType
    groups = F.array(*[F.lit(n).cast(kind) for n in names]) if names else F.array().cast(f"array<{kind.simpleString()}>")
    grid = counts.select("time").distinct().select("time", F.explode(groups).alias("group"))
    rows = grid.join(counts, ["group", "time"], "left").select("group", "time", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("c", "d")])
    onward = Window.partitionBy("group").orderBy("time").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # over distinct times
    rows = rows.withColumn("n", F.sum("c").over(onward))
    totals = rows.groupBy("time").agg(F.sum("d").alias("dt"), F.sum("n").alias("nt")).where("dt > 0")
    return rows.join(totals, "time").select("group", "time", "d", "n", "dt", "nt")


def log_rank_groups(cohort: DataFrame) -> DataFrame:
    """(group, observed, expected): events of (group, time, event) rows, and those expected if all groups were alike."""
    return at_risk(cohort).groupBy("group").agg(F.sum("d").alias("observed"), F.sum(F.col("dt") * F.col("n") / F.col("nt")).alias("expected"))


def log_rank(cohort: DataFrame) -> DataFrame:
    """One row: chi2, df and p of the log-rank test over the groups."""
    rows = at_risk(cohort)
    sums = {r.group: (r.observed, r.expected) for r in rows.groupBy("group").agg(F.sum("d").alias("observed"), F.sum(F.col("dt") * F.col("n") / F.col("nt")).alias("expected")).collect()}
    scale = F.col("dt") * (F.col("nt") - F.col("dt")) / F.greatest(F.col("nt") - 1, F.lit(1))
    share = F.col("n") / F.col("nt")
    a, b = rows.select("time", F.col("group").alias("a"), share.alias("x"), scale.alias("s")), rows.select("time", F.col("group").alias("b"), share.alias("y"))
    cross = a.join(b, "time").groupBy("a", "b").agg(F.sum(F.col("s") * F.when(F.col("a").eqNullSafe(F.col("b")), F.col("x") * (1 - F.col("x"))).otherwise(-F.col("x") * F.col("y"))).alias("v")).collect()
    names = list(sums)
    index = {g: i for i, g in enumerate(names)}
    v = np.zeros((len(names), len(names)))
    for r in cross:
        v[index[r.a], index[r.b]] = r.v
    u = np.array([sums[g][0] - sums[g][1] for g in names])
    df = max(0, len(names) - 1)
    chi2 = float(u[:-1] @ np.linalg.pinv(v[:-1, :-1]) @ u[:-1]) if df else 0.0
    return cohort.sparkSession.createDataFrame([(chi2, df, chi_square_tail(chi2, df))], "chi2 double, df int, p double")


def cox(cohort: DataFrame, covariates: list[str], steps: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """(covariate, coefficient, hazard_ratio, se, z, p) of the proportional hazards of (time, event) rows; ties as Efron has them.

    A step of Newton's method sums risks by distinct time on the executors, runs them over the
    later times, and brings one row of sums to the driver; rows with a null are left out.
    """
    k = len(covariates)
    if not 0 < k <= MOST_COVARIATES:
        raise ValueError(f"one to {MOST_COVARIATES} covariates")
    rows = cohort.select(F.col("time").cast("double").alias("time"), F.col("event").cast("boolean").alias("event"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    stats = rows.agg(F.min("time").alias("low"), F.max("time").alias("high"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(k)]).first()
    if stats.low is None:
        raise ValueError("no complete rows")
    width = max((stats.high - stats.low) / 256, 1e-300)
    rows = rows.select("time", "event", *[(F.col(f"x{i}") - stats[f"x{i}"]).alias(f"x{i}") for i in range(k)])  # centred
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["s", *[f"s{i}" for i in range(k)], *[f"s{i}_{j}" for i, j in pairs]]
    beta, before = np.zeros(k), -math.inf
    for _ in range(steps):
        risk = F.exp(sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0)))
        values = [risk, *[risk * F.col(f"x{i}") for i in range(k)], *[risk * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs]]
        died = lambda c: F.sum(F.when(F.col("event"), c).otherwise(0.0))
        times = rows.groupBy("time").agg(
            F.sum(F.col("event").cast("int")).alias("d"), *[F.sum(v).alias(n) for n, v in zip(names, values)], *[died(v).alias(f"d{n}") for n, v in zip(names, values)], *[died(F.col(f"x{i}")).alias(f"e{i}") for i in range(k)],
        ).withColumn("k", F.lit(0)).withColumn("bin", F.floor((F.col("time") - stats.low) / width))
        times = running(times, ["k"], "bin", [F.desc("time")], {f"r{n}": ("sum", F.col(n)) for n in names}, inclusive=True, backward=True).where("d > 0")
        each = times.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("d") - 1)))
        part = F.col("l") / F.col("d")
        of = lambda n: F.col(f"r{n}") - part * F.col(f"d{n}")
        mean = lambda n: of(n) / of("s")
        gradient = [F.sum(F.col(f"e{i}") / F.col("d") - mean(f"s{i}")).alias(f"g{i}") for i in range(k)]
        hessian = [F.sum(mean(f"s{i}_{j}") - mean(f"s{i}") * mean(f"s{j}")).alias(f"h{i}_{j}") for i, j in pairs]
        weighted = sum((F.lit(float(b)) * F.col(f"e{i}") / F.col("d") for i, b in enumerate(beta)), F.lit(0.0))
        r = each.agg(F.sum(weighted - F.ln(of("s"))).alias("loglik"), *gradient, *hessian).first()
        if r.loglik is None:
            raise ValueError("no events")
        g, h = np.array([r[f"g{i}"] for i in range(k)]), np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        if abs(r.loglik - before) <= tolerance * (abs(r.loglik) + tolerance):
            break
        before = r.loglik
        beta = beta + np.linalg.pinv(h) @ g
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h)), 0))
    out = [(c, float(b), float(math.exp(b)), float(e), float(b / e) if e else None, math.erfc(abs(b / e) / math.sqrt(2)) if e else None) for c, b, e in zip(covariates, beta, se)]
    return cohort.sparkSession.createDataFrame(out, "covariate string, coefficient double, hazard_ratio double, se double, z double, p double")
