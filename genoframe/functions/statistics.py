"""Statistics on DataFrames: step-up correction, log factorials, hypergeometric tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running, value_bin


def bh_adjusted(df: DataFrame, p: str, tie: str, out: str = "padj") -> DataFrame:
    """df with Benjamini-Hochberg values of p.

    Equal p values have one result, that of the last of them, so the order that the tie column
    would give them does not matter: only distinct p values are counted and put in order,
    in bins of their values.
    """
    held = F.col(p).cast("double")
    rows = df.groupBy(held.alias("__q")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bin", value_bin(F.col("__q")))
    rows = running(rows, [], "__bin", [F.col("__q")], {"__k": ("sum", F.col("__n"))}, inclusive=True)
    rows = rows.crossJoin(df.agg(F.count(F.lit(1)).alias("__m")))  # one row
    rows = rows.withColumn("__v", F.least(F.lit(1.0), F.col("__q") * F.col("__m") / F.col("__k")))
    rows = running(rows, [], "__bin", [F.col("__q").desc()], {"__l": ("min", F.col("__v"))}, inclusive=True, backward=True)
    rows = rows.select("__q", F.col("__l").alias("__padj"))
    return df.join(rows, held.eqNullSafe(F.col("__q"))).select(*df.columns, F.col("__padj").alias(out))


def hypergeometric_tail(df: DataFrame, total: int) -> DataFrame:
    """df with p: the chance of `overlap` or more of `term_n` marked genes among `drawn` of `total`.

    ln k! is Stirling's series (exact to 1e-12 from 16 on, a product below), so no table
    of factorials has to be sent about; the tail is summed over its support.
    """

    def lf(x):
        x = x.cast("double")
        small = F.ln(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))
        series = x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
        return F.when(x <= 20, small).otherwise(series)

    choose = lambda a, b: lf(a) - lf(b) - lf(a - b)
    k, n, m, t = F.col("overlap"), F.col("drawn"), F.col("term_n"), F.lit(total)
    term = lambda i: F.exp(choose(m, i) + choose(t - m, n - i) - choose(t, n))
    tail = F.aggregate(F.sequence(k, F.least(n, m)), F.lit(0.0), lambda a, i: a + F.when(n - i <= t - m, term(i)).otherwise(0.0))
    return df.withColumn("p", F.least(F.lit(1.0), tail))
