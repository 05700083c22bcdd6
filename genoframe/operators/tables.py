"""Operators on delimited tables of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that count as missing in cohort tables, a fixed list.
COHORT_MISSING = ("", "na", "nan", "null", ".")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def filtered(column: str, op: str, value: str | None = None) -> Column:
    """equals, contains (both case-sensitive) or non-empty (after trimming)."""
    c = F.col(column)
    if op == "equals":
        return c == value
    if op == "contains":
        return c.contains(value)
    if op == "non-empty":
        return F.length(F.trim(c)) > 0
    raise ValueError(f"unknown filter {op}")


def manipulate(df: DataFrame, order: str, select=None, drop=None, filter_column=None, filter_op=None, filter_value=None, skip_rows: int = 0, limit: int | None = None) -> DataFrame:
    """Skips rows, then filters, then limits, in the order of a unique column; selects in the requested order or drops.

    The first rows are found by their bounded top-k, so no total sort is made.
    """
    if select and drop:
        raise ValueError("select and drop exclude each other")
    out = df
    if skip_rows:
        skipped = df.select(F.col(order).alias("__o")).orderBy("__o").limit(skip_rows).agg(F.max("__o").alias("__last"))
        out = df.join(F.broadcast(skipped), F.col(order) > F.col("__last")).drop("__last")  # one row
    if filter_op:
        out = out.where(filtered(filter_column, filter_op, filter_value))
    if limit is not None:
        out = out.orderBy(order).limit(limit)
    return out.select(*select) if select else out.drop(*(drop or []))


def manipulate_summary(df: DataFrame, order: str, filter_column=None, filter_op=None, filter_value=None, skip_rows: int = 0, limit: int | None = None) -> DataFrame:
    """input_rows, skipped_rows, filtered_rows (removed by the filter), output_rows."""
    total = df.agg(F.count(F.lit(1)).alias("input_rows"))
    kept = manipulate(df, order, filter_column=filter_column, filter_op=filter_op, filter_value=filter_value, skip_rows=skip_rows).agg(F.count(F.lit(1)).alias("kept"))
    skipped = F.least("input_rows", F.lit(skip_rows))
    shown = F.col("kept") if limit is None else F.least("kept", F.lit(limit))
    return total.crossJoin(kept).select("input_rows", skipped.cast("long").alias("skipped_rows"), (F.col("input_rows") - skipped - F.col("kept")).alias("filtered_rows"), shown.cast("long").alias("output_rows"))


def cohort_qc(df: DataFrame) -> DataFrame:
    """Per column: present, missing, missing %, distinct present values, numeric values and their range."""
    long = df.unpivot([], df.columns, "column", "value").withColumn("value", F.trim(F.coalesce("value", F.lit(""))))
    missing = F.lower("value").isin(*COHORT_MISSING)
    number = F.when(~missing & F.col("value").rlike(NUMBER), F.col("value").try_cast("double"))
    by_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    out = by_value.groupBy("column").agg(
        F.sum(F.when(missing, 0).otherwise(F.col("n"))).alias("present"), F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("missing"), F.count_if(~missing).alias("distinct"),
        F.sum(F.when(number.isNotNull(), F.col("n")).otherwise(0)).alias("numeric"), F.min(number).alias("min"), F.max(number).alias("max"),
    )
    return out.select("column", "present", "missing", (F.lit(100.0) * F.col("missing") / (F.col("present") + F.col("missing"))).alias("missing_pct"), "distinct", "numeric", "min", "max")


def duplicates(df: DataFrame) -> DataFrame:
    """rows and duplicate_rows (rows less distinct rows)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def export_columns(df: DataFrame) -> DataFrame:
    """Columns in sorted order; nested values as JSON text; integers that a double cannot hold exactly as text."""
    out = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("struct", "array", "map"):
            c = F.to_json(c)
        elif kind == "long":
            c = F.when(F.abs(c) <= 2**53, c.cast("string")).otherwise(F.concat(F.lit("'"), c.cast("string")))
        out.append(c.alias(f.name))
    return df.select(*out)


def membership(long: DataFrame, names: list[str]) -> DataFrame:
    """(item, mask) of (set, item) rows: bit i is set if the item is in names[i]; at most 64 sets."""
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("set")) - 1
    rows = long.select(F.trim("item").alias("item"), index.cast("int").alias("i")).where("item <> '' AND i >= 0")
    return rows.groupBy("item").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("mask"))


def exclusive_intersections(long: DataFrame, names: list[str]) -> DataFrame:
    """Per combination of sets the items in exactly these: (mask, sets, degree, n)."""
    regions = membership(long, names).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))
    inside = F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return regions.select("mask", F.array_join(inside, "&").alias("sets"), F.bit_count("mask").cast("long").alias("degree"), "n")


def upset_top(long: DataFrame, names: list[str], max_intersections: int) -> DataFrame:
    """The largest exclusive intersections: by count, then degree, both descending, then name."""
    top = exclusive_intersections(long, names).orderBy(F.desc("n"), F.desc("degree"), "sets").limit(max_intersections)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.desc("degree"), "sets"))  # over max_intersections rows
    return top.select(rank.cast("long").alias("rank"), "sets", "degree", "n")


def set_sizes(long: DataFrame) -> DataFrame:
    return long.select("set", F.trim("item").alias("item")).where("item <> ''").distinct().groupBy("set").agg(F.count(F.lit(1)).alias("n"))
