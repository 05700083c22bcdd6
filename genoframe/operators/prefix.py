"""Running aggregates that no single task holds a whole key for.

A window partitioned by one key puts all its rows into one task. Here rows also have a
bin that follows the order; bins are aggregated first, the totals of earlier bins of the
key are carried over (one row a bin), and only rows of one bin are put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_bin(value: Column, steps: int = 256) -> Column:
    """A whole number that ascends with a double: `steps` bins between a number and its double, on either side of 0.

    It is a function of the value alone, so every use of the rows sees the same bins; sampled
    range bounds and numbers of partitions differ between two uses.
    """
    size = F.abs(value)
    octave = F.floor(F.log2(size))  # one off beside a power of two does no harm: the bins still ascend
    bin_ = (octave + 1100) * steps + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * steps)
    return F.when(value.isNull(), None).when(size > 0, F.when(value < 0, -bin_).otherwise(bin_)).otherwise(0).cast("long")


def running(df: DataFrame, keys: list[str], bin_column: str, order: list[Column], of: dict[str, tuple[str, Column]], inclusive: bool = False, backward: bool = False) -> DataFrame:
    """df with a column for each of `of`: {name: ("sum" | "max" | "min", value)} over the key's rows before.

    Bins ascend with `order` (descend if backward, where order must be given reversed).
    Sums without a row are 0, extremes null.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}
    held = df.withColumns({f"__v_{n}": v for n, (_, v) in of.items()})
    totals = held.groupBy(*keys, bin_column).agg(*[agg[f](f"__v_{n}").alias(f"__t_{n}") for n, (f, _) in of.items()])
    by_bin = F.col(bin_column).desc() if backward else F.col(bin_column).asc()
    over_bins = Window.partitionBy(*keys).orderBy(by_bin).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"__k_{k}") for k in [*keys, bin_column]], *[agg[f](f"__t_{n}").over(over_bins).alias(f"__c_{n}") for n, (f, _) in of.items()])
    inside = Window.partitionBy(*keys, bin_column).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    held = held.withColumns({f"__w_{n}": agg[f](f"__v_{n}").over(inside) for n, (f, _) in of.items()})
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in [*keys, bin_column]]
    held = held.join(carried, on)

    def both(n: str, f: str) -> Column:
        w, c = F.col(f"__w_{n}"), F.col(f"__c_{n}")
        if f == "sum":
            return F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0))
        better = F.when(w >= c, w).otherwise(c) if f == "max" else F.when(w <= c, w).otherwise(c)
        return F.when(w.isNull(), c).when(c.isNull(), w).otherwise(better)

    return held.select(*df.columns, *[both(n, f).alias(n) for n, (f, _) in of.items()])
