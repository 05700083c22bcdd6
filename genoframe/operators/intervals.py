"""Operators on half-open intervals (contig, start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running

#: Positions per bin; a hot contig is spread over its bins.
BIN = 1 << 14


def _bin(position, width: int):
    return F.floor(position / F.lit(width)).cast("long")


def range_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """All pairs that overlap: l.start < r.end and r.start < l.end on one contig.

    Both sides are dealt to the bins they touch, and a pair is kept in the first bin
    that both touch. Columns of the left get the prefix l_, of the right r_.
    """
    sides = []
    for df, p in ((left, "l_"), (right, "r_")):
        cut = df.select(*[F.col(c).alias(p + c) for c in df.columns])
        bins = F.sequence(_bin(F.col(f"{p}start"), width), _bin(F.col(f"{p}end") - 1, width))
        sides.append(cut.withColumn(f"{p}bin", F.explode(bins)))
    a, b = sides
    near = (F.col("l_contig") == F.col("r_contig")) & (F.col("l_bin") == F.col("r_bin"))
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    first = F.col("l_bin") == _bin(F.greatest("l_start", "r_start"), width)
    return a.join(b, near & meet & first).drop("l_bin", "r_bin")


def overlap_pairs(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """(contig, ls, le, rs, re, bases) of each overlapping pair; touching intervals do not overlap."""
    out = range_join(left.select("contig", "start", "end"), right.select("contig", "start", "end"), width)
    bases = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    return out.select(F.col("l_contig").alias("contig"), F.col("l_start").alias("ls"), F.col("l_end").alias("le"), F.col("r_start").alias("rs"), F.col("r_end").alias("re"), bases.alias("bases"))


def _distinct(df: DataFrame) -> DataFrame:
    """(contig, start, end, n): equal intervals are one row. They are their own key: no generated id is joined on."""
    return df.groupBy("contig", "start", "end").agg(F.count(F.lit(1)).alias("n"))


def _counted(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """(left, contig, start, end, n, pairs, bases) of the distinct intervals of both sides.

    No pair is made. With S(x) the other side's starts below x and E(x) its ends up to x, an
    interval overlaps S(end) - E(start) others; the bases up to x are running sums too. One
    pass over the starts and ends of both sides, ends first at each place, has all of them.
    """
    both = _distinct(left).withColumn("left", F.lit(True)).unionByName(_distinct(right).withColumn("left", F.lit(False)))
    marks = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("end").alias("at"), F.lit(0).alias("kind")))
    rows = both.withColumn("m", F.explode(marks)).select("*", F.col("m.at").alias("at"), F.col("m.kind").alias("kind")).drop("m").withColumn("bin", _bin(F.col("at"), width))
    sums = {}
    for side, own in (("l", F.col("left")), ("r", ~F.col("left"))):
        for kind, name in ((1, "s"), (0, "e")):
            here = own & (F.col("kind") == kind)
            sums |= {f"{side}{name}0": ("sum", F.when(here, F.col("n")).otherwise(0)), f"{side}{name}1": ("sum", F.when(here, F.col("n") * F.col("at")).otherwise(0))}
    rows = running(rows, ["contig"], "bin", [F.col("at"), F.col("kind")], sums)
    other = lambda c: F.when(F.col("left"), F.col(f"r{c}")).otherwise(F.col(f"l{c}"))
    covered = other("s0") * F.col("at") - other("s1") - other("e0") * F.col("at") + other("e1")
    end = F.col("kind") == 0
    return rows.groupBy("left", "contig", "start", "end", "n").agg(
        F.sum(F.when(end, other("s0")).otherwise(-other("e0"))).alias("pairs"), F.sum(F.when(end, covered).otherwise(-covered)).alias("bases"),
    )


def overlap_counts(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """left with the number of right intervals that each overlaps, and the bases of all overlaps."""
    found = _counted(left, right, width).where("left").select("contig", "start", "end", "pairs", "bases")
    return left.join(found, ["contig", "start", "end"])


def intersect_by_contig(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Per contig: intervals of each side, pairs, intervals with a partner, and overlapping bases (a base counts once for each pair)."""
    rows = _counted(left, right, width)
    of = lambda rule, value: F.coalesce(F.sum(F.when(rule, value)), F.lit(0)).cast("long")
    own, hit = F.col("left"), F.col("pairs") > 0
    return rows.groupBy("contig").agg(
        of(own, F.col("n")).alias("left_n"), of(~own, F.col("n")).alias("right_n"), of(own, F.col("n") * F.col("pairs")).alias("pairs"),
        of(own & hit, F.col("n")).alias("left_hit"), of(~own & hit, F.col("n")).alias("right_hit"), of(own, F.col("n") * F.col("bases")).alias("bases"),
    )


def intersect_total(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    names = ("left_n", "right_n", "pairs", "left_hit", "right_hit", "bases")
    return intersect_by_contig(left, right, width).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def merge(intervals: DataFrame, max_gap: int = 0, width: int = BIN) -> DataFrame:
    """Unions of intervals that overlap, touch, or are at most max_gap apart: (contig, start, end, n)."""
    rows = _distinct(intervals).withColumn("bin", _bin(F.col("start"), width))  # no ties: both passes have one order
    order = [F.col("start"), F.col("end")]
    rows = running(rows, ["contig"], "bin", order, {"reach": ("max", F.col("end"))})
    rows = rows.withColumn("new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + max_gap), 1).otherwise(0))
    rows = running(rows, ["contig"], "bin", order, {"island": ("sum", F.col("new"))}, inclusive=True)
    return rows.groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("island")


def merge_stats(intervals: DataFrame, max_gap: int = 0, width: int = BIN) -> DataFrame:
    """Per contig: intervals and bases before and after merging; merged_n is how many went."""
    merged = merge(intervals, max_gap, width)
    out = merged.groupBy("contig").agg(F.sum("n").alias("in_n"), F.count(F.lit(1)).alias("out_n"), F.sum(F.col("end") - F.col("start")).alias("out_bases"))
    bases = intervals.groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("in_bases"))
    return out.join(bases, "contig").select("contig", "in_n", "out_n", (F.col("in_n") - F.col("out_n")).alias("merged_n"), "in_bases", "out_bases")


def subtract(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """What is left of each left interval outside the right ones: (contig, start, end), a row for each piece.

    Left intervals are not merged first; right ones are.
    """
    lefts = _distinct(left)
    cuts = range_join(lefts, merge(right, 0, width).select("contig", "start", "end"), width)
    cuts = cuts.select(F.col("l_contig").alias("contig"), F.col("l_n").alias("n"), F.col("l_start").alias("ls"), F.col("l_end").alias("le"), F.col("r_start").alias("rs"), F.col("r_end").alias("re"))
    w = Window.partitionBy("contig", "ls", "le").orderBy("rs")
    cuts = cuts.withColumn("before", F.coalesce(F.lag("re").over(w), F.col("ls"))).withColumn("last", F.lead("rs").over(w).isNull())
    pieces = F.array(F.struct(F.col("before").alias("start"), F.col("rs").alias("end")), F.when(F.col("last"), F.struct(F.col("re").alias("start"), F.col("le").alias("end"))))
    kept = cuts.select("contig", "n", F.explode(F.filter(pieces, lambda p: p.isNotNull() & (p["start"] < p["end"]))).alias("p")).select("contig", "p.start", "p.end", "n")
    hit = cuts.select("contig", F.col("ls").alias("start"), F.col("le").alias("end")).distinct()
    rows = lefts.join(hit, ["contig", "start", "end"], "left_anti").select("contig", "start", "end", "n").unionByName(kept)
    return rows.select("contig", "start", "end", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("__k")).drop("__k")


def closest(queries: DataFrame, targets: DataFrame, width: int = BIN) -> DataFrame:
    """For each query the target with the least (distance, start, end) on its contig; queries without one go.

    Overlapping and touching targets are at distance 0. Of targets that end at or after the
    query's start, the one that starts first is the best at distance 0 or downstream; of
    those that end before, the one that ends last is the best upstream. So two running
    extremes over the targets' ends find it.
    """
    t = targets.select("contig", F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("qs"), F.lit(None).cast("long").alias("qe"), F.col("start").alias("ts"), F.col("end").alias("te"))
    q = queries.select("contig", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("start").alias("qs"), F.col("end").alias("qe"), F.lit(None).cast("long").alias("ts"), F.lit(None).cast("long").alias("te"))
    rows = t.unionByName(q).withColumn("bin", _bin(F.col("at"), width))
    is_target = F.col("kind") == 0
    # before a query: targets that end below its start; a target ending at the start comes after it
    rows = running(rows, ["contig"], "bin", [F.col("at"), F.col("kind").desc()], {"up": ("max", F.when(is_target, F.struct(F.col("te").alias("e"), (-F.col("ts")).alias("s"))))})
    rows = running(rows, ["contig"], "bin", [F.col("at").desc(), F.col("kind")], {"down": ("min", F.when(is_target, F.struct(F.col("ts").alias("s"), F.col("te").alias("e"))))}, backward=True)
    rows = rows.where("kind = 1")
    up = F.when(F.col("up").isNotNull(), F.struct((F.col("qs") - F.col("up.e")).alias("d"), (-F.col("up.s")).alias("s"), F.col("up.e").alias("e")))
    down = F.when(F.col("down").isNotNull(), F.struct(F.greatest(F.lit(0), F.col("down.s") - F.col("qe")).alias("d"), F.col("down.s").alias("s"), F.col("down.e").alias("e")))
    rows = rows.withColumn("best", F.when(up.isNull(), down).when(down.isNull(), up).when(up <= down, up).otherwise(down)).where("best is not null")
    s, e = F.col("best.s"), F.col("best.e")
    direction = F.when((s < F.col("qe")) & (F.col("qs") < e), "overlap").when(e <= F.col("qs"), "upstream").otherwise("downstream")
    return rows.select("contig", F.col("qs").alias("q_start"), F.col("qe").alias("q_end"), s.alias("t_start"), e.alias("t_end"), F.col("best.d").alias("distance"), direction.alias("direction"))
