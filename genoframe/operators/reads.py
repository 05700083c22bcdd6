"""Operators on reads (id, seq, qual), qualities as text with an offset of 33, and on alignment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import count_of
from .intervals import BIN
from .prefix import running

ADAPTER = "AGATCGGAAGAGC"
#: Bits of the alignment FLAG, fixed values.
FLAGS = {"paired": 1, "proper_pair": 2, "read1": 64, "read2": 128, "qc_fail": 512, "duplicate": 1024}
UNMAPPED, SECONDARY, SUPPLEMENTARY = 4, 256, 2048


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def qc_total(reads: DataFrame, offset: int = 33) -> DataFrame:
    """reads, bases, length range and mean, GC and N % of all bases, mean quality, Q20 and Q30 %, and the encoding.

    Ratios are 0 without bases. Below ASCII 59 the encoding is phred33, else ambiguous.
    """
    upper = F.upper("seq")
    above = lambda q: F.length(F.regexp_replace("qual", f"[{_escaped(chr(33))}-{_escaped(chr(offset + q - 1))}]", ""))
    rows = reads.select(
        F.length("seq").cast("long").alias("len"), count_of(upper, "GC").alias("gc"), count_of(upper, "N").alias("n"),
        F.aggregate(chars(F.col("qual")), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c)).alias("q"), above(20).cast("long").alias("q20"), above(30).cast("long").alias("q30"), F.array_min(F.transform(chars(F.col("qual")), F.ascii)).alias("low"),
    )
    out = rows.agg(F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), *[F.sum(c).alias(c) for c in ("gc", "n", "q", "q20", "q30")], F.min("low").alias("low"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    bases = F.col("bases")
    return out.select(
        "reads", "bases", "min_len", "max_len", ratio(bases.cast("double"), F.col("reads")).alias("mean_len"), ratio(100.0 * F.col("gc"), bases).alias("gc_percent"), ratio(100.0 * F.col("n"), bases).alias("n_percent"),
        (ratio(F.col("q").cast("double"), bases) - offset).alias("mean_quality"), ratio(100.0 * F.col("q20"), bases).alias("q20_percent"), ratio(100.0 * F.col("q30"), bases).alias("q30_percent"),
        F.when(F.col("low") < 59, "phred33").otherwise("ambiguous").alias("encoding"),
    )


def _escaped(c: str) -> str:
    return f"\\{c}" if c in r"[]\^-&" else c


def qc_cycles(reads: DataFrame, max_cycles: int = 500, offset: int = 33) -> DataFrame:
    """(cycle, bases, gc_percent, n_percent, mean_quality, q20_percent, q30_percent); rows are counted by (cycle, base, quality)."""
    pairs = F.arrays_zip(chars(F.upper(F.substring("seq", 1, max_cycles))).alias("b"), chars(F.substring("qual", 1, max_cycles)).alias("q"))
    rows = reads.select(F.posexplode(pairs).alias("i", "p")).select((F.col("i") + 1).cast("long").alias("cycle"), F.col("p.b").alias("b"), (F.ascii("p.q") - offset).alias("q"))
    rows = rows.groupBy("cycle", "b", "q").agg(F.count(F.lit(1)).alias("c"))
    part = lambda rule: F.lit(100.0) * F.sum(F.when(rule, F.col("c")).otherwise(0)) / F.sum("c")
    return rows.groupBy("cycle").agg(
        F.sum("c").alias("bases"), part(F.col("b").isin("G", "C")).alias("gc_percent"), part(F.col("b") == "N").alias("n_percent"),
        (F.sum(F.col("q") * F.col("c")).cast("double") / F.sum("c")).alias("mean_quality"), part(F.col("q") >= 20).alias("q20_percent"), part(F.col("q") >= 30).alias("q30_percent"),
    )


def quality_trimmed(reads: DataFrame, min_quality: int = 20, min_length: int = 20, offset: int = 33) -> DataFrame:
    """Reads cut after their last base of min_quality or more; shorter ones go."""
    low = f"[{_escaped(chr(33))}-{_escaped(chr(offset + min_quality - 1))}]+$"
    keep = F.length(F.regexp_replace("qual", low, ""))
    return reads.withColumn("__k", keep).where(F.col("__k") >= min_length).select("id", F.expr("substring(seq, 1, __k)").alias("seq"), F.expr("substring(qual, 1, __k)").alias("qual"))


def adapter_trimmed(reads: DataFrame, adapters=(ADAPTER,), min_overlap: int = 8, min_length: int = 1) -> DataFrame:
    """Reads cut where the first adapter begins, whole or running over the end with min_overlap or more."""
    upper = F.upper("seq")
    places = []
    for a in adapters:
        whole = F.instr(upper, F.lit(a))
        places.append(F.when(whole > 0, whole - 1))
        for n in range(len(a) - 1, min_overlap - 1, -1):
            places.append(F.when(upper.endswith(a[:n]), F.length("seq") - n))
    keep = F.least(F.length("seq"), *places)
    return reads.withColumn("__k", keep).where(F.col("__k") >= min_length).select("id", F.expr("substring(seq, 1, __k)").alias("seq"), F.expr("substring(qual, 1, __k)").alias("qual"))


def deduplicated(reads: DataFrame, order: str, umi_delimiter: str | None = None, umi_bases: int | None = None) -> DataFrame:
    """The first read, in the order, of each key: the sequence, or a UMI (of the header after the last delimiter, or the first bases) and the rest.

    Only the least place of each key is gathered, so a key with any number of reads is reduced before the shuffle.
    """
    upper = F.upper("seq")
    if umi_delimiter:
        key = F.concat(F.substring_index("header", umi_delimiter, -1), F.lit(":"), upper)
    elif umi_bases:
        umi = F.when(F.length("seq") <= umi_bases, F.raise_error(F.lit("read is not longer than its UMI"))).otherwise(F.substring(upper, 1, umi_bases))
        key = F.concat(umi, F.lit(":"), F.substring(upper, umi_bases + 1, 2**30))
    else:
        key = upper
    first = reads.groupBy(F.sha2(key, 256).alias("k")).agg(F.min(order).alias(order)).select(order)
    return reads.join(first, order, "left_semi")


def subsampled(reads: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """Exactly n reads (or the rounded-up fraction, 1 at least), fixed by the seed."""
    if n is None:
        n = max(1, -int(-reads.count() * fraction // 1))
    return reads.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)


def alignment_qc(records: DataFrame) -> DataFrame:
    """Counters of (flag, mapq) records; percentages and the mean are null without records."""
    has = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    mapped = ~has(UNMAPPED)
    known = mapped & (F.col("mapq") != 255)
    out = records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~has(SECONDARY | SUPPLEMENTARY)).alias("primary"), F.count_if(has(SECONDARY)).alias("secondary"), F.count_if(has(SUPPLEMENTARY)).alias("supplementary"),
        F.count_if(mapped).alias("mapped"), F.count_if(has(UNMAPPED)).alias("unmapped"), *[F.count_if(has(bit)).alias(name) for name, bit in FLAGS.items()],
        F.count_if(mapped & (F.col("mapq") == 0)).alias("zero_mapq"), F.try_divide(F.sum(F.when(known, F.col("mapq"))).cast("double"), F.count_if(known)).alias("mean_mapq"),
    )
    return out.withColumn("mapped_percent", F.try_divide(F.lit(100.0) * F.col("mapped"), F.col("records")))


def reference_counts(records: DataFrame) -> DataFrame:
    return records.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED)) == 0).groupBy("rname").agg(F.count(F.lit(1)).alias("mapped"))


def coverage(records: DataFrame) -> DataFrame:
    """(contig, start, end, depth): runs of equal depth of (contig, start, end) alignments, 0-based half-open."""
    events = records.select("contig", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("contig", F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    steps = steps.withColumn("__bin", F.floor(F.col("start") / BIN))
    rows = running(steps, ["contig"], "__bin", [F.col("start")], {"depth": ("sum", F.col("d"))}, inclusive=True)
    rows = running(rows, ["contig"], "__bin", [F.desc("start")], {"end": ("min", F.col("start"))}, backward=True)
    return rows.where("depth > 0").select("contig", "start", "end", "depth")
