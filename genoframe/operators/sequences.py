"""Operators on sequence records (id, seq) with optional description and ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical_kmer, count_of, gc_percent, kmers, n_percent, reverse_complement, translate_frame
from .prefix import running


def stats(seqs: DataFrame) -> DataFrame:
    """count, total, min, max, mean, N50, L50, auN, GC % (of A, C, G, T, U), N count and %.

    N50 is the first length, from the longest, at which the running total reaches half;
    lengths are counted first, so the running total is over distinct lengths.
    """
    upper = F.upper("seq")
    rows = seqs.select(F.length("seq").cast("long").alias("len"), count_of(upper, "GC").alias("gc"), count_of(upper, "ACGTU").alias("acgt"), count_of(upper, "N").alias("n"))
    by_len = rows.groupBy("len").agg(F.count(F.lit(1)).alias("c"), F.sum("gc").alias("gc"), F.sum("acgt").alias("acgt"), F.sum("n").alias("n"))
    down = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each length
    whole = Window.partitionBy()
    by_len = by_len.withColumn("run", F.sum(F.col("len") * F.col("c")).over(down)).withColumn("before", F.sum("c").over(down) - F.col("c")).withColumn("all", F.sum(F.col("len") * F.col("c")).over(whole))
    half = F.floor((F.col("all") + 1) / 2)
    reached = F.col("run") >= half
    missing = half - (F.col("run") - F.col("len") * F.col("c"))
    l50 = F.col("before") + F.ceil(F.try_divide(missing, F.col("len")))
    out = by_len.agg(
        F.sum("c").alias("count"), F.sum(F.col("len") * F.col("c")).alias("total"), F.min("len").alias("min"), F.max("len").alias("max"), F.max(F.when(reached, F.struct("len", l50.alias("l50")))).alias("half"),
        F.sum(F.col("len") * F.col("len") * F.col("c")).alias("sq"), F.sum("gc").alias("gc"), F.sum("acgt").alias("acgt"), F.sum("n").alias("n_count"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        "count", "total", "min", "max", ratio(F.col("total").cast("double"), F.col("count")).alias("mean"), F.col("half.len").alias("n50"), F.col("half.l50").cast("long").alias("l50"), ratio(F.col("sq").cast("double"), F.col("total")).alias("aun"),
        ratio(100.0 * F.col("gc"), F.col("acgt")).alias("gc_percent"), "n_count", ratio(100.0 * F.col("n_count"), F.col("total")).alias("n_percent"),
    )


def reject_reason(min_length=None, max_length=None, min_gc=None, max_gc=None, max_n=None):
    """The first rule that a sequence fails, or null."""
    n, gc = F.length("seq"), gc_percent(F.col("seq"))
    rules = [(n < min_length) if min_length is not None else None, (n > max_length) if max_length is not None else None, (gc < min_gc) if min_gc is not None else None, (gc > max_gc) if max_gc is not None else None, (n_percent(F.col("seq")) > max_n) if max_n is not None else None]
    out = None
    for rule, name in zip(rules, ("too-short", "too-long", "low-gc", "high-gc", "high-n")):
        if rule is not None:
            out = F.when(rule, name) if out is None else out.when(rule, name)
    return F.lit(None).cast("string") if out is None else out


def filtered(seqs: DataFrame, **limits) -> DataFrame:
    return seqs.where(reject_reason(**limits).isNull())


def filter_reasons(seqs: DataFrame, **limits) -> DataFrame:
    return seqs.groupBy(F.coalesce(reject_reason(**limits), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def extract_ids(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    return seqs.join(ids.distinct(), "id", "left_semi")


def missing_ids(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.distinct().join(seqs, "id", "left_anti")


def extract_regions(seqs: DataFrame, regions: DataFrame) -> DataFrame:
    """(label, subseq) of (id, start, end, strand): 1-based closed; '-' is reverse-complemented; an end beyond the sequence is an error."""
    rows = seqs.join(regions, "id")
    cut = F.substring("seq", F.col("start"), F.col("end") - F.col("start") + 1)
    cut = F.when(F.col("end") > F.length("seq"), F.raise_error(F.lit("region ends beyond the sequence"))).otherwise(cut)
    label = F.concat(F.col("id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(":"), F.col("strand"))
    return rows.select(label.alias("label"), F.when(F.col("strand") == "-", reverse_complement(cut)).otherwise(cut).alias("subseq"))


def reverse_complements(seqs: DataFrame) -> DataFrame:
    return seqs.select("id", reverse_complement(F.col("seq")).alias("revcomp"))


def translated(seqs: DataFrame, frames=(1,), **how) -> DataFrame:
    """(id, frame, protein) for each frame."""
    made = F.array(*[F.struct(F.lit(f).alias("frame"), translate_frame(F.col("seq"), f, **how).alias("protein")) for f in frames])
    return seqs.select("id", F.explode(made).alias("p")).select("id", "p.frame", "p.protein")


def orfs(seqs: DataFrame, min_aa: int = 30, reverse: bool = True, partial: bool = False) -> DataFrame:
    """(id, start, end, strand, frame, complete, aa_length): first ATG to the next stop in each frame; 1-based closed places on the + strand.

    In a frame's protein a reading frame is a piece between stops, from its first M on; the
    pieces' places are running sums of their lengths.
    """
    frames = (1, 2, 3, -1, -2, -3) if reverse else (1, 2, 3)
    rows = seqs.select("id", F.length("seq").alias("n"), F.monotonically_increasing_id().alias("row"), "seq")
    made = F.array(*[F.struct(F.lit(f).alias("frame"), translate_frame(F.col("seq"), f).alias("p")) for f in frames])
    rows = rows.select("id", "n", "row", F.explode(made).alias("f")).select("id", "n", "row", "f.frame", F.split("f.p", r"\*").alias("pieces"))
    rows = rows.select("id", "n", "row", "frame", F.size("pieces").alias("k"), F.posexplode("pieces").alias("i", "piece"))
    before = Window.partitionBy("row", "frame").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0))).where(F.col("piece").contains("M"))
    complete, m = F.col("i") < F.col("k") - 1, F.instr("piece", "M") - 1
    aa = F.length("piece") - m
    offset = F.abs("frame") - 1
    begin = offset + 3 * (F.col("at") + m)
    end = offset + 3 * (F.col("at") + F.length("piece") + F.when(complete, 1).otherwise(0))
    kept = (aa >= min_aa) & (complete if not partial else F.lit(True))
    plus = F.col("frame") > 0
    return rows.where(kept).select(
        "id", F.when(plus, begin + 1).otherwise(F.col("n") - end + 1).cast("long").alias("start"), F.when(plus, end).otherwise(F.col("n") - begin).cast("long").alias("end"),
        F.when(plus, "+").otherwise("-").alias("strand"), F.abs("frame").cast("int").alias("frame"), complete.alias("complete"), aa.cast("long").alias("aa_length"),
    )


def numbered(df: DataFrame, order: list, blocks: int = 4096) -> DataFrame:
    """df with n, its place (from 1) in the order; rows are counted by range first, so no task sees them all."""
    ranged = df.withColumn("__b", F.lit(0)) if blocks == 1 else df.withColumn("__b", F.floor(F.col(order[0]) / blocks))
    out = running(ranged.withColumn("__k", F.lit(0)), ["__k"], "__b", [F.col(c) for c in order], {"__n": ("sum", F.lit(1))}, inclusive=True)
    return out.withColumn("n", F.col("__n").cast("long")).drop("__n", "__b", "__k")


def normalized_ids(seqs: DataFrame, order: list, prefix: str = "sequence", start: int = 1, width: int = 6) -> DataFrame:
    """(id, new_id): prefix_000001 and on, in input order; numbers beyond the width are not cut."""
    number = (F.col("n") + (start - 1)).cast("string")
    padded = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    return numbered(seqs, order).select("id", F.concat(F.lit(f"{prefix}_"), padded).alias("new_id"))


def split_files(seqs: DataFrame, order: list, records_per_file: int) -> DataFrame:
    """(id, file_no): chunks of the input order."""
    return numbered(seqs, order).select("id", (F.floor((F.col("n") - 1) / records_per_file) + 1).cast("long").alias("file_no"))


def merged(parts: list[DataFrame], allow_duplicate_ids: bool = False) -> DataFrame:
    """All records; without leave, an id that comes twice is an error when the rows are read."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if allow_duplicate_ids:
        return out
    twice = out.groupBy("id").agg(F.count(F.lit(1)).alias("__c"))
    checked = twice.select("id", F.when(F.col("__c") > 1, F.raise_error(F.lit("duplicate sequence id"))).otherwise(F.col("__c")).alias("__c"))
    return out.join(checked, "id").where("__c = 1").drop("__c")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """records, and records whose id came before."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("records"), F.sum(F.col("c") - 1).alias("duplicates"))


def to_table(seqs: DataFrame) -> DataFrame:
    return seqs.select("id", "description", F.length("seq").cast("long").alias("length"), F.col("seq").alias("sequence"))


def from_table(df: DataFrame, id_column: str = "id", sequence_column: str = "sequence", description_column: str | None = None) -> DataFrame:
    """Records of a table; whitespace leaves the sequences, an empty id or one with a space is an error."""
    i = F.col(id_column).cast("string")
    checked = F.when((F.length(i) == 0) | i.rlike(r"\s"), F.raise_error(F.lit("bad sequence id"))).otherwise(i)
    description = F.col(description_column) if description_column else F.lit("")
    return df.select(checked.alias("id"), description.alias("description"), F.regexp_replace(sequence_column, r"\s", "").alias("seq"))


def kmer_counts(seqs: DataFrame, k: int = 21, canonical: bool = False) -> DataFrame:
    """(kmer, n): windows of A, C, G, T (U is T); others are skipped."""
    clean = F.translate(F.upper("seq"), "U", "T")
    rows = seqs.select(F.explode(F.array_compact(F.transform(kmers(clean, k), lambda w: F.when(w.rlike("^[ACGT]+$"), canonical_kmer(w) if canonical else w)))).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_top(seqs: DataFrame, k: int = 21, canonical: bool = False, top_n: int = 50) -> DataFrame:
    return kmer_counts(seqs, k, canonical).orderBy(F.desc("n"), "kmer").limit(top_n)


def kmer_summary(seqs: DataFrame, k: int = 21, canonical: bool = False) -> DataFrame:
    """windows, counted and skipped ones, distinct k-mers."""
    windows = seqs.agg(F.coalesce(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0)).cast("long")), F.lit(0)).alias("windows"))
    counted = kmer_counts(seqs, k, canonical).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"), F.count(F.lit(1)).alias("distinct_kmers"))
    return windows.crossJoin(counted).select("windows", "counted", (F.col("windows") - F.col("counted")).alias("skipped"), "distinct_kmers")


def consensus(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(pos, base): per column the commonest of A, C, G, T, U, N, ties to the later; N below ceil(n * threshold); all-gap columns go."""
    total = aligned.agg(F.count(F.lit(1)).alias("total"))
    letters = aligned.select(F.posexplode(F.split(F.upper("seq"), "")).alias("i", "base")).where("base <> ''")
    counts = letters.groupBy("i", "base").agg(F.count(F.lit(1)).alias("c"))
    rank = F.instr(F.lit("ACGTUN"), F.col("base"))
    best = counts.groupBy("i").agg(F.max(F.when(rank > 0, F.struct(F.col("c"), rank.alias("rank"), F.col("base")))).alias("best"), F.sum(F.when(F.col("base") != "-", F.col("c")).otherwise(0)).alias("filled")).where("filled > 0")
    need = F.ceil(F.col("total") * F.lit(threshold))
    return best.crossJoin(total).select((F.col("i") + 1).cast("long").alias("pos"), F.when(F.coalesce(F.col("best.c"), F.lit(0)) >= need, F.col("best.base")).otherwise("N").alias("base"))


#: Primer pairs of one search.
MOST_PRIMERS = 10_000


def epcr(seqs: DataFrame, primers: DataFrame, min_amplicon: int, max_amplicon: int) -> DataFrame:
    """(primer, id, start, end, length): a forward hit and a later hit of the reverse primer's complement within the size limits; hits may overlap."""

    def places(primer: str, name: str) -> DataFrame:
        # the text before each hit, overlapping ones included, gives its place
        at = F.regexp_instr("seq", F.col(primer))
        rows = seqs.join(F.broadcast(primers), F.col("seq").contains(F.col(primer)))
        parts = F.split("seq", F.concat(F.lit("(?="), F.col(primer), F.lit(")")))
        sizes = F.transform(parts, lambda x: F.length(x))
        ends = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        starts = F.filter(F.transform(ends, lambda x: x + 1), lambda x: x <= F.length("seq"))
        hits = F.when(at == 1, starts).otherwise(F.filter(starts, lambda x: x > 1))
        return rows.select("primer", "id", F.explode(F.array_distinct(hits)).alias(name), F.length(primer).alias(f"{name}_len"))

    if primers.limit(MOST_PRIMERS + 1).count() > MOST_PRIMERS:
        raise ValueError(f"more than {MOST_PRIMERS} primer pairs: they are sent to all executors")
    primers = primers.select("primer", F.upper("forward").alias("forward"), reverse_complement(F.col("reverse")).alias("reverse"))
    seqs = seqs.select("id", F.upper("seq").alias("seq"))
    f, r = places("forward", "start"), places("reverse", "rev")
    length = F.col("rev") + F.col("rev_len") - F.col("start")
    rows = f.join(r, ["primer", "id"]).where((F.col("rev") >= F.col("start")) & length.between(min_amplicon, max_amplicon))
    return rows.select("primer", "id", F.col("start").cast("long").alias("start"), (F.col("rev") + F.col("rev_len") - 1).cast("long").alias("end"), length.cast("long").alias("length"))


def dotplot(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(qid, rid, qpos, rpos) of equal k-mers without N, 1-based."""

    def windows(df: DataFrame, p: str) -> DataFrame:
        at = df.select(F.col("id").alias(f"{p}id"), F.posexplode(kmers(F.upper("seq"), k)).alias("i", "kmer")).where(F.col("kmer").rlike("^[ACGTU]+$"))
        return at.select(f"{p}id", (F.col("i") + 1).cast("long").alias(f"{p}pos"), "kmer")

    return windows(queries, "q").join(windows(references, "r"), "kmer").select("qid", "rid", "qpos", "rpos")


def shuffled(seqs: DataFrame, seed: int = 42) -> DataFrame:
    """Records with their place (from 1) in an order fixed by the seed; ids are dealt evenly to bins by the first digits of their digest, so no task sees all."""
    rows = seqs.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))).withColumn("__k", F.lit(0)).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("long"))
    out = running(rows, ["__k"], "__b", [F.col("__h"), F.col("id")], {"place": ("sum", F.lit(1))}, inclusive=True)
    return out.withColumn("place", F.col("place").cast("long")).drop("__h", "__k", "__b")
