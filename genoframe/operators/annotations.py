"""Operators on features (seqid, source, type, start, end, strand, id, parent), 1-based closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement

#: Which attributes name a feature, in order, fixed lists.
POSITION_IDS = ("ID", "gene_id", "transcript_id", "locus_tag", "Name")
BED_IDS = ("ID", "Name", "gene_id", "transcript_id", "locus_tag")


def named(attributes: Column, keys) -> Column:
    """The first value of the first of keys that a map of lists has."""
    return F.coalesce(*[F.get(F.try_element_at(attributes, F.lit(k)), F.lit(0)) for k in keys])


def stats(features: DataFrame) -> DataFrame:
    """(kind, value, n): records by type, seqid, source and strand, with an id, with a parent, and the range of places."""
    one = F.count(F.lit(1))
    groups = features.groupingSets([["type"], ["seqid"], ["source"], ["strand"]], "type", "seqid", "source", "strand").agg(one.alias("n"), F.grouping("type").alias("t"), F.grouping("seqid").alias("q"), F.grouping("source").alias("s"))
    kind = F.when(F.col("t") == 0, "type").when(F.col("q") == 0, "seqid").when(F.col("s") == 0, "source").otherwise("strand")
    groups = groups.select(kind.alias("kind"), F.coalesce("type", "seqid", "source", "strand").alias("value"), "n")
    whole = features.agg(F.count("id").alias("with_id"), F.count("parent").alias("with_parent"), F.min("start").alias("min_start"), F.max("end").alias("max_end"), one.alias("records"))
    whole = whole.unpivot([], ["records", "with_id", "with_parent", "min_start", "max_end"], "value", "n").select(F.lit("total").alias("kind"), "value", F.col("n").cast("long").alias("n"))
    return groups.unionByName(whole)


def normalized(features: DataFrame) -> DataFrame:
    """GFF3 lines in the order (seqid, start, end, type, source)."""
    attributes = F.concat_ws(";", F.concat(F.lit("ID="), "id"), F.concat(F.lit("Parent="), "parent"))
    line = F.concat_ws("\t", "seqid", "source", "type", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), F.when(attributes == "", ".").otherwise(attributes))
    return features.orderBy("seqid", "start", "end", "type", "source", "id").select(line.alias("line"))


def positions(features: DataFrame, types=None) -> DataFrame:
    """(id, seqid, start, end, strand) of the features of the given types."""
    rows = features.where(F.col("type").isin(*types)) if types else features
    return rows.where("id IS NOT NULL").select("id", "seqid", "start", "end", "strand")


def to_bed(features: DataFrame) -> DataFrame:
    """(contig, start, end, name, score, strand), 0-based half-open; a score that is no number is 0."""
    score = F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)) if "score" in features.columns else F.lit(0.0)
    return features.select(F.col("seqid").alias("contig"), (F.col("start") - 1).alias("start"), "end", F.coalesce("id", F.lit(".")).alias("name"), score.alias("score"), "strand")


def density(features: DataFrame, window: int, step: int, types=None) -> DataFrame:
    """(seqid, start, end, n, per_mb): features that overlap each bin of each sequence, up to the last end of all its features.

    A feature meets the bins of a contiguous range: +1 where it starts, -1 after it ends, summed up along the bins.
    """
    chosen = features.where(F.col("type").isin(*types)) if types else features
    lengths = features.groupBy("seqid").agg(F.max("end").alias("len"))
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - window) / F.lit(step))).cast("long")
    last = F.floor((F.col("end") - 1) / F.lit(step)).cast("long")
    events = chosen.select("seqid", F.explode(F.array(F.struct(first.alias("bin"), F.lit(1).alias("d")), F.struct((last + 1).alias("bin"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy("seqid", F.col("e.bin").alias("bin")).agg(F.sum("e.d").alias("d"))
    bins = lengths.select("seqid", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("len") - 1) / F.lit(step)))).alias("bin"))
    w = Window.partitionBy("seqid").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = bins.join(events, ["seqid", "bin"], "left").withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(w))
    start = F.col("bin") * step + 1
    end = F.least(start + (window - 1), F.col("len"))
    return rows.select("seqid", start.alias("start"), end.alias("end"), "n", (F.col("n") * 1e6 / (end - start + 1)).alias("per_mb"))


def extracted(features: DataFrame, references: DataFrame, promoter: int | None = None) -> DataFrame:
    """(id, seq) of each feature id: its parts in order, joined, '-' reverse-complemented; or the promoter before it.

    A place beyond the reference's end is cut. With a column `phase` (0, 1 or 2, else 0) the
    first coding part, in the direction of the strand, starts that many bases later.
    """
    phase = F.lit(0)
    if promoter is None:
        own = F.coalesce(F.col("phase").try_cast("int"), F.lit(0)) if "phase" in features.columns else F.lit(0)
        parts = features.groupBy("id", "seqid", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end", own.alias("phase")))).alias("parts"))  # the parts of one feature
        phase = F.when(F.col("strand") == "-", F.element_at("parts", -1)["phase"]).otherwise(F.element_at("parts", 1)["phase"])
    else:
        minus = F.col("strand") == "-"
        start = F.when(minus, F.col("end") + 1).otherwise(F.greatest(F.lit(1), F.col("start") - promoter))
        end = F.when(minus, F.col("end") + promoter).otherwise(F.col("start") - 1)
        parts = features.select("id", "seqid", "strand", F.array(F.struct(start.alias("start"), end.alias("end"))).alias("parts"))
    rows = parts.join(references.select(F.col("seqid"), F.col("seq").alias("ref")), "seqid")
    joined = F.array_join(F.transform("parts", lambda p: F.substring(F.col("ref"), p["start"].cast("int"), F.greatest(F.lit(0), p["end"] - p["start"] + 1).cast("int"))), "")
    seq = F.when(F.col("strand") == "-", reverse_complement(joined)).otherwise(joined)
    return rows.select("id", F.substring(seq, phase + 1, F.length(seq)).alias("seq") if promoter is None else seq.alias("seq"))


def go_terms(rows: DataFrame) -> DataFrame:
    """(gene, term): valid GO ids of lists separated by , ; or |, distinct."""
    terms = F.filter(F.transform(F.split("terms", r"[,;|]"), lambda t: F.trim(t)), lambda t: t.rlike(r"^GO:\d{7}$"))
    return rows.select("gene", F.explode(F.array_distinct(terms)).alias("term")).distinct()


def eggnog(rows: DataFrame) -> DataFrame:
    """(gene, n_go, n_kegg, cog): GO ids that are valid, KEGG orthologs and pathways, COG letters one by one; '-' is none."""
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.col(c), ","), lambda t: F.trim(t)), lambda t: ~t.isin("", "-")))
    go = F.filter(listed("gos"), lambda t: t.rlike(r"^GO:\d{7}$"))
    letters = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("cog", ""), lambda c: c.rlike("[A-Z]")))), ",")
    return rows.select("gene", F.size(go).cast("long").alias("n_go"), (F.size(listed("ko")) + F.size(listed("pathways"))).cast("long").alias("n_kegg"), letters.alias("cog"))
