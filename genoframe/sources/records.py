"""Readers of line-oriented formats into DataFrames. Compressed files are read by their extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import wrapped
from ..operators.prefix import running
from .tables import first_lines


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, description, seq): records are the text between line starts with '>', so a file splits at them."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("ord", F.monotonically_increasing_id())
    body = F.regexp_replace("value", "^>", "")
    header = F.regexp_replace(F.substring_index(body, "\n", 1), r"\s+$", "")
    rest = F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n"), F.length(body))).otherwise("")
    rows = rows.select("ord", header.alias("header"), F.regexp_replace(rest, r"\s", "").alias("seq")).where("header <> '' OR seq <> ''")
    return rows.select("ord", F.regexp_extract("header", r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace("header", r"^\S*", "")).alias("description"), "seq")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines from 0 over all files, by path, whatever parts of which files a task reads.

    The parts are counted first; only their sizes leave them.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = rows.groupBy("f", "p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("f", "p", (before - F.col("low")).alias("shift"))  # a row for each part
    return rows.join(first, ["f", "p"]).select((F.col("m") + F.col("shift")).alias("line"), "value")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, header, seq, qual) of four-line records; unequal lengths or a differing second header are errors."""
    rows = numbered_lines(spark, path).withColumn("ord", F.floor(F.col("line") / 4)).withColumn("k", F.col("line") % 4)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rows = rows.groupBy("ord").agg(pick(0).alias("h"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("qual"))
    bad = ~F.col("h").startswith("@") | ~F.col("plus").startswith("+") | (F.length("seq") != F.length("qual")) | F.col("qual").isNull() | ((F.length("plus") > 1) & (F.substring("plus", 2, 2**30) != F.substring("h", 2, 2**30)))
    header = F.when(bad, F.raise_error(F.concat(F.lit("malformed read at record "), F.col("ord")))).otherwise(F.substring("h", 2, 2**30))
    return rows.select("ord", header.alias("header"), "seq", "qual").select("ord", F.regexp_extract("header", r"^(\S*)", 1).alias("id"), "header", "seq", "qual")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fields of alignment records; fewer fields are an error."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND NOT value LIKE '@%'").select(F.when(F.size(f) < 11, F.raise_error(F.lit("alignment record with fewer than 11 fields"))).otherwise(f).alias("f"))
    names = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    return rows.select(*[F.col("f")[i].cast(kinds.get(n, "string")).alias(n) for i, n in enumerate(names)])


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end); an end that is not beyond the start is an error."""
    rows = spark.read.text(path).where(~F.trim("value").rlike(r"^(#|track |browser |$)")).select(F.split("value", "\t").alias("f"))
    start, end = F.col("f")[1].cast("long"), F.col("f")[2].cast("long")
    return rows.select(F.col("f")[0].alias("contig"), start.alias("start"), F.when(end > start, end).otherwise(F.raise_error(F.lit("interval ends before it starts"))).alias("end"))


def gxf(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 or GTF features with attributes as a map of lists, and id and parent."""
    rows = spark.read.text(path).where("value <> '' AND NOT value LIKE '#%'").select(F.split("value", "\t").alias("f"))
    rows = rows.select(F.when(F.size("f") != 9, F.raise_error(F.lit("feature without nine fields"))).otherwise(F.col("f")).alias("f"))
    text = F.col("f")[8]
    gtf = text.rlike(r'^\s*\w+ "')
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != "")
    key = lambda p: F.when(gtf, F.regexp_extract(p, r"^(\S+)", 1)).otherwise(F.substring_index(p, "=", 1))
    own = lambda p: F.when(gtf, F.array(F.regexp_extract(p, r'"([^"]*)"', 1))).otherwise(F.transform(F.split(F.regexp_extract(p, "=(.*)$", 1), ","), lambda v: F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))))
    keys = F.array_distinct(F.transform(parts, key))
    attributes = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.flatten(F.transform(F.filter(parts, lambda p: key(p) == k), own)).alias("value"))))
    names = ("seqid", "source", "type", "start", "end", "score", "strand", "phase")
    rows = rows.select(*[F.col("f")[i].cast("long" if n in ("start", "end") else "string").alias(n) for i, n in enumerate(names)], attributes.alias("attributes"), gtf.alias("used_gtf"))
    first = lambda k: F.get(F.try_element_at("attributes", F.lit(k)), F.lit(0))
    return rows.withColumn("id", F.coalesce(first("ID"), first("gene_id"))).withColumn("parent", first("Parent"))


def vcf(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Variant records with qual as a number, and samples as an array of (name, value); gt is the first sample's genotype.

    Strict reading checks the version line and the number of fields; else short records are left out.
    """
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    version = lines.where(F.col("value").rlike(r"^##fileformat=VCFv\d+\.\d+")).limit(1).collect()
    if not header or (strict and not version):
        raise ValueError("no VCF header")
    columns = header[0].value.split("\t")
    samples = columns[9:]
    if len(set(samples)) != len(samples) or "" in samples:
        raise ValueError("sample names must be unique")
    f = F.split("value", "\t")
    rows = lines.where("value <> '' AND NOT value LIKE '#%'").select(f.alias("f"))
    short = F.size("f") != len(columns)
    rows = rows.select(F.when(short, F.raise_error(F.lit("variant record with a wrong number of fields"))).otherwise(F.col("f")).alias("f")) if strict else rows.where(~short)
    at = lambda i: F.get("f", F.lit(i))
    own = F.array(*[F.struct(F.lit(n).alias("name"), at(9 + i).alias("value")) for i, n in enumerate(samples)]) if samples else F.array().cast("array<struct<name:string,value:string>>")
    gt = F.when(at(8).startswith("GT"), F.substring_index(at(9), ":", 1)) if samples else F.lit(None).cast("string")
    return rows.select(
        at(0).alias("chrom"), at(1).cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), F.when(at(5) != ".", at(5)).cast("double").alias("qual"),
        at(6).alias("filter"), at(7).alias("info"), (at(8) if samples else F.lit(None).cast("string")).alias("format"), own.alias("samples"), gt.alias("gt"),
    )


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a coordinate file, 1-based; a wrong banner is an error."""
    head = first_lines(spark, path)
    if not head or not head[0].startswith("%%MatrixMarket matrix coordinate"):
        raise ValueError("not a coordinate MatrixMarket file")
    rows = numbered_lines(spark, path).where("value <> '' AND NOT value LIKE '\\%%'")
    first = rows.agg(F.min("line").alias("__first"))
    rows = rows.join(F.broadcast(first), F.col("line") > F.col("__first"))  # after the line of sizes; one row
    f = F.split(F.trim("value"), r"\s+")
    return rows.select(f[0].cast("long").alias("row"), f[1].cast("long").alias("col"), f[2].cast("double").alias("value"))


def kraken_report(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("value <> ''").select(f.alias("f"))
    name = F.array_join(F.slice("f", 6, F.greatest(F.size("f") - 5, F.lit(0))), " ")
    return rows.select(F.col("f")[0].cast("double").alias("percentage"), F.col("f")[1].cast("long").alias("clade_count"), F.col("f")[2].cast("long").alias("taxon_count"), F.col("f")[3].alias("rank"), F.col("f")[4].alias("taxon_id"), name.alias("name"))


def pdb(spark: SparkSession, path: str, drop_altloc: bool = True) -> DataFrame:
    """Atoms of a fixed-width structure file up to END, with the model they are in."""
    lines = numbered_lines(spark, path)
    end = lines.where(F.trim("value") == "END").agg(F.min("line").alias("__end"))
    lines = lines.crossJoin(F.broadcast(end)).where("__end IS NULL OR line < __end")  # one row
    named = F.when(F.col("value").startswith("MODEL "), F.struct("line", F.trim(F.substring("value", 7, 10)).alias("name")))
    rows = lines.withColumn("k", F.lit(0)).withColumn("bin", F.floor(F.col("line") / 65536))
    rows = running(rows, ["k"], "bin", [F.col("line")], {"last": ("max", named)}).withColumn("model", F.coalesce("last.name", F.lit("1")))
    rows = rows.where(F.col("value").rlike("^(ATOM  |HETATM)") & (F.length("value") >= 54))
    cut = lambda a, b, kind="string": F.trim(F.substring("value", a + 1, b - a)).try_cast(kind)
    out = rows.select(
        F.col("line").alias("ord"), "model", cut(0, 6).alias("record"), cut(12, 16).alias("name"), cut(16, 17).alias("altloc"), cut(17, 20).alias("resname"), cut(21, 22).alias("chain"), cut(22, 26).alias("resseq"), cut(26, 27).alias("icode"),
        cut(30, 38, "double").alias("x"), cut(38, 46, "double").alias("y"), cut(46, 54, "double").alias("z"), cut(54, 60, "double").alias("occupancy"), cut(60, 66, "double").alias("b"), cut(76, 78).alias("element"),
    )
    return out.where(F.col("altloc").isin("", "A", "1", ".", "?")) if drop_altloc else out


# ---- writers: an existing path is an error


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("errorifexists").text(path)


def write_fasta(seqs: DataFrame, path: str) -> None:
    header = F.concat(F.lit(">"), F.col("id").cast("string"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise("") if "description" in seqs.columns else F.lit(""))
    write_lines(seqs.select(F.concat_ws("\n", header, wrapped(F.col("seq")))), path)


def write_fastq(reads: DataFrame, path: str) -> None:
    write_lines(reads.select(F.concat(F.lit("@"), F.col("id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual")), path)


def write_bed(intervals: DataFrame, path: str) -> None:
    write_lines(intervals.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in intervals.columns])), path)


def write_vcf(variants: DataFrame, path: str, sample: str = "sample") -> None:
    """Records with the version and column lines as the first file; a column gt is the genotype of one sample. Missing values are '.'."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in variants.columns else F.lit(".")
    q = F.col("qual")
    qual = F.when(q.isNull(), ".").when(q == F.floor(q), F.floor(q).cast("string")).otherwise(q.cast("string")) if "qual" in variants.columns else F.lit(".")
    names, cells = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"], [dot("chrom"), dot("pos"), dot("id"), dot("ref"), dot("alt"), qual, dot("filter"), dot("info")]
    if "gt" in variants.columns:
        names, cells = [*names, "FORMAT", sample], [*cells, F.lit("GT"), dot("gt")]
    head = variants.sparkSession.createDataFrame([("##fileformat=VCFv4.2\n" + "\t".join(names),)], "value string").coalesce(1)
    write_lines(head.union(variants.select(F.concat_ws("\t", *cells))), path)


def write_table(df: DataFrame, path: str, delimiter: str = "\t") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", delimiter).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
