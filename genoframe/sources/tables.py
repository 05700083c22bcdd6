"""Readers of delimited tables, with the columns found by their names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that count as missing, fixed lists.
MATRIX_MISSING = ("", ".", "na", "nan")
FUNCTIONAL_MISSING = ("", "-", ".", "na", "n/a", "none", "null")
#: Names of the columns of tables of terms, and of tabular similarity hits, fixed lists.
ALIASES = {
    "gene_id": ("gene_id", "gene", "geneid", "id", "query"), "term_id": ("term_id", "term", "go_id", "pathway_id", "set_id"), "term_name": ("term_name", "name", "description"),
    "namespace": ("namespace", "kind", "category"), "score": ("score", "rank_score", "stat", "log2foldchange"),
}
OUTFMT6 = ("qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")
FIELDS = {
    "query acc.ver": "qseqid", "query id": "qseqid", "subject acc.ver": "sseqid", "subject id": "sseqid", "% identity": "pident", "alignment length": "length", "mismatches": "mismatch", "gap opens": "gapopen",
    "q. start": "qstart", "q. end": "qend", "s. start": "sstart", "s. end": "send", "evalue": "evalue", "bit score": "bitscore",
}


def first_lines(spark: SparkSession, path: str, n: int = 1) -> list[str]:
    """The first lines of the files, by path."""
    out: list[str] = []
    for file in sorted(spark.read.text(path).inputFiles()):
        out += [r.value for r in spark.read.text(file).limit(n - len(out)).collect()]
        if len(out) >= n:
            break
    return out


def delimiter_of(spark: SparkSession, path: str) -> str:
    """By the extension (before a compression's), else by what the first line has more of."""
    name = re.sub(r"\.(gz|bgz|bgzip)$", "", path.lower())
    if name.endswith((".csv", ".tsv")):
        return "," if name.endswith(".csv") else "\t"
    line = (first_lines(spark, path) or [""])[0]
    return "," if line.count(",") > line.count("\t") else "\t"


def table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as text; a column name that comes twice is an error."""
    sep = delimiter or delimiter_of(spark, path)
    names = [n.strip('"') for n in (first_lines(spark, path) or [""])[0].split(sep)]
    if len(set(names)) != len(names):
        raise ValueError("duplicate column")
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def normalized(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def resolved(df: DataFrame, wanted: list[str], optional: list[str] = ()) -> DataFrame:
    """df's columns under their standard names, by the aliases."""
    by = {normalized(c): c for c in df.columns}
    out = []
    for w in [*wanted, *optional]:
        found = next((by[a] for a in ALIASES.get(w, (w,)) if a in by), None)
        if found is None and w in wanted:
            raise ValueError(f"no column for {w}")
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(w))
    return df.select(*out)


def _present(c: str, missing) -> Column:
    return ~F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin(*missing)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(feature, sample, value): the first column names the features; missing tokens are null."""
    df = table(spark, path)
    feature, *samples = df.columns
    long = df.unpivot([feature], samples, "sample", "text")
    return long.select(F.col(f"`{feature}`").alias("feature"), "sample", F.when(_present("text", MATRIX_MISSING), F.trim("text")).cast("double").alias("value"))


def sets(spark: SparkSession, path: str) -> DataFrame:
    """(set, item) of a table with a column for each set; short rows are filled with blanks."""
    df = table(spark, path)
    return df.unpivot([], df.columns, "set", "item").where(F.trim(F.coalesce("item", F.lit(""))) != "").withColumn("item", F.trim("item")).distinct()


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id): the first field of each line, without comments, a header and missing tokens."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.trim(F.split("value", r"[\t,]")[0]).alias("gene_id"))
    rows = rows.where(_present("gene_id", FUNCTIONAL_MISSING))
    return rows.where(~F.lower("gene_id").isin(*ALIASES["gene_id"])).distinct()


def associations(spark: SparkSession, path: str) -> DataFrame:
    rows = resolved(table(spark, path), ["gene_id", "term_id"], ["term_name", "namespace"])
    return rows.where(_present("gene_id", FUNCTIONAL_MISSING) & _present("term_id", FUNCTIONAL_MISSING)).distinct()


def ranked(spark: SparkSession, path: str) -> DataFrame:
    return resolved(table(spark, path), ["gene_id", "score"]).select("gene_id", F.col("score").cast("double").alias("score"))


def blast_tabular(spark: SparkSession, path: str) -> DataFrame:
    """Hits (query, subject, identity, length, evalue, bits and places); a '# Fields:' line gives the order."""
    head = [x for x in first_lines(spark, path, 20) if x.startswith("# Fields:")]
    names = [FIELDS.get(x.strip(), x.strip()) for x in head[0][9:].split(",")] if head else list(OUTFMT6)
    f = F.split("value", "\t")
    at = lambda n, kind: F.get(f, F.lit(names.index(n))).cast(kind)
    rows = spark.read.text(path).where("value <> '' AND NOT value LIKE '#%'")
    return rows.select(
        at("qseqid", "string").alias("query"), at("sseqid", "string").alias("subject"), at("pident", "double").alias("identity"), at("length", "long").alias("length"), at("evalue", "double").alias("evalue"), at("bitscore", "double").alias("bits"),
        *[at(n, "long").alias(n) for n in ("qstart", "qend", "sstart", "send") if n in names],
    )


def blast_xml(spark: SparkSession, path: str) -> DataFrame:
    """Hits of an XML report, one row for each HSP. A record is the text up to the end of an iteration, so a file splits at them."""
    hit = "struct<Hit_id:string,Hit_accession:string,Hit_hsps:struct<Hsp:array<struct<`Hsp_bit-score`:string,Hsp_evalue:string,Hsp_identity:string,`Hsp_align-len`:string,Hsp_gaps:string>>>>"
    kind = f"`Iteration_query-def` string, `Iteration_query-ID` string, Iteration_hits struct<Hit:array<{hit}>>"
    text = spark.read.option("lineSep", "</Iteration>").text(path).where(F.instr("value", "<Iteration>") > 0)
    one = F.concat(F.substring("value", F.instr("value", "<Iteration>"), F.length("value")), F.lit("</Iteration>"))
    rows = text.select(F.from_xml(one, kind).alias("i")).select("i.*")
    rows = rows.select(F.coalesce(F.regexp_extract("`Iteration_query-def`", r"^(\S+)", 1), F.col("`Iteration_query-ID`")).alias("query"), F.explode("Iteration_hits.Hit").alias("h"))
    rows = rows.select("query", F.coalesce("h.Hit_id", "h.Hit_accession").alias("subject"), F.explode("h.Hit_hsps.Hsp").alias("p"))
    length, same = F.col("p.`Hsp_align-len`").cast("long"), F.col("p.Hsp_identity").cast("long")
    return rows.select("query", "subject", (100.0 * same / length).alias("identity"), length.alias("length"), (length - same - F.coalesce(F.col("p.Hsp_gaps").cast("long"), F.lit(0))).alias("mismatches"), F.col("p.Hsp_evalue").cast("double").alias("evalue"), F.col("p.`Hsp_bit-score`").cast("double").alias("bits"))


def domains(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, source, accession, start, end, score): 11 tab fields or more are InterProScan's, 22 by blanks a HMMER domain table's."""
    lines = spark.read.text(path).where("value <> '' AND NOT value LIKE '#%'")
    first = lines.limit(1).collect()
    if first and len(first[0].value.split("\t")) >= 11:
        f = F.split("value", "\t")
        cut = ("string", 0), ("string", 3), ("string", 4), ("long", 6), ("long", 7), ("double", 8)
    else:
        f = F.split(F.trim("value"), r"\s+")
        cut = ("string", 3), (None, "HMMER"), ("string", 1), ("long", 17), ("long", 18), ("double", 6)
    names = ("sequence", "source", "accession", "start", "end", "score")
    return lines.select(*[(F.lit(i) if kind is None else F.get(f, F.lit(i)).try_cast(kind)).alias(n) for n, (kind, i) in zip(names, cut)])
