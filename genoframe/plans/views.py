"""Domain views of the given tables: as DataFrames, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seqs(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq): the letters ACGTN of a document's text, upper-cased."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", "")).alias("seq"))


def intervals(spark: SparkSession, d: str, side: str) -> DataFrame:
    """(contig, start, end): days of shipping since 1992 with the quantity as length, by supplier; left has odd line numbers."""
    rows = table(spark, d, "lineitem").where(F.pmod("l_linenumber", F.lit(2)) == (1 if side == "left" else 0))
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return rows.select(F.col("l_suppkey").cast("string").alias("contig"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


#: Bases of a read of the reads view.
READ = 100


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq, qual): each sequence in reads of up to 100 bases, and a quality made of base, place and id."""
    pieces = F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{READ}}}"), F.lit(0))).alias("part", "seq")
    rows = seqs(spark, d).select("id", pieces).select((F.col("id") * 100_000 + F.col("part")).alias("id"), "seq")
    code = lambda c, i: F.chr(33 + F.pmod(F.ascii(c) * 7 + (i + 1) * 3 + F.col("id"), F.lit(41)))
    split = F.filter(F.split("seq", ""), lambda c: c != "")
    return rows.select("id", "seq", F.array_join(F.transform(split, code), "").alias("qual"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """(seqid, source, type, start, end, strand, id, parent): parts as features of their brand."""
    p = table(spark, d, "part")
    start = F.col("p_partkey") * 10 + 1
    return p.select(
        F.col("p_brand").alias("seqid"), F.when(F.col("p_partkey") % 3 == 0, "curated").otherwise("predicted").alias("source"), F.col("p_type").alias("type"), start.alias("start"),
        (start + F.col("p_size") * 20).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.concat(F.lit("g"), F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("g"), F.col("p_partkey") - F.col("p_partkey") % 5)).alias("parent"),
    )


def variants(spark: SparkSession, d: str) -> DataFrame:
    """(side, chrom, pos, ref, alt, qual, filter, info, gt): line items as variant records."""
    li = table(spark, d, "lineitem")
    base = lambda x: F.substring(F.lit("ACGT"), (F.pmod(x, F.lit(4)) + 1).cast("int"), F.lit(1))
    k = F.col("l_partkey") + F.col("l_linenumber")
    ref = F.when(F.pmod(k, F.lit(11)) == 0, F.concat(base(F.col("l_partkey")), base(k))).otherwise(base(F.col("l_partkey")))
    alt = F.when(F.pmod(k, F.lit(13)) == 0, "<DEL>").when(F.pmod(k, F.lit(7)) == 0, F.concat(base(k + 1), F.lit(","), base(k + 2))).when(F.pmod(k, F.lit(5)) == 0, F.concat(ref, base(k))).otherwise(base(k + 1))
    return li.select(
        F.when(F.col("l_returnflag") == "N", "left").otherwise("right").alias("side"), F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1).alias("chrom"), F.col("l_partkey").alias("pos"),
        ref.alias("ref"), alt.alias("alt"), F.when(F.pmod(k, F.lit(9)) != 0, F.col("l_quantity")).alias("qual"), F.when(F.col("l_linestatus") == "O", "PASS").when(F.pmod(k, F.lit(4)) == 0, ".").otherwise("q10").alias("filter"),
        F.when(F.pmod(k, F.lit(6)) == 0, ".").otherwise(F.concat(F.lit("AC=1;DP="), F.col("l_quantity").cast("long"))).alias("info"),
        F.element_at(F.array(*[F.lit(x) for x in ("0/0", "0/1", "1|1", "./.")]), (F.pmod(F.col("l_orderkey"), F.lit(4)) + 1).cast("int")).alias("gt"),
    )


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """(feature, sample, value): quantities by brand and the supplier's nation, exact in doubles."""
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    rows = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return rows.groupBy(F.col("p_brand").alias("feature"), F.col("s_nationkey").cast("string").alias("sample")).agg(F.sum("l_quantity").cast("double").alias("value"))


def associations(spark: SparkSession, d: str) -> DataFrame:
    """(gene_id, term_id): customers and the priorities and states of their orders."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("gene_id"), F.explode(F.array(F.col("o_orderpriority"), F.concat(F.lit("status-"), "o_orderstatus"))).alias("term_id")).distinct()


def hits(spark: SparkSession, d: str, side: str = "forward") -> DataFrame:
    """(query, subject, identity, length, evalue, bits): line items between suppliers and parts."""
    li = table(spark, d, "lineitem")
    q, s = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    q, s = (q, s) if side == "forward" else (s, q)
    return li.select(q.alias("query"), s.alias("subject"), (100 - 100 * F.col("l_tax")).alias("identity"), F.col("l_quantity").cast("long").alias("length"), F.col("l_discount").alias("evalue"), F.col("l_extendedprice").alias("bits"))


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """(chain, residue, x, y, z): vectors as atoms."""
    e = table(spark, d, "embeddings")
    at = lambda k: F.element_at("embedding", k).cast("double") * 20
    return e.select(F.col("label").cast("string").alias("chain"), F.col("vec_id").alias("residue"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


#: Columns of the alignment view.
COLUMNS = 60


def alignment(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq): each sequence in pieces of 60 bases, filled up with gaps."""
    pieces = F.explode(F.regexp_extract_all("seq", F.lit(f".{{1,{COLUMNS}}}"), F.lit(0))).alias("seq")
    return seqs(spark, d).select("id", pieces).select("id", F.rpad("seq", COLUMNS, "-").alias("seq"))


def alleles_of(spark: SparkSession, d: str) -> DataFrame:
    """(chrom, pos, ref, alt): a deletion of one base after every seventh base of each sequence, its own contig."""
    s = seqs(spark, d).distinct().where(F.length("seq") >= 9)
    at = F.explode(F.sequence(F.lit(2), F.length("seq") - 1, F.lit(7))).alias("pos")
    rows = s.select(F.concat(F.lit("d"), "id").alias("chrom"), "seq", at)
    return rows.select("chrom", "pos", F.expr("substring(seq, pos, 2)").alias("ref"), F.expr("substring(seq, pos, 1)").alias("alt"))


SQL = {
    "seqs": "SELECT doc_id AS id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents",
    "ivl": """SELECT l_suppkey::VARCHAR AS contig, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e,
      l_linenumber % 2 AS odd, row_number() OVER () AS rid FROM lineitem""",
    "lft": "SELECT * FROM ivl WHERE odd = 1",
    "rgt": "SELECT * FROM ivl WHERE odd = 0",
    "pieces": "SELECT id * 100000 + part AS id, substr(seq, part * 100 + 1, 100) AS seq FROM (SELECT id, seq, unnest(range(0, (length(seq) + 99) // 100)) AS part FROM seqs)",
    "reads": "SELECT id, seq, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: chr((33 + (ascii(seq[i]) * 7 + i * 3 + id) % 41)::INTEGER)), '') AS qual FROM pieces",
    "features": """SELECT p_brand AS seqid, CASE WHEN p_partkey % 3 = 0 THEN 'curated' ELSE 'predicted' END AS source, p_type AS type, p_partkey * 10 + 1 AS s, p_partkey * 10 + 1 + p_size * 20 AS e,
      CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'g' || (p_partkey - p_partkey % 5) END AS parent FROM part""",
    "vk": "SELECT *, l_partkey + l_linenumber AS k FROM lineitem",
    "vr": "SELECT *, CASE WHEN k % 11 = 0 THEN substr('ACGT', (l_partkey % 4 + 1)::INT, 1) || substr('ACGT', (k % 4 + 1)::INT, 1) ELSE substr('ACGT', (l_partkey % 4 + 1)::INT, 1) END AS ref FROM vk",
    "variants": """SELECT CASE WHEN l_returnflag = 'N' THEN 'left' ELSE 'right' END AS side, 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey AS pos, ref,
      CASE WHEN k % 13 = 0 THEN '<DEL>' WHEN k % 7 = 0 THEN substr('ACGT', ((k + 1) % 4 + 1)::INT, 1) || ',' || substr('ACGT', ((k + 2) % 4 + 1)::INT, 1)
           WHEN k % 5 = 0 THEN ref || substr('ACGT', (k % 4 + 1)::INT, 1) ELSE substr('ACGT', ((k + 1) % 4 + 1)::INT, 1) END AS alt,
      CASE WHEN k % 9 <> 0 THEN l_quantity END AS qual, CASE WHEN l_linestatus = 'O' THEN 'PASS' WHEN k % 4 = 0 THEN '.' ELSE 'q10' END AS filter,
      CASE WHEN k % 6 = 0 THEN '.' ELSE 'AC=1;DP=' || l_quantity::BIGINT END AS info, ['0/0', '0/1', '1|1', './.'][l_orderkey % 4 + 1] AS gt FROM vr""",
    "matrix": """SELECT p_brand AS feature, s_nationkey::VARCHAR AS sample, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "assoc": "SELECT DISTINCT o_custkey AS gene_id, unnest([o_orderpriority, 'status-' || o_orderstatus]) AS term_id FROM orders",
    "fwd": "SELECT 's' || l_suppkey AS query, 'p' || l_partkey AS subject, 100 - 100 * l_tax AS identity, l_quantity::BIGINT AS length, l_discount AS evalue, l_extendedprice AS bits FROM lineitem",
    "rev": "SELECT subject AS query, query AS subject, identity, length, evalue, bits FROM fwd",
    "atoms": "SELECT label::VARCHAR AS chain, vec_id AS residue, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z FROM embeddings",
    "aln": "SELECT id, rpad(substr(seq, part * 60 + 1, 60), 60, '-') AS seq FROM (SELECT id, seq, unnest(range(0, (length(seq) + 59) // 60)) AS part FROM seqs)",
}
_NEEDS = {"lft": ["ivl"], "rgt": ["ivl"], "pieces": ["seqs"], "reads": ["seqs", "pieces"], "aln": ["seqs"], "vr": ["vk"], "variants": ["vk", "vr"], "rev": ["fwd"]}


def sql(views: str, body: str) -> str:
    """body after the common table expressions of the named views."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
