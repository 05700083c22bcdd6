"""Queries on variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants as op
from .catalog import query
from .views import alleles_of, seqs, sql, variants

_CLASS = "CASE WHEN a = '*' OR (a[1] = '<' AND a[-1] = '>') OR contains(a, '[') OR contains(a, ']') THEN 'SYMBOLIC' WHEN length(ref) = 1 AND length(a) = 1 THEN 'SNP' WHEN length(ref) = length(a) THEN 'MNV' ELSE 'INDEL' END"


@query("vcf_stats", sql("variants", f"""
WITH k AS (SELECT *, list_filter(string_split(alt, ','), lambda a: a <> '.') AS alts, string_split(replace(gt, '|', '/'), '/') AS g FROM variants),
c AS (SELECT *, list_transform(alts, lambda a: {_CLASS}) AS kinds, list_contains(g, '.') AS miss, CASE WHEN list_contains(g, '.') THEN 0 ELSE len(list_filter(g, lambda x: x NOT IN ('0', '.'))) END AS copies FROM k),
s AS (SELECT count(*) AS records, count(*) FILTER (filter = 'PASS') AS pass, count(*) FILTER (filter NOT IN ('PASS', '.')) AS filtered, sum(len(list_filter(kinds, lambda x: x = 'SNP')))::BIGINT AS snp,
  sum(len(list_filter(kinds, lambda x: x = 'INDEL')))::BIGINT AS indel, sum(len(list_filter(kinds, lambda x: x = 'MNV')))::BIGINT AS mnv, sum(len(list_filter(kinds, lambda x: x = 'SYMBOLIC')))::BIGINT AS symbolic, count(*) FILTER (len(kinds) > 1) AS multiallelic,
  count(*) FILTER (len(kinds) = 1 AND kinds[1] = 'SNP' AND ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS transitions, count(*) FILTER (len(kinds) = 1 AND kinds[1] = 'SNP' AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS transversions,
  count(*) FILTER (miss) AS missing_gt, count(*) FILTER (NOT miss) AS called_gt, count(*) FILTER (copies > 0) AS carriers, sum(copies)::BIGINT AS alt_copies FROM c)
SELECT *, transitions::DOUBLE / transversions AS ti_tv, missing_gt::DOUBLE / (missing_gt + called_gt) AS missing_rate FROM s"""))
def stats(spark, d):
    return op.stats(variants(spark, d))


@query("vcf_contig_counts", sql("variants", "SELECT chrom, count(*) AS n FROM variants GROUP BY 1"))
def contigs(spark, d):
    return op.contig_counts(variants(spark, d))


_RULES = {"min_qual": 10, "require_pass": True, "contigs": ["chr1", "chr2", "chr3"], "min_dp": 15}
_REASON = """WITH r AS (SELECT *, CASE WHEN qual IS NULL OR qual < 10 THEN 'qual' WHEN filter <> 'PASS' THEN 'filter' WHEN chrom NOT IN ('chr1', 'chr2', 'chr3') THEN 'contig'
  WHEN info = '.' OR nullif(regexp_extract(info, 'DP=([^;]*)', 1), '')::BIGINT < 15 THEN 'depth' END AS reason FROM variants) """


@query("vcf_filter", sql("variants", _REASON + "SELECT chrom, pos, ref, alt FROM r WHERE reason IS NULL"))
def filtered(spark, d):
    return variants(spark, d).where(op.reject_reason(**_RULES).isNull()).select("chrom", "pos", "ref", "alt")


@query("vcf_filter_reasons", sql("variants", _REASON + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1"))
def reasons(spark, d):
    return variants(spark, d).groupBy(F.coalesce(op.reject_reason(**_RULES), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ALLELES = """WITH x AS (SELECT DISTINCT side, chrom, pos, ref, unnest(string_split(alt, ',')) AS alt FROM variants),
y AS (SELECT *, alt = '<DEL>' AS sym, CASE WHEN alt <> '<DEL>' AND length(ref) > 1 AND length(alt) > 1 AND ref[-1] = alt[-1] THEN 1 ELSE 0 END AS n1 FROM x),
y2 AS (SELECT side, chrom, pos, sym, left(ref, length(ref) - n1) AS ref, CASE WHEN sym THEN alt ELSE left(alt, length(alt) - n1) END AS alt FROM y),
y3 AS (SELECT *, CASE WHEN NOT sym AND length(ref) > 1 AND length(alt) > 1 AND ref[-1] = alt[-1] THEN 1 ELSE 0 END AS n2 FROM y2),
y4 AS (SELECT side, chrom, pos, sym, left(ref, length(ref) - n2) AS ref, CASE WHEN sym THEN alt ELSE left(alt, length(alt) - n2) END AS alt FROM y3),
y5 AS (SELECT *, CASE WHEN NOT sym AND length(ref) > 1 AND length(alt) > 1 AND ref[1] = alt[1] THEN 1 ELSE 0 END AS p1 FROM y4),
z AS (SELECT DISTINCT side, chrom, pos + p1 AS pos, substr(ref, p1 + 1) AS ref, CASE WHEN sym THEN alt ELSE substr(alt, p1 + 1) END AS alt FROM y5) """


@query("vcf_compare", sql("variants", _ALLELES + """SELECT chrom, pos, ref, alt, CASE WHEN bool_or(side = 'left') AND bool_or(side = 'right') THEN 'shared' WHEN bool_or(side = 'left') THEN 'left-only' ELSE 'right-only' END AS status FROM z GROUP BY ALL"""))
def compare(spark, d):
    v = variants(spark, d)
    return op.compared(v.where("side = 'left'"), v.where("side = 'right'"))


@query("vcf_to_table", sql("variants", """SELECT chrom AS "CHROM", pos::VARCHAR AS "POS", ref AS "REF", alt AS "ALT", filter AS "FILTER", info AS "INFO", gt AS sample FROM variants"""))
def to_table(spark, d):
    return op.to_table(variants(spark, d))


@query("vcf_normalize", sql("seqs", """WITH s AS (SELECT DISTINCT 'd' || id AS chrom, seq FROM seqs WHERE length(seq) >= 9), v AS (SELECT chrom, seq, unnest(range(2, length(seq), 7)) AS p FROM s),
r AS (SELECT chrom, seq, greatest(1, length(rtrim(left(seq, p), seq[p + 1]))) AS pos FROM v)
SELECT chrom, pos::BIGINT AS pos, substr(seq, pos, 2) AS ref, substr(seq, pos, 1) AS alt FROM r"""))
def normalize(spark, d):
    """Deletions of one base all along each document's sequence."""
    references = seqs(spark, d).distinct().where(F.length("seq") >= 9).select(F.concat(F.lit("d"), "id").alias("chrom"), "seq")
    return op.normalized(alleles_of(spark, d), references)


@query("pgx_match", """WITH v AS (SELECT l_orderkey, l_linenumber, l_orderkey % 6 AS i, ['0/0', '0/1', '1|1', './.'][l_partkey % 4 + 1] AS gt FROM lineitem),
r AS (SELECT * FROM (VALUES (0, 'chr10', 96541605, 'CYP2C19', 'CYP2C19*2'), (1, 'chr10', 96540410, 'CYP2C19', 'CYP2C19*3'), (2, 'chr10', 96521657, 'CYP2C19', 'CYP2C19*17'), (3, 'chr22', 42130641, 'CYP2D6', 'CYP2D6*4'),
  (4, 'chr22', 42127943, 'CYP2D6', 'CYP2D6*10'), (5, 'chr12', 21176826, 'SLCO1B1', 'SLCO1B1*5')) t(i, chrom, pos, gene, allele))
SELECT chrom, pos::BIGINT AS pos, gene, allele, CASE gt WHEN '1|1' THEN 'hom-alt' ELSE 'het-alt' END AS genotype, count(*) AS n FROM v JOIN r ON v.i = r.i WHERE gt IN ('0/1', '1|1') GROUP BY ALL""")
def pgx(spark, d):
    rules = op.pgx_rules(spark)
    sites = F.array(*[F.struct(F.lit(c).alias("chrom"), F.lit(p).cast("long").alias("pos"), F.lit(r).alias("ref"), F.lit(a).alias("alt")) for c, p, r, a, *_ in op.PGX_ALLELES[:6]])
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    gt = F.element_at(F.array(*[F.lit(x) for x in ("0/0", "0/1", "1|1", "./.")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    rows = li.select(F.element_at(sites, (F.col("l_orderkey") % 6 + 1).cast("int")).alias("s"), gt.alias("gt")).select("s.*", "gt")
    return op.pgx_matches(rows, rules).groupBy("chrom", "pos", "gene", "allele", "genotype").agg(F.count(F.lit(1)).alias("n"))
