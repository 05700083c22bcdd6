"""Queries on annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as op
from .catalog import query
from .views import features, seqs, sql, table


@query("gxf_stats", sql("features", """
SELECT 'type' AS kind, type AS value, count(*) AS n FROM features GROUP BY 2 UNION ALL SELECT 'seqid', seqid, count(*) FROM features GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM features GROUP BY 2
UNION ALL SELECT 'strand', strand, count(*) FROM features GROUP BY 2 UNION ALL SELECT 'total', 'records', count(*) FROM features UNION ALL SELECT 'total', 'with_id', count(id) FROM features
UNION ALL SELECT 'total', 'with_parent', count(parent) FROM features UNION ALL SELECT 'total', 'min_start', min(s) FROM features UNION ALL SELECT 'total', 'max_end', max(e) FROM features"""))
def stats(spark, d):
    return op.stats(features(spark, d))


@query("gxf_normalize", sql("features", "SELECT concat_ws(chr(9), seqid, source, type, s, e, '.', strand, '.', 'ID=' || id || coalesce(';Parent=' || parent, '')) AS line FROM features"))
def normalize(spark, d):
    return op.normalized(features(spark, d))


@query("gene_positions", sql("features", """SELECT id, seqid, s AS "start", e AS "end", strand FROM features WHERE type IN (SELECT max(type) FROM features UNION SELECT min(type) FROM features)"""))
def positions(spark, d):
    f = features(spark, d)
    low, high = f.agg(F.min("type"), F.max("type")).first()
    return op.positions(f, (low, high))


@query("gxf_to_bed", sql("features", """SELECT seqid AS contig, s - 1 AS "start", e AS "end", id AS name, 0.0::DOUBLE AS score, strand FROM features"""))
def to_bed(spark, d):
    return op.to_bed(features(spark, d))


@query("gene_density", sql("features", """
WITH l AS (SELECT seqid, max(e) AS len FROM features GROUP BY 1), b AS (SELECT seqid, len, unnest(range(0, (len - 1) // 500 + 1)) AS k FROM l),
w AS (SELECT seqid, k * 500 + 1 AS "start", least(k * 500 + 1000, len) AS "end" FROM b)
SELECT w.seqid, "start", "end", count(f.id) AS n, count(f.id) * 1e6::DOUBLE / ("end" - "start" + 1) AS per_mb FROM w LEFT JOIN features f ON f.seqid = w.seqid AND f.s <= "end" AND f.e >= "start" GROUP BY 1, 2, 3"""))
def density(spark, d):
    return op.density(features(spark, d), 1000, 500)


def _placed(spark, d):
    """Features of two parts each on documents' sequences."""
    s = seqs(spark, d).distinct().where(F.length("seq") >= 60)
    refs = s.select(F.concat(F.lit("d"), "id").alias("seqid"), "seq")
    part = lambda a, b: s.select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("d"), "id").alias("seqid"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    return part(41, 55).unionByName(part(11, 20)), refs


_RC = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"


@query("annotation_extract", sql("seqs", f"""WITH p AS (SELECT DISTINCT id, substr(seq, 11, 10) || substr(seq, 41, 15) AS x FROM seqs WHERE length(seq) >= 60)
SELECT 'f' || id AS id, CASE WHEN id % 2 = 0 THEN x ELSE {_RC.format('x')} END AS seq FROM p"""))
def extract(spark, d):
    return op.extracted(*_placed(spark, d))


@query("annotation_promoter", sql("seqs", f"""WITH p AS (SELECT DISTINCT id, seq FROM seqs WHERE length(seq) >= 60)
SELECT 'f' || id AS id, CASE WHEN id % 2 = 0 THEN substr(seq, 1, 10) ELSE {_RC.format('substr(seq, 21, 30)')} END AS seq FROM p"""))
def promoter(spark, d):
    f, refs = _placed(spark, d)
    return op.extracted(f.where("start = 11"), refs, promoter=30)


@query("go_normalize", r"""WITH t AS (SELECT doc_id, unnest([CASE WHEN doc_id % 3 = 0 THEN 'GO:' || lpad((doc_id % 50)::VARCHAR, 7, '0') END, CASE WHEN doc_id % 2 = 0 THEN 'GO:' || lpad((n_chars % 40)::VARCHAR, 7, '0') END]) AS term FROM documents)
SELECT DISTINCT doc_id AS gene, term FROM t WHERE term IS NOT NULL""")
def go_normalize(spark, d):
    docs = table(spark, d, "documents")
    go = lambda c, k: F.concat(F.lit("GO:"), F.lpad((F.col(c) % k).cast("string"), 7, "0"))
    terms = F.concat_ws(";", F.when(F.col("doc_id") % 3 == 0, go("doc_id", 50)), F.lit("bad|GO:12"), F.when(F.col("doc_id") % 2 == 0, go("n_chars", 40)))
    return op.go_terms(docs.select(F.col("doc_id").alias("gene"), terms.alias("terms")))


@query("eggnog_normalize", """SELECT doc_id AS gene, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_go, (CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END + 1)::BIGINT AS n_kegg, CASE WHEN doc_id % 4 = 0 THEN 'K,S' WHEN doc_id % 4 = 1 THEN '' ELSE 'T' END AS cog FROM documents""")
def eggnog_normalize(spark, d):
    i = F.col("doc_id")
    return op.eggnog(table(spark, d, "documents").select(
        i.alias("gene"), F.when(i % 2 == 0, "GO:0000001,GO:1,GO:0000001").otherwise("-").alias("gos"), F.when(i % 3 == 0, "ko:K1,ko:K2").otherwise("-").alias("ko"), F.lit("map1").alias("pathways"),
        F.when(i % 4 == 0, "SK").when(i % 4 == 1, "-").otherwise("T").alias("cog")))
