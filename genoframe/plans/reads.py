"""Queries on reads and alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads as op
from .catalog import query
from .views import intervals, reads, sql, table

_BASES = "WITH b AS (SELECT id, i AS cycle, seq[i] AS b, ascii(qual[i]) - 33 AS q FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM reads))"


@query("fastq_qc_total", sql("reads", _BASES + """, l AS (SELECT count(*) AS reads, min(length(seq)) AS min_len, max(length(seq)) AS max_len FROM reads)
SELECT any_value(reads) AS reads, count(*) AS bases, any_value(min_len) AS min_len, any_value(max_len) AS max_len, count(*)::DOUBLE / any_value(reads) AS mean_len, 100.0::DOUBLE * count(*) FILTER (b IN ('G', 'C')) / count(*) AS gc_percent,
  100.0::DOUBLE * count(*) FILTER (b = 'N') / count(*) AS n_percent, sum(q + 33)::DOUBLE / count(*) - 33 AS mean_quality, 100.0::DOUBLE * count(*) FILTER (q >= 20) / count(*) AS q20_percent,
  100.0::DOUBLE * count(*) FILTER (q >= 30) / count(*) AS q30_percent, CASE WHEN min(q) + 33 < 59 THEN 'phred33' ELSE 'ambiguous' END AS encoding FROM b, l"""))
def qc_total(spark, d):
    return op.qc_total(reads(spark, d))


@query("fastq_qc_per_cycle", sql("reads", _BASES + """
SELECT cycle, count(*) AS bases, 100.0::DOUBLE * count(*) FILTER (b IN ('G', 'C')) / count(*) AS gc_percent, 100.0::DOUBLE * count(*) FILTER (b = 'N') / count(*) AS n_percent,
  sum(q)::DOUBLE / count(*) AS mean_quality, 100.0::DOUBLE * count(*) FILTER (q >= 20) / count(*) AS q20_percent, 100.0::DOUBLE * count(*) FILTER (q >= 30) / count(*) AS q30_percent FROM b GROUP BY 1"""))
def qc_cycles(spark, d):
    return op.qc_cycles(reads(spark, d))


@query("fastq_trim", sql("reads", _BASES + ", t AS (SELECT id, max(cycle) FILTER (q >= 20) AS n FROM b GROUP BY id) SELECT r.id, left(seq, n::INT) AS seq, left(qual, n::INT) AS qual FROM reads r JOIN t ON r.id = t.id WHERE n >= 20"))
def trim(spark, d):
    return op.quality_trimmed(reads(spark, d))


@query("fastq_adapter", sql("reads", """WITH p AS (SELECT *, least(length(seq), CASE WHEN instr(seq, 'ATGANNTA') > 0 THEN instr(seq, 'ATGANNTA') - 1 END, CASE WHEN instr(seq, 'TNAG') > 0 THEN instr(seq, 'TNAG') - 1 END,
  CASE WHEN suffix(seq, 'ATGANNT') THEN length(seq) - 7 END, CASE WHEN suffix(seq, 'ATGANN') THEN length(seq) - 6 END, CASE WHEN suffix(seq, 'ATGAN') THEN length(seq) - 5 END, CASE WHEN suffix(seq, 'ATGA') THEN length(seq) - 4 END,
  CASE WHEN suffix(seq, 'ATG') THEN length(seq) - 3 END, CASE WHEN suffix(seq, 'TNA') THEN length(seq) - 3 END) AS k FROM reads) SELECT id, left(seq, k::INT) AS seq, left(qual, k::INT) AS qual FROM p WHERE k >= 10"""))
def adapter(spark, d):
    return op.adapter_trimmed(reads(spark, d), ("ATGANNTA", "TNAG"), min_overlap=3, min_length=10)


@query("fastq_dedup_sequence", sql("reads", "SELECT min(id) AS id FROM reads GROUP BY upper(seq)"))
def dedup_sequence(spark, d):
    return op.deduplicated(reads(spark, d), "id").select("id").distinct()


@query("fastq_dedup_header_umi", sql("reads", "SELECT min(id) AS id FROM reads GROUP BY id % 50, upper(seq)"))
def dedup_header(spark, d):
    rows = reads(spark, d).select("id", "seq", F.concat(F.lit("read:x:"), (F.col("id") % 50).cast("string")).alias("header"))
    return op.deduplicated(rows, "id", umi_delimiter=":").select("id").distinct()


@query("fastq_dedup_prefix_umi", sql("reads", "SELECT min(id) AS id FROM reads WHERE length(seq) > 4 GROUP BY left(seq, 4), substr(seq, 5)"))
def dedup_prefix(spark, d):
    rows = reads(spark, d).where(F.length("seq") > 4).select("id", "seq")
    return op.deduplicated(rows, "id", umi_bases=4).select("id").distinct()


@query("fastq_subsample", sql("reads", "SELECT id FROM reads ORDER BY md5('42:' || id), id LIMIT 100"))
def subsample(spark, d):
    return op.subsampled(reads(spark, d), 100).select("id")


def records(spark, d):
    li = table(spark, d, "lineitem")
    flag = (F.pmod("l_orderkey", F.lit(16)) * 1 + F.when(F.col("l_linenumber") == 3, 64).otherwise(128) + F.when(F.col("l_linenumber") == 4, 256).otherwise(0) + F.when(F.col("l_linenumber") == 5, 2048).otherwise(0) + F.when(F.col("l_returnflag") == "R", 1024).otherwise(0)).cast("int")
    mapq = F.when(F.col("l_linenumber") == 2, 255).when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int")).otherwise(0)
    return li.select(flag.alias("flag"), mapq.alias("mapq"), F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("rname"))


_SAM = """WITH s AS (SELECT (l_orderkey % 16 + CASE WHEN l_linenumber = 3 THEN 64 ELSE 128 END + CASE WHEN l_linenumber = 4 THEN 256 ELSE 0 END + CASE WHEN l_linenumber = 5 THEN 2048 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 1024 ELSE 0 END)::INT AS flag,
  CASE WHEN l_linenumber = 2 THEN 255 WHEN l_linestatus = 'F' THEN l_quantity::INT ELSE 0 END AS mapq, 'chr' || l_suppkey % 5 AS rname FROM lineitem) """


@query("sam_qc", _SAM + """SELECT count(*) AS records, count(*) FILTER (flag & 2304 = 0) AS "primary", count(*) FILTER (flag & 256 <> 0) AS secondary, count(*) FILTER (flag & 2048 <> 0) AS supplementary,
  count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped, count(*) FILTER (flag & 1 <> 0) AS paired, count(*) FILTER (flag & 2 <> 0) AS proper_pair, count(*) FILTER (flag & 64 <> 0) AS read1,
  count(*) FILTER (flag & 128 <> 0) AS read2, count(*) FILTER (flag & 512 <> 0) AS qc_fail, count(*) FILTER (flag & 1024 <> 0) AS "duplicate", count(*) FILTER (flag & 4 = 0 AND mapq = 0) AS zero_mapq,
  sum(mapq) FILTER (flag & 4 = 0 AND mapq <> 255)::DOUBLE / count(*) FILTER (flag & 4 = 0 AND mapq <> 255) AS mean_mapq, 100.0::DOUBLE * count(*) FILTER (flag & 4 = 0) / count(*) AS mapped_percent FROM s""")
def sam_qc(spark, d):
    return op.alignment_qc(records(spark, d))


@query("sam_ref_counts", _SAM + "SELECT rname, count(*) AS mapped FROM s WHERE flag & 4 = 0 GROUP BY 1")
def ref_counts(spark, d):
    return op.reference_counts(records(spark, d))


@query("alignment_coverage", sql("lft", """
WITH v AS (SELECT contig, s AS p, 1 AS d FROM lft UNION ALL SELECT contig, e AS p, -1 AS d FROM lft), g AS (SELECT contig, p, sum(d) AS d FROM v GROUP BY contig, p HAVING sum(d) <> 0),
w AS (SELECT contig, p AS "start", lead(p) OVER (PARTITION BY contig ORDER BY p) AS "end", (sum(d) OVER (PARTITION BY contig ORDER BY p))::BIGINT AS depth FROM g) SELECT * FROM w WHERE depth > 0"""))
def coverage(spark, d):
    return op.coverage(intervals(spark, d, "left"))
