"""Queries on intervals."""

from __future__ import annotations

from ..operators import intervals as op
from .catalog import query
from .views import intervals, sql

WIDTH = 32


def _both(spark, d):
    return intervals(spark, d, "left"), intervals(spark, d, "right")


_PER_CONTIG = """
WITH p AS (SELECT l.contig, l.rid AS lid, r.rid AS rid, least(l.e, r.e) - greatest(l.s, r.s) AS b FROM lft l JOIN rgt r ON l.contig = r.contig AND l.s < r.e AND r.s < l.e),
ps AS (SELECT contig, count(*) AS pairs, count(DISTINCT lid) AS left_hit, count(DISTINCT rid) AS right_hit, sum(b)::BIGINT AS bases FROM p GROUP BY 1),
ln AS (SELECT contig, count(*) AS left_n FROM lft GROUP BY 1), rn AS (SELECT contig, count(*) AS right_n FROM rgt GROUP BY 1),
res AS (SELECT coalesce(ln.contig, rn.contig) AS contig, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n, coalesce(pairs, 0) AS pairs, coalesce(left_hit, 0) AS left_hit,
  coalesce(right_hit, 0) AS right_hit, coalesce(bases, 0)::BIGINT AS bases FROM ln FULL JOIN rn ON ln.contig = rn.contig LEFT JOIN ps ON ps.contig = coalesce(ln.contig, rn.contig))
"""


@query("interval_intersect_by_contig", sql("lft rgt", _PER_CONTIG + "SELECT * FROM res"))
def by_contig(spark, d):
    return op.intersect_by_contig(*_both(spark, d), 256)


@query("interval_intersect_total", sql("lft rgt", _PER_CONTIG + "SELECT sum(left_n)::BIGINT AS left_n, sum(right_n)::BIGINT AS right_n, sum(pairs)::BIGINT AS pairs, sum(left_hit)::BIGINT AS left_hit, sum(right_hit)::BIGINT AS right_hit, sum(bases)::BIGINT AS bases FROM res"))
def total(spark, d):
    return op.intersect_total(*_both(spark, d), 256)


@query("interval_overlap_pairs", sql("lft rgt", "SELECT l.contig, l.s AS ls, l.e AS le, r.s AS rs, r.e AS re, least(l.e, r.e) - greatest(l.s, r.s) AS bases FROM lft l JOIN rgt r ON l.contig = r.contig AND l.s < r.e AND r.s < l.e"))
def pairs(spark, d):
    return op.overlap_pairs(*_both(spark, d), WIDTH)


_MERGE = """
WITH a AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {v}),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM a),
m AS (SELECT contig, min(s) AS "start", max(e) AS "end", count(*) AS n FROM b GROUP BY contig, island)
"""


@query("interval_merge", sql("lft", _MERGE.format(v="lft", gap=0) + "SELECT * FROM m"))
def merge(spark, d):
    return op.merge(intervals(spark, d, "left"), 0, 256)


@query("interval_merge_gap", sql("lft", _MERGE.format(v="lft", gap=5) + "SELECT * FROM m"))
def merge_gap(spark, d):
    return op.merge(intervals(spark, d, "left"), 5, 256)


@query("interval_merge_stats", sql("lft", _MERGE.format(v="lft", gap=0) + """,
o AS (SELECT contig, sum(n)::BIGINT AS in_n, count(*) AS out_n, sum("end" - "start")::BIGINT AS out_bases FROM m GROUP BY 1),
i AS (SELECT contig, sum(e - s)::BIGINT AS in_bases FROM lft GROUP BY 1)
SELECT o.contig, in_n, out_n, in_n - out_n AS merged_n, in_bases, out_bases FROM o JOIN i ON o.contig = i.contig"""))
def merge_stats(spark, d):
    return op.merge_stats(intervals(spark, d, "left"), 0, 256)


@query("interval_subtract", sql("lft rgt", _MERGE.format(v="rgt", gap=0) + """,
c AS (SELECT l.contig, l.rid, l.s, l.e, m."start" AS rs, m."end" AS re FROM lft l JOIN m ON l.contig = m.contig AND l.s < m."end" AND m."start" < l.e),
w AS (SELECT *, coalesce(lag(re) OVER (PARTITION BY rid ORDER BY rs), s) AS prev, lead(rs) OVER (PARTITION BY rid ORDER BY rs) AS nxt FROM c)
SELECT contig, s AS "start", e AS "end" FROM lft WHERE rid NOT IN (SELECT rid FROM c)
UNION ALL SELECT contig, prev, rs FROM w WHERE prev < rs
UNION ALL SELECT contig, re, e FROM w WHERE nxt IS NULL AND re < e"""))
def subtract(spark, d):
    return op.subtract(*_both(spark, d), 64)


@query("interval_closest", sql("lft rgt", """
WITH x AS (SELECT l.contig, l.rid, l.s AS q_start, l.e AS q_end, r.s AS t_start, r.e AS t_end, greatest(0, r.s - l.e, l.s - r.e) AS distance FROM lft l JOIN rgt r ON l.contig = r.contig),
b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, t_start, t_end) AS k FROM x)
SELECT contig, q_start, q_end, t_start, t_end, distance,
  CASE WHEN t_start < q_end AND q_start < t_end THEN 'overlap' WHEN t_end <= q_start THEN 'upstream' ELSE 'downstream' END AS direction FROM b WHERE k = 1"""))
def closest(spark, d):
    return op.closest(*_both(spark, d), 256)
