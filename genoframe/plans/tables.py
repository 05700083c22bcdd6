"""Queries on tables and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as op
from .catalog import query
from .views import table

_FILTERS = {"equals": ("c_mktsegment", "BUILDING", "c_mktsegment = 'BUILDING'"), "contains": ("c_name", "77", "contains(c_name, '77')"), "non-empty": ("c_mktsegment", None, "length(trim(c_mktsegment)) > 0")}

for _op, (_column, _value, _where) in _FILTERS.items():

    def _manipulate(spark, d, op_=_op, column=_column, value=_value):
        return op.manipulate(table(spark, d, "customer"), "c_custkey", select=["c_name", "c_custkey", "c_mktsegment"], filter_column=column, filter_op=op_, filter_value=value, skip_rows=10, limit=200)

    query(f"table_filter_{_op.replace('-', '_')}", f"SELECT c_name, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r > 10 AND {_where} ORDER BY c_custkey LIMIT 200")(_manipulate)


@query("table_drop", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop(spark, d):
    return op.manipulate(table(spark, d, "customer"), "c_custkey", drop=["c_name", "c_mktsegment"])


@query("table_manipulate_summary", """SELECT count(*) AS input_rows, 10::BIGINT AS skipped_rows, count(*) - 10 - count(*) FILTER (r > 10 AND c_mktsegment = 'BUILDING') AS filtered_rows,
  least(count(*) FILTER (r > 10 AND c_mktsegment = 'BUILDING'), 200)::BIGINT AS output_rows FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)""")
def summary(spark, d):
    return op.manipulate_summary(table(spark, d, "customer"), "c_custkey", "c_mktsegment", "equals", "BUILDING", 10, 200)


def cohort(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("participant"), F.when(F.col("c_nationkey") % 7 == 0, "NA").otherwise(F.col("c_nationkey").cast("string")).alias("site"),
        F.when(F.col("c_nationkey") == 3, ".").when(F.col("c_nationkey") == 4, "1.5d").otherwise(F.floor(F.col("c_acctbal")).cast("string")).alias("biomarker"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("arm"),
    )


_COHORT = """WITH c AS (SELECT c_custkey::VARCHAR AS participant, CASE WHEN c_nationkey % 7 = 0 THEN 'NA' ELSE c_nationkey::VARCHAR END AS site,
  CASE WHEN c_nationkey = 3 THEN '.' WHEN c_nationkey = 4 THEN '1.5d' ELSE floor(c_acctbal)::BIGINT::VARCHAR END AS biomarker, nullif(c_mktsegment, 'BUILDING') AS arm FROM customer)"""


@query("cohort_qc", _COHORT + r""", u AS (
  SELECT 'participant' AS col, participant AS v FROM c UNION ALL SELECT 'site', site FROM c UNION ALL SELECT 'biomarker', biomarker FROM c UNION ALL SELECT 'arm', arm FROM c),
 t AS (SELECT col, trim(coalesce(v, '')) AS v, lower(trim(coalesce(v, ''))) IN ('', 'na', 'nan', 'null', '.') AS miss FROM u),
 n AS (SELECT *, CASE WHEN NOT miss AND regexp_matches(v, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN v::DOUBLE END AS x FROM t)
SELECT col AS "column", count(*) FILTER (NOT miss) AS present, count(*) FILTER (miss) AS missing, 100.0::DOUBLE * count(*) FILTER (miss) / count(*) AS missing_pct,
  count(DISTINCT v) FILTER (NOT miss) AS "distinct", count(x) AS "numeric", min(x) AS "min", max(x) AS "max" FROM n GROUP BY 1""")
def cohort_qc(spark, d):
    return op.cohort_qc(cohort(spark, d))


@query("cohort_duplicates", "SELECT count(*) AS rows, count(*) - count(DISTINCT (c_nationkey, c_mktsegment)) AS duplicate_rows FROM customer")
def cohort_duplicates(spark, d):
    return op.duplicates(table(spark, d, "customer").select("c_nationkey", "c_mktsegment"))


@query("table_export", "SELECT conv_id::VARCHAR AS conv_id, '{\"role\":\"' || role || '\",\"turn\":' || turn || '}' AS nested, role FROM conversations")
def export(spark, d):
    c = table(spark, d, "conversations")
    return op.export_columns(c.select("role", "conv_id", F.struct("role", "turn").alias("nested")))


NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def sets(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("set"), F.col("o_custkey").cast("string").alias("item"))


_REGIONS = "WITH m AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '&' ORDER BY o_orderpriority) AS sets, count(DISTINCT o_orderpriority) AS degree, bit_or(1 << (left(o_orderpriority, 1)::BIGINT - 1)) AS mask FROM orders GROUP BY 1), r AS (SELECT mask::BIGINT AS mask, sets, degree, count(*) AS n FROM m GROUP BY ALL) "


@query("set_venn_regions", _REGIONS + "SELECT * FROM r")
def venn(spark, d):
    return op.exclusive_intersections(sets(spark, d), NAMES)


@query("set_upset_top", _REGIONS + "SELECT row_number() OVER (ORDER BY n DESC, degree DESC, sets) AS rank, sets, degree, n FROM r ORDER BY rank LIMIT 10")
def upset(spark, d):
    return op.upset_top(sets(spark, d), NAMES, 10)


@query("set_sizes", "SELECT o_orderpriority AS \"set\", count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def sizes(spark, d):
    return op.set_sizes(sets(spark, d))
