"""Mixing sources to target weights by systematic sampling, with Spark SQL expressions only.

Within a source every document is expected the same number of copies, target / size
of the source. Documents are put in order of size, the expected copies are summed up
along that order, one offset per source is added, and a document leaves one copy for
each integer that its part of the sum crosses.

The running sum needs no task that holds a whole source: sizes are counted per
(source, size), then per (source, size, block of ids by their hash), and only documents of one
such block are put in order together.

Defined results: a null or blank text has size 0 and takes 0 words; a null source
is a source of its own and comes last; equal rows are counted each, and each
has copies of its own; a null id comes first; a source of size 0 has target 0 and
copies 0; an empty table gives an empty table; other columns are kept as they are
by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The weights of sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is used more often than this.
MOST = 3
#: Documents of one size and source are dealt into as many blocks.
BLOCKS = 1021


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: shares by weight of the total, none above most times its size.

    Sources whose limit per unit of weight is smallest fill first, so one pass in
    that order finds all of them. There are as many rows as sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_source, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    ranked = sizes.withColumn("k", F.row_number().over(by_source)).withColumn("w", w)
    ranked = ranked.withColumn("most", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("most") / F.col("w"))
    before = Window.orderBy("level", "k").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("rest", F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("share", F.col("rest") / F.sum("w").over(onward))
    # the first row that keeps below its limit sets the level for itself and all later ones
    open_ = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "k", "share"))).over(all_rows)
    ranked = ranked.withColumn("open", open_)
    full = F.col("open").isNull() | (F.struct("level", "k") < F.struct(F.col("open.level"), F.col("open.k")))
    return ranked.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("w") * F.col("open.share")).alias("target"))


def offset(seed: int):
    """The source's offset in [0, 1), from a digest of the seed and its name."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, source, size) -> with source_size, target and copies; a column `tie` orders rows of one doc_id."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumn("block", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(blocks)))
    cells = rows.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n"))
    heights = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = heights.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes.select("source", "source_size"), weights, most)
    goal = goal.withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).withColumn("u", offset(seed))
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    heights = heights.select("source", "size", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("below"))
    along = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "size", "block", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))

    def same(a: str, b: str, columns):
        return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]

    heights = heights.alias("h").join(goal.alias("g"), same("h", "g", ["source"])).select("h.*", "g.source_size", "g.target", "g.rate", "g.u")
    cells = cells.alias("c").join(heights.alias("h"), same("c", "h", ["source", "size"])).select("c.source", "c.size", "c.block", (F.col("below") + F.col("before")).alias("start"), "source_size", "target", "rate", "u")
    tie = [F.col("tie")] if "tie" in docs.columns else []
    rank = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy(F.col("doc_id").asc_nulls_first(), *tie))
    rows = rows.withColumn("rank", rank).alias("d").join(cells.alias("c"), same("d", "c", ["source", "size", "block"]))
    k = F.col("c.start") + F.col("d.rank")
    crossed = lambda n: F.floor(n.cast("double") * F.col("rate") + F.col("u"))
    kept = [F.col(f"d.`{c}`") for c in docs.columns]
    return rows.select(*kept, F.col("c.source_size"), F.col("c.target"), (crossed(k) - crossed(k - 1)).cast("long").alias("copies"))


def sized(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, size): size is the number of words [^\\x20\\x09-\\x0D]+."""
    n = F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return df.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), n.cast("long").alias("size"))


def mixed_documents(df: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns.

    Rows go along whole through the plan of copies, so rows that share an id have copies of their own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = df.select("doc_id", "source", n.cast("long").alias("size"), F.xxhash64("text").alias("tie"), whole.alias("whole"))
    plan = copies(rows, weights, most, seed).where("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("whole.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken(docs)


def taken(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): taken counts the words of all copies."""
    out = copies(sized(docs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(k - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS most FROM r),
v AS (SELECT *, most / w AS level FROM w),
x AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY level, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY level, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM v),
y AS (SELECT *, rest / ws AS share, row_number() OVER (ORDER BY level, k) AS p FROM x),
o AS (SELECT min(p) AS p FROM y WHERE share <= level),
g AS (SELECT source, source_size,
             CASE WHEN o.p IS NULL OR y.p < o.p THEN most ELSE w * (SELECT share FROM y AS z WHERE z.p = o.p) END AS target
      FROM y, o),
h AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
             ('0x' || substr(md5('17:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM g),
n AS (SELECT d.*, h.source_size, h.target, h.rate, h.u,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1021, d.doc_id NULLS FIRST) AS k
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, ((floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT * size)::BIGINT AS taken,
       (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS copies
FROM n
"""
