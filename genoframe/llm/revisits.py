"""Resolution of not-modified revisit records of web archives.

A record with status 304 has no body. It is resolved to the latest full response
(status 200) captured earlier under the same canonical URL, if the validators agree:
equal strong ETags, or, where either side has none, equal Last-Modified. The headers are
those of the full response, updated by those that a 304 may carry.

The as-of join uses Spark SQL only. Captures of a URL are cut into ranges of time; the
latest response of each range is found by aggregation, carried over ranges (at most
`ranges` rows for a URL), and only captures in one range of one URL are put in order
together, so a URL with a third of all captures is spread.

Defined results: captures at the same time are ordered by record_id, null first; a null
URL is its own group; a revisit without an earlier response is `no-origin`; one whose
validators differ is `mismatch`, and one where neither pair can be compared is
`unvalidated`, both with the origin found; repeated records each get a row; other
columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
#: Headers that a 304 response may update, fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't name a resource.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical(url: Column) -> Column:
    """Scheme, a www host prefix, default ports, fragment, tracking parameters, an index page's name and trailing slashes go; host lowered; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merged_headers(origin: Column, update: Column) -> Column:
    """The origin's headers, with those of the update that a 304 may carry; names lowered."""
    permitted = F.array(*[F.lit(h) for h in PERMITTED])
    lowered = lambda m: F.transform_keys(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: F.lower(k))
    new = F.map_filter(lowered(update), lambda k, v: F.array_contains(permitted, k))
    return F.map_concat(F.map_filter(lowered(origin), lambda k, v: ~F.map_contains_key(new, k)), new)


def resolved(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """One row for each 304 of (record_id, url, at, status, etag, last_modified, headers)."""
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), F.col("at").cast("long").alias("at"), "status", "etag", "last_modified", "headers")
    span = rows.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    low, width = span.low or 0, max(1, -(-((span.high or 0) - (span.low or 0) + 1) // ranges))
    rows = rows.withColumn("range", F.floor((F.col("at") - F.lit(low)) / F.lit(width)))
    full = F.when(F.col("status") == 200, F.struct("at", "record_id", "etag", "last_modified", "headers"))
    rows = rows.withColumn("own", full)
    order = F.when(F.col("status") == 200, F.struct("at", "record_id"))
    lasts = rows.groupBy("canonical_url", "range").agg(F.max_by("own", order).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(F.col("canonical_url").alias("u"), F.col("range").alias("r"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("canonical_url", "range").orderBy(F.col("at").asc_nulls_first(), F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last("own", ignorenulls=True).over(within)).where(F.col("status") == 304)
    rows = rows.join(lasts, F.col("canonical_url").eqNullSafe(F.col("u")) & F.col("range").eqNullSafe(F.col("r")), "left")
    rows = rows.withColumn("o", F.coalesce("near", "carried"))
    strong = lambda e: e.isNotNull() & ~e.startswith("W/")
    etags = strong(F.col("etag")) & strong(F.col("o.etag"))
    dates = F.col("last_modified").isNotNull() & F.col("o.last_modified").isNotNull()
    agree = F.when(etags, F.col("etag") == F.col("o.etag")).when(dates, F.col("last_modified") == F.col("o.last_modified"))
    outcome = F.when(F.col("o").isNull(), "no-origin").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    return rows.select(
        "record_id", "canonical_url", "at", F.col("o.record_id").alias("origin_id"), F.col("o.at").alias("origin_at"), outcome.alias("outcome"),
        F.when(outcome == "resolved", merged_headers(F.col("o.headers"), F.col("headers"))).alias("headers"),
    )


def records_of(pages: DataFrame, again: int = 1000) -> DataFrame:
    """Crawl records of the pages table: each page's full response at its id, and the crawler's later 304 for it.

    A record's id is twice the page's, plus 1 for the 304. The entity tag is a digest of the body.
    """
    tag = F.md5(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", tag.alias("etag"), F.length(F.coalesce("html", F.lit(""))).alias("size"))
    full = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit(200).alias("status"), "etag", F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("Content-Length"), F.col("size").cast("string"), F.lit("ETag"), F.col("etag"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"),
    )
    when = F.col("page_id") + again
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", when.alias("at"), F.lit(304).alias("status"), "etag", F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), when.cast("string"), F.lit("Expires"), (when + 60).cast("string")).alias("headers"),
    )
    return full.unionByName(revisit)


def op6_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolved(records_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    line = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select(F.shiftright("record_id", 1).alias("page_id"), "canonical_url", F.shiftright("origin_id", 1).alias("origin_page_id"), "origin_at", "outcome", line.alias("merged_headers"))


OP6_SQL = r"""
WITH b AS (SELECT page_id, md5(coalesce(html, '')) AS etag, length(coalesce(html, '')) AS size,
       regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (SELECT page_id, etag, size,
       regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(?:80|443)$', ''), '^www\.', '') AS host,
       regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/index\.html?$', ''), '/+$', '') AS path,
       list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
         lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS kept FROM b),
u AS (SELECT page_id, etag, size, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url FROM c),
j AS (SELECT r.page_id, r.canonical_url, r.etag, o.page_id AS origin_page_id, o.etag AS o_etag, o.size
      FROM u AS r ASOF LEFT JOIN u AS o ON r.canonical_url = o.canonical_url AND r.page_id + 1000 >= o.page_id)
SELECT page_id, canonical_url, origin_page_id, origin_page_id AS origin_at,
       CASE WHEN origin_page_id IS NULL THEN 'no-origin' WHEN etag = o_etag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN etag = o_etag THEN 'content-length=' || size || ';date=' || (page_id + 1000) || ';etag=' || o_etag || ';expires=' || (page_id + 1060) END AS merged_headers
FROM j
"""
