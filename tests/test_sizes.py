"""Results that must not depend on how rows are split, sampled or ordered among equals."""

import random

from pyspark.sql import functions as F

from genoframe.functions.statistics import bh_adjusted
from genoframe.operators import enrichment, intervals, phylogeny, prefix
from genoframe.sources import tables


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_keeps_equal_intervals_in_their_island(spark, monkeypatch):
    """The second pass may meet equal intervals in another order than the first: here the one that opens an island comes last."""
    plain, calls = intervals.running, []

    def turned(df, keys, bin_column, order, of, **how):
        calls.append(1)
        return plain(df, keys, bin_column, [*order, F.col("new")] if len(calls) == 2 else order, of, **how)

    monkeypatch.setattr(intervals, "running", turned)
    a = [("c", 0, 5), ("c", 10, 15), ("c", 10, 15), ("c", 10, 15), ("c", 30, 31)]
    frame = spark.createDataFrame(a, "contig string, start long, end long")
    assert rows_of(intervals.merge(frame, 0, 256)) == [("c", 0, 5, 1), ("c", 10, 15, 3), ("c", 30, 31, 1)]
    calls.clear()
    assert rows_of(intervals.merge_stats(frame, 0, 256)) == [("c", 5, 3, 2, 21, 11)]
    calls.clear()
    left = spark.createDataFrame([("c", 0, 40)], "contig string, start long, end long")
    assert rows_of(intervals.subtract(left, frame, 256)) == [("c", 5, 10), ("c", 15, 30), ("c", 31, 40)]


def test_adjusted_values_and_ranks_over_many_rows(spark):
    """More rows than a range partitioning samples: two uses of it would have other bounds."""
    n = 200_000
    rows = spark.range(0, 3 * n, 1, 8).groupBy((F.col("id") % n).alias("id")).agg(F.count(F.lit(1)).alias("c")).select("id", (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0)).alias("p"))
    got = {r.id: r.padj for r in bh_adjusted(rows, "p", "id").collect()}
    want, least = {}, 1.0
    for k, r in reversed(list(enumerate(sorted(rows.collect(), key=lambda r: (r.p, r.id)), 1))):
        least = min(least, r.p * n / k)
        want[r.id] = least
    assert got == want
    scores = rows.select(F.col("id").cast("string").alias("gene_id"), (F.floor(F.col("p") * 20_000) - 10_000).cast("double").alias("score"))
    order = sorted(scores.collect(), key=lambda r: (-r.score, r.gene_id))
    assert {r.gene_id: r["rank"] for r in enrichment.ranked(scores).collect()} == {r.gene_id: k for k, r in enumerate(order, 1)}


def test_bins_ascend_with_values(spark):
    rng = random.Random(2)
    x = [s * m * 2.0**e for s in (1, -1) for e in range(-1074, 1020, 7) for m in (1.0, 1 + 2**-52, 2 - 2**-52, rng.uniform(1, 2))] + [0.0, -0.0]
    got = [r.b for r in spark.createDataFrame([(v,) for v in sorted(x)], "v double").coalesce(1).select(prefix.value_bin(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


def _plain_kinds(x, y):
    n = max(len(x), len(y))
    cols = [(p, q) for p, q in zip(x.ljust(n, "-"), y.ljust(n, "-")) if (p, q) != ("-", "-")]
    ts = sum(p + q in ("AG", "GA", "CT", "TC") for p, q in cols)
    differ = sum(p != q for p, q in cols)
    return len(cols), differ, ts, sum(p != q and "-" not in (p, q) for p, q in cols) - ts


def test_packed_pairs_against_plain_columns():
    """Gaps, other letters, empty and missing sequences, ends in and at the end of a word."""
    rng = random.Random(3)
    for letters in ("ACGTN", "ACGTN-", "ACGTN-RYKMéz."):
        make = lambda: ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 128, 200)))) for _ in range(20)] + [None]
        a, b = make(), make()
        q, d = phylogeny._packed(list(range(21)), a, phylogeny.QUERY), phylogeny._packed(list(range(21)), b, phylogeny.OTHER)
        got = list(zip(*[v.tolist() for v in phylogeny._pairs(q, d, True)]))
        utf = lambda s: s.encode().decode("latin-1")
        want = [(0, 0, 0, 0) if None in (a[i], b[j]) else _plain_kinds(utf(a[i]), utf(b[j])) for i in q["ids"] for j in d["ids"]]
        assert got == want


def test_distances_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(phylogeny, "BESIDE", 7)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGTN") for _ in range(rng.randrange(150)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, seq string")
    got = {(r.a, r.b): r.distance for r in phylogeny.distances(frame, "p-distance", frame.where("id % 5 = 0"), 3).collect()}
    plain = {(i, j): _plain_kinds(x, y) for i, x in rows if i % 5 == 0 for j, y in rows}
    assert got == {k: v[1] / v[0] if v[0] else 0.0 for k, v in plain.items()}


def test_xml_reports_split(spark, tmp_path):
    """A report in several parts; each is read by itself, split at iterations."""
    one = lambda k: f"<Iteration>\n<Iteration_query-def>q{k} &amp; x</Iteration_query-def><Iteration_hits><Hit><Hit_id>s{k}</Hit_id><Hit_hsps><Hsp><Hsp_bit-score>90</Hsp_bit-score><Hsp_evalue>1e-9</Hsp_evalue><Hsp_identity>45</Hsp_identity><Hsp_align-len>50</Hsp_align-len></Hsp></Hit_hsps></Hit></Iteration_hits>\n</Iteration>\n"
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?>\n<BlastOutput>\n" + "".join(one(k) for k in range(400)) + "</BlastOutput>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.blast_xml(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        assert sorted(r["query"] + r.subject for r in rows.collect()) == sorted(f"q{k}s{k}" for k in range(400))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
