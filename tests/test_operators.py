"""Small fixtures with results worked out by hand, and brute force over small universes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from genoframe.functions.sequence import reverse_complement, translate_frame
from genoframe.operators import ecology, enrichment, expression, intervals, phylogeny, proteins, reads, sequences, similarity, structures, survival, tables, variants

IV = "contig string, start long, end long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def universe():
    rng = random.Random(1)
    make = lambda: [("c" + str(rng.randrange(3)), s, s + rng.randrange(1, 6)) for s in (rng.randrange(0, 30) for _ in range(60))]
    return make(), make()


def test_overlaps_against_brute_force(spark, universe):
    a, b = universe
    left, right = spark.createDataFrame(a, IV), spark.createDataFrame(b, IV)
    want = sorted((c, s, e, s2, e2, min(e, e2) - max(s, s2)) for c, s, e in a for c2, s2, e2 in b if c == c2 and s < e2 and s2 < e)
    for width in (1, 4, 100):
        assert rows_of(intervals.overlap_pairs(left, right, width)) == want
        assert rows_of(intervals.overlap_counts(left, right, width)) == sorted((c, s, e, sum(c == c2 and s < e2 and s2 < e for c2, s2, e2 in b), sum(max(0, min(e, e2) - max(s, s2)) for c2, s2, e2 in b if c == c2)) for c, s, e in a)


def test_closest_against_brute_force(spark, universe):
    a, b = universe
    got = rows_of(intervals.closest(spark.createDataFrame(a, IV), spark.createDataFrame(b, IV), 7))
    want = []
    for c, s, e in a:
        near = sorted((max(0, s2 - e, s - e2), s2, e2) for c2, s2, e2 in b if c2 == c)
        if near:
            d, s2, e2 = near[0]
            want.append((c, s, e, s2, e2, d, "overlap" if s2 < e and s < e2 else "upstream" if e2 <= s else "downstream"))
    assert got == sorted(want)


def test_merge_and_subtract_against_brute_force(spark, universe):
    a, b = universe
    cover = lambda rows: {(c, x) for c, s, e in rows for x in range(s, e)}
    merged = rows_of(intervals.merge(spark.createDataFrame(a, IV), 0, 5).drop("n"))
    assert cover(merged) == cover(a) and all(x[0] != y[0] or x[2] < y[1] for x, y in zip(merged, merged[1:]))
    left = rows_of(intervals.subtract(spark.createDataFrame(a, IV), spark.createDataFrame(b, IV), 5))
    want = sorted(p for c, s, e in a for p in pieces(c, [x for x in range(s, e) if (c, x) not in cover(b)]))
    assert left == want


def pieces(c, xs):
    out = []
    for x in xs:
        if out and out[-1][2] == x:
            out[-1] = (c, out[-1][1], x + 1)
        else:
            out.append((c, x, x + 1))
    return out


def test_sequence_stats(spark):
    row = sequences.stats(spark.createDataFrame([("ACGTNN",), ("GGGG",), ("AT",)], "seq string")).first()
    assert (row["count"], row.total, row.n50, row.l50, row.n_count, row.min, row.max) == (3, 12, 6, 1, 2, 2, 6)
    assert abs(row.aun - 56 / 12) < 1e-12 and row.gc_percent == 60.0
    empty = sequences.stats(spark.createDataFrame([], "seq string")).first()
    assert empty["count"] is None or empty["count"] == 0


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGRYN",)], "s string")
    assert df.select(reverse_complement(F.col("s"))).first()[0] == "NRYCGT"
    assert spark.createDataFrame([("ACGU",)], "s string").select(reverse_complement(F.col("s"))).first()[0] == "ACGU"
    with pytest.raises(Exception):
        spark.createDataFrame([("TU",)], "s string").select(reverse_complement(F.col("s"))).collect()
    p = spark.createDataFrame([("ATGGCNTAAGG",)], "s string").select(translate_frame(F.col("s"), 1), translate_frame(F.col("s"), 1, stop_at_first=True), translate_frame(F.col("s"), 2)).first()
    assert p[0] == "MX*" and p[1] == "MX"


def test_orfs(spark):
    seq = "CCATGAAATTTTAACC"
    rows = sequences.orfs(spark.createDataFrame([(1, seq)], "id long, seq string"), min_aa=3, reverse=False).collect()
    assert [(r.start, r.end, r.strand, r.frame, r.complete, r.aa_length) for r in rows] == [(3, 14, "+", 3, True, 3)]


def test_duplicate_ids_are_an_error(spark):
    s = spark.createDataFrame([("a", "A")], "id string, seq string")
    assert sequences.merged([s, s], allow_duplicate_ids=True).count() == 2
    with pytest.raises(Exception):
        sequences.merged([s, s]).collect()


def test_consensus_ties_go_to_the_later_base(spark):
    df = spark.createDataFrame([("A-",), ("C-",), ("GT",)], "seq string")
    assert rows_of(sequences.consensus(df, 0.3)) == [(1, "G"), (2, "T")]


def test_fastq(spark):
    df = spark.createDataFrame([("a", "ACGTN", "IIII!"), ("b", "GGCC", "5555")], "id string, seq string, qual string")
    row = reads.qc_total(df).first()
    assert (row["reads"], row.bases) == (2, 9) and abs(row.gc_percent - 600 / 9) < 1e-9 and abs(row.q30_percent - 400 / 9) < 1e-9
    assert [(r.id, r.seq) for r in reads.quality_trimmed(df, 30, 1).collect()] == [("a", "ACGT")]
    assert [r.seq for r in reads.adapter_trimmed(df, ("TNACGTACGT",), 2).collect()] == ["ACG", "GGCC"]
    assert reads.subsampled(df, 1).count() == 1 and reads.subsampled(df, fraction=0.1).count() == 1


def test_variants(spark):
    kind = "chrom string, pos long, ref string, alt string, qual double, filter string, info string, gt string"
    df = spark.createDataFrame([("1", 10, "AC", "AT", 5.0, "PASS", "DP=3", "0/1"), ("1", 11, "C", "T", None, ".", ".", "1|1"), ("1", 5, "A", "<DEL>", 9.0, "q", "DP=9", "./.")], kind)
    left, right = df.where("pos = 10 OR pos = 5"), df.where("pos = 11 OR pos = 5")
    assert rows_of(variants.compared(left, right)) == [("1", 5, "A", "<DEL>", "shared"), ("1", 11, "C", "T", "shared")]
    row = variants.stats(df).first()
    assert (row.records, row.snp, row.mnv, row.symbolic, row.missing_gt, row.carriers, row.alt_copies) == (3, 1, 1, 1, 1, 2, 3)


def test_left_alignment(spark):
    refs = spark.createDataFrame([("1", "GCAAAAT")], "chrom string, seq string")
    v = spark.createDataFrame([("1", 6, "A", "AA")], "chrom string, pos long, ref string, alt string")
    assert rows_of(variants.normalized(v, refs)) == [("1", 2, "C", "CA")]
    with pytest.raises(Exception):
        variants.normalized(spark.createDataFrame([("1", 6, "G", "GA")], "chrom string, pos long, ref string, alt string"), refs).collect()


def test_sets(spark):
    long = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y"), ("B", " y "), ("C", "z")], "set string, item string")
    assert rows_of(tables.exclusive_intersections(long, ["A", "B", "C"]).select("sets", "degree", "n")) == [("A", 1, 1), ("A&B", 2, 1), ("C", 1, 1)]


def test_overrepresentation(spark):
    a = spark.createDataFrame([(f"g{i}", "t1" if i < 4 else "t2") for i in range(10)], "gene_id string, term_id string")
    genes = spark.createDataFrame([("g0",), ("g1",), ("g9",), ("none",)], "gene_id string")
    rows = {r.term_id: r for r in enrichment.overrepresentation(genes, a).collect()}
    p = sum(math.comb(4, k) * math.comb(6, 3 - k) for k in (2, 3)) / math.comb(10, 3)
    assert rows["t1"].overlap == 2 and abs(rows["t1"].p - p) < 1e-9 and abs(rows["t1"].padj - min(1, p * 2)) < 1e-9


def test_gsea(spark):
    scores = spark.createDataFrame([(f"g{i}", float(7 - i)) for i in range(1, 7)], "gene_id string, score double")
    sets = spark.createDataFrame([("g1", "top"), ("g2", "top"), ("g5", "low"), ("g6", "low")], "gene_id string, term_id string")
    rows = {r.term_id: r for r in enrichment.enrichment_scores(scores, sets, min_size=1).collect()}
    assert abs(rows["top"].es - 1) < 1e-12 and rows["top"].peak_rank == 2 and abs(rows["low"].es + 1) < 1e-12
    edge = enrichment.leading_edge(scores, sets, min_size=1)
    assert rows_of(edge) == [("low", "g5"), ("low", "g6"), ("top", "g1"), ("top", "g2")]
    assert enrichment.permuted_pvalues(scores, sets, 20, min_size=1).count() == 2


def test_similarity(spark):
    kind = "query string, subject string, identity double, length long, evalue double, bits double"
    f = spark.createDataFrame([("a", "x", 99.0, 10, 1e-9, 50.0), ("a", "y", 99.0, 10, 1e-9, 60.0), ("b", "x", 90.0, 9, 1e-9, 40.0)], kind)
    r = spark.createDataFrame([("y", "a", 99.0, 10, 1e-9, 60.0), ("x", "a", 99.0, 10, 1e-9, 60.0)], kind)
    assert rows_of(similarity.reciprocal(f, r).select("query", "subject")) == [("a", "y")]


def test_proteins(spark):
    rows = {r.id: r for r in proteins.properties(spark.createDataFrame([(1, "ACDEFGHIKLMNPQRSTVWY"), (2, "AX")], "id long, seq string")).collect()}
    assert rows[2].weight is None and rows[2].pi is None and rows[1].extinction_reduced == 6990
    assert abs(rows[1].weight - (sum(proteins.MASS.values()) + proteins.WATER)) < 1e-6 and 0 < rows[1].pi < 14


def test_structures(spark):
    kind = "chain string, residue long, x double, y double, z double"
    a = spark.createDataFrame([("A", 1, 0.0, 0.0, 0.0), ("A", 2, 3.0, 0.0, 0.0), ("B", 3, 0.0, 4.0, 0.0), ("B", 4, 50.0, 0.0, 1.0)], kind)
    assert rows_of(structures.contact_map(a, 5.0)) == [(1, 2, 3.0, False), (1, 3, 4.0, True), (2, 3, 5.0, True)]
    assert rows_of(structures.contact_map(a, 5.0, inter_chain=False)) == [(1, 2, 3.0, False)]
    row = structures.superposed(spark, a, a.select("chain", "residue", (-F.col("y")).alias("x"), F.col("x").alias("y"), "z")).first()
    assert row.rmsd < 1e-6 and row.rmsd_before > 1
    assert structures.geometry([(0, 0, 0), (4, 0, 0)]) == 4 and abs(structures.geometry([(1, 0, 0), (0, 0, 0), (0, 1, 0)]) - 90) < 1e-9
    assert abs(abs(structures.geometry([(1, 0, 0), (0, 0, 0), (0, 0, 1), (0, 1, 1)])) - 90) < 1e-9


def test_distances(spark):
    a = spark.createDataFrame([("x", "ACGT-"), ("y", "GCG--")], "id string, seq string")
    d = {(r.a, r.b): r.distance for r in phylogeny.distances(a).collect()}
    assert d["x", "x"] == 0 and d["x", "y"] == 0.5
    k = {(r.a, r.b): r.distance for r in phylogeny.distances(a, "k2p").collect()}
    assert abs(k["x", "y"] + 0.5 * math.log(1 - 2 * 0.25)) < 1e-12
    assert {(r.a, r.b): r.distance for r in phylogeny.distances(spark.createDataFrame([("x", "AAAA"), ("y", "CCCC")], "id string, seq string"), "jc69").collect()}["x", "y"] == math.inf


def test_survival(spark):
    df = spark.createDataFrame([("g", 1, True), ("g", 2, False), ("g", 3, True), ("g", 3, True)], "group string, time long, event boolean")
    rows = survival.curve(df).orderBy("time").collect()
    assert [(r.time, r.at_risk, r.events, round(r.survival, 6)) for r in rows] == [(1, 4, 1, 0.75), (3, 2, 2, 0.0)]
    assert survival.medians(df).first().median == 3


def test_ecology(spark):
    t = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("q", "a", 3)], "sample string, taxon string, n long")
    rows = {r.sample: r for r in ecology.alpha_diversity(t).collect()}
    assert abs(rows["s"].shannon - math.log(2)) < 1e-12 and rows["s"].evenness == 1 and rows["q"].evenness is None
    trace = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([5, 1, 3, 3, 2, 4])], "k int, t int, value double")
    assert [r.t for r in ecology.local_maxima(trace, "k", ["t"]).collect()] == [2]


def test_expression(spark):
    m = spark.createDataFrame([(f"f{i}", s, float(v)) for i, r in enumerate([(1, 2), (10, 20), (5, 10), (100, 200)]) for s, v in zip("ab", r)], "feature string, sample string, value double")
    norm = {(r.feature, r.sample): r.value for r in expression.median_ratio(m).collect()}
    assert all(abs(norm[f"f{i}", "a"] - norm[f"f{i}", "b"]) < 1e-9 for i in range(4))
    assert expression.pca(spark, m, 1).count() == 2
    groups = {r.feature: r.cluster for r in expression.kmeans(spark, m, 2).collect()}
    assert groups["f3"] != groups["f0"] == groups["f2"]
