"""Survival, differential expression, clustering, geometry and extraction against plain computations."""

import math
import random

import numpy as np
import pytest

from genoframe import jobs
from genoframe.operators import annotations, differential, expression, intervals, reads, structures, survival, variants
from genoframe.sources import records


def test_log_rank(spark):
    """Two groups of six: the textbook sums by hand."""
    rows = [("a", t, e) for t, e in ((3, True), (5, True), (7, True), (9, False), (11, True), (12, False))] + [("b", t, e) for t, e in ((1, True), (2, True), (3, True), (5, True), (8, True), (10, True))]
    df = spark.createDataFrame(rows, "group string, time int, event boolean")
    observed, expected, v = 0, 0.0, 0.0
    for t in sorted({t for _, t, e in rows if e}):
        n, na = sum(x >= t for _, x, _ in rows), sum(x >= t for g, x, _ in rows if g == "a")
        d, da = sum(x == t and e for _, x, e in rows), sum(x == t and e for g, x, e in rows if g == "a")
        observed, expected = observed + da, expected + d * na / n
        v += d * (n - d) / max(n - 1, 1) * na / n * (1 - na / n)
    r = survival.log_rank(df).first()
    assert math.isclose(r.chi2, (observed - expected) ** 2 / v, rel_tol=1e-9) and r.df == 1
    assert math.isclose(r.p, math.erfc(math.sqrt(r.chi2 / 2)), rel_tol=1e-9)
    got = {x.group: (x.observed, x.expected) for x in survival.log_rank_groups(df).collect()}
    assert got["a"][0] == observed and math.isclose(got["a"][1], expected) and math.isclose(sum(o for o, _ in got.values()), sum(e for _, e in got.values()))
    assert math.isclose(survival.chi_square_tail(5.991464547, 2), 0.05, rel_tol=1e-6) and math.isclose(survival.chi_square_tail(7.814727903, 3), 0.05, rel_tol=1e-6)


def efron(rows, beta):
    out = 0.0
    for t in {t for t, e, *_ in rows if e}:
        dead = [x for s, e, *x in rows if s == t and e]
        risk = sum(math.exp(np.dot(beta, x)) for s, _, *x in rows if s >= t)
        own = sum(math.exp(np.dot(beta, x)) for x in dead)
        out += sum(np.dot(beta, x) for x in dead) - sum(math.log(risk - k / len(dead) * own) for k in range(len(dead)))
    return out


def test_cox(spark):
    """The estimate is where the partial likelihood with Efron's ties is largest."""
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        x, y = rng.random() < 0.5, rng.gauss(0, 1)
        rows.append((float(math.ceil(rng.expovariate(0.1 * math.exp(0.8 * x - 0.5 * y)))), rng.random() < 0.8, float(x), y))
    df = spark.createDataFrame([*rows, (1.0, True, None, 0.0)], "time double, event boolean, x double, y double")
    got = {r.covariate: r for r in survival.cox(df, ["x", "y"]).collect()}
    best = [got["x"].coefficient, got["y"].coefficient]
    top = efron(rows, best)
    for step in (1e-3, -1e-3):
        assert efron(rows, [best[0] + step, best[1]]) < top and efron(rows, [best[0], best[1] + step]) < top
    assert 0.3 < best[0] < 1.3 and got["x"].p < 0.05 and math.isclose(got["x"].hazard_ratio, math.exp(best[0]))
    h = 1e-3
    second = (efron(rows, [best[0] + h, best[1]]) - 2 * top + efron(rows, [best[0] - h, best[1]])) / h**2
    assert 0.8 < got["x"].se / math.sqrt(-1 / second) < 1.25


def test_differential(spark):
    """Simulated negative-binomial counts: changed features are found, others are not."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(120):
        base, change = math.exp(rng.uniform(3, 7)), 4.0 if g < 20 else 1.0
        for s in range(8):
            mu = base * (change if s >= 4 else 1) * (1 + 0.2 * (s % 3))
            rows.append((f"g{g}", f"s{s}", float(rng.negative_binomial(1 / 0.05, 1 / (1 + 0.05 * mu)))))
    rows += [("none", f"s{s}", 0.0) for s in range(8)]
    counts = spark.createDataFrame(rows, "feature string, sample string, value double")
    design = spark.createDataFrame([(f"s{s}", "case" if s >= 4 else "control") for s in range(8)], "sample string, condition string")
    got = {r.feature: r for r in differential.wald(counts, design, "control").collect()}
    assert got["none"].p is None and got["none"].padj is None and len(got) == 121
    hits = {f for f, r in got.items() if r.padj is not None and r.padj < 0.05}
    assert {f"g{g}" for g in range(20)} <= hits and len(hits) <= 27
    assert abs(np.mean([got[f"g{g}"].log2_fold_change for g in range(20)]) - 2) < 0.35
    with pytest.raises(ValueError):
        differential.wald(counts, design, "other")


def test_kmeans_on_executors(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.5, (15, 4)) for c in (0, 5, 10)])
    rows = [(f"f{i:02d}", f"s{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    m = spark.createDataFrame(rows, "feature string, sample string, value double")
    got = {r.feature: r.cluster for r in expression.kmeans(spark, m, 3).collect()}
    assert [got[f"f{i:02d}"] for i in range(45)] == expression.kmeans_rows(x, 3).tolist()


def test_pairs_are_guarded(spark, monkeypatch):
    monkeypatch.setattr(expression, "MOST_FEATURES", 3)
    m = spark.createDataFrame([(f"f{i}", "s", 1.0) for i in range(4)], "feature string, sample string, value double")
    with pytest.raises(ValueError):
        expression.correlation_distances(m)


def test_counts_on_shuffled_input(spark):
    """Equal intervals, an input out of a shuffle that adaptive execution coalesces: against all pairs."""
    rng = random.Random(8)
    make = lambda n: [(rng.choice("ab"), s, s + rng.randint(1, 40)) for s in (rng.randint(0, 60) * 1000 for _ in range(n))]
    a, b = make(120), make(90)
    frame = lambda x: spark.createDataFrame(x, "contig string, start long, end long").repartition(7, "start").where("start >= 0")
    got = sorted((r.contig, r.start, r.end, r.pairs, r.bases) for r in intervals.overlap_counts(frame(a), frame(b)).collect())
    meets = lambda x: [min(x[2], y[2]) - max(x[1], y[1]) for y in b if y[0] == x[0] and y[1] < x[2] and x[1] < y[2]]
    assert got == sorted((*x, len(meets(x)), sum(meets(x))) for x in a)


def test_coverage(spark):
    rng = random.Random(9)
    rows = [("c", s, s + rng.randint(1, 50)) for s in (rng.randint(0, 40_000) for _ in range(300))]
    depth = [0] * 40_100
    for _, s, e in rows:
        for i in range(s, e):
            depth[i] += 1
    got = sorted((r.start, r.end, r.depth) for r in reads.coverage(spark.createDataFrame(rows, "contig string, start long, end long")).collect())
    back = [0] * 40_100
    for s, e, n in got:
        assert n > 0 and not any(back[s:e])
        back[s:e] = [n] * (e - s)
    assert back == depth


def test_coding_phase(spark):
    ref = spark.createDataFrame([("c", "AACCGGTTACGT")], "seqid string, seq string")
    parts = [("p", "c", "+", 1, 4, "1"), ("p", "c", "+", 7, 9, "2"), ("m", "c", "-", 1, 4, "0"), ("m", "c", "-", 9, 12, "2")]
    rows = annotations.extracted(spark.createDataFrame(parts, "id string, seqid string, strand string, start long, end long, phase string"), ref).collect()
    assert {r.id: r.seq for r in rows} == {"p": "ACCTTA", "m": "GTGGTT"}


def test_torsion(spark):
    p = [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.5, 1.0, 1.5)]
    row = spark.createDataFrame([tuple({"x": x, "y": y, "z": z} for x, y, z in p)], ", ".join(f"{n} struct<x:double,y:double,z:double>" for n in "abcd"))
    assert math.isclose(row.select(structures.torsion_of("a", "b", "c", "d")).first()[0], structures.geometry(p), abs_tol=1e-9)


def test_alignment_over_blocks(spark):
    """A deletion moves left through a repeat longer than two blocks."""
    seq = "GATC" + "A" * 60 + "CGT" + "TG" * 30 + "C"
    refs = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    at = [(10, "AA", "A"), (63, "AA", "A"), (64, "AC", "A"), (3, "T", "TA"), (120, seq[119:122], seq[119])]
    got = [{tuple(r) for r in variants.normalized(spark.createDataFrame([("c", *v) for v in at], "chrom string, pos long, ref string, alt string"), refs, block).collect()} for block in (8, 16, 4096)]
    assert got[0] == got[1] == got[2] and ("c", 4, "CA", "C") in got[0]


def test_jobs(spark, put, tmp_path):
    run = lambda name, inputs, **p: jobs.execute(spark, {"job_id": "1", "capability": name, "inputs": inputs, "parameters": p})
    sam = put("a.sam", "q1\t0\tc\t1\t9\t2M1D2M\t*\t0\t0\tACGT\tIIII\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\nq3\t0\tc\t4\t9\t3M\t*\t0\t0\tACG\tIII\n")
    assert {(r.start, r.end, r.depth) for r in run("alignment.coverage.v1", {"sam": sam}).data.collect()} == {(0, 3, 1), (3, 5, 2), (5, 6, 1)}
    assert run("dataset.inspect.v1", {"dataset": sam}).data.first()[0] != "" and run("dataset.inspect.v1", {"dataset": put("x.fa", ">a\nACGT\n")}).data.first()[0] == "fasta"
    egg = put("e.tsv", "## made\n#query\tseed\tGOs\tKEGG_ko\tKEGG_Pathway\tCOG_category\ng1\ts\tGO:0000001,GO:0000002\tko:K1\tmap1,map2\tKS\ng2\ts\t-\t-\t-\t-\n")
    assert {(r.gene, r.n_go, r.n_kegg, r.cog) for r in run("annotation.eggnog.normalize.v1", {"annotations": egg}).data.collect()} == {("g1", 2, 3, "K,S"), ("g2", 0, 0, "")}
    pdb = put("a.pdb", "".join(f"ATOM  {i:5d}  CA  GLY A{i:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  7.00           C\n" for i, (x, y, z) in enumerate([(1, 0, 0), (0, 0, 0), (0, 0, 1)], 1)))
    r = run("structure.geometry.v1", {"structure": pdb}, points=[{"chain": "A", "residue": k, "atom": "CA"} for k in (1, 2, 3)]).data.first()
    assert r.kind == "angle" and math.isclose(r.value, 90)
    cohort = put("c.csv", "time,event,arm\n" + "".join(f"{t},{t % 2},{'x' if t < 9 else 'y'}\n" for t in range(1, 16)))
    assert run("medical.survival.v1", {"cohort": cohort}, group_column="arm", analysis="log-rank").data.first().df == 1
    vcf = put("a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t2\t.\tA\tT\t50\tPASS\tDP=3\nc\t4\t.\tA\tT\t5\tPASS\tDP=3\n")
    done = run("variant.filter.v1", {"vcf": vcf}, min_qual=10, output=str(tmp_path / "out.vcf"))
    assert done.status == "succeeded" and [(r.pos, r.qual) for r in records.vcf(spark, str(tmp_path / "out.vcf")).collect()] == [(2, 50.0)]
    bad = run("variant.filter.v1", {"vcf": str(tmp_path / "none.vcf")})
    assert bad.status == "failed" and bad.error is not None
