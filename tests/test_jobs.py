from genoframe.jobs import CAPABILITIES, execute


def job(name, inputs, **parameters):
    return {"job_id": "j", "capability": name, "inputs": inputs, "parameters": parameters}


def test_requests_are_checked(spark, put):
    bed = put("a.bed", "c\t0\t5\n")
    assert execute(spark, job("no.such.v1", {})).status == "failed"
    assert "inputs must be" in execute(spark, job("interval.merge.v1", {"x": bed})).message
    assert "unknown parameters" in execute(spark, job("interval.merge.v1", {"bed": bed}, gap=1)).message
    assert len(CAPABILITIES) > 60


def test_intervals(spark, put, tmp_path):
    left, right = put("l.bed", "chr1\t0\t10\nchr1\t20\t30\n"), put("r.bed", "chr1\t5\t25\n")
    row = execute(spark, job("interval.intersect.v1", {"left-bed": left, "right-bed": right})).data.first()
    assert (row.pairs, row.left_hit, row.right_hit, row.bases) == (2, 2, 1, 10)
    out = str(tmp_path / "merged")
    result = execute(spark, job("interval.merge.v1", {"bed": left}, max_gap=10, output=out))
    assert result.status == "succeeded" and [r.value for r in spark.read.text(out).collect()] == ["chr1\t0\t30"] and len(result.inputs["bed"]) == 64
    assert execute(spark, job("interval.merge.v1", {"bed": left}, output=out)).status == "failed"


def test_sequences(spark, put):
    fa = put("a.fa", ">s1 d\nACGTNN\n>s2\nGGGG\n>s3\nAT\n")
    assert execute(spark, job("sequence.stats.v1", {"fasta": fa})).data.first().n50 == 6
    assert {r.id for r in execute(spark, job("sequence.extract.v1", {"fasta": fa}, identifiers=["s2"])).data.collect()} == {"s2"}
    assert execute(spark, job("sequence.extract.v1", {"fasta": fa}, identifiers=["zz"], strict=True)).status == "failed"
    assert execute(spark, job("sequence.extract.v1", {"fasta": fa}, regions=["s1:1-4:-"])).data.first().subseq == "ACGT"
    assert [r.new_id for r in execute(spark, job("sequence.id.normalize.v1", {"fasta": fa}, width=2)).data.orderBy("new_id").collect()] == ["sequence_01", "sequence_02", "sequence_03"]
    assert execute(spark, job("sequence.merge.v1", {"fasta": [fa, fa]}, allow_duplicate_ids=True)).data.count() == 6


def test_tables_and_terms(spark, put):
    t = put("t.csv", "a,b\n1,x\n2,y\n3,x\n4,x\n")
    rows = execute(spark, job("table.manipulate.v1", {"table": t}, filter_column="b", filter_op="equals", filter_value="x", skip_rows=1, limit=1, select_columns=["a"])).data.collect()
    assert [tuple(r) for r in rows] == [("3",)]
    genes, terms = put("g.txt", "gene\ng1\ng2\n"), put("a.tsv", "gene\tterm\tnamespace\ng1\tA\tgo\ng2\tA\tgo\ng3\tB\tkegg\n")
    assert [r.term_id for r in execute(spark, job("enrichment.go.v1", {"genes": genes, "associations": terms})).data.collect()] == ["A"]
    tree = put("t.nwk", "((a:1,b:1):1,c:2);")
    assert execute(spark, job("phylogeny.tree.transform.v1", {"tree": tree}, label_map={"a": "z"})).data.first().tree == "((z:1,b:1):1,c:2);"
