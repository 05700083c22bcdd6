import base64
import struct
import zlib

import pytest

from genoframe.functions.sequence import wrapped
from genoframe.sources import files, records, tables


def test_fasta(spark, put):
    path = put("a.fa", ">s1 first one\nACGT\nNN\n>s2\nGGGG\n\n>s3\nAT\n")
    rows = records.fasta(spark, path).orderBy("ord").collect()
    assert [(r.id, r.description, r.seq) for r in rows] == [("s1", "first one", "ACGTNN"), ("s2", "", "GGGG"), ("s3", "", "AT")]


def test_fasta_round_trip(spark, put, tmp_path):
    seqs = spark.createDataFrame([("a", "x", "ACGT" * 41), ("b", "", "A" * 80)], "id string, description string, seq string")
    records.write_fasta(seqs.coalesce(1), str(tmp_path / "out"))
    back = records.fasta(spark, str(tmp_path / "out"))
    assert {(r.id, r.description, r.seq) for r in back.collect()} == {tuple(r) for r in seqs.collect()}
    with pytest.raises(Exception):
        records.write_fasta(seqs, str(tmp_path / "out"))
    line = seqs.select(wrapped(seqs.seq).alias("w")).first().w
    assert [len(x) for x in line.split("\n")] == [80, 80, 4]


def test_fastq(spark, put):
    path = put("a.fastq", "@r1 x\nACG\n+\nIII\n@r2\nAC\n+r2\n@I\n")
    rows = records.fastq(spark, path).orderBy("ord").collect()
    assert [(r.ord, r.id, r.seq, r.qual) for r in rows] == [(0, "r1", "ACG", "III"), (1, "r2", "AC", "@I")]
    with pytest.raises(Exception):
        records.fastq(spark, put("b.fastq", "@r1\nACG\n+\nII\n")).collect()


def test_wrapped_fastq(spark, put):
    path = put("a.fastq", "@r1\nAC\nGT\n+r1\nII\nII\n@r2\nA\n+\nI\n")
    assert [(r.id, r.seq, r.qual) for r in files.fastq_wrapped(spark, path).collect()] == [("r1", "ACGT", "IIII"), ("r2", "A", "I")]
    with pytest.raises(ValueError):
        files.wrapped_fastq(b"@r1\nACG\n+\nII\n")
    with pytest.raises(ValueError):
        files.wrapped_fastq(b"@r1\nACG\n")


def test_sam(spark, put):
    path = put("a.sam", "@HD\tVN:1.6\nq1\t99\tchr1\t7\t30\t3M\t=\t37\t39\tACG\tIII\n")
    row = records.sam(spark, path).first()
    assert (row.qname, row.flag, row.pos, row.mapq, row.tlen) == ("q1", 99, 7, 30, 39)
    with pytest.raises(Exception):
        records.sam(spark, put("b.sam", "q1\t99\tchr1\n")).collect()


def test_bed(spark, put):
    path = put("a.bed", "track name=x\n#c\nchr1\t0\t5\tn\nchr2\t3\t9\n")
    assert [tuple(r) for r in records.bed(spark, path).collect()] == [("chr1", 0, 5), ("chr2", 3, 9)]
    with pytest.raises(Exception):
        records.bed(spark, put("b.bed", "chr1\t5\t5\n")).collect()


def test_gxf(spark, put):
    gff = put("a.gff3", "##gff-version 3\nc1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=a%20b,c\nc1\ts\tmRNA\t1\t9\t.\t+\t.\tID=m1;Parent=g1\n")
    rows = records.gxf(spark, gff).collect()
    assert sorted((r.id, r.parent or "", r.used_gtf) for r in rows) == [("g1", "", False), ("m1", "g1", False)]
    assert {r.id: r.attributes for r in rows}["g1"]["Name"] == ["a b", "c"]
    gtf = put("a.gtf", 'c1\ts\texon\t1\t9\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n')
    row = records.gxf(spark, gtf).first()
    assert row.used_gtf and row.id == "g1" and row.attributes["transcript_id"] == ["t1"]


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\nc1\t5\t.\tA\tG,T\t30\tPASS\tDP=9\tGT:DP\t0/1:3\t./.:.\n"


def test_vcf(spark, put):
    row = records.vcf(spark, put("a.vcf", VCF)).first()
    assert (row.chrom, row.pos, row.alt, row.qual, row.gt) == ("c1", 5, "G,T", 30.0, "0/1")
    assert [tuple(s) for s in row.samples] == [("A", "0/1:3"), ("B", "./.:.")]
    short = put("b.vcf", VCF + "c1\t6\t.\tA\n")
    assert records.vcf(spark, short, strict=False).count() == 1
    with pytest.raises(Exception):
        records.vcf(spark, short).collect()
    with pytest.raises(ValueError):
        records.vcf(spark, put("c.vcf", "c1\t6\n"))


def test_matrix_market(spark, put):
    path = put("m.mtx", "%%MatrixMarket matrix coordinate integer general\n%x\n2 2 2\n1 1 5\n2 1 7\n")
    assert sorted(tuple(r) for r in records.matrix_market(spark, path).collect()) == [(1, 1, 5.0), (2, 1, 7.0)]
    with pytest.raises(ValueError):
        records.matrix_market(spark, put("n.mtx", "1 1 1\n"))


def test_kraken(spark, put):
    row = records.kraken_report(spark, put("k.txt", " 12.5\t10\t4\tS\t562\t    Escherichia  coli\n")).first()
    assert tuple(row) == (12.5, 10, 4, "S", "562", "Escherichia coli")


PDB = "MODEL        1\nATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00 91.00           C  \nATOM      2  CB BALA A   1       1.000   2.000   3.000  1.00 91.00           C  \nENDMDL\nEND\nATOM      3  CA  ALA A   2       1.000   2.000   3.000  1.00 91.00           C  \n"


def test_pdb(spark, put):
    rows = records.pdb(spark, put("a.pdb", PDB)).collect()
    assert [(r.model, r.name, r.resname, r.chain, r.resseq, r.x, r.b) for r in rows] == [("1", "CA", "ALA", "A", "1", 1.0, 91.0)]
    assert records.pdb(spark, put("b.pdb", PDB), drop_altloc=False).count() == 2


def test_mmcif():
    text = b"data_x\nloop_\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.label_alt_id\n_atom_site.label_comp_id\n_atom_site.auth_asym_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n1 CA . ALA A 1.0 2.0 3.0\n2 \"C'\" B GLY A 1 2 3\n#\n"
    rows = files.mmcif_atoms(text)
    assert len(rows) == 1 and rows[0][:5] == ("1", "A", "atom-1", "ALA", "CA") and rows[0][6:9] == (1.0, 2.0, 3.0)


def test_mzml():
    mz, inten = base64.b64encode(zlib.compress(struct.pack("<3d", 1, 2, 3))).decode(), base64.b64encode(struct.pack("<3f", 5, 9, 4)).decode()
    text = f"""<mzML><run><spectrumList><spectrum index="0"><cvParam accession="MS:1000511" value="2"/><binaryDataArrayList>
    <binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="MS:1000574"/><cvParam accession="MS:1000514"/><binary>{mz}</binary></binaryDataArray>
    <binaryDataArray><cvParam accession="MS:1000521"/><cvParam accession="MS:1000515"/><binary>{inten}</binary></binaryDataArray></binaryDataArrayList></spectrum></spectrumList></run></mzML>"""
    assert files.mzml_peaks(text.encode()) == [(0, 2, 0, 1.0, 5.0), (0, 2, 1, 2.0, 9.0), (0, 2, 2, 3.0, 4.0)]


def test_newick(spark):
    text = "((a:0.5,b:0.25)x:0.25,(c:0.5,'d e':0.5)y:0.1);"
    edges = files.newick_edges(text)
    assert files.newick_text(edges) == text
    from genoframe.operators.phylogeny import tree_metrics

    row = tree_metrics(files.newick(spark, text)).first()
    assert (row.leaves, row.internal, row.max_depth) == (4, 3, 2) and abs(row.total_length - 2.1) < 1e-9
    turned = files.rerooted(edges, "a")
    assert abs(sum(e[3] or 0 for e in turned) - 2.1) < 1e-9
    assert files.newick_edges(files.newick_text(turned))
    for bad in ("(a,b)", "(a);", "(a,);", "(a,b);x"):
        with pytest.raises((ValueError, IndexError)):
            files.newick_edges(bad)


def test_meme_and_sniff():
    assert files.meme_matrix("MEME version 4\nALPHABET= ACGT\nMOTIF x\nletter-probability matrix: alength= 4\n0.1 0.2 0.3 0.4\n1 0 0 0\n\nURL\n") == ("ACGT", [[0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]])
    for text, kind in ((b">a\nAC\n", "fasta"), (b"@r\nAC\n+\nII\n", "fastq"), (VCF.encode(), "vcf"), (b"@HD\tVN:1\n", "sam"), (b"c\t1\t5\n", "bed"), (PDB.encode(), "pdb"), (b"(a,b);", "newick"), (b"a,b\n1,2\n", "csv"), (b"a\tb\n1\t2\n", "tsv"), (b"BAM\1", "bam"), (b"zz", "unknown")):
        assert files.sniffed(text) == kind, kind
    import gzip

    assert files.sniffed(gzip.compress(b">a\nAC\n")) == "fasta"


def test_tables(spark, put):
    df = tables.table(spark, put("t.csv", "gene,a,b\ng1,1,NA\ng2,0,2.5\n"))
    assert df.columns == ["gene", "a", "b"]
    with pytest.raises(ValueError):
        tables.table(spark, put("d.csv", "a,a\n1,2\n"))
    rows = tables.matrix(spark, put("m.tsv", "gene\ta\tb\ng1\t1\tNA\ng2\t0\t2.5\n")).collect()
    assert {(r.feature, r.sample): r.value for r in rows} == {("g1", "a"): 1.0, ("g1", "b"): None, ("g2", "a"): 0.0, ("g2", "b"): 2.5}
    assert {tuple(r) for r in tables.sets(spark, put("s.tsv", "A\tB\nx\ty\ny\t\n")).collect()} == {("A", "x"), ("A", "y"), ("B", "y")}
    assert {r.gene_id for r in tables.gene_list(spark, put("g.txt", "gene\ng1\n#c\ng2\tx\nNA\n")).collect()} == {"g1", "g2"}


def test_blast(spark, put):
    row = tables.blast_tabular(spark, put("b.tsv", "q1\ts1\t99.0\t50\t0\t0\t1\t50\t1\t50\t1e-20\t90\n")).first()
    assert (row.query, row.subject, row.identity, row.length, row.evalue, row.bits) == ("q1", "s1", 99.0, 50, 1e-20, 90.0)
    row = tables.blast_tabular(spark, put("c.tsv", "# BLASTP\n# Fields: subject id, query id, % identity, alignment length, evalue, bit score\ns1\tq1\t99.0\t50\t1e-20\t90\n")).first()
    assert (row.query, row.subject) == ("q1", "s1")
    xml = "<BlastOutput><BlastOutput_iterations><Iteration><Iteration_query-def>q1 x</Iteration_query-def><Iteration_hits><Hit><Hit_id>s1</Hit_id><Hit_hsps><Hsp><Hsp_bit-score>90</Hsp_bit-score><Hsp_evalue>1e-9</Hsp_evalue><Hsp_identity>45</Hsp_identity><Hsp_align-len>50</Hsp_align-len><Hsp_gaps>2</Hsp_gaps></Hsp></Hit_hsps></Hit></Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"
    row = tables.blast_xml(spark, put("d.xml", xml)).first()
    assert (row.query, row.subject, row.identity, row.length, row.mismatches) == ("q1", "s1", 90.0, 50, 3)


def test_domains(spark, put):
    row = tables.domains(spark, put("i.tsv", "p1\tmd5\t100\tPfam\tPF1\tdesc\t3\t40\t1e-5\tT\tdate\n")).first()
    assert tuple(row)[:5] == ("p1", "Pfam", "PF1", 3, 40)
    row = tables.domains(spark, put("h.txt", "# c\n" + "dom PF2 90 prot - 100 1e-9 50 0.1 1 1 1e-9 1e-9 49 0.1 1 90 5 80 4 85 0.9 -\n")).first()
    assert (row.sequence, row.source, row.accession, row.start, row.end) == ("prot", "HMMER", "PF2", 5, 80)
