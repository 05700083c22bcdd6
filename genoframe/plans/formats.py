"""Queries that write a format from the given tables and read it back."""

from __future__ import annotations

import base64
import struct
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.sequence import wrapped
from ..operators import annotations
from ..sources import files, records, tables
from .catalog import query
from .views import associations, features, hits, intervals, matrix, reads, seqs, sql, table, variants


def place(spark, name: str) -> str:
    """A new path in the folder that executors share (a temporary one where none is set, as in tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='genoframe-')}"
    return f"{top.rstrip('/')}/formats/{uuid.uuid4().hex[:12]}-{name}"


def _lines(spark, name: str, body, head: tuple = (), tail: tuple = ()) -> str:
    """Writes a column of lines, a head before them as the first file, a tail as the last."""
    path = place(spark, name)
    body = body.toDF("value")
    if head:
        body = spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).union(body)
    if tail:
        body = body.union(spark.createDataFrame([("\n".join(tail),)], "value string").coalesce(1))
    records.write_lines(body, path)
    return path


def _one_file(spark, name: str, body, head: str, tail: str) -> str:
    """A format whose files are read as a whole: head, lines and tail in one."""
    path = place(spark, name)
    ends = spark.createDataFrame([(0, head), (2, tail)], "k int, value string")
    rows = ends.union(body.toDF("value").select(F.lit(1), "value")).repartition(1).sortWithinPartitions("k")
    records.write_lines(rows.select("value"), path)
    return path


def _tabs(df, *columns):
    return df.select(F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in columns]))


def _csv(spark, df, name: str, delimiter: str) -> str:
    path = place(spark, name)
    records.write_table(df, path, delimiter)
    return path


@query("read_fasta", sql("seqs", "SELECT DISTINCT 'd' || id AS id, lang AS description, s.seq FROM seqs s JOIN (SELECT DISTINCT doc_id, lang FROM documents) ON doc_id = id"))
def fasta(spark, d):
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("description")).distinct()
    path = place(spark, "a.fa")
    records.write_fasta(seqs(spark, d).distinct().join(lang, "id").withColumn("id", F.concat(F.lit("d"), "id")), path)
    return records.fasta(spark, path).select("id", "description", "seq")


_READS = sql("reads", "SELECT id::VARCHAR AS id, seq, qual FROM reads")


@query("read_fastq", _READS)
def fastq(spark, d):
    path = place(spark, "a.fastq")
    records.write_fastq(reads(spark, d), path)
    return records.fastq(spark, path).select("id", "seq", "qual")


@query("read_fastq_wrapped", _READS)
def fastq_wrapped(spark, d):
    rows = reads(spark, d).select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), wrapped(F.col("seq"), 40), F.lit("+"), wrapped(F.col("qual"), 40)))
    return files.fastq_wrapped(spark, _lines(spark, "a.fastq", rows)).select("id", "seq", "qual")


_ALIGNED = """SELECT 'r' || l_orderkey || '.' || l_linenumber AS qname, (l_orderkey % 4096)::INTEGER AS flag, 'chr' || l_suppkey % 22 AS rname, l_partkey::BIGINT AS pos, (l_quantity::BIGINT)::INTEGER AS mapq, l_quantity::BIGINT || 'M' AS cigar FROM lineitem"""


@query("read_sam", _ALIGNED)
def sam(spark, d):
    li = table(spark, d, "lineitem")
    name = F.concat_ws(".", F.concat(F.lit("r"), "l_orderkey"), "l_linenumber")
    rows = _tabs(li, name, F.col("l_orderkey") % 4096, F.concat(F.lit("chr"), F.col("l_suppkey") % 22), "l_partkey", F.col("l_quantity").cast("int"), F.concat(F.col("l_quantity").cast("int"), F.lit("M")), F.lit("*"), F.lit(0), F.lit(0), F.lit("ACGT"), F.lit("IIII"))
    return records.sam(spark, _lines(spark, "a.sam", rows, ("@HD\tVN:1.6", "@SQ\tSN:chr1\tLN:1000"))).select("qname", "flag", "rname", "pos", "mapq", "cigar")


@query("read_bed", sql("lft", 'SELECT contig, s AS "start", e AS "end" FROM lft'))
def bed(spark, d):
    path = place(spark, "a.bed")
    records.write_bed(intervals(spark, d, "left"), path)
    return records.bed(spark, path)


_FEATURES = """SELECT seqid, source, type, s::BIGINT AS "start", e::BIGINT AS "end", strand, id, parent FROM features"""
_FEATURE = ("seqid", "source", "type", "start", "end", "strand", "id", "parent")


@query("read_gff3", sql("features", _FEATURES))
def gff3(spark, d):
    return records.gxf(spark, _lines(spark, "a.gff3", annotations.normalized(features(spark, d)), ("##gff-version 3",))).select(*_FEATURE)


@query("read_gtf", sql("features", """SELECT seqid, source, type, s::BIGINT AS "start", e::BIGINT AS "end", strand, id FROM features"""))
def gtf(spark, d):
    attributes = F.concat(F.lit('gene_id "'), "id", F.lit('"; level "1";'))
    rows = _tabs(features(spark, d), "seqid", "source", "type", "start", "end", F.lit("."), "strand", F.lit("."), attributes)
    return records.gxf(spark, _lines(spark, "a.gtf", rows)).select(*_FEATURE[:-1])


@query("read_vcf", sql("variants", "SELECT chrom, pos, ref, alt, qual, filter, info, gt FROM variants"))
def vcf(spark, d):
    path = place(spark, "a.vcf")
    records.write_vcf(variants(spark, d), path)
    return records.vcf(spark, path).select("chrom", "pos", "ref", "alt", "qual", "filter", "info", "gt")


@query("read_csv", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv(spark, d):
    return tables.table(spark, _csv(spark, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "a.csv", ","))


@query("read_tsv", "SELECT p_partkey::VARCHAR AS p_partkey, p_brand, p_type FROM part")
def tsv(spark, d):
    return tables.table(spark, _csv(spark, table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "a.tsv", "\t"))


@query("read_expression_matrix", sql("matrix", "SELECT f.feature, s.sample, m.value FROM (SELECT DISTINCT feature FROM matrix) f CROSS JOIN (SELECT DISTINCT sample FROM matrix) s LEFT JOIN matrix m ON m.feature = f.feature AND m.sample = s.sample"))
def expression_matrix(spark, d):
    wide = matrix(spark, d).groupBy("feature").pivot("sample").agg(F.first("value"))
    return tables.matrix(spark, _csv(spark, wide.na.fill(-1.0).replace(-1.0, None).select("feature", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in wide.columns[1:]]), "a.tsv", "\t"))


@query("read_sets", """SELECT DISTINCT r_name AS "set", n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey""")
def sets(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("r_name").orderBy("n_name")))
    return tables.sets(spark, _csv(spark, rows.groupBy("k").pivot("r_name").agg(F.first("n_name")).drop("k"), "a.tsv", "\t"))


@query("read_gene_list", "SELECT DISTINCT c_name AS gene_id FROM customer")
def gene_list(spark, d):
    return tables.gene_list(spark, _lines(spark, "genes.txt", table(spark, d, "customer").select(F.concat("c_name", F.lit("\tx"))), ("# genes", "gene_id", "-", "NA")))


@query("read_associations", sql("assoc", "SELECT gene_id::VARCHAR AS gene_id, term_id FROM assoc"))
def read_associations(spark, d):
    rows = associations(spark, d).select(F.col("gene_id").alias("Gene"), F.col("term_id").alias("GO ID"))
    return tables.associations(spark, _csv(spark, rows, "a.tsv", "\t")).select("gene_id", "term_id")


@query("read_ranked", "SELECT p_partkey::VARCHAR AS gene_id, p_size / 4.0::DOUBLE AS score FROM part")
def read_ranked(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") / 4.0).alias("log2FoldChange"))
    return tables.ranked(spark, _csv(spark, rows, "a.csv", ","))


_HITS = "SELECT query, subject, identity, length, evalue, bits FROM fwd"


@query("read_blast_tabular", sql("fwd", _HITS))
def blast_tabular(spark, d):
    zero = [F.lit(0)] * 6
    rows = _tabs(hits(spark, d), "query", "subject", "identity", "length", *zero, "evalue", "bits")
    return tables.blast_tabular(spark, _lines(spark, "a.tsv", rows, ("# BLASTN",))).select("query", "subject", "identity", "length", "evalue", "bits")


@query("read_blast_xml", sql("fwd", "SELECT query, subject, 100.0::DOUBLE * (length // 2) / length AS identity, length, evalue, bits FROM fwd"))
def blast_xml(spark, d):
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c.cast("string"), F.lit(f"</{n}>"))
    hsp = tag("Hsp", F.concat(tag("Hsp_bit-score", F.col("bits")), tag("Hsp_evalue", F.col("evalue")), tag("Hsp_identity", F.floor(F.col("length") / 2)), tag("Hsp_align-len", F.col("length"))))
    hit = tag("Hit", F.concat(tag("Hit_id", F.col("subject")), tag("Hit_hsps", hsp)))
    rows = hits(spark, d).groupBy("query", F.pmod(F.xxhash64("subject"), F.lit(16))).agg(F.array_join(F.collect_list(hit), "").alias("h"))  # a sixteenth of a query's hits
    rows = rows.select(tag("Iteration", F.concat(tag("Iteration_query-def", F.concat(F.col("query"), F.lit(" made"))), tag("Iteration_hits", F.col("h")))))
    return tables.blast_xml(spark, _lines(spark, "a.xml", rows, ("<BlastOutput>",), ("</BlastOutput>",))).select("query", "subject", "identity", "length", "evalue", "bits")


_DOMAINS = """SELECT 'p' || p_partkey AS sequence, {0} AS source, p_brand AS accession, p_size::BIGINT AS "start", (p_size + 9)::BIGINT AS "end", p_size / 8.0::DOUBLE AS score FROM part"""


@query("read_interproscan", _DOMAINS.format("p_type"))
def interproscan(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    rows = _tabs(p, F.concat(F.lit("p"), "p_partkey"), F.lit("md5"), F.lit(100), "p_type", "p_brand", F.lit("made"), size, size + 9, size / 8.0, F.lit("T"), F.lit("01-01-2020"))
    return tables.domains(spark, _lines(spark, "a.tsv", rows))


@query("read_hmmer_domains", _DOMAINS.format("'HMMER'"))
def hmmer(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    cells = [F.lit("target"), F.col("p_brand"), F.lit(10), F.concat(F.lit("p"), "p_partkey"), F.lit("-"), F.lit(100), size / 8.0, *[F.lit(0)] * 10, size, size + 9, F.lit(1), F.lit(2), F.lit(0.9)]
    return tables.domains(spark, _lines(spark, "a.domtbl", p.select(F.concat_ws("   ", *[c.cast("string") for c in cells])), ("# target name",)))


_ATOMS = """SELECT (c_custkey % 2 + 1)::VARCHAR AS model, 'A' AS chain, c_custkey::VARCHAR AS resseq, 'GLY' AS resname, (c_custkey % 797) / 8.0::DOUBLE AS x, -(c_custkey % 89) / 4.0::DOUBLE AS y, (c_custkey % 13)::DOUBLE AS z, (c_custkey % 100)::DOUBLE AS b FROM customer WHERE c_custkey < 10000"""


@query("read_pdb", _ATOMS.replace("-(c_custkey % 89) / 4.0::DOUBLE", "(c_custkey % 89) / 4.0::DOUBLE").replace("c_custkey::VARCHAR AS resseq", "(c_custkey % 9999)::VARCHAR AS resseq").replace(" WHERE c_custkey < 10000", ""))
def pdb(spark, d):
    """Customers as atoms of two models."""
    k = F.col("c_custkey")
    atom = F.format_string("ATOM  %5d  CA  GLY A%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C", k % 99999, k % 9999, (k % 797) / 8.0, (k % 89) / 4.0, (k % 13).cast("double"), (k % 100).cast("double"))
    rows = table(spark, d, "customer").select((k % 2 + 1).alias("m"), atom.alias("a"))
    both = [rows.where(F.col("m") == m).select("a") for m in (1, 2)]
    path = place(spark, "a.pdb")
    lines = lambda *x: spark.createDataFrame([("\n".join(x),)], "a string").coalesce(1)
    records.write_lines(lines("HEADER", "MODEL        1").union(both[0]).union(lines("ENDMDL", "MODEL        2")).union(both[1]).union(lines("ENDMDL", "END")).toDF("value"), path)
    return records.pdb(spark, path).select("model", "chain", "resseq", "resname", "x", "y", "z", "b")


@query("read_mmcif", "SELECT '1' AS model, 'S' AS chain, s_suppkey::VARCHAR AS resseq, 'GLY' AS resname, (s_suppkey % 97) / 8.0::DOUBLE AS x, s_nationkey::DOUBLE AS y, 0.5::DOUBLE AS z, 7.0::DOUBLE AS b FROM supplier")
def mmcif(spark, d):
    """Suppliers as atoms of one file, which is read as a whole."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.concat_ws(" ", F.lit("ATOM"), k, F.lit("C CA . GLY S"), k, (k % 97) / 8.0, F.col("s_nationkey").cast("double"), F.lit("0.5 7.0 1")))
    names = ("group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "auth_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num")
    path = _one_file(spark, "a.cif", rows, "\n".join(["data_x", "loop_", *[f"_atom_site.{n}" for n in names]]), "#")
    return files.mmcif(spark, path + "/part-*").select("model", "chain", "resseq", "resname", "x", "y", "z", "b")


@query("read_newick", """SELECT n_name AS label, r_name AS parent, (n_nationkey % 7) / 4.0::DOUBLE AS length FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'root', 1.5::DOUBLE FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def newick(spark, d):
    """The tree of nations, 25 of them at any scale."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", ((F.col("n_nationkey") % 7) / 4.0).alias("length")).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.r_name, []).append(f"'{r.n_name}':{r.length}")
    e = files.newick(spark, "(" + ",".join(f"({','.join(own)})'{name}':1.5" for name, own in by.items()) + ")root;")
    up = e.select(F.col("node").alias("p"), F.col("label").alias("parent_label"))
    return e.join(up, F.col("parent") == F.col("p")).select("label", F.col("parent_label").alias("parent"), "length")


@query("read_matrix_market", "SELECT user_id::BIGINT AS row, length(event_type)::BIGINT AS col, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2")
def matrix_market(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.length("event_type").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return records.matrix_market(spark, _lines(spark, "a.mtx", rows.select(F.concat_ws(" ", "user_id", "c", "n")), ("%%MatrixMarket matrix coordinate integer general", "% made", "10 10 10")))


@query("read_mzml", "SELECT n_regionkey::BIGINT AS index, 1::INTEGER AS ms_level, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::BIGINT AS i, n_nationkey * 1.5::DOUBLE AS mz, n_nationkey + 0.25::DOUBLE AS intensity FROM nation")
def mzml(spark, d):
    """A spectrum for each region, in one small file."""
    by: dict = {}
    for r in table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").collect():
        by.setdefault(r.n_regionkey, []).append(r.n_nationkey)
    packed = lambda kind, values: f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{kind}"/><binary>{base64.b64encode(struct.pack(f"<{len(values)}d", *values)).decode()}</binary></binaryDataArray>'
    spectra = [f'<spectrum index="{k}"><cvParam accession="MS:1000511" value="1"/>{packed("MS:1000514", [1.5 * n for n in own])}{packed("MS:1000515", [n + 0.25 for n in own])}</spectrum>' for k, own in by.items()]
    path = place(spark, "a.mzML")
    records.write_lines(spark.createDataFrame([("<mzML>" + "".join(spectra) + "</mzML>",)], "value string").coalesce(1), path)
    return files.mzml(spark, path + "/part-*")


@query("read_kraken_report", "SELECT p_size / 4.0::DOUBLE AS percentage, p_size::BIGINT AS clade_count, 1::BIGINT AS taxon_count, 'S' AS rank, p_partkey::VARCHAR AS taxon_id, p_brand || ' ' || p_type AS name FROM part")
def kraken(spark, d):
    p = table(spark, d, "part")
    return records.kraken_report(spark, _lines(spark, "a.report", _tabs(p, F.col("p_size") / 4.0, "p_size", F.lit(1), F.lit("S"), "p_partkey", F.concat(F.lit("    "), "p_brand", F.lit(" "), "p_type"))))


@query("read_motif", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS place, (n_nationkey % 5) / 4.0::DOUBLE AS a, (4 - n_nationkey % 5) / 4.0::DOUBLE AS c FROM nation")
def motif(spark, d):
    """A probability matrix with a row for each nation; motifs are read by the driver."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey").collect()
    text = "MEME version 4\nALPHABET= ACGT\nMOTIF x\nletter-probability matrix: alength= 4\n" + "\n".join(f"{r[0] % 5 / 4} {(4 - r[0] % 5) / 4} 0 0" for r in rows) + "\n"
    _, made = files.meme_matrix(text)
    return spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(made)], "place int, a double, c double")


@query("sniff_formats", "SELECT * FROM (VALUES ('bed', 'bed'), ('csv', 'csv'), ('fasta', 'fasta'), ('fastq', 'fastq'), ('gff3', 'gff3'), ('newick', 'newick'), ('tsv', 'tsv'), ('vcf', 'vcf')) t(made, kind)")
def sniff(spark, d):
    """What the heads of files written from the tables are taken for."""
    made = {"bed": _lines(spark, "x", _tabs(intervals(spark, d, "left"), "contig", "start", "end")), "csv": _csv(spark, table(spark, d, "nation"), "y", ","), "tsv": _csv(spark, table(spark, d, "region").select("r_regionkey", "r_name"), "z", "\t")}
    made["fasta"] = place(spark, "f")
    records.write_fasta(seqs(spark, d), made["fasta"])
    made["fastq"] = place(spark, "q")
    records.write_fastq(reads(spark, d), made["fastq"])
    made["vcf"] = place(spark, "v")
    records.write_vcf(variants(spark, d), made["vcf"])
    made["gff3"] = _lines(spark, "g", annotations.normalized(features(spark, d)), ("##gff-version 3",))
    made["newick"] = _lines(spark, "n", spark.createDataFrame([("(a:1,b:2);",)], "value string"))
    rows = [(name, files.sniffed("\n".join(tables.first_lines(spark, path, 8)).encode())) for name, path in sorted(made.items())]
    return spark.createDataFrame(rows, "made string, kind string")
