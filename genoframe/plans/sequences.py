"""Queries on sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as op
from .catalog import query
from .views import alignment, seqs, sql

def _n(letters):
    return f"(length(seq) - length(regexp_replace(seq, '[{letters}]', '', 'g')))"


@query("seq_stats", sql("seqs", f"""
WITH l AS (SELECT length(seq) AS len, {_n('GC')} AS gc, {_n('ACGTU')} AS acgt, {_n('N')} AS n FROM seqs),
r AS (SELECT *, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY len DESC) AS k, sum(len) OVER () AS tot FROM l),
h AS (SELECT min(k) AS l50 FROM r WHERE run >= (tot + 1) // 2)
SELECT count(*) AS count, sum(len)::BIGINT AS total, min(len) AS min, max(len) AS max, sum(len)::DOUBLE / count(*) AS mean, (SELECT len FROM r, h WHERE k = l50) AS n50, (SELECT l50 FROM h) AS l50,
  sum(len * len)::DOUBLE / sum(len) AS aun, 100.0::DOUBLE * sum(gc) / sum(acgt) AS gc_percent, sum(n)::BIGINT AS n_count, 100.0::DOUBLE * sum(n) / sum(len) AS n_percent FROM l"""))
def stats(spark, d):
    return op.stats(seqs(spark, d))


LIMITS = {"min_length": 100, "max_length": 2000, "min_gc": 20.0, "max_gc": 30.0, "max_n": 30.0}
_REASON = f"""WITH g AS (SELECT *, 100.0::DOUBLE * {_n('GC')} / nullif({_n('ACGTU')}, 0) AS gc, 100.0::DOUBLE * {_n('N')} / nullif(length(seq), 0) AS np FROM seqs),
q AS (SELECT *, CASE WHEN length(seq) < 100 THEN 'too-short' WHEN length(seq) > 2000 THEN 'too-long' WHEN coalesce(gc, 0) < 20 THEN 'low-gc' WHEN coalesce(gc, 0) > 30 THEN 'high-gc' WHEN coalesce(np, 0) > 30 THEN 'high-n' ELSE 'kept' END AS reason FROM g) """


@query("seq_filter", sql("seqs", _REASON + "SELECT id, length(seq) AS len FROM q WHERE reason = 'kept'"))
def filtered(spark, d):
    return op.filtered(seqs(spark, d), **LIMITS).select("id", F.length("seq").cast("long").alias("len"))


@query("seq_filter_reasons", sql("seqs", _REASON + "SELECT reason, count(*) AS n FROM q GROUP BY 1"))
def reasons(spark, d):
    return op.filter_reasons(seqs(spark, d), **LIMITS)


@query("seq_extract_ids", sql("seqs", "SELECT * FROM seqs WHERE id IN (SELECT item_id * 7 FROM benchmark)"))
def extract_ids(spark, d):
    return op.extract_ids(seqs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") * 7).alias("id")))


@query("seq_extract_missing", sql("seqs", "SELECT DISTINCT item_id * 70 AS id FROM benchmark WHERE item_id * 70 NOT IN (SELECT id FROM seqs)"))
def extract_missing(spark, d):
    return op.missing_ids(seqs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") * 70).alias("id")))


_RC = "reverse(translate(upper({0}), 'ACGTRYKMBVDHSWN-.', 'TGCAYRMKVBHDSWN-.'))"


@query("seq_extract_regions", sql("seqs", f"""SELECT id || ':' || 2 || '-' || 9 || ':' || CASE WHEN id % 2 = 0 THEN '+' ELSE '-' END AS label,
  CASE WHEN id % 2 = 0 THEN substr(seq, 2, 8) ELSE {_RC.format('substr(seq, 2, 8)')} END AS subseq FROM seqs WHERE length(seq) >= 9"""))
def extract_regions(spark, d):
    s = seqs(spark, d).where(F.length("seq") >= 9)
    regions = s.select("id", F.lit(2).alias("start"), F.lit(9).alias("end"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand")).distinct()
    return op.extract_regions(s, regions)


@query("seq_revcomp", sql("seqs", f"SELECT id, {_RC.format('seq')} AS revcomp FROM seqs"))
def revcomp(spark, d):
    return op.reverse_complements(seqs(spark, d))


def _frame_sql(frame: int) -> str:
    strand = "seq" if frame > 0 else _RC.format("seq")
    aa = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    digit = lambda k: f"(instr('TCAG', c[{k}]) - 1)"
    return f"""SELECT id, {frame} AS frame, array_to_string(list_transform(list_transform(range(0, (length(s) - {abs(frame) - 1}) // 3), lambda i: substr(s, i * 3 + {abs(frame)}, 3)),
      lambda c: CASE WHEN contains(c, 'N') THEN 'X' ELSE substr('{aa}', {digit(1)} * 16 + {digit(2)} * 4 + {digit(3)} + 1, 1) END), '') AS protein FROM (SELECT id, {strand} AS s FROM seqs)"""


@query("seq_translate", sql("seqs", " UNION ALL ".join(map(_frame_sql, (1, 2, 3, -1, -2, -3)))))
def translate(spark, d):
    return op.translated(seqs(spark, d), (1, 2, 3, -1, -2, -3))


_FRAMES = " UNION ALL ".join(map(_frame_sql, (1, 2, 3, -1, -2, -3)))


@query("seq_orfs", sql("seqs", f"""WITH f AS (SELECT f.*, length(seq) AS n FROM ({_FRAMES}) f JOIN (SELECT DISTINCT id, seq FROM seqs) s ON f.id = s.id),
p AS (SELECT id, n, frame, list_transform(string_split(protein, '*'), lambda x: length(x) + 1) AS sizes, string_split(protein, '*') AS pieces FROM (SELECT DISTINCT * FROM f)),
x AS (SELECT id, n, frame, i, len(pieces) AS k, pieces[i] AS piece, list_sum(sizes[1:i - 1]) AS before FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM p)),
o AS (SELECT id, n, frame, i < k AS complete, instr(piece, 'M') - 1 AS m, length(piece) AS l, coalesce(before, 0) AS before FROM x WHERE contains(piece, 'M')),
b AS (SELECT *, abs(frame) - 1 + 3 * (before + m) AS b, abs(frame) - 1 + 3 * (before + l + CASE WHEN complete THEN 1 ELSE 0 END) AS e FROM o WHERE l - m >= 10)
SELECT id, (CASE WHEN frame > 0 THEN b + 1 ELSE n - e + 1 END)::BIGINT AS start, (CASE WHEN frame > 0 THEN e ELSE n - b END)::BIGINT AS "end", CASE WHEN frame > 0 THEN '+' ELSE '-' END AS strand, abs(frame)::INTEGER AS frame, complete, (l - m)::BIGINT AS aa_length FROM b"""))
def orfs(spark, d):
    return op.orfs(seqs(spark, d).distinct(), min_aa=10, partial=True)


@query("seq_id_normalize", sql("seqs", "SELECT id, 'rec_' || lpad((row_number() OVER (ORDER BY id))::VARCHAR, 6, '0') AS new_id FROM (SELECT DISTINCT id FROM seqs)"))
def id_normalize(spark, d):
    return op.normalized_ids(seqs(spark, d).select("id").distinct(), ["id"], "rec")


@query("seq_split", sql("seqs", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 + 1 AS file_no FROM (SELECT DISTINCT id FROM seqs)"))
def split(spark, d):
    return op.split_files(seqs(spark, d).select("id").distinct(), ["id"], 100)


@query("seq_merge_duplicates", sql("seqs", "SELECT count(*) AS records, count(*) - count(DISTINCT id) AS duplicates FROM (SELECT id FROM seqs UNION ALL SELECT id FROM seqs WHERE id % 2 = 0)"))
def merge(spark, d):
    s = seqs(spark, d)
    return op.duplicate_ids(op.merged([s, s.where("id % 2 = 0")], allow_duplicate_ids=True))


@query("seq_to_table", sql("seqs", "SELECT s.id, lang AS description, length(seq) AS length, seq AS sequence FROM (SELECT DISTINCT * FROM seqs) s JOIN (SELECT DISTINCT doc_id, lang FROM documents) ON doc_id = s.id"))
def to_table(spark, d):
    lang = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("lang").alias("description")).distinct()
    return op.to_table(seqs(spark, d).distinct().join(lang, "id")).withColumn("length", F.col("length").cast("long"))


@query("seq_from_table", r"SELECT doc_id::VARCHAR AS id, lang AS description, regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g') AS seq FROM documents")
def from_table(spark, d):
    return op.from_table(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", "lang")


_KMER = "WITH w AS (SELECT substr(seq, i, 5) AS w FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM seqs)), k AS (SELECT {0} AS kmer, count(*) AS n FROM w WHERE NOT contains(w, 'N') GROUP BY 1) "


@query("kmer_counts", sql("seqs", _KMER.format("w") + "SELECT * FROM k"))
def kmer_counts(spark, d):
    return op.kmer_counts(seqs(spark, d), 5)


@query("kmer_counts_canonical", sql("seqs", _KMER.format("least(w, reverse(translate(w, 'ACGT', 'TGCA')))") + "SELECT * FROM k"))
def kmer_canonical(spark, d):
    return op.kmer_counts(seqs(spark, d), 5, canonical=True)


@query("kmer_top", sql("seqs", _KMER.format("w") + "SELECT * FROM k ORDER BY n DESC, kmer LIMIT 50"))
def kmer_top(spark, d):
    return op.kmer_top(seqs(spark, d), 5)


@query("kmer_summary", sql("seqs", _KMER.format("w") + "SELECT (SELECT count(*) FROM w) AS windows, sum(n)::BIGINT AS counted, (SELECT count(*) FROM w) - sum(n)::BIGINT AS skipped, count(*) AS distinct_kmers FROM k"))
def kmer_summary(spark, d):
    return op.kmer_summary(seqs(spark, d), 5)


@query("consensus", sql("aln", """
WITH c AS (SELECT i AS pos, seq[i] AS base, count(*) AS c FROM aln, range(1, 61) t(i) GROUP BY 1, 2),
b AS (SELECT pos, base, c, row_number() OVER (PARTITION BY pos ORDER BY c DESC, instr('ACGTUN', base) DESC) AS k FROM c WHERE base <> '-')
SELECT pos, CASE WHEN c >= ceil((SELECT count(*) FROM aln) * 0.3::DOUBLE) THEN base ELSE 'N' END AS base FROM b WHERE k = 1"""))
def consensus(spark, d):
    return op.consensus(alignment(spark, d), 0.3)


@query("epcr", sql("seqs", """
WITH s AS (SELECT DISTINCT * FROM seqs), p(primer, f, r) AS (VALUES ('p1', 'TGAT', 'TNAT'), ('p2', 'GNGA', 'TCNT')), q AS (SELECT primer, f, reverse(translate(r, 'ACGT', 'TGCA')) AS r FROM p),
a AS (SELECT primer, id, i AS st FROM (SELECT primer, f, id, seq, unnest(range(1, length(seq) - 2)) AS i FROM s, q) WHERE substr(seq, i, 4) = f),
b AS (SELECT primer, id, i AS rv FROM (SELECT primer, r, id, seq, unnest(range(1, length(seq) - 2)) AS i FROM s, q) WHERE substr(seq, i, 4) = r)
SELECT a.primer, a.id, st AS start, rv + 3 AS "end", rv + 4 - st AS length FROM a JOIN b ON a.primer = b.primer AND a.id = b.id WHERE rv >= st AND rv + 4 - st BETWEEN 10 AND 60"""))
def epcr(spark, d):
    primers = spark.createDataFrame([("p1", "TGAT", "TNAT"), ("p2", "GNGA", "TCNT")], "primer string, forward string, reverse string")
    return op.epcr(seqs(spark, d).distinct(), primers, 10, 60)


@query("dotplot_matches", sql("seqs", """
WITH w AS (SELECT id, i, substr(seq, i, 8) AS k FROM (SELECT id, seq, unnest(range(1, length(seq) - 6)) AS i FROM (SELECT DISTINCT * FROM seqs))), q AS (SELECT item_id, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM benchmark),
v AS (SELECT item_id AS id, i, substr(seq, i, 8) AS k FROM (SELECT item_id, seq, unnest(range(1, length(seq) - 6)) AS i FROM q))
SELECT a.id AS qid, b.id AS rid, a.i AS qpos, b.i AS rpos FROM v a JOIN w b ON a.k = b.k WHERE NOT contains(a.k, 'N')"""))
def dotplot(spark, d):
    """The benchmark's items as queries, against all documents."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", "")).alias("seq"))
    return op.dotplot(items, seqs(spark, d).distinct(), 8)


@query("seq_shuffle", sql("seqs", "SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS place FROM (SELECT DISTINCT id FROM seqs)"))
def shuffle(spark, d):
    return op.shuffled(seqs(spark, d).select("id").distinct())
