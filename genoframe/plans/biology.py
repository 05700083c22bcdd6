"""Queries on similarity, enrichment, proteins, ecology, structures, trees and survival."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sequence import translate_frame
from ..functions.statistics import bh_adjusted
from ..operators import differential, ecology, enrichment, phylogeny, proteins, similarity, structures, survival
from .catalog import query
from .sequences import _frame_sql
from .views import associations, atoms, features, hits, matrix, seqs, sql, table


@query("blast_summary", sql("fwd", "SELECT count(*) AS hits, count(DISTINCT query) AS queries, count(DISTINCT subject) AS subjects, min(evalue) AS min_evalue, max(bits) AS max_bits, round(avg(identity), 6) AS mean_identity FROM fwd"))
def blast_summary(spark, d):
    return similarity.summary(hits(spark, d)).withColumn("mean_identity", F.round("mean_identity", 6))


_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY evalue, bits DESC, identity DESC, length DESC, subject) AS k FROM {v} WHERE evalue <= 0.05 AND identity >= 95) WHERE k = 1"


@query("blast_best_hits", sql("fwd", f"SELECT query, subject, evalue, bits, identity, length FROM ({_BEST.format(v='fwd')})"))
def best_hits(spark, d):
    return similarity.best_hits(hits(spark, d), 0.05, 95.0)


@query("reciprocal_best_hits", sql("fwd rev", f"SELECT f.query, f.subject, f.evalue, f.bits FROM ({_BEST.format(v='fwd')}) f JOIN ({_BEST.format(v='rev')}) r ON f.query = r.subject AND f.subject = r.query"))
def rbh(spark, d):
    return similarity.reciprocal(hits(spark, d), hits(spark, d, "reverse"), 0.05, 95.0)


@query("domain_counts", sql("features", "SELECT source, type AS accession, count(*) AS n, count(DISTINCT seqid) AS sequences FROM features GROUP BY 1, 2"))
def domains(spark, d):
    return similarity.domain_counts(features(spark, d).select("source", F.col("type").alias("accession"), F.col("seqid").alias("sequence")))


def _genes(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("gene_id"))


_ORA = """WITH g AS (SELECT c_custkey AS gene_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT gene_id FROM assoc)),
t AS (SELECT count(DISTINCT gene_id) AS total, (SELECT count(*) FROM g) AS drawn FROM assoc),
o AS (SELECT term_id, count(*) FILTER (gene_id IN (SELECT gene_id FROM g)) AS overlap, count(*) AS term_n FROM assoc GROUP BY 1),
h AS (SELECT o.*, total, drawn, unnest(range(overlap, least(drawn, term_n) + 1)) AS i FROM o, t WHERE overlap >= 1),
p AS (SELECT term_id, overlap, term_n, drawn, total, least(1.0, sum(CASE WHEN drawn - i <= total - term_n THEN exp(lgamma(term_n + 1) - lgamma(i + 1) - lgamma(term_n - i + 1) + lgamma(total - term_n + 1) - lgamma(drawn - i + 1) - lgamma(total - term_n - drawn + i + 1)
   - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)) ELSE 0 END)) AS p FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY p, term_id) AS k, count(*) OVER () AS m FROM p),
a AS (SELECT *, min(least(1.0, p * m / k)) OVER (ORDER BY k DESC) AS padj FROM r) """


@query("ora", sql("assoc", _ORA + "SELECT term_id, overlap, term_n, drawn, (overlap::DOUBLE / drawn) / (term_n::DOUBLE / total) AS fold, round(p, 6) AS p, round(padj, 6) AS padj FROM a"))
def ora(spark, d):
    out = enrichment.overrepresentation(_genes(spark, d), associations(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("p", "padj")})


@query("ora_mapping", sql("assoc", "SELECT count(*) AS input, count(*) FILTER (c_custkey IN (SELECT gene_id FROM assoc)) AS mapped, count(*) FILTER (c_custkey NOT IN (SELECT gene_id FROM assoc)) AS unmapped FROM customer WHERE c_mktsegment = 'BUILDING'"))
def ora_mapping(spark, d):
    return enrichment.mapping(_genes(spark, d), associations(spark, d))


@query("bh_adjust", """WITH p AS (SELECT l_partkey AS term, (sum(l_quantity)::BIGINT % 1000 + 1) / 1001.0::DOUBLE AS p FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS k, count(*) OVER () AS m FROM p)
SELECT term, p, round(min(least(1.0, p * m / k)) OVER (ORDER BY k DESC), 9) AS padj FROM r""")
def bh(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("term")).agg(((F.sum("l_quantity").cast("long") % 1000 + 1) / F.lit(1001.0)).alias("p"))
    return bh_adjusted(p, "p", "term").withColumn("padj", F.round("padj", 9))


def _ranked(spark, d):
    scores = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("gene_id")).agg((F.sum("l_quantity").cast("long") % 997 - 498).cast("double").alias("score"))
    sets = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("gene_id"), F.concat("p_brand", F.lit("/"), (F.col("p_size") % 2).cast("string")).alias("term_id"))
    return scores, sets


@query("gsea_es", """WITH s AS (SELECT l_partkey::VARCHAR AS gene_id, (sum(l_quantity)::BIGINT % 997 - 498)::DOUBLE AS score FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene_id) AS rank, abs(score) / max(abs(score)) OVER () AS w, count(*) OVER () AS n FROM s),
h AS (SELECT p_brand || '/' || p_size % 2 AS term_id, r.* FROM part JOIN r ON p_partkey::VARCHAR = gene_id), z AS (SELECT term_id, count(*) AS size, sum(w) AS sw FROM h GROUP BY 1 HAVING count(*) BETWEEN 15 AND 500),
g AS (SELECT term_id, gene_id, size, t.rank, CASE WHEN gene_id2 IS NOT NULL THEN w / sw ELSE -1.0::DOUBLE / (n - size) END AS step FROM (SELECT z.term_id, size, sw, r.gene_id, r.rank, r.w, r.n, h.gene_id AS gene_id2 FROM z CROSS JOIN r LEFT JOIN h ON h.term_id = z.term_id AND h.gene_id = r.gene_id) t),
e AS (SELECT term_id, size, rank, sum(step) OVER (PARTITION BY term_id ORDER BY rank) AS es FROM g),
m AS (SELECT term_id, size, max(es) AS hi, min(es) AS lo FROM e GROUP BY 1, 2)
SELECT term_id, size, round(CASE WHEN abs(hi) + 1e-14 >= abs(lo) THEN hi ELSE lo END, 6) AS es FROM m""")
def gsea_es(spark, d):
    return enrichment.enrichment_scores(*_ranked(spark, d)).select("term_id", "size", F.round("es", 6).alias("es"))


@query("gsea_leading_edge", """WITH s AS (SELECT l_partkey::VARCHAR AS gene_id, (sum(l_quantity)::BIGINT % 997 - 498)::DOUBLE AS score FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, gene_id) AS rank, abs(score) / max(abs(score)) OVER () AS w, count(*) OVER () AS n FROM s),
h AS (SELECT p_brand || '/' || p_size % 2 AS term_id, r.* FROM part JOIN r ON p_partkey::VARCHAR = gene_id), z AS (SELECT term_id, count(*) AS size, sum(w) AS sw FROM h GROUP BY 1 HAVING count(*) BETWEEN 15 AND 500),
u AS (SELECT h.*, size, w / sw AS share, sum(w / sw) OVER o AS up, row_number() OVER o AS j FROM h JOIN z ON h.term_id = z.term_id WINDOW o AS (PARTITION BY h.term_id ORDER BY rank ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, up - (rank - j) / greatest(n - size, 1)::DOUBLE AS after_, up - share - (rank - j) / greatest(n - size, 1)::DOUBLE AS before_ FROM u),
m AS (SELECT term_id, max(after_) AS hi, min(before_) AS lo, arg_max(rank, after_) AS hi_rank, arg_min(rank - 1, before_) AS lo_rank FROM e GROUP BY 1)
SELECT e.term_id, gene_id FROM e JOIN m ON e.term_id = m.term_id WHERE CASE WHEN abs(hi) + 64 * 2.220446049250313e-16 >= abs(lo) THEN rank <= hi_rank ELSE rank > lo_rank END""")
def gsea_leading(spark, d):
    return enrichment.leading_edge(*_ranked(spark, d))


@query("gsea_pvalues")
def gsea_p(spark, d):
    return enrichment.permuted_pvalues(*_ranked(spark, d), permutations=200)


def _proteins(spark, d):
    s = seqs(spark, d).distinct()
    p = F.replace(translate_frame(F.col("seq"), 1), F.lit("*"), F.lit(""))
    return s.select("id", F.when(F.col("id") % 4 != 0, F.replace(p, F.lit("X"), F.lit(""))).otherwise(p).alias("seq"))


def _n(a: str) -> str:
    return f"(length(seq) - length(replace(seq, '{a}', '')))"


_MASS_SQL, _HYDRO_SQL = (" + ".join(["0.0::DOUBLE", *[f"{_n(a)} * {v!r}::DOUBLE" for a, v in t.items()]]) for t in (proteins.MASS, proteins.HYDROPATHY))


_PROTEIN_SQL = f"""one AS (SELECT DISTINCT id, seq FROM seqs), tr AS ({_frame_sql(1).replace('FROM seqs', 'FROM one')}),
p AS (SELECT id, CASE WHEN id % 4 <> 0 THEN replace(replace(protein, '*', ''), 'X', '') ELSE replace(protein, '*', '') END AS seq FROM tr)"""


@query("protein_properties", sql("seqs", f"""
WITH {_PROTEIN_SQL},
c AS (SELECT *, length(seq) > 0 AND NOT contains(seq, 'X') AS ok FROM p)
SELECT id, length(seq) AS length, CASE WHEN ok THEN round({_MASS_SQL} + 18.01528, 6) END AS weight, CASE WHEN ok THEN round(({_HYDRO_SQL}) / length(seq), 6) END AS gravy,
  CASE WHEN ok THEN 100.0::DOUBLE * ({_n('F')} + {_n('W')} + {_n('Y')}) / length(seq) END AS aromaticity, CASE WHEN ok THEN {_n('W')} * 5500 + {_n('Y')} * 1490 END AS extinction_reduced,
  CASE WHEN ok THEN {_n('W')} * 5500 + {_n('Y')} * 1490 + 125 * ({_n('C')} // 2) END AS extinction_oxidized FROM c"""))
def protein_properties(spark, d):
    out = proteins.properties(_proteins(spark, d)).drop("charge_7", "pi")
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "gravy")})


def _charge_sql(ph: str) -> str:
    plus, minus = f"1 / (1 + pow(10.0::DOUBLE, {ph} - {{0}}))", f"1 / (1 + pow(10.0::DOUBLE, {{0}} - {ph}))"
    parts = [plus.format(proteins.N_TERMINUS), "-" + minus.format(proteins.C_TERMINUS)]
    parts += [f"+ n_{a} * {plus.format(k)}" for a, k in proteins.BASIC.items()] + [f"- n_{a} * {minus.format(k)}" for a, k in proteins.ACIDIC.items()]
    return " ".join(parts)


@query("protein_pi", sql("seqs", f"""WITH RECURSIVE {_PROTEIN_SQL}, c AS (SELECT id, length(seq) > 0 AND NOT contains(seq, 'X') AS ok, {", ".join(f"{_n(a)} AS n_{a}" for a in [*proteins.BASIC, *proteins.ACIDIC])} FROM p),
s AS (SELECT id, 0 AS step, 0.0::DOUBLE AS lo, 14.0::DOUBLE AS hi FROM c WHERE ok UNION ALL
  SELECT id, step + 1, CASE WHEN high THEN mid ELSE lo END, CASE WHEN high THEN hi ELSE mid END FROM (SELECT s.*, (lo + hi) * 0.5 AS mid, {_charge_sql("(lo + hi) * 0.5")} > 0 AS high FROM s JOIN c ON s.id = c.id WHERE step < 80))
SELECT c.id, CASE WHEN ok THEN round({_charge_sql("7.0::DOUBLE")}, 6) END AS charge_7, round((lo + hi) * 0.5, 6) AS pi FROM c LEFT JOIN s ON s.id = c.id AND step = 80"""))
def protein_pi(spark, d):
    return proteins.properties(_proteins(spark, d)).select("id", F.round("charge_7", 6).alias("charge_7"), F.round("pi", 6).alias("pi"))


def _taxa(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("taxon")).agg(F.count(F.lit(1)).alias("n"))


@query("alpha_diversity", """WITH t AS (SELECT user_id AS sample, event_type, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY sample) AS p FROM t)
SELECT sample, count(*) AS richness, round(-sum(p * ln(p)), 6) AS shannon, CASE WHEN count(*) > 1 THEN round(-sum(p * ln(p)) / ln(count(*)), 6) END AS evenness FROM p GROUP BY 1""")
def alpha(spark, d):
    return ecology.alpha_diversity(_taxa(spark, d)).withColumns({c: F.round(c, 6) for c in ("shannon", "evenness")})


@query("top_taxa", "SELECT event_type AS taxon, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, taxon LIMIT 3")
def top_taxa(spark, d):
    return ecology.top_taxa(_taxa(spark, d), 3)


def _spots(spark, d):
    return _taxa(spark, d).select(F.col("sample").cast("string").alias("barcode"), F.col("taxon").alias("gene"), "n")


_RANKS = "WITH b AS (SELECT user_id::VARCHAR AS barcode, count(*) AS counts, count(DISTINCT event_type) AS genes FROM events GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY counts DESC, barcode) AS rank, * FROM b) "


@query("barcode_rank", _RANKS + "SELECT * FROM r")
def barcode_rank(spark, d):
    return ecology.barcode_ranks(_spots(spark, d))


@query("barcode_percentiles", _RANKS + ", n AS (SELECT count(*) AS n FROM r), f(fraction) AS (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) SELECT fraction, counts FROM f, n, r WHERE rank = n - round((n - 1) * fraction)::BIGINT")
def barcode_percentiles(spark, d):
    return ecology.barcode_percentiles(_spots(spark, d))


@query("local_maxima", """WITH w AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, event_id, value FROM w WHERE value > 0 AND value > a AND value >= b""")
def maxima(spark, d):
    return ecology.local_maxima(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("contact_map", sql("atoms", """SELECT a.residue AS a, b.residue AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS distance, a.chain <> b.chain AS inter_chain
FROM atoms a JOIN atoms b ON a.residue < b.residue WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 2"""))
def contact_map(spark, d):
    return structures.contact_map(atoms(spark, d), 2.0).withColumn("distance", F.round("distance", 6))


@query("atom_summary", sql("atoms", "SELECT chain, count(*) AS atoms, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM atoms GROUP BY 1"))
def atom_summary(spark, d):
    return structures.summary(atoms(spark, d))


@query("plddt_bands", "WITH r AS (SELECT user_id, avg(value) AS b FROM events GROUP BY 1) SELECT CASE WHEN b >= 90 THEN 'very-high' WHEN b >= 70 THEN 'confident' WHEN b >= 50 THEN 'low' ELSE 'very-low' END AS band, count(*) AS n FROM r GROUP BY 1")
def plddt(spark, d):
    return structures.plddt_bands(table(spark, d, "events").select(F.col("user_id").alias("residue"), F.col("value").alias("b")))


@query("superpose_rmsd", sql("atoms", """SELECT count(*) AS pairs, round(sqrt(avg((x + y - 3) ** 2 + (y - x + 1) ** 2 + 4)), 4) AS rmsd_before, 0.0::DOUBLE AS rmsd, 0.0::DOUBLE AS r00, 1.0::DOUBLE AS r01, 0.0::DOUBLE AS r02,
  -1.0::DOUBLE AS r10, 0.0::DOUBLE AS r11, 0.0::DOUBLE AS r12, 0.0::DOUBLE AS r20, 0.0::DOUBLE AS r21, 1.0::DOUBLE AS r22 FROM atoms"""))
def superpose(spark, d):
    """A quarter turn and a shift, which the best rotation undoes."""
    a = atoms(spark, d)
    turned = a.select("chain", "residue", (-F.col("y") + 3).alias("x"), (F.col("x") - 1).alias("y"), (F.col("z") + 2).alias("z"))
    out = structures.superposed(spark, a, turned)
    return out.select("pairs", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in out.columns[1:]])


_PAIRS = """WITH al AS (SELECT DISTINCT id, seq FROM seqs), m AS (SELECT a.id AS a, b.id AS b, a.seq AS x, b.seq AS y, length(a.seq) AS n, length(b.seq) AS k FROM al a, al b WHERE a.id % 50 = 0),
c AS (SELECT a, b, n, k, unnest(string_split(left(x, least(n, k)::INT), '')) AS p, unnest(string_split(left(y, least(n, k)::INT), '')) AS q FROM m),
g AS (SELECT a, b, count(*) FILTER (p <> q) AS diff, count(*) FILTER (p || q IN ('AG', 'GA', 'CT', 'TC')) AS ts FROM c WHERE p <> '' GROUP BY 1, 2),
f AS (SELECT m.a, m.b, coalesce((coalesce(diff, 0) + abs(n - k))::DOUBLE / nullif(greatest(n, k), 0), 0) AS p, coalesce(coalesce(ts, 0)::DOUBLE / nullif(greatest(n, k), 0), 0) AS ts, coalesce((coalesce(diff, 0) - coalesce(ts, 0))::DOUBLE / nullif(greatest(n, k), 0), 0) AS tv
  FROM m LEFT JOIN g ON m.a = g.a AND m.b = g.b) """

for _model, _formula in {
    "p-distance": "p",
    "jc69": "CASE WHEN p >= 0.75 THEN 'inf'::DOUBLE ELSE round(-0.75 * ln(1 - 4.0::DOUBLE / 3 * p), 6) END",
    "k80": "CASE WHEN 1 - 2 * ts - tv <= 0 OR 1 - 2 * tv <= 0 THEN 'inf'::DOUBLE ELSE round(-0.5 * ln((1 - 2 * ts - tv) * sqrt(1 - 2 * tv)), 6) END",
}.items():

    def _distance(spark, d, model=_model):
        """Documents whose id is divisible by 50 against all, whole sequences filled up with gaps."""
        rows = seqs(spark, d).distinct()
        out = phylogeny.distances(rows, model, rows.where("id % 50 = 0"))
        return out.withColumn("distance", F.round("distance", 6) + F.lit(0.0) if model != "p-distance" else F.col("distance"))

    query(f"seq_distance_{_model.replace('-', '_')}", sql("seqs", _PAIRS + f"SELECT a, b, CASE WHEN a = b THEN 0.0::DOUBLE ELSE {_formula} + 0.0 END AS distance FROM f"))(_distance)


def _tree(spark, d):
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    root = spark.createDataFrame([("root", None, 0.0)], "node string, parent string, length double")
    regions = r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("root").alias("parent"), F.lit(1.0).alias("length"))
    nations = n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit(0.5).alias("length"))
    suppliers = s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.lit(0.25).alias("length"))
    return root.unionByName(regions).unionByName(nations).unionByName(suppliers)


@query("tree_metrics", """WITH RECURSIVE e AS (SELECT 'root' AS node, NULL AS parent, 0.0::DOUBLE AS length UNION ALL SELECT 'r' || r_regionkey, 'root', 1.0 FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0.5 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 0.25 FROM supplier),
t AS (SELECT node, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.node, depth + 1 FROM e JOIN t ON e.parent = t.node)
SELECT count(*) FILTER (e.node NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL)) AS leaves, count(*) FILTER (e.node IN (SELECT parent FROM e WHERE parent IS NOT NULL)) AS internal, max(depth)::BIGINT AS max_depth, sum(length) AS total_length FROM e JOIN t ON e.node = t.node""")
def tree_metrics(spark, d):
    return phylogeny.tree_metrics(_tree(spark, d))


def _cohort(spark, d):
    o = table(spark, d, "orders")
    own = o.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("time"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    c = table(spark, d, "customer")
    return c.join(own, c.c_custkey == own.o_custkey).select(F.col("c_mktsegment").alias("group"), F.col("time").cast("long").alias("time"), (F.col("last") == "F").alias("event"))


_KM = """WITH o AS (SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS t, last(o_orderstatus ORDER BY o_orderdate, o_orderkey) = 'F' AS ev FROM orders GROUP BY 1),
c AS (SELECT c_mktsegment AS g, t, ev FROM customer JOIN o ON c_custkey = o_custkey), n AS (SELECT g, t, count(*) AS n, count(*) FILTER (ev) AS d FROM c GROUP BY 1, 2),
r AS (SELECT g, t, d, (sum(n) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS at_risk FROM n),
k AS (SELECT g, t, at_risk, d, CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d::DOUBLE / at_risk) ELSE 0 END) OVER w) END AS s FROM r WHERE d > 0 WINDOW w AS (PARTITION BY g ORDER BY t)) """


@query("km_curve", _KM + 'SELECT g AS "group", t AS "time", at_risk, d AS events, round(s, 6) AS survival FROM k')
def km_curve(spark, d):
    return survival.curve(_cohort(spark, d)).withColumn("survival", F.round("survival", 6))


@query("km_median", _KM + """, z AS (SELECT g, count(*) AS n, count(*) FILTER (ev) AS events FROM c GROUP BY 1), h AS (SELECT g, min(t) AS m FROM k WHERE s <= 0.5 + 1e-12 GROUP BY 1) SELECT z.g AS "group", n, events, m AS median FROM z LEFT JOIN h ON z.g = h.g""")
def km_median(spark, d):
    return survival.medians(_cohort(spark, d))


_RISK = _KM.replace("k AS (SELECT", "unused AS (SELECT") + """, u AS (SELECT DISTINCT t FROM n), w AS (SELECT u.t, g.g, coalesce(n.n, 0) AS c, coalesce(n.d, 0) AS d FROM u CROSS JOIN (SELECT DISTINCT g FROM n) g LEFT JOIN n ON n.t = u.t AND n.g = g.g),
x AS (SELECT t, g, d, sum(c) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr FROM w), y AS (SELECT *, sum(d) OVER (PARTITION BY t) AS dt, sum(nr) OVER (PARTITION BY t) AS nt FROM x) """


@query("log_rank_groups", _RISK + 'SELECT g AS "group", sum(d)::BIGINT AS observed, round(sum(dt * nr::DOUBLE / nt), 6) AS expected FROM y WHERE dt > 0 GROUP BY 1')
def log_rank_groups(spark, d):
    return survival.log_rank_groups(_cohort(spark, d)).withColumn("expected", F.round("expected", 6))


def _two(spark, d):
    return _cohort(spark, d).withColumn("group", F.when(F.col("group") == "BUILDING", "a").otherwise("b"))


@query("log_rank_test", _RISK.replace("c_mktsegment AS g", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'a' ELSE 'b' END AS g") + """SELECT round(sum(d - dt * nr::DOUBLE / nt) ** 2 / sum(dt * (nt - dt) / greatest(nt - 1, 1)::DOUBLE * (nr::DOUBLE / nt) * (1 - nr::DOUBLE / nt)), 6) AS chi2, 1::INTEGER AS df FROM y WHERE dt > 0 AND g = 'a'""")
def log_rank_test(spark, d):
    return survival.log_rank(_two(spark, d)).select(F.round("chi2", 6).alias("chi2"), "df")


@query("cox_hazards")
def cox_hazards(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"), (F.col("c_acctbal") / 1000).alias("balance"))
    o = table(spark, d, "orders")
    own = o.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("time"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    return survival.cox(c.join(own, F.col("k") == F.col("o_custkey")).withColumn("event", F.col("last") == "F"), ["building", "balance"])


@query("differential_wald")
def differential_wald(spark, d):
    """Brands whose quantities differ between suppliers' nations of even and odd keys."""
    m = matrix(spark, d)
    design = m.select("sample").distinct().withColumn("condition", F.when(F.col("sample").cast("int") % 2 == 0, "even").otherwise("odd"))
    return differential.wald(m, design, "even")


@query("structure_geometry", sql("atoms", """WITH p AS (SELECT chain, residue, x, y, z, row_number() OVER (PARTITION BY chain ORDER BY residue) AS k FROM atoms),
q AS (SELECT a.chain, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS u, sqrt((c.x - b.x) ** 2 + (c.y - b.y) ** 2 + (c.z - b.z) ** 2) AS v, (a.x - b.x) * (c.x - b.x) + (a.y - b.y) * (c.y - b.y) + (a.z - b.z) * (c.z - b.z) AS dot
  FROM p a JOIN p b ON a.chain = b.chain AND a.k = 1 AND b.k = 2 JOIN p c ON c.chain = a.chain AND c.k = 3)
SELECT chain, round(u, 6) AS distance, round(degrees(acos(dot / u / v)), 4) AS angle FROM q"""))
def geometry(spark, d):
    """Distance and angle of the first three residues of each chain."""
    k = F.row_number().over(Window.partitionBy("chain").orderBy("residue"))
    place = lambda n: F.max(F.when(F.col("k") == n, F.struct("x", "y", "z"))).alias(f"p{n}")
    first = atoms(spark, d).withColumn("k", k).where("k <= 3").groupBy("chain").agg(*[place(n) for n in (1, 2, 3)]).where("p3 IS NOT NULL")
    return first.select("chain", F.round(structures.distance_of("p1", "p2"), 6).alias("distance"), F.round(structures.angle_of("p1", "p2", "p3"), 4).alias("angle"))


@query("structure_sequences", """SELECT p_brand AS chain, string_agg(CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'W' ELSE 'X' END, '' ORDER BY p_partkey) AS seq FROM part GROUP BY 1""")
def structure_sequences(spark, d):
    p = table(spark, d, "part")
    name = F.element_at(F.array(*[F.lit(x) for x in ("ALA", "GLY", "TRP", "ZZZ")]), F.col("p_size") % 4 + 1)
    return structures.sequences(p.select(F.col("p_brand").alias("chain"), F.col("p_partkey").cast("string").alias("resseq"), F.lit("").alias("icode"), name.alias("resname"), F.col("p_partkey").alias("ord")))


@query("structure_torsion", sql("atoms", """WITH p AS (SELECT chain, x, y, z, row_number() OVER (PARTITION BY chain ORDER BY residue) AS k FROM atoms),
q AS (SELECT a.chain, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - b.x AS vx, c.y - b.y AS vy, c.z - b.z AS vz, d.x - c.x AS wx, d.y - c.y AS wy, d.z - c.z AS wz
  FROM p a JOIN p b ON a.chain = b.chain AND a.k = 1 AND b.k = 2 JOIN p c ON c.chain = a.chain AND c.k = 3 JOIN p d ON d.chain = a.chain AND d.k = 4),
n AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz, vy * wz - vz * wy AS mx, vz * wx - vx * wz AS my, vx * wy - vy * wx AS mz FROM q)
SELECT chain, round(degrees(atan2(((ny * mz - nz * my) * vx + (nz * mx - nx * mz) * vy + (nx * my - ny * mx) * vz) / sqrt(vx * vx + vy * vy + vz * vz), nx * mx + ny * my + nz * mz)), 4) AS torsion FROM n"""))
def torsion(spark, d):
    """Torsion of the first four residues of each chain."""
    k = F.row_number().over(Window.partitionBy("chain").orderBy("residue"))
    spot = lambda n: F.max(F.when(F.col("k") == n, F.struct("x", "y", "z"))).alias(f"p{n}")
    first = atoms(spark, d).withColumn("k", k).where("k <= 4").groupBy("chain").agg(*[spot(n) for n in (1, 2, 3, 4)]).where("p4 IS NOT NULL")
    return first.select("chain", F.round(structures.torsion_of("p1", "p2", "p3", "p4"), 4).alias("torsion"))
