"""Jobs by capability name: named input files and parameters in, a DataFrame or a written artifact out.

A job's inputs must be exactly the capability's roles, and its parameters among those the
capability knows; `output` names a path to write the result to, which must not exist.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotations, differential, ecology, enrichment, expression, intervals, phylogeny, proteins, reads, sequences, similarity, structures, survival, tables, variants
from .sources import files, records
from .sources import tables as readers


@dataclass(frozen=True)
class Capability:
    """roles: the inputs; parameters: what may be given; run(spark, inputs, parameters) -> DataFrame; write: the artifact's writer."""

    roles: tuple[str, ...]
    parameters: tuple[str, ...]
    run: Callable[[SparkSession, dict, dict], DataFrame]
    write: Callable[[DataFrame, str], None] = records.write_table


@dataclass
class Result:
    job_id: str
    capability: str
    status: str
    data: DataFrame | None = None
    artifact: str | None = None
    message: str = ""
    error: Exception | None = None
    inputs: dict = field(default_factory=dict)


CAPABILITIES: dict[str, Capability] = {}


def capability(name: str, roles: str = "", parameters: str = "", write=records.write_table):
    def add(f):
        CAPABILITIES[name] = Capability(tuple(roles.split()), tuple(parameters.split()), f, write)
        return f

    return add


def _picked(p: dict, **names) -> dict:
    """Keyword arguments from the parameters that were given."""
    return {k: p[v] for k, v in names.items() if v in p}


# ---- intervals
_bed = records.bed
capability("interval.intersect.v1", "left-bed right-bed")(lambda s, i, p: intervals.intersect_by_contig(_bed(s, i["left-bed"]), _bed(s, i["right-bed"])))
capability("interval.merge.v1", "bed", "max_gap", records.write_bed)(lambda s, i, p: intervals.merge(_bed(s, i["bed"]), p.get("max_gap", 0)).drop("n"))
capability("interval.subtract.v1", "left-bed right-bed", write=records.write_bed)(lambda s, i, p: intervals.subtract(_bed(s, i["left-bed"]), _bed(s, i["right-bed"])))
capability("interval.closest.v1", "query-bed target-bed")(lambda s, i, p: intervals.closest(_bed(s, i["query-bed"]), _bed(s, i["target-bed"])))

# ---- sequences
_fa = records.fasta
_FILTER = {"min_length": "min_length", "max_length": "max_length", "min_gc": "min_gc_percent", "max_gc": "max_gc_percent", "max_n": "max_n_percent"}
capability("sequence.stats.v1", "fasta")(lambda s, i, p: sequences.stats(_fa(s, i["fasta"])))
capability("sequence.filter.v1", "fasta", " ".join(_FILTER.values()), records.write_fasta)(lambda s, i, p: sequences.filtered(_fa(s, i["fasta"]), **_picked(p, **_FILTER)))
capability("sequence.translate.v1", "fasta", "frames trim_terminal_stop stop_at_first")(lambda s, i, p: sequences.translated(_fa(s, i["fasta"]), tuple(p.get("frames", (1,))), **_picked(p, stop_at_first="stop_at_first", trim_terminal_stop="trim_terminal_stop")))
capability("sequence.orf.v1", "fasta", "min_amino_acids include_reverse_strand include_partial_3prime")(lambda s, i, p: sequences.orfs(_fa(s, i["fasta"]), p.get("min_amino_acids", 30), p.get("include_reverse_strand", True), p.get("include_partial_3prime", False)))
capability("sequence.id.normalize.v1", "fasta", "prefix start width")(lambda s, i, p: sequences.normalized_ids(_fa(s, i["fasta"]), ["ord"], p.get("prefix", "sequence"), p.get("start", 1), p.get("width", 6)))
capability("sequence.split.v1", "fasta", "records_per_file")(lambda s, i, p: sequences.split_files(_fa(s, i["fasta"]), ["ord"], p["records_per_file"]))
capability("sequence.to-table.v1", "fasta")(lambda s, i, p: sequences.to_table(_fa(s, i["fasta"])))
capability("sequence.from-table.v1", "table", "id_column sequence_column description_column", records.write_fasta)(lambda s, i, p: sequences.from_table(readers.table(s, i["table"]), p.get("id_column", "id"), p.get("sequence_column", "sequence"), p.get("description_column")))
capability("sequence.kmer.count.v1", "fasta", "k canonical top_n")(lambda s, i, p: sequences.kmer_top(_fa(s, i["fasta"]), p.get("k", 21), p.get("canonical", False), p.get("top_n", 50)))
capability("sequence.consensus.v1", "fasta", "threshold")(lambda s, i, p: sequences.consensus(_fa(s, i["fasta"]), p.get("threshold", 0.5)))
capability("sequence.shuffle.v1", "fasta", "seed", records.write_fasta)(lambda s, i, p: sequences.shuffled(_fa(s, i["fasta"]), p.get("seed", 42)).orderBy("place").drop("place"))
capability("sequence.reverse-complement.v1", "fasta", write=records.write_fasta)(lambda s, i, p: sequences.reverse_complements(_fa(s, i["fasta"])).withColumnRenamed("revcomp", "seq"))
capability("comparative.dotplot.v1", "query reference", "kmer")(lambda s, i, p: sequences.dotplot(_fa(s, i["query"]), _fa(s, i["reference"]), p.get("kmer", 12)))


@capability("sequence.merge.v1", "fasta", "allow_duplicate_ids", records.write_fasta)
def _merge(s, i, p):
    paths = i["fasta"] if isinstance(i["fasta"], list) else [i["fasta"]]
    return sequences.merged([_fa(s, x) for x in paths], p.get("allow_duplicate_ids", False))


@capability("sequence.extract.v1", "fasta", "identifiers regions strict")
def _extract(s, i, p):
    seqs = _fa(s, i["fasta"])
    if "regions" in p:
        parts = F.split("r", ":")
        places = F.split(parts[1], "-")
        r = s.createDataFrame([(x,) for x in p["regions"]], "r string")
        r = r.select(parts[0].alias("id"), places[0].cast("int").alias("start"), places[1].cast("int").alias("end"), F.coalesce(F.get(parts, F.lit(2)), F.lit("+")).alias("strand"))
        return sequences.extract_regions(seqs, r)
    ids = s.createDataFrame([(x,) for x in p["identifiers"]], "id string")
    if p.get("strict") and sequences.missing_ids(seqs, ids).limit(1).count():
        raise ValueError("an identifier is missing")
    return sequences.extract_ids(seqs, ids)


@capability("primer.epcr.v1", "fasta primers", "min_amplicon max_amplicon max_hits")
def _epcr(s, i, p):
    primers = readers.table(s, i["primers"]).select(F.col("id").alias("primer"), "forward", "reverse")
    out = sequences.epcr(_fa(s, i["fasta"]), primers, p.get("min_amplicon", 50), p.get("max_amplicon", 5000))
    if "max_hits" in p and out.limit(p["max_hits"] + 1).count() > p["max_hits"]:
        raise ValueError("more hits than max_hits")
    return out


# ---- reads and alignments
_fq = records.fastq
capability("fastq.qc.v1", "fastq", "max_cycles")(lambda s, i, p: reads.qc_cycles(_fq(s, i["fastq"]), p.get("max_cycles", 500)))
capability("fastq.trim.v1", "fastq", "min_quality min_length", records.write_fastq)(lambda s, i, p: reads.quality_trimmed(_fq(s, i["fastq"]), p.get("min_quality", 20), p.get("min_length", 20)))
capability("fastq.adapter.v1", "fastq", "adapter adapters min_overlap min_length", records.write_fastq)(lambda s, i, p: reads.adapter_trimmed(_fq(s, i["fastq"]), tuple(p.get("adapters") or [p.get("adapter", reads.ADAPTER)]), p.get("min_overlap", 8), p.get("min_length", 1)))
capability("fastq.deduplicate.v1", "fastq", "header_umi_delimiter sequence_prefix_umi", records.write_fastq)(lambda s, i, p: reads.deduplicated(_fq(s, i["fastq"]), "ord", p.get("header_umi_delimiter"), p.get("sequence_prefix_umi")))
capability("fastq.subsample.v1", "fastq", "target_count fraction seed", records.write_fastq)(lambda s, i, p: reads.subsampled(_fq(s, i["fastq"]), p.get("target_count"), p.get("fraction"), p.get("seed", 42)))
capability("alignment.qc.v1", "sam")(lambda s, i, p: reads.alignment_qc(records.sam(s, i["sam"])))

# ---- variants
_vcf = records.vcf
for _name in ("variant.stats.v1", "medical.variant-cohort.v1"):
    capability(_name, "vcf")(lambda s, i, p: variants.stats(_vcf(s, i["vcf"])))
capability("variant.compare.v1", "left-vcf right-vcf")(lambda s, i, p: variants.compared(_vcf(s, i["left-vcf"]), _vcf(s, i["right-vcf"])))
capability("variant.filter.v1", "vcf", "min_qual require_pass contigs min_info_dp", records.write_vcf)(lambda s, i, p: _vcf(s, i["vcf"]).where(variants.reject_reason(**_picked(p, min_qual="min_qual", require_pass="require_pass", contigs="contigs", min_dp="min_info_dp")).isNull()).drop("samples"))
capability("variant.to-table.v1", "vcf")(lambda s, i, p: variants.to_table(_vcf(s, i["vcf"], strict=False)))
capability("variant.normalize.v1", "vcf reference", write=records.write_vcf)(lambda s, i, p: variants.normalized(_vcf(s, i["vcf"]), _fa(s, i["reference"]).select(F.col("id").alias("chrom"), "seq")))
capability("medical.pharmacogenomics.v1", "vcf")(lambda s, i, p: variants.pgx_matches(_vcf(s, i["vcf"]).select("chrom", "pos", "ref", "alt", "gt"), variants.pgx_rules(s)))

# ---- annotations
_gxf = records.gxf
capability("annotation.gxf.stats.v1", "annotation")(lambda s, i, p: annotations.stats(_gxf(s, i["annotation"])))
capability("annotation.gxf.normalize.v1", "annotation", "sort", records.write_lines)(lambda s, i, p: annotations.normalized(_gxf(s, i["annotation"])))
capability("annotation.gene-position.v1", "annotation", "feature_types")(lambda s, i, p: annotations.positions(_gxf(s, i["annotation"]).withColumn("id", annotations.named(F.col("attributes"), annotations.POSITION_IDS)), p.get("feature_types")))
capability("annotation.gxf.to-bed.v1", "annotation", write=records.write_bed)(lambda s, i, p: annotations.to_bed(_gxf(s, i["annotation"]).withColumn("id", annotations.named(F.col("attributes"), annotations.BED_IDS))))
capability("genome.gene-density.v1", "annotation", "feature_types window_size step_size")(lambda s, i, p: annotations.density(_gxf(s, i["annotation"]), p.get("window_size", 1_000_000), p.get("step_size", p.get("window_size", 1_000_000)), p.get("feature_types")))
capability("annotation.sequence.extract.v1", "annotation fasta", "feature_type promoter_length")(
    lambda s, i, p: annotations.extracted(_gxf(s, i["annotation"]).where(F.col("type") == p.get("feature_type", "gene")), _fa(s, i["fasta"]).select(F.col("id").alias("seqid"), "seq"), p.get("promoter_length"))
)
capability("annotation.go.normalize.v1", "annotations", "gene_column go_column")(lambda s, i, p: annotations.go_terms(readers.table(s, i["annotations"]).select(F.col(p.get("gene_column", "query")).alias("gene"), F.col(p.get("go_column", "GOs")).alias("terms"))))

# ---- tables, sets, expression
_TABLE = "delimiter select_columns drop_columns filter_column filter_op filter_value skip_rows limit"


@capability("table.manipulate.v1", "table", _TABLE)
def _manipulate(s, i, p):
    df = readers.table(s, i["table"], p.get("delimiter")).withColumn("__ord", F.monotonically_increasing_id())
    args = _picked(p, filter_column="filter_column", filter_op="filter_op", filter_value="filter_value", skip_rows="skip_rows", limit="limit")
    select = p.get("select_columns")
    return tables.manipulate(df, "__ord", select=select, drop=None if select else [*p.get("drop_columns", []), "__ord"], **args)


_mx = readers.matrix
capability("table.export.v1", "table")(lambda s, i, p: tables.export_columns(readers.table(s, i["table"])))
capability("medical.cohort-table.qc.v1", "cohort")(lambda s, i, p: tables.cohort_qc(readers.table(s, i["cohort"])))
for _name in ("expression.matrix.qc.v1", "medical.single-cell-qc.v1"):
    capability(_name, "matrix")(lambda s, i, p: expression.qc_samples(_mx(s, i["matrix"])))
capability("expression.pca.v1", "matrix", "components")(lambda s, i, p: expression.pca(s, _mx(s, i["matrix"]), p.get("components", 2)))
capability("expression.cluster.v1", "matrix", "feature_clusters")(lambda s, i, p: expression.kmeans(s, _mx(s, i["matrix"]), p.get("feature_clusters", 4)))
capability("expression.heatmap.v1", "matrix", "top_variable_features")(lambda s, i, p: expression.correlation_distances((m := _mx(s, i["matrix"])).join(expression.top_variable(m, p.get("top_variable_features", 50)), "feature", "left_semi")))


@capability("expression.normalize.v1", "matrix", "method pseudocount")
def _normalize(s, i, p):
    m, method = _mx(s, i["matrix"]), p.get("method", "cpm")
    if method == "median-ratio":
        return expression.median_ratio(m)
    if method in ("row-center", "z-score"):
        return expression.row_scaled(m, z=method == "z-score")
    return expression.cpm(m, log=method == "log2-cpm", pseudocount=p.get("pseudocount", 1.0))


@capability("expression.volcano.v1", "differential", "padj log2_fold_change max_points")
def _volcano(s, i, p):
    df = readers.table(s, i["differential"]).withColumn("__o", F.monotonically_increasing_id())
    df = df.select("__o", F.col("gene").alias("feature"), F.col("log2FoldChange").try_cast("double").alias("lfc"), F.col("padj").try_cast("double").alias("padj"))
    return expression.volcano(df, "__o", p.get("padj", 0.05), p.get("log2_fold_change", 1.0), p.get("max_points", 100))


def _sets(s, i, p, top: bool):
    long = readers.sets(s, i["table"])
    names = readers.table(s, i["table"]).columns
    return tables.upset_top(long, names, p.get("max_intersections", 40)) if top else tables.exclusive_intersections(long, names)


capability("set.venn.v1", "table", "max_intersections")(lambda s, i, p: _sets(s, i, p, False))
capability("set.upset.v1", "table", "max_intersections")(lambda s, i, p: _sets(s, i, p, True))


def _ora(kind: str | None):
    def run(s, i, p):
        a = readers.associations(s, i["associations"])
        a = a.where(F.lower("namespace") == kind) if kind else a
        out = enrichment.overrepresentation(readers.gene_list(s, i["genes"]), a, p.get("min_overlap", 1))
        return out.orderBy("padj", "p", F.desc("overlap"), "term_id").limit(p.get("max_terms", 100))

    return run


for _name, _kind in {"enrichment.overrepresentation.v1": None, "enrichment.go.v1": "go", "enrichment.kegg.v1": "kegg", "medical.pathway-ruo.v1": None}.items():
    capability(_name, "genes associations", "min_overlap max_terms")(_ora(_kind))
capability("enrichment.gsea.v1", "ranked gene-sets", "score_exponent min_set_size max_set_size permutations seed")(
    lambda s, i, p: enrichment.permuted_pvalues(readers.ranked(s, i["ranked"]), readers.associations(s, i["gene-sets"]), p.get("permutations", 1000), p.get("seed", 0), p.get("score_exponent", 1.0), **_picked(p, min_size="min_set_size", max_size="max_set_size"))
)

# ---- similarity, proteins, structures, trees, ecology, survival
capability("similarity.blast.parse.v1", "blast")(lambda s, i, p: similarity.summary(readers.blast_xml(s, i["blast"]) if i["blast"].endswith(".xml") else readers.blast_tabular(s, i["blast"])))
capability("similarity.reciprocal.v1", "forward reverse", "max_evalue min_identity_percent")(lambda s, i, p: similarity.reciprocal(readers.blast_tabular(s, i["forward"]), readers.blast_tabular(s, i["reverse"]), p.get("max_evalue", 1e-5), p.get("min_identity_percent", 0.0)))
capability("protein.properties.v1", "fasta")(lambda s, i, p: proteins.properties(_fa(s, i["fasta"])))
capability("protein.domain.parse.v1", "domains")(lambda s, i, p: similarity.domain_counts(readers.domains(s, i["domains"])))


def _atoms(s, path, name: str | None = "CA"):
    rows = files.mmcif(s, path) if path.lower().endswith((".cif", ".mmcif")) else records.pdb(s, path)
    rows = rows.where(F.col("name") == name) if name else rows
    return rows.select("chain", F.col("resseq").alias("residue"), "x", "y", "z", "model").where(F.col("model") == rows.agg(F.min("model")).first()[0])


capability("structure.pdb.summary.v1", "pdb")(lambda s, i, p: structures.summary(records.pdb(s, i["pdb"], drop_altloc=False)))
capability("structure.mmcif.summary.v1", "structure")(lambda s, i, p: structures.summary(files.mmcif(s, i["structure"])))
capability("structure.sequence.extract.v1", "structure")(lambda s, i, p: structures.sequences(records.pdb(s, i["structure"]).where("record = 'ATOM'")))
capability("structure.contact-map.v1", "structure", "cutoff_angstrom atom_name include_inter_chain")(lambda s, i, p: structures.contact_map(_atoms(s, i["structure"], p.get("atom_name", "CA")), p.get("cutoff_angstrom", 8.0), p.get("include_inter_chain", True)))
capability("structure.superpose.v1", "reference mobile", "atom_name")(lambda s, i, p: structures.superposed(s, _atoms(s, i["reference"], p.get("atom_name", "CA")), _atoms(s, i["mobile"], p.get("atom_name", "CA"))))
capability("phylogeny.distance.v1", "alignment", "model")(lambda s, i, p: phylogeny.distances(_fa(s, i["alignment"]).select("id", "seq"), p.get("model", "p-distance")))
capability("medical.spatial-transcriptomics.v1", "matrix features barcodes")(
    lambda s, i, p: ecology.barcode_ranks(records.matrix_market(s, i["matrix"]).join(records.numbered_lines(s, i["barcodes"]).select((F.col("line") + 1).alias("col"), F.split("value", "\t")[0].alias("barcode")), "col").select("barcode", F.col("row").alias("gene"), F.col("value").alias("n")))
)
capability("medical.metabolomics.v1", "mzml")(lambda s, i, p: ecology.local_maxima(files.mzml(s, i["mzml"]).withColumn("value", F.col("intensity")), "index", ["i"]))
capability("medical.microbiome.v1", "report")(lambda s, i, p: ecology.alpha_diversity(records.kraken_report(s, i["report"]).where("rank = 'S' AND taxon_count > 0").select(F.lit("report").alias("sample"), F.col("name").alias("taxon"), F.col("taxon_count").alias("n"))))


@capability("phylogeny.tree.transform.v1", "tree", "reroot_label label_map", records.write_lines)
def _tree(s, i, p):
    edges = files.newick_edges("".join(r.value for r in s.read.text(i["tree"]).collect()))  # one tree
    edges = files.rerooted(edges, p["reroot_label"]) if "reroot_label" in p else edges
    edges = [(*e[:2], p.get("label_map", {}).get(e[2], e[2]), e[3]) for e in edges]
    return s.createDataFrame([(files.newick_text(edges),)], "tree string")


@capability("medical.survival.v1", "cohort", "time_column event_column group_column analysis covariates")
def _survival(s, i, p):
    """analysis: medians (the default), curve, log-rank, or cox with numeric covariates."""
    df = readers.table(s, i["cohort"])
    group = F.col(p["group_column"]) if "group_column" in p else F.lit("all")
    numbers = [F.col(c).cast("double").alias(c) for c in p.get("covariates", [])]
    rows = df.select(group.alias("group"), F.col(p.get("time_column", "time")).cast("double").alias("time"), (F.col(p.get("event_column", "event")).cast("int") == 1).alias("event"), *numbers)
    kind = p.get("analysis", "medians")
    if kind == "cox":
        return survival.cox(rows, list(p.get("covariates", [])))
    return {"medians": survival.medians, "curve": survival.curve, "log-rank": survival.log_rank}[kind](rows)


@capability("expression.differential.v1", "matrix design", "reference sample_column condition_column")
def _differential(s, i, p):
    design = readers.table(s, i["design"]).select(F.col(p.get("sample_column", "sample_id")).alias("sample"), F.col(p.get("condition_column", "condition")).alias("condition"))
    return differential.wald(readers.matrix(s, i["matrix"]), design, p["reference"])


@capability("annotation.eggnog.normalize.v1", "annotations")
def _eggnog(s, i, p):
    """An annotation table whose column line starts with one '#'."""
    head = next(x for x in readers.first_lines(s, i["annotations"], 50) if x.startswith("#") and not x.startswith("##"))
    names = [readers.normalized(n) for n in head.lstrip("#").split("\t")]
    f = F.split("value", "\t")
    rows = s.read.text(i["annotations"]).where("value <> '' AND NOT value LIKE '#%'")
    at = lambda *of: next((F.get(f, F.lit(names.index(n))) for n in of if n in names), F.lit("-"))
    return annotations.eggnog(rows.select(at("query", "query_name").alias("gene"), at("gos").alias("gos"), at("kegg_ko").alias("ko"), at("kegg_pathway").alias("pathways"), at("cog_category").alias("cog")))


@capability("structure.geometry.v1", "structure", "points")
def _geometry(s, i, p):
    """points: two to four of {chain, residue, atom}; their distance, angle or torsion."""
    rows = files.mmcif(s, i["structure"]) if i["structure"].lower().endswith((".cif", ".mmcif")) else records.pdb(s, i["structure"])
    found = []
    for q in p["points"]:
        own = rows.where((F.col("chain") == q["chain"]) & (F.col("resseq") == str(q["residue"])) & (F.col("name") == q["atom"])).select("x", "y", "z").limit(1).collect()
        if not own:
            raise ValueError(f"no atom {q}")
        found.append(tuple(own[0]))
    kind = {2: "distance", 3: "angle", 4: "torsion"}.get(len(found), "")
    return s.createDataFrame([(kind, structures.geometry(found))], "kind string, value double")


@capability("alignment.coverage.v1", "sam")
def _coverage(s, i, p):
    """Depth of mapped records; bases of the reference that M, D, N, = and X of the CIGAR cover."""
    rows = records.sam(s, i["sam"]).where(F.col("flag").bitwiseAND(F.lit(reads.UNMAPPED)) == 0)
    long = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return reads.coverage(rows.select(F.col("rname").alias("contig"), (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + long).alias("end")).where("end > start"))


@capability("dataset.inspect.v1", "dataset")
def _inspect(s, i, p):
    """The format of a file by its first bytes or its name."""
    row = s.read.format("binaryFile").load(i["dataset"]).select("path", F.substring("content", 1, 65536).alias("head")).limit(1).collect()
    return s.createDataFrame([(files.sniffed(bytes(row[0].head), row[0].path),)], "format string")


def digest(path: str) -> str | None:
    """The file's SHA-256, if it is a file here."""
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def execute(spark: SparkSession, request: dict) -> Result:
    """Runs {job_id, capability, inputs: {role: path}, parameters}; what goes wrong is the result's message."""
    name, job = request.get("capability", ""), request.get("job_id", "")
    try:
        own = CAPABILITIES.get(name)
        if own is None:
            raise ValueError(f"unknown capability {name}")
        inputs, parameters = dict(request.get("inputs", {})), dict(request.get("parameters", {}))
        output = parameters.pop("output", None)
        if set(inputs) != set(own.roles):
            raise ValueError(f"inputs must be {', '.join(own.roles)}")
        if unknown := set(parameters) - set(own.parameters):
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        before = {r: digest(x) for r, x in inputs.items() if isinstance(x, str)}
        data = own.run(spark, inputs, parameters)
        if output:
            own.write(data, output)
            if before != {r: digest(x) for r, x in inputs.items() if isinstance(x, str)}:
                raise ValueError("an input changed while the job ran")
        return Result(job, name, "succeeded", data, output, inputs=before)
    except Exception as e:
        return Result(job, name, "failed", message=str(e)[:2000], error=e)
