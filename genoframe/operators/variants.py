"""Operators on variant records (chrom, pos, ref, alt as text with commas, qual, filter, info, gt)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alleles with known effects on drugs, GRCh38, fixed values: chrom, position, reference, alternate, rsid, gene, allele, consequence, phenotype, drugs.
PGX_ALLELES = (
    ("chr10", 96541605, "G", "A", "rs4244285", "CYP2C19", "CYP2C19*2", "loss-of-function splice variant", "reduced CYP2C19 activity (poor metabolizer when homozygous)", "clopidogrel,omeprazole"),
    ("chr10", 96540410, "G", "A", "rs4986893", "CYP2C19", "CYP2C19*3", "loss-of-function stop-gain variant", "reduced CYP2C19 activity (poor metabolizer when homozygous)", "clopidogrel,omeprazole"),
    ("chr10", 96521657, "C", "T", "rs12248560", "CYP2C19", "CYP2C19*17", "increased-expression promoter variant", "increased CYP2C19 activity (rapid/ultrarapid metabolizer)", "clopidogrel"),
    ("chr22", 42130641, "G", "A", "rs3892097", "CYP2D6", "CYP2D6*4", "loss-of-function splice variant", "reduced CYP2D6 activity (poor metabolizer when homozygous)", "codeine,tramadol,tamoxifen"),
    ("chr22", 42127943, "C", "T", "rs1065852", "CYP2D6", "CYP2D6*10", "decreased-function missense variant", "reduced CYP2D6 activity (intermediate metabolizer)", "codeine,tamoxifen"),
    ("chr12", 21176826, "T", "C", "rs4149056", "SLCO1B1", "SLCO1B1*5", "decreased-function missense variant", "reduced OATP1B1 transport; increased simvastatin myopathy risk", "simvastatin"),
    ("chr16", 31096446, "G", "A", "rs9923231", "VKORC1", "VKORC1 -1639G>A", "decreased-expression promoter variant", "increased warfarin sensitivity", "warfarin"),
    ("chr6", 18143954, "G", "C", "rs1800462", "TPMT", "TPMT*2", "loss-of-function missense variant", "reduced TPMT activity; increased thiopurine toxicity risk", "azathioprine,mercaptopurine,thioguanine"),
    ("chr6", 18139228, "G", "A", "rs1800460", "TPMT", "TPMT*3B", "loss-of-function missense variant", "reduced TPMT activity; increased thiopurine toxicity risk", "azathioprine,mercaptopurine,thioguanine"),
    ("chr6", 18130718, "A", "G", "rs1142345", "TPMT", "TPMT*3C", "loss-of-function missense variant", "reduced TPMT activity; increased thiopurine toxicity risk", "azathioprine,mercaptopurine,thioguanine"),
    ("chr1", 97515789, "C", "T", "rs3918290", "DPYD", "DPYD*2A", "loss-of-function splice variant", "reduced DPD activity; increased fluoropyrimidine toxicity risk", "fluorouracil,capecitabine"),
    ("chr6", 31353884, "G", "A", "rs2395029", "HLA-B", "HLA-B*57:01 tag", "tag variant in strong linkage with HLA-B*57:01", "increased abacavir hypersensitivity risk", "abacavir"),
)
PGX_COLUMNS = "chrom string, pos long, ref string, alt string, rsid string, gene string, allele string, consequence string, phenotype string, drugs string"


def allele_class(ref: Column, alt: Column) -> Column:
    """SYMBOLIC (*, <...>, breakends), SNP, MNV or INDEL."""
    symbolic = (alt == "*") | (alt.startswith("<") & alt.endswith(">")) | alt.contains("[") | alt.contains("]")
    return F.when(symbolic, "SYMBOLIC").when((F.length(ref) == 1) & (F.length(alt) == 1), "SNP").when(F.length(ref) == F.length(alt), "MNV").otherwise("INDEL")


def stats(variants: DataFrame) -> DataFrame:
    """Counters of records, alleles, filters, transitions and genotypes; ratios are null without their denominators."""
    alts = F.filter(F.split("alt", ","), lambda a: a != ".")
    kinds = F.transform(alts, lambda a: allele_class(F.col("ref"), a))
    gt = F.split("gt", r"[/|]")
    missing = F.exists(gt, lambda a: a == ".")
    copies = F.size(F.filter(gt, lambda a: ~a.isin("0", ".")))
    rows = variants.select(kinds.alias("kinds"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), "filter", F.col("gt").isNotNull().alias("has"), missing.alias("missing"), F.when(~missing, copies).otherwise(0).alias("copies"))
    of = lambda k: F.coalesce(F.sum(F.size(F.filter("kinds", lambda x: x == k))), F.lit(0)).alias(k.lower())
    pure = (F.size("kinds") == 1) & (F.element_at("kinds", 1) == "SNP") & F.col("ref").isin(*"ACGT") & F.col("alt").isin(*"ACGT")
    pair = F.concat("ref", "alt")
    ti = F.when(F.size("kinds") == 1, pure & pair.isin("AG", "GA", "CT", "TC")).otherwise(False)
    tv = F.when(F.size("kinds") == 1, pure & ~pair.isin("AG", "GA", "CT", "TC")).otherwise(False)
    out = rows.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("filter") == "PASS").alias("pass"), F.count_if(~F.col("filter").isin("PASS", ".")).alias("filtered"), of("SNP"), of("INDEL"), of("MNV"), of("SYMBOLIC"),
        F.count_if(F.size("kinds") > 1).alias("multiallelic"), F.count_if(ti).alias("transitions"), F.count_if(tv).alias("transversions"), F.count_if(F.col("has") & F.col("missing")).alias("missing_gt"),
        F.count_if(F.col("has") & ~F.col("missing")).alias("called_gt"), F.count_if(F.col("has") & (F.col("copies") > 0)).alias("carriers"), F.coalesce(F.sum("copies"), F.lit(0)).alias("alt_copies"),
    )
    return out.withColumn("ti_tv", F.try_divide(F.col("transitions").cast("double"), F.col("transversions"))).withColumn("missing_rate", F.try_divide(F.col("missing_gt").cast("double"), F.col("missing_gt") + F.col("called_gt")))


def contig_counts(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def info_value(info: Column, key: str) -> Column:
    """A value of the INFO text; null without the key."""
    found = F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1)
    return F.when(info.rlike(f"(?:^|;){key}="), found)


def reject_reason(min_qual: float | None = None, require_pass: bool = False, contigs=None, min_dp: int | None = None) -> Column:
    """The first rule that a record fails, or null; a missing QUAL or DP fails, a DP that is no integer is an error."""
    out = F.when(F.lit(False), "")
    if min_qual is not None:
        out = out.when(F.col("qual").isNull() | (F.col("qual") < min_qual), "qual")
    if require_pass:
        out = out.when(F.col("filter") != "PASS", "filter")
    if contigs:
        out = out.when(~F.col("chrom").isin(*contigs), "contig")
    if min_dp is not None:
        dp = info_value(F.col("info"), "DP").cast("long")
        out = out.when(dp.isNull() | (dp < min_dp), "depth")
    return out


def alleles(variants: DataFrame) -> DataFrame:
    """Distinct (chrom, pos, ref, alt) in shortest form: shared ends cut, the suffix first, one base kept; symbolic alleles as they are.

    The shared lengths come from aggregates over the characters, without a UDF.
    """
    rows = variants.select("chrom", "pos", F.col("ref").alias("r0"), F.explode(F.split("alt", ",")).alias("a0")).where("a0 <> '.'")
    symbolic = (F.col("a0") == "*") | F.col("a0").contains("<") | F.col("a0").contains(">") | F.col("a0").contains("[") | F.col("a0").contains("]")
    rows = rows.withColumn("s", symbolic).withColumn("r", F.upper("r0")).withColumn("a", F.upper("a0"))

    def shared(x: Column, y: Column) -> Column:
        """Characters that x and y begin with alike, one less than the shorter at most."""
        both = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p == q, F.lit(False)))
        run = F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
        return F.least(run, F.length(x) - 1, F.length(y) - 1)

    rows = rows.withColumn("n", shared(F.reverse("r"), F.reverse("a"))).withColumn("r", F.expr("left(r, length(r) - n)")).withColumn("a", F.expr("left(a, length(a) - n)"))
    rows = rows.withColumn("n", shared(F.col("r"), F.col("a"))).withColumn("r", F.expr("substring(r, n + 1)")).withColumn("a", F.expr("substring(a, n + 1)"))
    pos = F.when(F.col("s"), F.col("pos")).otherwise(F.col("pos") + F.col("n"))
    return rows.select("chrom", pos.alias("pos"), F.when(F.col("s"), F.col("r0")).otherwise(F.col("r")).alias("ref"), F.when(F.col("s"), F.col("a0")).otherwise(F.col("a")).alias("alt")).distinct()


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, status): shared, left-only, right-only."""
    a, b = alleles(left).withColumn("l", F.lit(True)), alleles(right).withColumn("r", F.lit(True))
    rows = a.join(b, ["chrom", "pos", "ref", "alt"], "full_outer")
    return rows.select("chrom", "pos", "ref", "alt", F.when(F.col("l").isNull(), "right-only").when(F.col("r").isNull(), "left-only").otherwise("shared").alias("status"))


#: Bases of reference beside a variant: its own block of this size and the one before.
BLOCK = 4096


def _left_aligned(batches):
    """Over (chrom, pos, ref, alt, first, last, window): window holds the reference from base `first` on, to its end if last.

    done is false where the alignment reached the window's first base, but not the contig's.
    """
    for pdf in batches:
        out = []
        for chrom, pos, ref, alt, first, last, window in zip(*(pdf[c] for c in ("chrom", "pos", "ref", "alt", "first", "last", "window"))):
            r, a, p = ref.upper(), alt.upper(), int(pos)
            at = p - int(first)
            own = window[at : at + len(r)].upper()
            if own != r[: len(own)] or (len(own) < len(r) and last):
                raise ValueError(f"REF differs from the reference at {chrom}:{p}")
            while len(r) > 1 and len(a) > 1 and r[-1] == a[-1]:
                r, a = r[:-1], a[:-1]
            while len(r) > 1 and len(a) > 1 and r[0] == a[0]:
                r, a, p = r[1:], a[1:], p + 1
            done = True
            while len(r) != len(a) and p > 1 and r[0] == a[0] and min(len(r), len(a)) == 1 and max(r, a, key=len)[-1] == r[0]:
                if p - 1 < int(first):
                    done = False
                    break
                before = window[p - 1 - int(first)].upper()
                longer = before + max(r, a, key=len)[:-1]
                r, a, p = (longer, before, p - 1) if len(r) > len(a) else (before, longer, p - 1)
            out.append((chrom, p, r, a, done))
        yield pd.DataFrame(out, columns=["chrom", "pos", "ref", "alt", "done"])


def normalized(variants: DataFrame, references: DataFrame, block: int = BLOCK) -> DataFrame:
    """Left-aligned, trimmed records with one ALT; references has (chrom, seq), REF must equal it.

    References are cut into blocks, and a variant meets its own block with the one before and
    the one after, not its contig. The few that could move beyond that, in a repeat of more
    than a block, go on against the whole contig.
    """
    kind = "chrom string, pos long, ref string, alt string, done boolean"
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / block).cast("int")), lambda i: F.struct(i.cast("long").alias("block"), F.substring(F.col("seq"), F.greatest((i - 1) * block, F.lit(0)) + 1, F.when(i == 0, 2 * block).otherwise(3 * block)).alias("window")))
    blocks = references.where(F.length("seq") > 0).select("chrom", F.length("seq").alias("size"), F.explode(pieces).alias("b")).select("chrom", "size", "b.block", "b.window")
    first = F.greatest((F.col("block") - 1) * block, F.lit(0)) + 1
    rows = variants.where(~F.col("alt").contains(",")).select("chrom", F.col("pos").cast("long").alias("pos"), "ref", "alt", F.floor((F.col("pos") - 1) / block).alias("block"))
    rows = rows.join(blocks, ["chrom", "block"]).withColumn("first", first).withColumn("last", F.col("first") + F.length("window") > F.col("size"))
    once = rows.select("chrom", "pos", "ref", "alt", "first", "last", "window").mapInPandas(_left_aligned, kind)
    far = once.where("NOT done").join(references, "chrom").select("chrom", "pos", "ref", "alt", F.lit(1).cast("long").alias("first"), F.lit(True).alias("last"), F.col("seq").alias("window"))
    return once.where("done").union(far.mapInPandas(_left_aligned, kind)).drop("done")


def pgx_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(PGX_ALLELES), PGX_COLUMNS)


def pgx_matches(variants: DataFrame, rules: DataFrame) -> DataFrame:
    """Records that match a rule, with the first sample's genotype for that allele; reference genotypes go."""
    alts = F.posexplode(F.split("alt", ",")).alias("i", "alt")
    rows = variants.select("chrom", "pos", "ref", "gt", alts).join(F.broadcast(rules), ["chrom", "pos", "ref", "alt"])  # a dozen rules
    n = F.size(F.filter(F.split("gt", r"[/|]"), lambda a: a == (F.col("i") + 1).cast("string")))
    genotype = F.when(F.col("gt").isNull(), None).when(n == 2, "hom-alt").when(n == 1, "het-alt").otherwise("ref")
    return rows.withColumn("genotype", genotype).where("genotype IS NULL OR genotype <> 'ref'").drop("i", "gt")


def to_table(variants: DataFrame) -> DataFrame:
    """CHROM, POS, REF, ALT, QUAL, FILTER, INFO and the sample column as text; '.' for what is missing."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return variants.select(*[dot(c).alias(n) for c, n in (("chrom", "CHROM"), ("pos", "POS"), ("ref", "REF"), ("alt", "ALT"), ("filter", "FILTER"), ("info", "INFO"), ("gt", "sample"))])
