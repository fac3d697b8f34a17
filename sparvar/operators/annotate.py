"""Joins to annotation and tissue tables, and their diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variant import phred_weight
from ..schemas import CHANNELS

# Where each channel lives in the nested annotation table.
CHANNEL_PATHS = {
    "cadd_phred": "main.cadd.phred",
    "linsight": "linsight",
    "fathmm_xf": "fathmm_xf",
    "apc_epigenetics_active": "apc.epigenetics_active",
    "apc_epigenetics_repressed": "apc.epigenetics_repressed",
    "apc_epigenetics_transcription": "apc.epigenetics_transcription",
    "apc_conservation": "apc.conservation_v2",
    "apc_protein_function": "apc.protein_function_v3",
    "apc_local_nucleotide_diversity": "apc.local_nucleotide_diversity_v3",
    "apc_mutation_density": "apc.mutation_density",
    "apc_transcription_factor": "apc.transcription_factor",
}
KEYS = ["chromosome", "position", "ref", "alt"]
# Chromosomes probed for build detection, in order.
PROBE_CHROMOSOMES = ["1", "2", "22", "10", "X"]


def channel_columns() -> list[Column]:
    return [F.col(CHANNEL_PATHS[c]).cast("double").alias(c) for c in CHANNELS]


def structural_columns() -> list[Column]:
    ccre = F.col("ccre.annotations").cast("string")
    return [
        (F.col("position") + F.length("ref_vcf") - 1).cast("int").alias("end_position"),
        F.coalesce(F.get("gencode.genes", F.lit(0)), F.lit("")).alias("gene_name"),
        F.coalesce("gencode.region_type", F.lit("")).alias("region_type"),
        F.coalesce("gencode.consequence", F.lit("")).alias("consequence"),
        F.coalesce(F.col("dbnsfp.revel"), F.lit(0.0)).cast("double").alias("revel"),
        F.coalesce("dbnsfp.metasvm_pred", F.lit("")).alias("metasvm_pred"),
        F.coalesce("genehancer.id", F.lit("")).alias("genehancer"),
        F.col("cage.cage_promoter").isNotNull().alias("is_cage_promoter"),
        F.col("cage.cage_enhancer").isNotNull().alias("is_cage_enhancer"),
        F.coalesce(ccre.like("%PLS%"), F.lit(False)).alias("is_ccre_promoter"),
        F.coalesce(ccre.like("%ELS%"), F.lit(False)).alias("is_ccre_enhancer"),
    ]


def extract_annotation(ann: DataFrame, keep: list[str]) -> DataFrame:
    """Flat annotation columns; nested pruning limits the scan to the leaves used."""
    return ann.select(*keep, *structural_columns(), *channel_columns())


def with_weights(df: DataFrame) -> DataFrame:
    """w0..w10, one probability weight per channel."""
    return df.withColumns({f"w{i}": phred_weight(c) for i, c in enumerate(CHANNELS)})


def _annotation_keys(ann: DataFrame) -> DataFrame:
    return ann.withColumnsRenamed({"ref_vcf": "ref", "alt_vcf": "alt"})


def annotate_exact(variants: DataFrame, ann: DataFrame) -> DataFrame:
    """Inner join on chromosome, position and both alleles, over all chromosomes at once."""
    return variants.join(_annotation_keys(ann), KEYS, "inner")


def annotate_by_position(variants: DataFrame, ann: DataFrame) -> DataFrame:
    """Inner join on chromosome and position; one row per annotated allele."""
    return variants.join(ann, ["chromosome", "position"], "inner")


def annotate_by_rsid(variants: DataFrame, lookup: DataFrame, ann: DataFrame) -> DataFrame:
    """rsid -> position and alleles -> annotation."""
    return variants.join(lookup, "rsid", "inner").join(_annotation_keys(ann), KEYS, "inner")


def annotate_genotypes(geno: DataFrame, ann: DataFrame) -> DataFrame:
    """Polymorphic genotyped variants with flat annotation; unannotated ones drop out."""
    flat = extract_annotation(ann, ["chromosome", "position", "ref_vcf", "alt_vcf"])
    return geno.filter(F.col("maf") > 0).withColumn("maf", F.col("maf").cast("double")).join(
        _annotation_keys(flat), KEYS, "inner"
    )


def match_rate(variants: DataFrame, annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Input and matched counts by chromosome."""
    total = variants.groupBy("chromosome").agg(F.count("*").alias("n_input"))
    hit = annotated.groupBy("chromosome").agg(F.count("*").alias("n_matched"))
    return total.join(hit, "chromosome", "left").select(
        "chromosome", "n_input", F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"),
        (F.coalesce("n_matched", F.lit(0)) / F.col("n_input")).alias("rate"),
    )


def rate_verdict(rate: Column) -> Column:
    return F.when(rate == 0, "error").when(rate < 0.05, "warn").otherwise("ok")


# ------------------------------------------------------------------- tissues


def resolve_tissue(vocabulary: DataFrame, query: str) -> DataFrame:
    """Distinct normalised tissue names matching anywhere in group, name or raw label."""
    like = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.col("tissue_group").ilike(like) | F.col("tissue_norm").ilike(like) | F.col("tissue_raw").ilike(like)
    return vocabulary.filter(hit).select(F.col("tissue_norm").alias("tissue_name")).distinct()


def check_tissue(vocabulary: DataFrame, query: str) -> list[str]:
    """Resolved names, or an error listing the groups (runs a small job)."""
    names = [r[0] for r in resolve_tissue(vocabulary, query).orderBy("tissue_name").collect()]
    if not names:
        groups = [r[0] for r in vocabulary.select("tissue_group").distinct().orderBy("tissue_group").collect()]
        raise ValueError(f"unknown tissue '{query}'. Available groups: {', '.join(groups)}")
    return names


def enrich(tissue: DataFrame, variants: DataFrame, tissues: DataFrame | None = None) -> DataFrame:
    """Tissue rows of the given variants, optionally limited to resolved tissues.

    Both filters are semi-joins; the vid side carries chromosome so partitions prune.
    """
    keys = ["vid"] + (["chromosome"] if {"chromosome"} <= set(tissue.columns) & set(variants.columns) else [])
    out = tissue.join(variants.select(*keys), keys, "left_semi")
    if tissues is not None and "tissue_name" in tissue.columns:
        out = out.join(tissues, "tissue_name", "left_semi")
    return out.drop("chrom_id")


def enrich_all(tables: dict[str, DataFrame], variants: DataFrame, tissues: DataFrame) -> DataFrame:
    """Row counts per tissue table; tables without hits are absent."""
    parts = [
        enrich(t, variants, tissues).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).filter("n_rows > 0")


# --------------------------------------------------------------- diagnostics


def probe_positions(variants: DataFrame, ann: DataFrame, per_chrom: int = 100, minimum: int = 5) -> DataFrame:
    """Hit rate of pos and pos+1 on the probe chromosomes, in probe order.

    The probe is the ``per_chrom`` smallest positions: the sampling is the
    feature, the ordering makes it reproducible.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in PROBE_CHROMOSOMES]), F.col("chromosome"))
    w = Window.partitionBy("chromosome").orderBy("position", "ref", "alt")
    probe = (
        variants.filter(F.col("chromosome").isin(PROBE_CHROMOSOMES))
        .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_chrom)
        .select("chromosome", "position", "_r")
    )
    sites = ann.filter(F.col("chromosome").isin(PROBE_CHROMOSOMES)).select("chromosome", "position").distinct()
    one = sites.withColumn("_one", F.lit(1))
    zero = sites.select("chromosome", (F.col("position") - 1).alias("position"), F.lit(1).alias("_zero"))
    return (
        probe.join(one, ["chromosome", "position"], "left").join(zero, ["chromosome", "position"], "left")
        .groupBy("chromosome").agg(
            F.count("*").alias("n_probe"),
            F.count("_one").alias("hits_one_based"), F.count("_zero").alias("hits_zero_based"),
        )
        .filter(F.col("n_probe") >= minimum)
        .withColumn("probe_order", order)
    )


def detect_build(variants: DataFrame, ann: DataFrame) -> DataFrame:
    """Coordinate base and genome build judged on the first usable probe chromosome."""
    rates = probe_positions(variants, ann).orderBy("probe_order").limit(1)
    one = F.col("hits_one_based") / F.col("n_probe")
    zero = F.col("hits_zero_based") / F.col("n_probe")
    best = F.greatest(one, zero)
    return rates.select(
        "chromosome", "n_probe", one.alias("rate_one_based"), zero.alias("rate_zero_based"),
        F.when(one > 0.5, "one").when(zero > 0.5, "zero").otherwise("unknown").alias("coord_base"),
        F.when(best > 0.5, "hg38").when(best < 0.2, "hg19").otherwise("unknown").alias("build"),
    )


def position_hits(variants: DataFrame, ann: DataFrame) -> DataFrame:
    """Input rows per chromosome whose position occurs in the annotation."""
    return (
        variants.join(ann.select("chromosome", "position"), ["chromosome", "position"], "left_semi")
        .groupBy("chromosome").agg(F.count("*").alias("n_hits"))
    )


def allele_mismatches(variants: DataFrame, ann: DataFrame) -> DataFrame:
    """Same position, different alleles."""
    a = ann.select("chromosome", "position", F.col("ref_vcf").alias("ann_ref"), F.col("alt_vcf").alias("ann_alt"))
    return variants.join(a, ["chromosome", "position"]).filter(
        (F.col("ref") != F.col("ann_ref")) | (F.col("alt") != F.col("ann_alt"))
    ).select("chromosome", "position", "ref", "alt", "ann_ref", "ann_alt")


def zero_match_diagnosis(variants: DataFrame, ann: DataFrame) -> DataFrame:
    """Why nothing matched: prefix, build or allele representation, with the evidence."""
    prefixed = variants.agg(
        F.count("*").alias("n_input"), F.count_if(F.col("chromosome").startswith("chr")).alias("n_prefixed")
    )
    hits = variants.join(ann.select("chromosome", "position"), ["chromosome", "position"], "left_semi").agg(
        F.count("*").alias("n_position_hits")
    )
    bad = allele_mismatches(variants, ann).agg(F.count("*").alias("n_allele_mismatches"))
    facts = prefixed.select(
        "n_input", "n_prefixed", hits.scalar().alias("n_position_hits"), bad.scalar().alias("n_allele_mismatches")
    )
    return facts.withColumn(
        "cause",
        F.when(F.col("n_prefixed") > 0, "chr_prefix")
        .when(F.col("n_position_hits") == 0, "different_build")
        .when(F.col("n_allele_mismatches") > 0, "allele_representation").otherwise("none"),
    )


# ------------------------------------------------------------------- summary


def duplicate_keys(variants: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return variants.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n_duplicate_keys"))


def distinct_genes(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count_distinct(F.when(F.col("gene_name") != "", F.col("gene_name"))).alias("n_genes"))
