"""Functional masks and region sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import (
    DOWNSTREAM_TERMS, MISSENSE_TERMS, NCRNA_TERMS, PLOF_TERMS, PTV_TERMS, SPLICE_TERMS,
    SYNONYMOUS_TERMS, UPSTREAM_TERMS, UTR_TERMS, consequence, region_type,
)
from .cohort import ordered_rank

MIN_SET_SIZE = 2


def predicates() -> dict[str, Column]:
    """Mask name -> boolean column over annotated variants; coding masks come first."""
    region, csq = region_type("region_type"), consequence("consequence")
    splice_region = region.isin("splicing", "ncRNA_splicing", "ncRNA_exonic;splicing")
    missense = csq.isin(MISSENSE_TERMS)
    damaging = missense & (F.col("metasvm_pred") == "D")
    plof = csq.isin(PLOF_TERMS) | splice_region
    synonymous = csq.isin(SYNONYMOUS_TERMS)
    ptv = csq.isin(PTV_TERMS)
    ncrna = region.isin("ncRNA_exonic", "ncRNA_intronic", "ncRNA_splicing", "ncRNA_exonic;splicing")
    return {
        "plof": plof,
        "missense": missense,
        "disruptive_missense": damaging,
        "plof_ds": plof | damaging,
        "synonymous": synonymous,
        "ptv": ptv,
        "ptv_ds": ptv | splice_region | csq.isin(SPLICE_TERMS) | damaging,
        "coding_incl_ptv": plof | missense | synonymous | ptv,
        "upstream": region.isin("upstream", "upstream;downstream") | csq.isin(UPSTREAM_TERMS),
        "downstream": region.isin("downstream", "upstream;downstream") | csq.isin(DOWNSTREAM_TERMS),
        "utr": region.isin("UTR3", "UTR5", "UTR5;UTR3") | csq.isin(UTR_TERMS),
        "promoter_cage": F.col("is_cage_promoter"),
        "promoter_dhs": F.col("is_ccre_promoter"),
        "enhancer_cage": F.col("is_cage_enhancer"),
        "enhancer_dhs": F.col("is_ccre_enhancer"),
        "ncrna": ncrna | csq.isin(NCRNA_TERMS),
    }


CODING = ["plof", "missense", "disruptive_missense", "plof_ds", "synonymous", "ptv", "ptv_ds", "coding_incl_ptv"]
NONCODING = [
    "upstream", "downstream", "utr", "promoter_cage", "promoter_dhs",
    "enhancer_cage", "enhancer_dhs", "ncrna",
]
ALL_MASKS = CODING + NONCODING


def mask_array(names: list[str] | None = None) -> Column:
    """Names of the masks a variant satisfies."""
    preds = predicates()
    return F.array_compact(F.array(*[F.when(preds[n], F.lit(n)) for n in names or ALL_MASKS]))


def mask_members(variants: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per (variant, mask)."""
    return variants.withColumn("mask", F.explode(mask_array(names)))


def gene_mask_sets(
    variants: DataFrame, membership: DataFrame, names: list[str] | None = None, minimum: int = MIN_SET_SIZE
) -> DataFrame:
    """Gene x mask sets with extent and size; small sets drop out."""
    rows = mask_members(variants, names).join(membership.filter("gene_name != ''"), "variant_id")
    return (
        rows.groupBy("gene_name", "mask").agg(
            F.min_by("chromosome", "variant_id").alias("chromosome"),
            F.min("position").alias("start"), F.max("position").alias("end"),
            F.count("*").alias("n_variants"),
        ).filter(F.col("n_variants") >= minimum)
    )


def gene_sets(variants: DataFrame, membership: DataFrame) -> DataFrame:
    """Gene extents and sizes; members stay in the bridge table."""
    return variants.join(membership.filter("gene_name != ''"), "variant_id").groupBy("gene_name").agg(
        F.min("position").alias("start"), F.max("position").alias("end"), F.count("*").alias("n_variants")
    )


# -------------------------------------------------------------------- windows


def sliding_window_members(variants: DataFrame, size: int, step: int | None = None) -> DataFrame:
    """(window_start, variant) rows for windows ``[start, start+size)``.

    Starts run from the chromosome's first variant in steps of half a window by
    default.  Each variant is expanded only to the windows that contain it.
    """
    step = step or size // 2
    first = variants.groupBy("chromosome").agg(F.min("position").alias("_first"))
    off = F.col("position") - F.col("_first")
    hi = F.floor(off / step)
    lo = F.greatest(F.lit(0), F.ceil((off - size + 1) / step))
    return (
        variants.join(F.broadcast(first), "chromosome")  # one row per contig
        .withColumn("_k", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        .withColumn("window_start", (F.col("_first") + F.col("_k") * step).cast("int"))
        .withColumn("window_end", (F.col("window_start") + size).cast("int"))
        .drop("_first", "_k")
    )


def window_sets(members: DataFrame, minimum: int = MIN_SET_SIZE) -> DataFrame:
    return (
        members.groupBy("chromosome", "window_start", "window_end").agg(F.count("*").alias("n_variants"))
        .filter(F.col("n_variants") >= minimum)
        .withColumn("set_id", F.concat(
            "chromosome", F.lit(":"), F.col("window_start").cast("string"), F.lit("-"), F.col("window_end").cast("string")))
    )


def scan_ranks(variants: DataFrame) -> DataFrame:
    """0-based variant order per chromosome, the coordinate of count-based windows."""
    return ordered_rank(
        variants, ["chromosome"], F.floor(F.col("position") / 4096), ["position", "ref", "alt"], "rank"
    )


def scan_lengths(lmin: int = 40, lmax: int = 300, step: int = 10) -> list[int]:
    return list(range(lmin, lmax + 1, step))


def scan_windows(ranked: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows of L consecutive variants, moved one variant at a time.

    First and last member come from an equi-join of ranks (start + L - 1), so no
    window frame has to hold a whole chromosome.
    """
    ends = ranked.select("chromosome", F.col("rank").alias("_end"), F.col("position").alias("end"))
    starts = ranked.select(
        "chromosome", F.col("rank").alias("start_rank"), F.col("position").alias("start"),
        F.explode(F.array(*[F.lit(v) for v in lengths])).alias("n_variants"),
    ).withColumn("_end", F.col("start_rank") + F.col("n_variants") - 1)
    return starts.join(ends, ["chromosome", "_end"]).select(
        "chromosome", "start_rank", "n_variants", "start", "end",
        F.concat(F.lit("scang_L"), F.col("n_variants").cast("string"), F.lit("_"), "chromosome", F.lit(":"),
                 F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("set_id"),
    )


def scan_members(ranked: DataFrame, windows: DataFrame) -> DataFrame:
    """(set_id, variant_id) rows of count-based windows: each window lists its ranks."""
    wanted = windows.select(
        "set_id", "chromosome",
        F.explode(F.sequence("start_rank", F.col("start_rank") + F.col("n_variants") - 1)).alias("rank"),
    )
    return wanted.join(ranked.select("chromosome", "rank", "variant_id"), ["chromosome", "rank"])


# ------------------------------------------------------------------- segments

SEGMENT_BP = 500_000
SEGMENT_VARIANTS = 2000


def assign_segments(variants: DataFrame, width: int = SEGMENT_BP, limit: int = SEGMENT_VARIANTS) -> DataFrame:
    """Adds ``segment_id``: position bins cut into runs of ``limit`` variants, numbered per chromosome.

    A bin's run count follows from its size, so ids come from a per-bin table.
    """
    binned = variants.withColumn("_bin", F.floor(F.col("position") / width))
    within = ordered_rank(
        binned, ["chromosome", "_bin"], F.floor(F.col("position") / 4096), ["position", "ref", "alt"], "_r"
    )
    bins = binned.groupBy("chromosome", "_bin").agg(F.ceil(F.count("*") / limit).alias("_runs"))
    from pyspark.sql import Window

    before = Window.partitionBy("chromosome").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    base = bins.select("chromosome", "_bin", F.coalesce(F.sum("_runs").over(before), F.lit(0)).alias("_base"))
    return within.join(base, ["chromosome", "_bin"]).withColumn(
        "segment_id", (F.col("_base") + F.floor(F.col("_r") / limit)).cast("int")
    ).drop("_bin", "_r", "_base")
