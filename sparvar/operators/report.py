"""Data frames behind result plots and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prob import neg_log10
from ..functions.variant import karyotype_rank
from .cohort import ordered_rank

# Plotting length of each chromosome in base pairs.
CHROMOSOME_LENGTHS = {
    "1": 249_000_000, "2": 243_000_000, "3": 198_000_000, "4": 190_000_000,
    "5": 182_000_000, "6": 171_000_000, "7": 159_000_000, "8": 145_000_000,
    "9": 138_000_000, "10": 134_000_000, "11": 135_000_000, "12": 133_000_000,
    "13": 114_000_000, "14": 107_000_000, "15": 102_000_000, "16": 90_000_000,
    "17": 84_000_000, "18": 80_000_000, "19": 59_000_000, "20": 65_000_000,
    "21": 47_000_000, "22": 51_000_000, "X": 156_000_000, "Y": 57_000_000,
}
SIGNIFICANCE = 2.5e-6


def chromosome_offsets(spark: SparkSession) -> DataFrame:
    """Genome-wide start of every chromosome (24 rows)."""
    t = spark.createDataFrame(list(CHROMOSOME_LENGTHS.items()), "chromosome string, length long")
    before = Window.orderBy(karyotype_rank("chromosome")).rowsBetween(Window.unboundedPreceding, -1)
    return t.select("chromosome", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def manhattan(sets: DataFrame, p: str = "STAAR-O") -> DataFrame:
    """Genome-wide midpoint and -log10 p of every set with a usable p-value."""
    raw = F.col(f"`{p}`")
    pv = F.when(raw <= 0, 1e-300).otherwise(raw)
    usable = raw.isNotNull() & ~F.isnan(raw) & (raw <= 1)
    return (
        sets.filter(usable).join(F.broadcast(chromosome_offsets(sets.sparkSession)), "chromosome")
        .withColumns({
            "genome_x": F.col("offset") + (F.col("start") + F.col("end")) / 2.0,
            "p": pv, "neg_log_p": neg_log10(pv),
        }).drop("offset")
    )


def qq_points(sets: DataFrame, p: str = "STAAR-O", keep: int = 3000, tail: int = 100) -> DataFrame:
    """Observed against expected -log10 p per mask, thinned except for the last ``tail``.

    Ranks come from fixed-width p-value buckets, so a mask with most of the
    rows is ranked by many tasks; equal p-values may take any order.
    """
    pv = F.col(f"`{p}`")
    valid = sets.filter(pv.isNotNull() & ~F.isnan(pv) & (pv > 0) & (pv <= 1)).select(
        "mask", pv.alias("p"), F.pmod(F.xxhash64("set_id"), F.lit(1024)).alias("tie"), "set_id"
    )
    # 4096 equal slices of (0, 1]; ties at one value split further by hash.
    bucket = F.least(F.floor(F.col("p") * 4096), F.lit(4095)) * 1024 + F.when(F.col("p") >= 1, F.col("tie")).otherwise(0)
    ranked = ordered_rank(valid, ["mask"], bucket, ["p", "tie", "set_id"], "i")
    sizes = valid.groupBy("mask").agg(F.count("*").alias("n"))
    pts = ranked.join(F.broadcast(sizes), "mask").withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / keep)))
    return pts.filter((F.col("i") % F.col("step") == 0) | (F.col("i") >= F.col("n") - tail)).select(
        "mask", "i", (-F.log10((F.col("i") + 0.5) / F.col("n"))).alias("expected"), (-F.log10("p")).alias("observed")
    )


TIE_DIGITS = 12


def best_per_gene(sets: DataFrame, p: str = "STAAR-O") -> DataFrame:
    """The lowest-p mask of every gene and chromosome.

    Masks can hold the same variants, whose p-values then differ in their last bits by
    the order of summation; ``TIE_DIGITS`` decimals and then the name decide.
    """
    pv = F.col(f"`{p}`")
    ok = sets.filter(pv.isNotNull() & ~F.isnan(pv))
    best = F.min_by(F.struct("mask", pv.alias("p"), "n_variants", "cmac"), F.struct(F.round(pv, TIE_DIGITS), "mask"))
    return ok.groupBy("gene_name", "chromosome").agg(best.alias("b")).select("gene_name", "chromosome", "b.*")


def volcano(sets: DataFrame, p: str = "STAAR-O") -> DataFrame:
    """Best -log10 p per gene against its cumulative allele count."""
    return best_per_gene(sets, p).select(
        "gene_name", "chromosome", "mask", F.greatest("cmac", F.lit(1)).alias("cmac"), "n_variants", "p",
        neg_log10(F.col("p")).alias("neg_log_p"), (F.col("p") < SIGNIFICANCE).alias("significant"),
    )


def sorted_sets(sets: DataFrame, p: str = "STAAR-O") -> DataFrame:
    """Ascending p-value, NaN and null last."""
    return sets.orderBy(F.col(f"`{p}`").asc_nulls_last())
