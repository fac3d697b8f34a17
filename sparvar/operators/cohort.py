"""Genotypes as a sparse carriers table: frequencies, ids, dedup, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variant import gt_dosage, quantize_dosage


def allele_frequencies(carriers: DataFrame, n_samples: int) -> DataFrame:
    """Alt allele count, frequency and folded MAF over all samples."""
    af = F.col("ac") / (2.0 * n_samples)
    return (
        carriers.groupBy("variant_id").agg(F.sum("dosage").cast("long").alias("ac"))
        .select("variant_id", "ac", af.alias("af"), F.least(af, 1.0 - af).alias("maf"))
    )


def genotype_calls(vcf_rows: DataFrame) -> DataFrame:
    """One row per (variant, alt, sample) from parsed VCF rows with an array of GT fields.

    Expects ``alt_index`` and ``calls`` (per-sample fields in header order).
    """
    return vcf_rows.select(
        *[c for c in vcf_rows.columns if c != "calls"],
        F.posexplode("calls").alias("sample_idx", "gt"),
    ).select(
        *[c for c in vcf_rows.columns if c != "calls"],
        F.col("sample_idx").cast("long").alias("sample_idx"),
        gt_dosage("gt", "alt_index").alias("dosage"),
    )


def call_frequencies(calls: DataFrame, keys: list[str]) -> DataFrame:
    """AC, AN, AF and folded MAF from called genotypes; 0 where nothing is called."""
    ac = F.coalesce(F.sum("dosage"), F.lit(0.0))
    an = F.count("dosage") * 2
    af = F.when(F.col("an") > 0, F.col("ac") / F.col("an")).otherwise(0.0)
    return (
        calls.groupBy(*keys).agg(ac.alias("ac"), an.alias("an"))
        .withColumn("af", af)
        .withColumn("maf", F.least(F.col("af"), 1.0 - F.col("af")))
    )


def carriers_from_calls(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.select(*keys, "sample_idx", quantize_dosage("dosage").alias("dosage")).filter("dosage is not null")


def carriers_from_packed(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Carriers from rows holding one ``dosages`` array per variant."""
    flat = packed.select(*keys, F.posexplode("dosages").alias("sample_idx", "dosage"))
    return carriers_from_calls(flat.withColumn("sample_idx", F.col("sample_idx").cast("long")), keys)


def ordered_rank(
    df: DataFrame, part: list[str], bucket: Column, order: list, name: str, start: int = 0
) -> DataFrame:
    """Dense ``row_number`` within ``part`` without sorting a partition in one task.

    ``bucket`` must be non-decreasing in ``order``.  Rows are numbered inside
    (part, bucket); bucket totals, a table with one row per bucket, carry the
    offsets.  A part holding most of the data is therefore spread over buckets.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*part, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*part, "_bucket").orderBy(*order)
    keys = [*part, "_bucket"]
    numbered = tagged.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, keys)
        .withColumn(name, (F.col("_rn") + F.col("_off") - 1 + start).cast("long"))
        .drop("_bucket", "_rn", "_off")
    )


def assign_variant_ids(variants: DataFrame, name: str = "variant_vcf") -> DataFrame:
    """0-based order by (position, ref, alt) within each chromosome."""
    bucket = F.floor(F.col("position") / 4096)
    return ordered_rank(variants, ["chromosome"], bucket, ["position", "ref", "alt"], name)


def deduplicate(variants: DataFrame, keys: list[str], tiebreak: list[str]) -> DataFrame:
    """Keep the highest-MAF row per key; ties fall to the smallest tiebreak values.

    An aggregation, not a window: repeats of a hot key collapse map-side.
    """
    rest = [c for c in variants.columns if c not in keys]
    rank = F.struct((-F.col("maf")).alias("m"), *[F.col(t) for t in tiebreak])
    best = F.min_by(F.struct(*rest), rank)
    return variants.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def invariant_violations(
    variants: DataFrame, carriers: DataFrame, membership: DataFrame, n_samples: int
) -> DataFrame:
    """Violation count per rule of the variant store."""
    n_dup = (
        carriers.groupBy("variant_id", "sample_idx").count().filter("count > 1")
        .agg(F.count("*").alias("n")).select(F.lit("duplicate_carrier").alias("rule"), "n")
    )
    single = carriers.agg(
        F.count_if(~F.col("dosage").isin(1, 2)).alias("dosage_code"),
        F.count_if((F.col("sample_idx") < 0) | (F.col("sample_idx") >= n_samples)).alias("sample_range"),
    )
    flat = single.select(F.explode(F.array(
        F.struct(F.lit("dosage_code").alias("rule"), F.col("dosage_code").alias("n")),
        F.struct(F.lit("sample_range").alias("rule"), F.col("sample_range").alias("n")),
    )).alias("s")).select("s.*")

    def orphan(rows: DataFrame, rule: str) -> DataFrame:
        return (
            rows.join(variants.select("variant_id"), "variant_id", "left_anti")
            .agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        )

    silent = (
        variants.filter("maf > 0").join(carriers.select("variant_id"), "variant_id", "left_anti")
        .agg(F.count("*").alias("n")).select(F.lit("polymorphic_without_carriers").alias("rule"), "n")
    )
    dup_key = (
        variants.groupBy("chromosome", "position", "ref", "alt").count().filter("count > 1")
        .agg(F.count("*").alias("n")).select(F.lit("duplicate_variant").alias("rule"), "n")
    )
    parts = [n_dup, flat, orphan(membership, "membership_orphan"),
             orphan(carriers.select("variant_id").distinct(), "carrier_orphan"), silent, dup_key]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
