"""Result and intermediate tables on Parquet and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNIFICANT_P = 2.5e-6


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """Hive-partitioned ZSTD Parquet.

    Rows are redistributed by the partition columns plus a slice of the row
    hash, so one dominant partition value is still written by many tasks.
    """
    slices = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by][:4]), F.lit(32))
    (
        df.withColumn("_slice", slices).repartition(*by, "_slice").drop("_slice")
        .write.mode(mode).partitionBy(*by).option("compression", "zstd").parquet(path)
    )


def write_sorted_variants(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Variants partitioned by chromosome, position-sorted inside every file."""
    block = F.floor(F.col("position") / 5_000_000)
    (
        df.repartition("chromosome", block).sortWithinPartitions("chromosome", "position")
        .write.mode(mode).partitionBy("chromosome").option("compression", "zstd").parquet(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: list[str], sort: list[str], buckets: int, mode: str = "errorifexists") -> None:
    """Catalog table bucketed and sorted on the join keys (no shuffle in later joins)."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*sort).format("parquet").saveAsTable(table)


def write_mask_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One directory per mask, ordered by the omnibus p-value (NaN last)."""
    ordered = df.repartitionByRange("mask", "STAAR-O").sortWithinPartitions("mask", F.col("STAAR-O").asc_nulls_last())
    ordered.write.mode(mode).partitionBy("mask").option("compression", "zstd").parquet(path)


def significant_sets(df: DataFrame, alpha: float = SIGNIFICANT_P) -> DataFrame:
    return df.filter((F.col("STAAR-O") < alpha) & ~F.isnan("STAAR-O"))


def nan_report(df: DataFrame) -> DataFrame:
    """NaN omnibus results per mask, for the warning printed with a run."""
    return df.groupBy("mask").agg(
        F.count("*").alias("n_sets"),
        F.count_if(F.col("STAAR-O").isNull() | F.isnan("STAAR-O")).alias("n_nan"),
    )


def write_individual_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.orderBy("chromosome", "position", "ref", "alt").write.mode(mode).option("compression", "zstd").parquet(path)


def fixed6(c: Column | str) -> Column:
    return F.format_string("%.6f", F.col(c) if isinstance(c, str) else c)


def log10p_text(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == float("inf"), "Inf").otherwise(F.format_string("%.6f", col))


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


# ---------------------------------------------------------------- relatedness


def write_kinship(kin: DataFrame, samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``ID1 ID2 Kinship`` rows of (i, j, kinship), named by ``samples`` (sample_idx, sample_id)."""
    a = samples.select(F.col("sample_idx").alias("i"), F.col("sample_id").alias("ID1"))
    b = samples.select(F.col("sample_idx").alias("j"), F.col("sample_id").alias("ID2"))
    write_tsv(kin.join(a, "i").join(b, "j").select("ID1", "ID2", fixed6("kinship").alias("Kinship")), path, mode)


def write_component_scores(scores: DataFrame, columns: list[str], samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``sample_id PC1 PC2 ..`` rows, one a sample of ``scores`` (sample_idx and ``columns`` in their order)."""
    named = scores.join(samples.select("sample_idx", "sample_id"), "sample_idx")
    write_tsv(named.select("sample_id", *[fixed6(c).alias(f"PC{k + 1}") for k, c in enumerate(columns)]), path, mode)


def write_unrelated(chosen: DataFrame, samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sample id a line, without header, in order of the sample index."""
    ids = chosen.select("sample_idx").join(samples.select("sample_idx", "sample_id"), "sample_idx")
    ids.repartitionByRange("sample_idx").sortWithinPartitions("sample_idx").select("sample_id").write.mode(mode).text(path)
