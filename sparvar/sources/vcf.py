"""VCF text source on Spark's line reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_SITE_FIELDS = 8


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines of one or many files.  Gzip input works but is one task per file."""
    return spark.read.text(paths)


def parse_vcf(lines: DataFrame, with_calls: bool = False, keep: list[str] = ()) -> DataFrame:
    """Site columns of every record line; ``.`` becomes null where a null is allowed.

    The first id of a ``;`` list is kept and QUAL stays text.  ``with_calls``
    adds the per-sample fields as an array in header order.
    """
    # A site-only read keeps the tail unsplit: genotype columns are never materialised.
    fields = F.split("value", "\t", -1 if with_calls else N_SITE_FIELDS + 1)

    def field(i: int) -> Column:
        return F.get(fields, F.lit(i))

    def optional(c: Column) -> Column:
        return F.when(c != ".", c)

    first_id = F.split_part(field(2), F.lit(";"), F.lit(1))
    cols = [
        field(0).alias("raw_chromosome"),
        field(1).try_cast("int").alias("raw_position"),
        field(3).alias("raw_ref"),
        field(4).alias("raw_alt"),
        optional(first_id).alias("rsid"),
        optional(field(5)).alias("qual"),
        field(6).alias("filter"),
    ]
    if with_calls:
        cols.append(F.slice(fields, 10, F.greatest(F.size(fields) - 9, F.lit(0))).alias("calls"))
    records = lines.filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    return records.select(*keep, *cols).filter("raw_position is not null")


def sample_header(lines: DataFrame) -> DataFrame:
    """(sample_idx, sample_id) from ``#CHROM`` lines; other columns are kept."""
    header = lines.filter(F.col("value").startswith("#CHROM"))
    names = F.split("value", "\t")
    return header.select(
        *[c for c in lines.columns if c != "value"],
        F.posexplode(F.slice(names, 10, F.greatest(F.size(names) - 9, F.lit(0)))).alias("sample_idx", "sample_id"),
    ).withColumn("sample_idx", F.col("sample_idx").cast("long"))


def header_groups(lines: DataFrame) -> DataFrame:
    """Distinct sample headers over files (``file``, ``value``): size, number of files, an example."""
    names = F.slice(F.split("value", "\t"), 10, 1 << 30)
    return lines.filter(F.col("value").startswith("#CHROM")).groupBy(
        F.sha2(F.array_join(names, "\t"), 256).alias("digest"), F.size(names).cast("long").alias("n_samples")
    ).agg(F.count("*").alias("n_files"), F.min("file").alias("example"))


def check_same_samples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The shared sample header of several files; raises when files disagree (one job)."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), "value")
    found = header_groups(lines).limit(20).collect()
    if len(found) != 1 or found[0]["n_files"] != len(paths):
        detail = "; ".join(f"{r['n_samples']} samples as in {r['example']}" for r in found)
        raise ValueError(f"sample columns differ between files: {detail}")
    return sample_header(spark.read.text(paths[0]))
