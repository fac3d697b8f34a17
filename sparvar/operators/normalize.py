"""From parsed input rows to canonical variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.variant import CONTIGS, normalize_chromosome, parse_chromosome_spec, parsimonious


def split_alternates(rows: DataFrame) -> DataFrame:
    """One row per usable ALT with its 1-based index; symbolic and empty ALTs go."""
    alts = rows.select(
        *[c for c in rows.columns if c != "raw_alt"],
        F.posexplode(F.split("raw_alt", ",")).alias("_i", "_alt"),
    ).withColumn("alt", F.upper(F.trim("_alt"))).withColumn("alt_index", F.col("_i") + 1)
    usable = ~F.col("alt").isin("*", ".", "") & ~F.col("alt").startswith("<")
    return alts.filter(usable).drop("_i", "_alt")


def canonical_variants(rows: DataFrame, chromosomes: str | None = None, observe: Observation | None = None) -> DataFrame:
    """Standard contigs, split and trimmed alleles, adjusted positions.

    ``observe`` collects the number of input and dropped rows without a second pass.
    """
    tagged = rows.withColumn("chromosome", normalize_chromosome("raw_chromosome"))
    wanted = F.col("chromosome").isin(parse_chromosome_spec(chromosomes) if chromosomes else CONTIGS)
    if observe is not None:
        tagged = tagged.observe(
            observe, F.count("*").alias("input_rows"),
            F.count_if(F.coalesce(~wanted, F.lit(True))).alias("dropped_rows"),
        )
    split = split_alternates(tagged.filter(wanted))
    trimmed = split.withColumn("_v", parsimonious(F.upper("raw_ref"), "alt", "raw_position"))
    keep = [c for c in rows.columns if not c.startswith("raw_")]
    return trimmed.select(
        "chromosome", F.col("_v.position").alias("position"), F.col("_v.ref").alias("ref"),
        F.col("_v.alt").alias("alt"), "alt_index", *keep,
    )


def pack_user_columns(df: DataFrame, standard: list[str], name: str = "input") -> DataFrame:
    """All non-standard columns gathered in one struct."""
    extra = [c for c in df.columns if c not in standard]
    if not extra:
        return df
    return df.select(*[c for c in standard if c in df.columns], F.struct(*extra).alias(name))
