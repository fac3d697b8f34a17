"""Column contracts, checked from ``df.schema`` alone (no job)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Functional-score channels, in weight order.
CHANNELS = [
    "cadd_phred", "linsight", "fathmm_xf", "apc_epigenetics_active",
    "apc_epigenetics_repressed", "apc_epigenetics_transcription",
    "apc_conservation", "apc_protein_function", "apc_local_nucleotide_diversity",
    "apc_mutation_density", "apc_transcription_factor",
]

INGESTED = T.StructType([
    T.StructField("chromosome", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("ref", T.StringType(), False),
    T.StructField("alt", T.StringType(), False),
    T.StructField("rsid", T.StringType()),
    T.StructField("qual", T.StringType()),
    T.StructField("filter", T.StringType()),
])

CARRIERS = T.StructType([
    T.StructField("variant_id", T.LongType()),
    T.StructField("sample_idx", T.LongType()),
    T.StructField("dosage", T.IntegerType()),
])

SEGMENTS = T.StructType([
    T.StructField("segment_id", T.IntegerType()),
    T.StructField("n_variants", T.IntegerType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("refs", T.ArrayType(T.StringType())),
    T.StructField("alts", T.ArrayType(T.StringType())),
    T.StructField("g", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("cross", T.ArrayType(T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType()),
    ]))),
])


def _accepts(want: T.DataType, have: T.DataType) -> bool:
    if want == have:
        return True
    wider = {
        T.DoubleType: (T.FloatType,),
        T.LongType: (T.IntegerType, T.ShortType, T.ByteType),
        T.IntegerType: (T.ShortType, T.ByteType),
    }
    return isinstance(have, wider.get(type(want), ()))


def assert_schema(df: DataFrame, contract: T.StructType, what: str = "input") -> DataFrame:
    """Raise with every missing or mistyped column named; extra columns are fine."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in contract.fields:
        if field.name not in have:
            problems.append(f"missing column '{field.name}' ({field.dataType.simpleString()})")
        elif not _accepts(field.dataType, have[field.name]):
            problems.append(
                f"column '{field.name}' is {have[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    if problems:
        raise ValueError(f"{what}: " + "; ".join(problems) + f". Available: {', '.join(have)}")
    return df
