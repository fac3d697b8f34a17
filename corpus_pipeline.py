"""A training corpus from raw documents: five stages, each on all that the one before kept.

1. quality: documents that the weak-label classifier rejects go.
2. near duplicates: of each group of linked shingle sets, the smallest id stays.
3. decontamination: documents with a twentieth of their words in benchmark windows go.
4. secrets: every reported span is replaced by the name of its kind.
5. tokens: whole texts become SentencePiece ids.

A stage takes and returns the columns of ``documents``; the last returns ids instead of
the text.  Rows without id pass the second stage, as they have no group; a null text is
kept as null until it becomes an empty list of ids.  Further columns pass through unchanged,
also those named like a column that an operator adds; only in the last stage do its own
``ids`` and ``n_tokens`` replace such ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvar.llm import decontaminate, jaccard_join, quality, secrets, sentencepieces
from sparvar.llm.queries import tokenizer_path


DOCUMENT = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose further columns bear names that no operator uses."""
    names = {c: c if c in DOCUMENT else f"corpus_{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _apart(docs, lambda d: quality.classify(d).where("kept"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_components(docs.select("doc_id", "text"))
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("g_id"), F.col("text_crc").alias("g_crc")).distinct()

    def keep(d: DataFrame) -> DataFrame:
        rows = d.withColumn("text_crc", F.crc32(F.coalesce("text", F.lit(""))))
        left = rows.join(gone, (F.col("doc_id") == F.col("g_id")) & (F.col("text_crc") == F.col("g_crc")), "left_anti")
        # Rows without id are no group: each gets a key of its own, so all stay and none crowd a task.
        own = left.withColumn("alone", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
        nth = F.row_number().over(Window.partitionBy("doc_id", "text_crc", "alone").orderBy("doc_id"))
        return own.withColumn("nth", nth).where("nth = 1")

    return _apart(docs, keep)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, lambda d: decontaminate.find_contamination(d, benchmark).where("NOT contaminated"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def clean(d: DataFrame) -> DataFrame:
        found = secrets.find_secrets(d.withColumn("body", F.col("text")))
        out = secrets.redact(found, "body").withColumnRenamed("body", "text")
        return out.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType))

    return _apart(docs, clean)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_near), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("tokens", encode_pieces)]

#: Classifier, components and ids are beyond SQL; tests/llm checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = jaccard_join.stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
