import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text) as a documents table with columns whose names clash with outputs."""

    def build(rows, parts=3):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        df = spark.createDataFrame(rows, schema).repartition(parts)
        return df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "'x' AS id", "1 AS h", "2 AS n_words", "'r' AS row", "3 AS crc")

    return build
