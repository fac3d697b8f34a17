"""Exact top-k inner products by norm buckets with local pruning.

Vectors are ordered by length and cut into buckets.  A few of the longest vectors give
each query a first lower bound of its k-th score.  A bucket is paired with a block of
queries only where the product of lengths can reach the bound.  Inside a pair each query
has a local cosine threshold, ``bound / (query length * longest of the bucket)``; with a
high threshold the bucket's candidates are pruned by coordinates (the query's largest
ones bound what the rest can add), with a low one by length alone.  What is left is
verified by exact integer products, and the best k of every pair are merged.

Query blocks and buckets hold at most ``QUERY_BLOCK`` and ``BUCKET`` rows, so a pair is
bounded work; equal vectors of any number are spread over buckets.

Defined results: vectors that are null, or hold a null or non-finite component, take no
part; vectors of different sizes have no product; rows without id take no part; repeated
ids are separate candidates, a query never gets rows of its own id; empty vectors score 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

QUERY_BLOCK = 512
BUCKET = 4096
FOCUS = 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(id, v, sq)``: floor(scale * x) of every usable vector and its squared length."""
    x = F.transform(vec_col, lambda e: e.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows = rows.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))))
    rows = rows.select("id", F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e).cast("long")).alias("v"))
    return rows.withColumn("sq", F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.int64).reshape(len(flat), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def search_pair(query: np.ndarray, bound: float, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of a bucket (longest first) that may reach ``bound`` with ``query``."""
    size = math.sqrt(float(query @ query))
    if bound == -math.inf or size == 0 or lengths[0] == 0:
        return np.arange(len(vectors)) if bound <= 0 else np.zeros(0, np.int64)
    local = bound / (size * float(lengths[0]))
    if local > 1 + 1e-9:
        return np.zeros(0, np.int64)
    # Lengths fall, so length pruning keeps a head of the bucket.
    head = len(vectors) if bound <= 0 else int(np.searchsorted(-lengths, -(bound / size) * (1 - 1e-9), side="right"))
    if local < 0.3 or head <= 64 or len(query) <= FOCUS:
        return np.arange(head)
    focus = np.argsort(-np.abs(query))[:FOCUS]
    part = vectors[:head][:, focus]
    rest_query = math.sqrt(max(0.0, size * size - float(query[focus] @ query[focus])))
    rest = np.sqrt(np.maximum(lengths[:head] ** 2 - (part * part).sum(1), 0.0))
    return np.flatnonzero(part @ query[focus] + rest_query * rest >= bound - 1e-6 * (1 + abs(bound)))


def _pairs(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, sq = np.asarray(right.column("id")), np.asarray(right.column("sq"))
            order = np.lexsort((ids, -sq))
            ids, lengths = ids[order], np.sqrt(sq[order].astype(float))
            vectors = _matrix(right.column("v"))[order].astype(np.float64)  # exact below 2**53
            queries = _matrix(left.column("v")).astype(np.float64)
            for q, query, low in zip(np.asarray(left.column("id")), queries, left.column("bound").to_pylist(), strict=True):
                rows = search_pair(query, -math.inf if low is None else float(low), vectors, lengths)
                rows = rows[ids[rows] != q]
                scores = (vectors[rows] @ query).astype(np.int64)
                best = _best(ids[rows], scores, k)
                out[0].append(np.full(len(best), q))
                out[1].append(ids[rows][best])
                out[2].append(scores[best])
        flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in out]
        return pa.table({"query_id": flat[0], "vec_id": flat[1], "score": flat[2]})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, bucket: int = BUCKET, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on ``id``."""
    rows = cut_lineage(quantised(vectors, id_col, vec_col, scale).withColumn("dim", F.size("v")))
    total = rows.count()
    schema = "query_id long, vec_id long, score long"
    # Buckets by length: quantiles of the squared length, and a salt where many rows tie.
    wanted = max(1, -(-total // bucket))
    cuts = sorted({float(x) for x in rows.approxQuantile("sq", [i / min(wanted, 2000) for i in range(1, min(wanted, 2000))], 0.0005)}, reverse=True) if wanted > 1 else []
    band = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("sq") >= c)) if cuts else F.lit(0)
    banded = rows.withColumn("band", band.cast("int"))
    sizes = {(r.dim, r.band): r for r in banded.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("sq").alias("most")).collect()}
    salts = F.create_map(*[F.lit(x) for (d, b), r in sizes.items() for x in (f"{d}:{b}", -(-r.n // bucket))]) if sizes else F.create_map(F.lit(""), F.lit(1))
    name = F.concat_ws(":", F.col("dim").cast("string"), F.col("band").cast("string"))
    placed = banded.withColumn("bucket", F.concat_ws(":", name, F.pmod(F.xxhash64("id"), salts[name]).cast("string")))
    queries = rows.where(is_query)
    n_blocks = max(1, -(-queries.count() // query_block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(n_blocks)).cast("int"))

    def run(asked: DataFrame, held: DataFrame) -> DataFrame:
        """``asked`` has (block, bucket) pairs; ``held`` is dealt to the blocks that ask for it."""
        wants = asked.select("block", "bucket").distinct()
        dealt = held.select(F.col("bucket").alias("h_bucket"), F.col("id").alias("h_id"), F.col("v").alias("h_v"), F.col("sq").alias("h_sq")).join(wants, F.col("h_bucket") == F.col("bucket"))
        dealt = dealt.select(F.col("block").alias("h_block"), "h_bucket", F.col("h_id").alias("id"), F.col("h_v").alias("v"), F.col("h_sq").alias("sq"))
        left = asked.select("block", "bucket", "id", "v", "bound")
        return left.groupBy("block", "bucket").cogroup(dealt.groupBy("h_block", "h_bucket")).applyInArrow(_pairs(k), schema)

    # First bounds: the longest rows of each size, one bucket of them.
    longest = {}
    for (d, b), r in sorted(sizes.items()):
        longest.setdefault(d, (b, r.most))
    first = F.create_map(*[F.lit(x) for d, (b, _) in longest.items() for x in (d, f"{d}:{b}:0")]) if longest else F.create_map(F.lit(0), F.lit(""))
    start = run(queries.withColumn("bucket", first[F.col("dim")]).withColumn("bound", F.lit(None).cast("long")), placed)
    bounds = start.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("id", F.when(F.size("s") >= k, F.col("s")[k - 1]).alias("bound"))
    bounded = cut_lineage(queries.join(bounds, "id", "left"))
    spots = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(f"{d}:{b}:{s}").alias("bucket"), F.lit(int(r.most)).alias("most")) for (d, b), r in sizes.items() for s in range(-(-r.n // bucket))])
    asked = bounded.withColumn("p", F.explode(spots)) if sizes else bounded.withColumn("p", F.struct(F.lit(0).alias("d"), F.lit("").alias("bucket"), F.lit(0).alias("most")))
    reach = F.col("bound").isNull() | (F.sqrt(F.col("sq").cast("double") * F.col("p.most")) * 1.000001 >= F.col("bound"))
    asked = asked.where((F.col("p.d") == F.col("dim")) & reach).withColumn("bucket", F.col("p.bucket"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    best = run(asked, placed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
