"""Genotype cross-products G'WG within variant sets.

A sample that carries few variants of a set gives its pairs directly, so rare
variants cost what they share and not the area of the set.  The samples that carry
many are cut into chunks (and, for wide sets, tiles of variants), a task multiplies
one chunk, and Spark adds the partial cells.  No task ever sees a whole hot set,
and only non-zero cells leave a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohort import ordered_rank

CHUNK_ROWS = 200_000
TILE = 1024
#: Variants of a set that one sample may carry and still be paired row by row.
FEW = 64


def rank_members(members: DataFrame, keys: list[str] = ("set_id",), name: str = "j") -> DataFrame:
    """Dense member number per set; the ranking of a hot set is spread over buckets."""
    bucket = F.pmod(F.xxhash64("variant_id"), F.lit(256))
    return ordered_rank(members, list(keys), bucket, ["variant_id"], name).withColumn(name, F.col(name).cast("int"))


def member_carriers(ranked: DataFrame, carriers: DataFrame) -> DataFrame:
    """(set_id, j, sample_idx, dosage) rows; sets share variants, so this fans out."""
    return ranked.select("set_id", "j", "variant_id").join(
        carriers.select("variant_id", "sample_idx", "dosage"), "variant_id"
    ).select("set_id", "j", "sample_idx", F.col("dosage").cast("double").alias("d"))


def _multiply(pdf: pd.DataFrame, tile_a: int, tile_b: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero cells of A'WB for the two variant tiles held in one chunk."""
    j = pdf["j"].to_numpy()
    s, codes = np.unique(pdf["sample_idx"].to_numpy(), return_inverse=True)
    d, w = pdf["d"].to_numpy(), pdf["w"].to_numpy()
    ids, local = np.unique(j, return_inverse=True)
    in_a = (ids // tile) == tile_a
    in_b = (ids // tile) == tile_b
    total = np.zeros((int(in_a.sum()), int(in_b.sum())))
    block = max(1, 4_000_000 // max(1, len(ids)))
    order = np.argsort(codes, kind="stable")
    codes, local, d, w = codes[order], local[order], d[order], w[order]
    for lo in range(0, len(s), block):
        a, b = np.searchsorted(codes, [lo, lo + block])
        g = np.zeros((min(block, len(s) - lo), len(ids)))
        np.add.at(g, (codes[a:b] - lo, local[a:b]), d[a:b])
        om = np.zeros(g.shape[0])
        om[codes[a:b] - lo] = w[a:b]
        total += (g[:, in_a] * om[:, None]).T @ g[:, in_b]
    ja, jb = ids[in_a], ids[in_b]
    r, c = np.nonzero(total)
    v = total[r, c]
    r, c = ja[r], jb[c]
    keep = r <= c
    return r[keep], c[keep], v[keep]


def pair_products(
    ranked: DataFrame, carriers: DataFrame, weights: DataFrame, stratum: str | None = None,
    chunk_rows: int | None = None, tile: int = TILE,
) -> DataFrame:
    """Upper-triangle cells (set_id, j1 <= j2, s) of G'WG per set, non-zero only.

    ``weights`` has sample_idx and w, plus ``stratum`` when the product is to be
    kept apart by a sample group.
    """
    chunk_rows = chunk_rows or CHUNK_ROWS
    extra = [stratum] if stratum else []
    every = member_carriers(ranked, carriers).join(weights.select("sample_idx", "w", *extra), "sample_idx")
    # A sample's variants in a set: at most the set's width.
    held = every.groupBy("set_id", *extra, "sample_idx").agg(F.first("w").alias("w"), F.collect_list(F.struct("j", "d")).alias("m"))
    few = held.where(F.size("m") <= FEW).select("set_id", *extra, "w", "m", F.explode("m").alias("x"))
    few = few.select("set_id", *extra, "w", "x", F.explode(F.filter("m", lambda y: y["j"] >= F.col("x.j"))).alias("y"))
    few = few.select("set_id", *extra, F.col("x.j").alias("j1"), F.col("y.j").alias("j2"), (F.col("w") * F.col("x.d") * F.col("y.d")).alias("s"))
    rows = held.where(F.size("m") > FEW).select("set_id", *extra, "sample_idx", "w", F.explode("m").alias("x")).select("set_id", *extra, "sample_idx", "w", "x.*")
    load = rows.groupBy("set_id").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("_chunks"), (F.floor(F.max("j") / tile) + 1).cast("int").alias("_tiles"))
    mine = F.floor(F.col("j") / tile).cast("int")
    others = F.when(F.col("_tiles") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), lambda t: F.struct(F.least(mine, t).alias("a"), F.greatest(mine, t).alias("b")))
    )
    keyed = rows.join(load, "set_id").select(
        "set_id", "j", "sample_idx", "d", "w", *extra,
        F.pmod(F.xxhash64("sample_idx"), F.greatest("_chunks", F.lit(1))).cast("int").alias("_chunk"),
        F.explode(others).alias("_t"),
    ).select("set_id", "j", "sample_idx", "d", "w", *extra, "_chunk", F.col("_t.a").alias("_a"), F.col("_t.b").alias("_b"))
    types = dict(keyed.dtypes)
    out = f"set_id {types['set_id']}, " + (f"{stratum} {types[stratum]}, " if stratum else "") + "j1 int, j2 int, s double"

    def chunk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, v = _multiply(pdf, int(key[-2]), int(key[-1]), tile)
        cols = {"set_id": key[0]}
        if stratum:
            cols[stratum] = key[1]
        # Object columns convert when they are empty too: a tile pair may have no cell.
        named = {k: pd.Series([x] * len(v), dtype=object) for k, x in cols.items()}
        return pd.DataFrame({**named, "j1": r.astype("int32"), "j2": c.astype("int32"), "s": v})

    partial = keyed.groupBy("set_id", *extra, "_chunk", "_a", "_b").applyInPandas(chunk, out)
    return partial.unionByName(few.where("s <> 0")).groupBy("set_id", *extra, "j1", "j2").agg(F.sum("s").alias("s"))
