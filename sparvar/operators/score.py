"""Score statistics from the sparse carriers table: native aggregations only.

``u = G'r`` and the projected variance ``k = G'WG - G'WX (X'WX)^-1 X'WG`` need
nothing but sums over carriers.  The weighted burden variance of a whole set is
also linear work: with ``b_s`` the weighted dosage sum of sample s,
``w'Kw = sum_s W_s b_s^2 - h'(X'WX)^-1 h``, ``h = sum_s W_s b_s x_s``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prob import chi2_sf, neg_log10
from ..functions.variant import beta_weight
from .nullmodel import NullModel


def attach_null(carriers: DataFrame, null: NullModel, extra: list[str] = ()) -> DataFrame:
    """Carriers of phenotyped samples with residual, weight and covariates.

    The join strategy is left to the optimizer: the sample table is broadcast
    only when its size allows, and a skewed sample key is split at run time.
    """
    r = [c for c in null.vectors.columns if c == "r" or (c[0] == "r" and c[1:].isdigit())]
    return carriers.join(null.vectors.select("sample_idx", *r, "w", *null.x_cols, *extra), "sample_idx")


def quad_form(m: np.ndarray, a: list[str], b: list[str] | None = None) -> Column:
    """``a' M b`` with literal coefficients."""
    b = b or a
    acc = F.lit(0.0)
    for i, ci in enumerate(a):
        for j, cj in enumerate(b):
            acc = acc + F.lit(float(m[i, j])) * F.col(ci) * F.col(cj)
    return acc


def h_cols(null: NullModel) -> list[str]:
    return [f"h{i}" for i in range(len(null.x_cols))]


def variant_scores(carriers: DataFrame, null: NullModel, group: list[str] = ("variant_id",), dosage: str = "dosage") -> DataFrame:
    """Per variant: u, h = G'WX, gg = G'WG diagonal, projected k, allele count."""
    d = F.col(dosage).cast("double")
    sums = [
        F.sum(d * F.col("r")).alias("u"),
        *[F.sum(d * F.col("w") * F.col(x)).alias(h) for x, h in zip(null.x_cols, h_cols(null))],
        F.sum(d * d * F.col("w")).alias("gg"),
        F.sum(d).alias("mac"),
        F.count("*").alias("n_carriers"),
    ]
    agg = attach_null(carriers, null).groupBy(*group).agg(*sums)
    return agg.withColumn("k", F.col("gg") - quad_form(null.cov_inv, h_cols(null)))


def individual_tests(carriers: DataFrame, null: NullModel) -> DataFrame:
    """Single-variant score test: score, effect, standard errors and p-value."""
    s2 = null.sigma2
    cov = F.col("k") / s2
    ok = F.coalesce((cov > 0) & ~F.isnan(cov), F.lit(False))

    def when_ok(c: Column, other: float = 0.0) -> Column:
        return F.when(ok, c).otherwise(F.lit(other))

    out = variant_scores(carriers, null).select(
        "variant_id",
        F.col("mac").cast("long").alias("mac"),
        (F.col("mac") / (2.0 * null.n)).alias("alt_af"),
        when_ok(F.col("u") / s2).alias("score"),
        when_ok(F.sqrt(cov)).alias("score_se"),
        when_ok(F.col("u") / F.col("k")).alias("est"),
        when_ok(1.0 / F.sqrt(cov)).alias("est_se"),
        when_ok(F.col("u") * F.col("u") / (s2 * F.col("k"))).alias("stat"),
        when_ok(chi2_sf(F.col("u") * F.col("u") / (s2 * F.col("k"))), 1.0).alias("pvalue"),
    )
    return out.withColumn("neg_log10_p", neg_log10(F.col("pvalue")))


def mac_floor(mac_cutoff: int, n: int) -> float:
    """Lowest MAF admitted to single-variant testing (exclusive)."""
    return (mac_cutoff - 0.5) / (2.0 * n)


# ---------------------------------------------------------------------- burden


def burden_statistics(members: DataFrame, carriers: DataFrame, null: NullModel, weights: list[str], keys: list[str] = ("set_id",)) -> DataFrame:
    """(w'U)^2 / (sigma^2 w'Kw) per set for every weight column, without forming K.

    ``members`` has the set keys, variant_id and the weight columns.  The first
    shuffle is on (set, sample), so one dominant set is spread over all tasks;
    the second sums already-reduced rows.
    """
    keys = list(keys)
    hit = members.select(*keys, "variant_id", *weights).join(
        carriers.select("variant_id", "sample_idx", "dosage"), "variant_id"
    )
    per_sample = hit.groupBy(*keys, "sample_idx").agg(
        *[F.sum(F.col(w) * F.col("dosage")).alias(f"b_{i}") for i, w in enumerate(weights)]
    )
    rows = per_sample.join(null.vectors.select("sample_idx", "r", "w", *null.x_cols), "sample_idx")
    sums: list[Column] = []
    for i in range(len(weights)):
        b = F.col(f"b_{i}")
        sums.append(F.sum(b * F.col("r")).alias(f"wu_{i}"))
        sums.append(F.sum(b * b * F.col("w")).alias(f"bb_{i}"))
        sums += [F.sum(b * F.col("w") * F.col(x)).alias(f"hb_{i}_{j}") for j, x in enumerate(null.x_cols)]
    agg = rows.groupBy(*keys).agg(*sums)
    out = []
    for i, w in enumerate(weights):
        var = F.col(f"bb_{i}") - quad_form(null.cov_inv, [f"hb_{i}_{j}" for j in range(len(null.x_cols))])
        out.append(F.struct(
            F.lit(w).alias("weight"), F.col(f"wu_{i}").alias("wu"), var.alias("wkw"),
        ))
    long = agg.select(*keys, F.explode(F.array(*out)).alias("s")).select(*keys, "s.*")
    stat = F.col("wu") * F.col("wu") / (null.sigma2 * F.col("wkw"))
    return long.withColumn("stat", F.when(F.col("wkw") > 0, stat)).withColumn(
        "p", F.when(F.col("wkw") > 0, chi2_sf(F.col("stat"))).otherwise(1.0)
    )


def beta_columns(df: DataFrame) -> DataFrame:
    """b25 and b11 (burden/SKAT shapes) and the matching ACAT weights v25 and v11."""
    flat = beta_weight("maf", 0.5, 0.5)
    den = F.when(flat > 0, flat * flat).otherwise(1.0)
    return df.withColumns({"b25": beta_weight("maf", 1, 25), "b11": beta_weight("maf", 1, 1)}).withColumns({
        "v25": F.col("b25") * F.col("b25") / den, "v11": F.col("b11") * F.col("b11") / den,
    })


# ------------------------------------------------------------------- persisted


def effect_sums(scores: DataFrame, null: NullModel) -> DataFrame:
    """Per-variant U and V in the scaled form exchanged between stages."""
    return scores.withColumns({"u_stat": F.col("u") / null.sigma2, "v_stat": F.col("k") / null.sigma2})
