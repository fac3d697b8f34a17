"""Forward selection of independent signals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prob import chi2_sf, neg_log10
from ..session import cut_lineage
from .nullmodel import NullModel
from .score import attach_null, h_cols, quad_form, variant_scores


def match_candidates(candidates: DataFrame, variants: DataFrame, maf_cutoff: float = 0.01) -> DataFrame:
    """Genotyped variants named as candidates and common enough."""
    return variants.filter(F.col("maf") > maf_cutoff).join(candidates, ["chromosome", "position", "ref", "alt"], "left_semi")


def forward_selection(candidates: DataFrame, carriers: DataFrame, null: NullModel, p_threshold: float = 1e-4) -> DataFrame:
    """Variants kept per chromosome, in order of entry, with -log10 p at entry.

    ``candidates``: chromosome, variant_id.  Adding a chosen variant to the
    covariates equals one step of Gram-Schmidt on the score vector and its
    covariance, so each round needs only the chosen variant's covariance with
    the others: one join of its carriers on the sample.  All chromosomes advance
    together and no covariance matrix is formed.  Runs one round of jobs per
    selected variant; the driver sees one row per chromosome and round.
    """
    if null.kind != "continuous":
        raise ValueError("forward selection needs a continuous trait")
    hs = h_cols(null)
    own = carriers.join(candidates.select("chromosome", "variant_id"), "variant_id")
    own = cut_lineage(attach_null(own.select("chromosome", "variant_id", "sample_idx", "dosage"), null).select(
        "chromosome", "variant_id", "sample_idx", F.col("dosage").cast("double").alias("d"), "w"))
    scores = variant_scores(carriers.join(candidates.select("variant_id").distinct(), "variant_id", "left_semi"), null)
    state = cut_lineage(candidates.select("chromosome", "variant_id").join(scores.select("variant_id", "u", "k", *hs), "variant_id").withColumns({
        "l": F.array().cast("array<double>"), "chosen": F.lit(False)}))
    df = null.n - len(null.x_cols)
    rss: dict[str, float] = {}
    kept = []
    cut = -np.log10(p_threshold)
    round_no = 0
    while True:
        s2 = F.lit(null.sigma2 * df)
        if rss:
            table = F.create_map(*[F.lit(x) for kv in rss.items() for x in kv])
            s2 = F.coalesce(table[F.col("chromosome")], s2)
        s2 = s2 / (df - round_no)
        stat = F.when(F.col("k") > 0, F.col("u") * F.col("u") / (s2 * F.col("k")))
        lp = neg_log10(F.when(stat.isNotNull(), chi2_sf(stat)).otherwise(1.0))
        open_rows = state.filter("not chosen").withColumn("lp", lp)
        best = open_rows.groupBy("chromosome").agg(
            F.max_by(F.struct("variant_id", "u", "k", "l", "lp", *hs), F.struct("lp", -F.col("variant_id"))).alias("b")
        ).select("chromosome", "b.*")
        # A chromosome that failed to add a variant is finished.
        if round_no:
            best = best.filter(F.col("lp") > cut).filter(F.col("chromosome").isin([k["chromosome"] for k in kept if k["step"] == round_no - 1]))
        picks = best.collect()
        if not picks:
            break
        for r in picks:
            kept.append({"chromosome": r["chromosome"], "variant_id": r["variant_id"], "step": round_no, "neg_log10_p": r["lp"]})
            rss[r["chromosome"]] = rss.get(r["chromosome"], null.sigma2 * df) - (r["u"] ** 2 / r["k"] if r["k"] > 0 else 0.0)
        chosen = state.sparkSession.createDataFrame(
            [(r["chromosome"], r["variant_id"], r["u"], r["k"], list(r["l"]), *[r[h] for h in hs]) for r in picks],
            "chromosome string, c_id long, c_u double, c_k double, c_l array<double>, " + ", ".join(f"c_{h} double" for h in hs))
        small = F.broadcast(chosen)  # one row per chromosome
        theirs = own.join(small.select("chromosome", F.col("c_id").alias("variant_id")), ["chromosome", "variant_id"], "left_semi").select(
            "chromosome", "sample_idx", F.col("d").alias("c_d"))
        cross = own.join(theirs, ["chromosome", "sample_idx"]).groupBy("chromosome", "variant_id").agg(
            F.sum(F.col("d") * F.col("c_d") * F.col("w")).alias("s"))
        joined = state.join(small, "chromosome", "left").join(cross, ["chromosome", "variant_id"], "left")
        proj = quad_form(null.cov_inv, hs, [f"c_{h}" for h in hs])
        prev = F.aggregate(F.zip_with("l", "c_l", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
        col = F.when(F.col("c_k") > 0, (F.coalesce("s", F.lit(0.0)) - proj - prev) / F.sqrt("c_k")).otherwise(0.0)
        step = joined.withColumn("_l", F.when(F.col("c_id").isNotNull(), col))
        state = cut_lineage(step.select(
            "chromosome", "variant_id",
            F.when(F.col("_l").isNull() | (F.col("c_k") <= 0), F.col("u")).otherwise(F.col("u") - F.col("_l") * F.col("c_u") / F.sqrt("c_k")).alias("u"),
            F.when(F.col("_l").isNull(), F.col("k")).otherwise(F.col("k") - F.col("_l") * F.col("_l")).alias("k"),
            *hs, F.when(F.col("_l").isNull(), F.col("l")).otherwise(F.array_append("l", F.col("_l"))).alias("l"),
            (F.col("chosen") | F.coalesce(F.col("variant_id") == F.col("c_id"), F.lit(False))).alias("chosen"),
        ))
        round_no += 1
        if round_no >= df:
            break
    spark = candidates.sparkSession
    return spark.createDataFrame(
        [(k["chromosome"], k["variant_id"], k["step"], float(k["neg_log10_p"])) for k in kept],
        "chromosome string, variant_id long, step int, neg_log10_p double")
