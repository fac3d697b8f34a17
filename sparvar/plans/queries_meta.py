"""Pooled set tests of two studies as registered queries.

Each study fits its own model on its own samples, writes summary statistics and is read
back; study 1 names every fourth site's alleles the other way round.  SQL follows the
unweighted burden, whose pooled score and variance are sums over the studies' samples, with
the sign of the alleles' lexicographic order.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import meta as M
from ..operators import nullmodel as NM
from .cohort import Cohort
from .oracle import CTES, chi2_1, sql
from .registry import query, rnd


class Studies:
    """Two studies of a cohort, written and read back."""

    def __init__(self, c: Cohort, **segment_limits):
        self.c = c
        self.segment_limits = segment_limits

    @cached_property
    def tables(self) -> tuple[DataFrame, DataFrame]:
        from ..session import scratch_path

        paths = []
        for k in (0, 1):
            mine = F.col("sample_idx") % 2 == k
            null = NM.fit_gaussian(self.c.phenotype.where(mine), "y", self.c.COVARIATES)
            carriers = self.c.carriers.where(mine)
            freq = carriers.groupBy("variant_id").agg((F.sum("dosage") / (2.0 * null.n)).alias("maf"))
            index = self.c.rare_index().drop("maf", "af", "ac").join(freq, "variant_id", "left").fillna(0.0, subset=["maf"])
            variants, segments = M.emit_sumstats(index, carriers, null, **self.segment_limits)
            if k:
                variants, segments = self.turned(variants, segments)
            path = scratch_path(self.c.spark, f"study{k}")
            M.write_study(path, variants, segments, M.study_metadata(self.c.spark, null, "y", self.c.COVARIATES, 0.5))
            paths.append(path)
        return M.read_studies(self.c.spark, paths)

    def turned(self, variants: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sites at every fourth position trade their alleles, and with them the sign of all their statistics."""
        turn = F.floor(F.col("position") / 50) % 4 == 0
        variants = variants.withColumns({
            "ref": F.when(turn, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(turn, F.col("ref")).otherwise(F.col("alt")),
            "u_stat": F.when(turn, -F.col("u_stat")).otherwise(F.col("u_stat")),
        })
        sign = F.transform("positions", lambda p: F.when(F.floor(p / 50) % 4 == 0, -1.0).otherwise(1.0))
        pick = lambda a, b: F.transform(F.arrays_zip("sg", a, b), lambda z: F.when(z["sg"] < 0, z[b]).otherwise(z[a]))
        rows = segments.withColumn("sg", sign).withColumns({"refs": pick("refs", "alts"), "alts": pick("alts", "refs")})
        rows = rows.withColumn("g", F.zip_with("g", "sg", lambda g, s: F.transform(g, lambda v: v * s)))
        # Products take the signs of both variants, of one segment or two.
        own = rows.where("other_id is null")
        at = own.select("chromosome", F.col("segment_id").alias("_o"), F.col("sg").alias("sg2"))
        rows = rows.withColumn("_o", F.coalesce("other_id", "segment_id")).drop("sg").join(own.select("chromosome", "segment_id", F.col("sg").alias("sg1")), ["chromosome", "segment_id"]).join(at, ["chromosome", "_o"])
        signed = F.transform("cross", lambda z: F.struct(z["i"].alias("i"), z["j"].alias("j"), (z["s"] * F.get("sg1", z["i"]) * F.get("sg2", z["j"])).alias("s")))
        return variants, rows.withColumn("cross", signed).drop("sg1", "sg2", "_o")

    @cached_property
    def merged(self) -> DataFrame:
        return M.merge_variants(self.tables[0], 2.0)

    @cached_property
    def members(self) -> DataFrame:
        return M.meta_members(self.merged)


def _of_study(k: int) -> dict[str, str]:
    """The model's CTEs over one study's samples."""
    names = ("pheno", "ne_sums", "ne", "beta", "nm", "sig", "cv", "vscore")
    out = {f"pheno_s{k}": f"SELECT * FROM pheno WHERE sample_idx % 2 = {k}"}
    for n in names[1:]:
        out[f"{n}_s{k}"] = re.sub(rf"(?<![\w.])({'|'.join(names)})(?=[\s).,]|$)", rf"\1_s{k}", CTES[n])
    return out


CTES |= _of_study(0) | _of_study(1)
CTES["msets"] = "SELECT * FROM (SELECT chromosome || '|' || gene_name AS set_id, chromosome, gene_name, mask, variant_id, CASE WHEN ref <= alt THEN 1 ELSE -1 END AS sg, count(*) OVER (PARTITION BY chromosome, gene_name, mask) AS n_set FROM masked) WHERE n_set >= 2"
# One known locus a chromosome: its first rare variant.
CTES["mlocus"] = "SELECT chromosome, min(variant_id) AS locus FROM rare GROUP BY 1"


def _h(k: int, a: str, b: str) -> str:
    pairs = [f"c{min(i, j)}{max(i, j)}*{a}{i}*{b}{j}" for i in range(3) for j in range(3)]
    return "(" + " + ".join(pairs) + ")"


for _k in (0, 1):
    CTES[f"mburden_s{_k}"] = f"""
SELECT set_id, mask, locus, u/s2 AS u, (bb - {_h(_k, 'h', 'h')})/s2 AS k11, mac, (bc - {_h(_k, 'h', 'g')})/s2 AS k1c, uc/s2 AS uc, kc/s2 AS kc FROM (
  SELECT set_id, mask, any_value(l.locus) AS locus, sum(b*r) AS u, sum(b*b) AS bb, sum(b) AS h0, sum(b*x1) AS h1, sum(b*x2) AS h2, sum(s.mac)::BIGINT AS mac,
    sum(b*coalesce(q.dosage, 0)) AS bc, any_value(coalesce(v.u, 0)) AS uc, any_value(coalesce(v.k, 0)) AS kc, any_value(coalesce(v.h0, 0)) AS g0, any_value(coalesce(v.h1, 0)) AS g1, any_value(coalesce(v.h2, 0)) AS g2
  FROM (SELECT set_id, mask, any_value(chromosome) AS chromosome, sample_idx, CAST(sum(sg*dosage) AS DOUBLE) AS b, sum(dosage) AS mac FROM msets JOIN carriers USING (variant_id) GROUP BY set_id, mask, sample_idx) s
  JOIN nm_s{_k} USING (sample_idx) JOIN mlocus l USING (chromosome) LEFT JOIN carriers q ON q.variant_id = l.locus AND q.sample_idx = s.sample_idx LEFT JOIN vscore_s{_k} v ON v.variant_id = l.locus
  GROUP BY set_id, mask) CROSS JOIN cv_s{_k}"""
CTES["mpool"] = "SELECT * FROM mburden_s0 UNION ALL SELECT * FROM mburden_s1"


@query("M01_M04_M05_M09_pooled_set_tests", sql("mpool msets", f"""
SELECT set_id, mask, n_variants, cmac, round(u/k, 3) AS burden_beta, round(1/sqrt(k), 4) AS burden_se, round({chi2_1('u*u/k')}, 7) AS burden_1_1
FROM (SELECT set_id, mask, sum(u) AS u, sum(k11) AS k, sum(mac)::BIGINT AS cmac FROM mpool GROUP BY 1, 2) JOIN (SELECT set_id, mask, count(*)::INTEGER AS n_variants FROM msets GROUP BY 1, 2) USING (set_id, mask)"""))
def m05(c: Cohort) -> DataFrame:
    """Pooled battery of every gene and mask, one result table over all chromosomes and masks."""
    s = Studies(c)
    t = M.meta_tests(s.members, s.tables[1])
    return t.select("set_id", "mask", "n_variants", "cmac", rnd("burden_beta", 3), rnd("burden_se", 4), rnd(F.col("p")[1], 7, "burden_1_1"))


@query("M03_M06_pooled_gene_effect", sql("rare " + " ".join(f"nm_s{k} cv_s{k}" for k in (0, 1)), """
WITH g AS (SELECT chromosome || '|' || gene_name AS set_id, variant_id, CASE WHEN ref <= alt THEN 1 ELSE -1 END AS sg FROM rare), p AS (""" + " UNION ALL ".join(f"""
  SELECT set_id, u/s2 AS u, (bb - {_h(k, 'h', 'h')})/s2 AS k FROM (SELECT set_id, sum(b*r) AS u, sum(b*b) AS bb, sum(b) AS h0, sum(b*x1) AS h1, sum(b*x2) AS h2
    FROM (SELECT set_id, sample_idx, CAST(sum(sg*dosage) AS DOUBLE) AS b FROM g JOIN carriers USING (variant_id) GROUP BY 1, 2) JOIN nm_s{k} USING (sample_idx) GROUP BY 1) CROSS JOIN cv_s{k}""" for k in (0, 1)) + """)
SELECT set_id, n_variants, round(sum(u)/sum(k), 3) AS burden_beta, round(1/sqrt(sum(k)), 4) AS burden_se
FROM p JOIN (SELECT set_id, count(*) AS n_variants FROM g GROUP BY 1) USING (set_id) GROUP BY 1, 2""", carriers=CTES["carriers"]))
def m06(c: Cohort) -> DataFrame:
    """Effect of a whole gene from orientation-blind pooled covariance cells."""
    s = Studies(c)
    t = M.burden_effect(s.members, s.tables[1])
    return t.select("set_id", "n_variants", rnd("burden_beta", 3), rnd("burden_se", 4))


def known_loci(c: Cohort) -> DataFrame:
    """The first rare variant of every chromosome."""
    first = c.rare_index().groupBy("chromosome").agg(F.min("variant_id").alias("variant_id"))
    return c.variants.join(first.select("variant_id"), "variant_id").select("chromosome", "position", "ref", "alt")


_COND = "SELECT p.*, p.locus IN (SELECT variant_id FROM rare r WHERE r.chromosome || '|' || r.gene_name = p.set_id) AS inside FROM mpool p"
_EFFECT = "SELECT set_id, mask, round(u/k, 3) AS burden_beta, round(1/sqrt(k), 4) AS burden_se FROM"


@query("M07_conditional_pooled", sql("mpool rare", f"""
{_EFFECT} (SELECT set_id, mask, CASE WHEN inside THEN u ELSE u - k1c/(kc + 1e-8)*uc END AS u, CASE WHEN inside THEN k11 ELSE k11 - k1c*k1c/(kc + 1e-8) END AS k
  FROM (SELECT set_id, mask, bool_or(inside) AS inside, sum(u) AS u, sum(k11) AS k11, sum(k1c) AS k1c, sum(uc) AS uc, sum(kc) AS kc FROM cond GROUP BY 1, 2))""", cond=_COND))
def m07(c: Cohort) -> DataFrame:
    """Pooled effect given a known locus, one covariance for all studies."""
    return conditional(c, False)


@query("M08_conditional_by_study", sql("mpool rare", f"""
{_EFFECT} (SELECT set_id, mask, sum(CASE WHEN inside THEN u ELSE u - k1c/(kc + 1e-8)*uc END) AS u, sum(CASE WHEN inside THEN k11 ELSE k11 - k1c*k1c/(kc + 1e-8) END) AS k FROM cond GROUP BY 1, 2)""", cond=_COND))
def m08(c: Cohort) -> DataFrame:
    """The same, conditioned inside each study before pooling."""
    return conditional(c, True)


def conditional(c: Cohort, per_study: bool) -> DataFrame:
    s = Studies(c)
    t = M.conditional_tests(M.conditional_members(s.members, s.merged, known_loci(c)), s.tables[1], per_study)
    return t.select("set_id", "mask", rnd("burden_beta", 3), rnd("burden_se", 4))
