"""Divergence, components of ancestry and kinship as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relate as R
from .cohort import Cohort
from .oracle import sql
from .queries_more import _PAIRS, king_pairs
from .registry import query, rnd

PC_COUNT = 4


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("i", "j")).alias("sample_idx")).distinct()


def _divergence(c: Cohort) -> DataFrame:
    return R.divergence(c.carriers, c.variants, _ends(king_pairs(c)), c.samples)


# Overlaps by joining carriers on the variant, all other pairs by the counts of both samples.
@query("G03_divergence", sql("carriers samples", f"""
SELECT * FROM (WITH p AS ({_PAIRS}), ends AS (SELECT i AS a FROM p UNION SELECT j FROM p),
n AS (SELECT s.sample_idx AS s, count(*) FILTER (dosage = 1) AS het, count(*) FILTER (dosage = 2) AS hom FROM samples s LEFT JOIN carriers USING (sample_idx) GROUP BY 1),
o AS (SELECT x.sample_idx AS a, y.sample_idx AS b, count(*) FILTER (x.dosage = 1 AND y.dosage = 1) AS hethet,
    count(*) FILTER (x.dosage = 2) + count(*) FILTER (y.dosage = 2) AS met
  FROM carriers x JOIN carriers y USING (variant_id) WHERE x.sample_idx IN (SELECT a FROM ends) GROUP BY 1, 2)
SELECT e.a AS sample_idx, count(*) FILTER (x.het + y.het > 0 AND CAST(coalesce(hethet, 0) - 2*(x.hom + y.hom - coalesce(met, 0)) AS DOUBLE)/(x.het + y.het) < -0.025) AS divergence
FROM ends e JOIN n x ON x.s = e.a JOIN n y ON y.s <> e.a LEFT JOIN o ON o.a = e.a AND o.b = y.s GROUP BY 1)"""))
def g03(c: Cohort) -> DataFrame:
    """Related samples against all samples over all variants."""
    return _divergence(c)


@query("G07_principal_components")
def g07(c: Cohort) -> DataFrame:
    """Scores of all samples; unrelated samples span the components, the others are projected."""
    none = c.samples.select("sample_idx", F.lit(0).cast("long").alias("divergence"))
    unrelated = R.unrelated_subset(king_pairs(c), c.samples, none)
    scores, _ = R.principal_components(c.carriers, c.samples, unrelated, PC_COUNT)
    return scores


# One given component, so that the regression of dosages is a line.
@query("G08_pair_kinship", sql("carriers samples variants", f"""
SELECT * FROM (WITH p AS ({_PAIRS}), q AS (SELECT i, j FROM p UNION SELECT i, i FROM p UNION SELECT j, j FROM p),
x AS (SELECT sample_idx AS s, (sample_idx % 7)/7.0 - 0.4 AS z FROM samples),
t AS (SELECT count(*) AS n, sum(z) AS sz, sum(z*z) AS szz FROM x WHERE s % 3 <> 1),
g AS (SELECT variant_id, sum(dosage) AS d, sum(dosage*z) AS dz FROM carriers JOIN x ON s = sample_idx WHERE s % 3 <> 1 GROUP BY 1),
b AS (SELECT v.variant_id, coalesce((szz*d - sz*dz)/(n*szz - sz*sz), 0) AS b0, coalesce((n*dz - sz*d)/(n*szz - sz*sz), 0) AS b1
  FROM variants v LEFT JOIN g USING (variant_id) CROSS JOIN t),
m AS (SELECT i, j, b.variant_id, least(greatest(b0 + b1*xi.z, 1e-4), 1.9999) AS mi, least(greatest(b0 + b1*xj.z, 1e-4), 1.9999) AS mj
  FROM q JOIN x xi ON xi.s = i JOIN x xj ON xj.s = j CROSS JOIN b)
SELECT i, j, round(sum((coalesce(ci.dosage, 0) - mi)*(coalesce(cj.dosage, 0) - mj))/sum(sqrt(2*mi*(1 - mi/2)*2*mj*(1 - mj/2))), 8) AS kinship
FROM m LEFT JOIN carriers ci ON ci.variant_id = m.variant_id AND ci.sample_idx = i LEFT JOIN carriers cj ON cj.variant_id = m.variant_id AND cj.sample_idx = j GROUP BY 1, 2)"""))
def g08(c: Cohort) -> DataFrame:
    """Kinship of candidate pairs and of their samples with themselves, all variants."""
    from ..session import cut_lineage

    pcs = c.samples.select("sample_idx", (F.col("sample_idx") % 7 / 7.0 - 0.4).alias("pc1"))
    train = c.samples.where("sample_idx % 3 <> 1")
    beta = cut_lineage(R.ancestry_regression(c.carriers, pcs, train, ["pc1"]))
    kin = R.pair_kinship(R.with_self_pairs(king_pairs(c)), c.carriers, c.variants, pcs, beta, ["pc1"])
    return kin.select("i", "j", rnd("kinship", 8))


# Weak links tie all families into one component; the threshold rises until they are gone.
@query("G10_refined_pairs", sql("samples", """
SELECT * FROM (WITH e AS (SELECT a.sample_idx AS i, a.sample_idx // 3 = b.sample_idx // 3 AS kin, 0.089 + (a.sample_idx % 5)*0.0005 AS weak
  FROM samples a JOIN samples b ON b.sample_idx = a.sample_idx + 1),
t AS (SELECT pow(2, -3.5)*pow(2, 0.01*min(k)) AS threshold FROM range(1, 200) r(k) WHERE pow(2, -3.5 + 0.01*k) >= (SELECT max(weak) FROM e WHERE NOT kin))
SELECT i, i + 2 AS j, round(threshold, 9) AS threshold FROM e CROSS JOIN t WHERE kin AND i % 3 = 0 AND i + 1 IN (SELECT i FROM e WHERE kin))"""))
def g10(c: Cohort) -> DataFrame:
    """Pairs that the second pass has to estimate, with the threshold that was reached."""
    i = F.col("sample_idx")
    nxt = c.samples.select((i - 1).alias("sample_idx"))
    pairs = c.samples.select("sample_idx").join(nxt, "sample_idx").select(
        i.alias("i"), (i + 1).alias("j"),
        F.when(F.floor(i / 3) == F.floor((i + 1) / 3), 0.25 + (i % 4) / 16).otherwise(0.089 + (i % 5) * 0.0005).alias("kinship"))
    threshold, components, _ = R.refine_threshold(pairs, R.kinship_threshold(2), 3)
    return R.new_component_pairs(components, pairs).select("i", "j", F.lit(round(threshold, 9)).alias("threshold"))


@query("G11_relatedness_job")
def g11(c: Cohort) -> DataFrame:
    """Pairs to kinship in one job: divergence, unrelated subset, components, kinship, threshold."""
    pairs = king_pairs(c)
    out = R.relatedness_matrix(pairs, c.carriers, c.variants, c.samples, _divergence(c), PC_COUNT, 2)
    return out["kinship"]
