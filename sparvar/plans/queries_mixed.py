"""Mixed models of related samples as registered queries.

The cohort's families have three members with kinship 0.5, so Sigma has two distinct
eigenvalues: lb for the family mean and lw within the family.  SQL finds them by fixed-point
rounds of the REML equations and inverts Sigma in closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mixed as X
from ..operators import nullmodel as NM
from .cohort import Cohort
from .oracle import CTES, sql
from .queries_score import genes
from .registry import query, rnd

#: Tight enough that rounded digits do not depend on where the steps end.
TOL = 1e-9


def related_phenotype(c: Cohort) -> DataFrame:
    """The cohort's phenotype with an effect that families share."""
    family = F.floor(F.col("sample_idx") / 3)
    return c.phenotype.withColumns({
        "yf": F.col("y") + (family * 7 % 13) * 500.0, "yg": F.col("y2") + (family * 5 % 11) * 300.0,
        "yfb": F.when(F.col("y") + (family * 7 % 13) * 150.0 > 5400.0, 1.0).otherwise(0.0), "visit": (F.col("sample_idx") % 4).cast("double"),
    })


def family_model(c: Cohort, tol: float = TOL) -> X.MixedModel:
    return X.fit_reml(X.build_families(related_phenotype(c), [c.kin_pairs], ["yf"], c.COVARIATES), tol=tol)


CTES["fpheno"] = "SELECT sample_idx, sample_idx // 3 AS family, y + ((sample_idx // 3)*7 % 13)*500.0 AS y, x1, x2 FROM pheno"

_VARS = ("x0", "x1", "x2", "y")
_CROSS = [(a, b) for i, a in enumerate(_VARS) for b in _VARS[i:]]


def _cross(kind: str, a: str, b: str) -> str:
    return f"{kind}_{a}_{b}" if (a, b) in _CROSS else f"{kind}_{b}_{a}"


# Cross-products of family means (b_) and of what is left within families (w_).
CTES["fsums"] = f"""
SELECT nb, nw, {', '.join(f'b.b_{a}_{b}' for a, b in _CROSS)}, {', '.join(f't.t_{a}_{b} - b.b_{a}_{b} AS w_{a}_{b}' for a, b in _CROSS)}
FROM (SELECT CAST(count(*) AS DOUBLE) - count(DISTINCT family) AS nw, {', '.join(f'sum({a}*{b}) AS t_{a}_{b}' for a, b in _CROSS)} FROM (SELECT *, 1.0::DOUBLE AS x0 FROM fpheno)) t,
(SELECT CAST(count(*) AS DOUBLE) AS nb, {', '.join(f'sum({a}*{b}/x0) AS b_{a}_{b}' for a, b in _CROSS)}
  FROM (SELECT family, CAST(count(*) AS DOUBLE) AS x0, sum(x1) AS x1, sum(x2) AS x2, sum(y) AS y FROM fpheno GROUP BY 1)) b"""

_X = ("x0", "x1", "x2")


def _solved(src: str) -> str:
    """``src`` with columns lb, lw and the sums of fsums: adds c00..c22 = (X'S^-1X)^-1 and a0..a2."""
    m = ", ".join(f"{_cross('w', a, b)}/lw + {_cross('b', a, b)}/lb AS m{i}{j}" for i, a in enumerate(_X) for j, b in enumerate(_X) if j >= i)
    t = ", ".join(f"{_cross('w', a, 'y')}/lw + {_cross('b', a, 'y')}/lb AS t{i}" for i, a in enumerate(_X))
    return f"""(SELECT *, c00*t0 + c01*t1 + c02*t2 AS a0, c01*t0 + c11*t1 + c12*t2 AS a1, c02*t0 + c12*t1 + c22*t2 AS a2 FROM (
  SELECT *, (m11*m22 - m12*m12)/det AS c00, (m02*m12 - m01*m22)/det AS c01, (m01*m12 - m02*m11)/det AS c02,
    (m00*m22 - m02*m02)/det AS c11, (m01*m02 - m00*m12)/det AS c12, (m00*m11 - m01*m01)/det AS c22
  FROM (SELECT *, m00*(m11*m22 - m12*m12) - m01*(m01*m22 - m12*m02) + m02*(m01*m12 - m11*m02) AS det FROM (SELECT *, {m}, {t} FROM {src}))))"""


def _left(kind: str) -> str:
    """Squares that the fit leaves in a space, and the trace of what the covariates take there."""
    quad = " + ".join(f"a{i}*a{j}*{_cross(kind, a, b)}" for i, a in enumerate(_X) for j, b in enumerate(_X))
    lin = " + ".join(f"a{i}*{_cross(kind, a, 'y')}" for i, a in enumerate(_X))
    trace = " + ".join(f"c{min(i, j)}{max(i, j)}*{_cross(kind, a, b)}" for i, a in enumerate(_X) for j, b in enumerate(_X))
    return f"({kind}_y_y - 2*({lin}) + {quad})/(n{kind} - ({trace})/l{kind})"


CTES["feig"] = f"""
SELECT * FROM (WITH RECURSIVE it(i, lb, lw) AS (
  SELECT 0, b_y_y/nb, w_y_y/nw FROM fsums
  UNION ALL SELECT i + 1, {_left('b')}, {_left('w')} FROM {_solved('(SELECT * FROM it CROSS JOIN fsums WHERE i < 80)')})
SELECT lb, lw FROM it WHERE i = 80)"""
CTES["fmodel"] = f"SELECT lb, lw, (lb - lw)/1.5 AS tk, lb - 2*(lb - lw)/1.5 AS te, a0, a1, a2, c00, c01, c02, c11, c12, c22 FROM {_solved('(SELECT * FROM feig CROSS JOIN fsums)')}"
CTES["fpy"] = """
SELECT sample_idx, family, x1, x2, e/lw + (1/lb - 1/lw)*avg(e) OVER (PARTITION BY family) AS py
FROM (SELECT *, y - a0 - a1*x1 - a2*x2 AS e FROM fpheno CROSS JOIN fmodel)"""


@query("N06_kinship_null", sql("fpy fmodel", """
SELECT sample_idx, round(py*1e6, 4) AS py, round(tk, 0) AS tau_kinship, round(te, 0) AS tau_residual, round(tk/(tk + te), 6) AS heritability FROM fpy CROSS JOIN fmodel"""))
def n06(c: Cohort) -> DataFrame:
    """Variance components and the projected response of every sample."""
    m = family_model(c)
    lit = lambda v, d, name: F.round(F.lit(float(v)), d).alias(name)
    return m.projected.select("sample_idx", rnd(F.col("py") * 1e6, 4, "py"), lit(m.tau[0], 0, "tau_kinship"), lit(m.tau[1], 0, "tau_residual"), lit(m.heritability[0], 6, "heritability"))


# Genotypes against the inverse: 1/lw on the diagonal, and (1/lb - 1/lw)/3 between and within family members.
CTES["fscore"] = """
SELECT variant_id, sum(d*py) AS u, sum(d)::BIGINT AS mac,
  sum(d*d)/any_value(lw) + any_value((1/lb - 1/lw)/3)*sum(d*fd) AS gg, sum(d)/any_value(lw) + any_value((1/lb - 1/lw)/3)*sum(d*3.0) AS h0,
  sum(d*x1)/any_value(lw) + any_value((1/lb - 1/lw)/3)*sum(d*f1) AS h1, sum(d*x2)/any_value(lw) + any_value((1/lb - 1/lw)/3)*sum(d*f2) AS h2
FROM (SELECT variant_id, family, CAST(dosage AS DOUBLE) AS d, py, x1, x2, lb, lw, f1, f2, sum(CAST(dosage AS DOUBLE)) OVER (PARTITION BY variant_id, family) AS fd
  FROM carriers JOIN fpy USING (sample_idx) JOIN (SELECT family, sum(x1) AS f1, sum(x2) AS f2 FROM fpheno GROUP BY 1) USING (family) CROSS JOIN fmodel) GROUP BY 1"""
_HCH = "h0*h0*c00 + h1*h1*c11 + h2*h2*c22 + 2*(h0*h1*c01 + h0*h2*c02 + h1*h2*c12)"


@query("T02_kinship_scores", sql("fscore fmodel", f"""
SELECT variant_id, mac, round(u*1e6, 3) AS u, round((gg - ({_HCH}))*1e9, 4) AS k, round(u*u/(gg - ({_HCH})), 6) AS stat FROM fscore CROSS JOIN fmodel"""))
def t02(c: Cohort) -> DataFrame:
    """Scores and projected variances of all variants under kinship."""
    t = X.kinship_individual_tests(c.carriers, family_model(c))
    return t.select("variant_id", "mac", rnd(F.col("u") * 1e6, 3, "u"), rnd(F.col("k") * 1e9, 4, "k"), rnd("stat", 6))


@query("T02_kinship_gene_covariance", sql("gm fscore fmodel fpy carriers", """
WITH g AS (SELECT set_id, variant_id FROM gm), d AS (SELECT set_id, variant_id, sample_idx, family, CAST(dosage AS DOUBLE) AS d FROM g JOIN carriers USING (variant_id) JOIN fpy USING (sample_idx)),
f AS (SELECT set_id, variant_id, family, sum(d) AS d FROM d GROUP BY 1, 2, 3),
own AS (SELECT a.set_id, a.variant_id AS v, b.variant_id AS w, sum(a.d*b.d) AS s FROM d a JOIN d b USING (set_id, sample_idx) GROUP BY 1, 2, 3),
fam AS (SELECT a.set_id, a.variant_id AS v, b.variant_id AS w, sum(a.d*b.d) AS s FROM f a JOIN f b USING (set_id, family) GROUP BY 1, 2, 3),
p AS (SELECT a.set_id, a.variant_id AS v, b.variant_id AS w FROM g a JOIN g b USING (set_id)),
k AS (SELECT p.set_id, p.v, p.w, coalesce(own.s, 0)/lw + (1/lb - 1/lw)/3*coalesce(fam.s, 0)
    - (x.h0*(c00*y.h0 + c01*y.h1 + c02*y.h2) + x.h1*(c01*y.h0 + c11*y.h1 + c12*y.h2) + x.h2*(c02*y.h0 + c12*y.h1 + c22*y.h2)) AS k
  FROM p LEFT JOIN own USING (set_id, v, w) LEFT JOIN fam USING (set_id, v, w) JOIN fscore x ON x.variant_id = p.v JOIN fscore y ON y.variant_id = p.w CROSS JOIN fmodel)
SELECT set_id, CAST(round(sqrt(count(*))) AS BIGINT) AS n_variants, round(sum(CASE WHEN v = w THEN k ELSE 0 END)*1e6, 4) AS trace, round(sum(k)*1e6, 4) AS total, round(sqrt(sum(k*k))*1e6, 4) AS norm FROM k GROUP BY 1"""))
def t02_genes(c: Cohort) -> DataFrame:
    """Trace, sum and norm of every gene's whole covariance, from cross-products of whitened carriers."""
    from ..operators import gram
    from ..operators.score import h_cols, quad_form, variant_scores
    from ..session import cut_lineage

    m = family_model(c)
    null, white = m.null, cut_lineage(X.whiten(c.carriers, m))
    ranked = cut_lineage(gram.rank_members(genes(c).select("set_id", "variant_id")))
    cells = gram.pair_products(ranked, white, null.vectors.select("sample_idx", "w"))
    hs = h_cols(null)
    h = cut_lineage(ranked.join(variant_scores(white, null).select("variant_id", *hs), "variant_id").select("set_id", "j", *hs))
    # K = S - H C H': its trace, sum and square follow from the non-zero cells and the sums of H, so no pair without a cell is made.
    p, c = range(len(hs)), null.cov_inv
    sums = h.groupBy("set_id").agg(F.count("*").alias("n_variants"), *[F.sum(x).alias(f"t_{x}") for x in hs], *[F.sum(F.col(hs[i]) * F.col(hs[j])).alias(f"m_{i}_{j}") for i in p for j in p])
    a, b = (h.select("set_id", F.col("j").alias(f"j{i}"), *[F.col(x).alias(f"{x}_{i}") for x in hs]) for i in (1, 2))
    met = cells.join(a, ["set_id", "j1"]).join(b, ["set_id", "j2"]).withColumn("e", quad_form(c, [f"{x}_1" for x in hs], [f"{x}_2" for x in hs]))
    twice = F.when(F.col("j1") == F.col("j2"), 1.0).otherwise(2.0)
    seen = met.groupBy("set_id").agg(
        F.sum(F.when(F.col("j1") == F.col("j2"), F.col("s")).otherwise(0.0)).alias("s1"), F.sum(twice * F.col("s")).alias("s_all"),
        F.sum(twice * F.col("s") * (F.col("s") - 2 * F.col("e"))).alias("s2"))
    turned = [[sum((F.lit(float(c[i, k])) * F.col(f"m_{k}_{j}") for k in p), F.lit(0.0)) for j in p] for i in p]
    lost, lost2 = sum((turned[i][i] for i in p), F.lit(0.0)), sum((turned[i][j] * turned[j][i] for i in p for j in p), F.lit(0.0))
    out = sums.join(seen, "set_id", "left").fillna(0.0, subset=["s1", "s_all", "s2"]).select(
        "set_id", "n_variants", (F.col("s1") - lost).alias("trace"), (F.col("s_all") - quad_form(c, [f"t_{x}" for x in hs])).alias("total"), F.sqrt(F.col("s2") + lost2).alias("norm"))
    return out.select("set_id", "n_variants", *[rnd(F.col(x) * 1e6, 4, x) for x in ("trace", "total", "norm")])


@query("T02_kinship_set_tests")
def t02_sets(c: Cohort) -> DataFrame:
    """All 72 p-values of every gene under kinship; tests/test_mixed.py holds them against dense matrices."""
    t = X.kinship_set_tests(genes(c), c.carriers, family_model(c, X.TOL))
    return t.select("set_id", "n_variants", F.transform("p", lambda p: F.round(p, 8)).alias("p"))


@query("N07_residual_groups")
def n07(c: Cohort) -> DataFrame:
    """A residual variance for every ancestry, the codes from labels in order of their first sample."""
    pheno = NM.intern_labels(related_phenotype(c), "ancestry")
    n = pheno.agg(F.max("code").alias("n")).first()["n"] + 1
    m = X.fit_reml(X.build_families(pheno, [c.kin_pairs], ["yf"], c.COVARIATES, "code", n))
    return components(m)


def components(m: X.MixedModel) -> DataFrame:
    """Projected responses beside the variance components."""
    slots = F.create_map(*[F.lit(x) for s, t in zip(m.families.slots, m.tau, strict=True) for x in (s, float(f"{t:.6g}"))])
    return m.projected.select("sample_idx", "trait", rnd(F.col("py") * 1e6, 4, "py"), slots.alias("tau"))


@query("N08_random_slope")
def n08(c: Cohort) -> DataFrame:
    m = X.fit_reml(X.build_families(related_phenotype(c), [c.kin_pairs], ["yf"], c.COVARIATES, time="visit"))
    return components(m)


@query("N09_binary_mixed_model")
def n09(c: Cohort) -> DataFrame:
    m = X.fit_pql(related_phenotype(c), [c.kin_pairs], "yfb", c.COVARIATES)
    return m.projected.select("sample_idx", rnd("py", 6), F.lit(float(f"{m.tau[0]:.5g}")).alias("tau_kinship"), F.lit(float(f"{m.tau[1]:.5g}")).alias("dispersion"), F.lit(m.converged).alias("converged"))


@query("N10_multi_trait_kinship_null")
def n10(c: Cohort) -> DataFrame:
    return components(two_traits(c))


def two_traits(c: Cohort) -> X.MixedModel:
    return X.fit_reml(X.build_families(related_phenotype(c), [c.kin_pairs], ["yf", "yg"], c.COVARIATES))


@query("T23_multi_trait_kinship_sets")
def t23(c: Cohort) -> DataFrame:
    """Joint battery of two traits per gene under kinship."""
    t = X.kinship_multi_set_tests(genes(c), c.carriers, two_traits(c))
    return t.select("set_id", "n_variants", F.transform("p", lambda p: F.round(p, 8)).alias("p"))
