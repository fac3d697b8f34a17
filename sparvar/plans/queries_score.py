"""Null models, score statistics and set tests as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import nullmodel as NM
from ..operators import score as S
from .cohort import Cohort
from .oracle import CTES, beta25, cauchy, chi2_1, quad, sql
from .registry import query, rnd


def gaussian(c: Cohort, keep: list[str] = ()) -> NM.NullModel:
    return NM.fit_gaussian(c.phenotype, "y", c.COVARIATES, keep)


def logistic(c: Cohort, keep: list[str] = ()) -> NM.NullModel:
    return NM.fit_logistic(c.phenotype, "yb", c.COVARIATES, keep)


@query("T15_individual_test", sql("vscore", f"""
SELECT variant_id, mac, round(mac/(2.0*n), 9) AS alt_af, round(u/s2, 9) AS score, round(sqrt(k/s2), 9) AS score_se,
  round(u/k, 4) AS est, round(1/sqrt(k/s2), 4) AS est_se, round({chi2_1('u*u/(s2*k)')}, 9) AS pvalue FROM vscore"""))
def t15(c: Cohort) -> DataFrame:
    t = S.individual_tests(c.carriers, gaussian(c))
    return t.select("variant_id", "mac", rnd("alt_af", 9), rnd("score", 9), rnd("score_se", 9), rnd("est", 4), rnd("est_se", 4), rnd("pvalue", 9))


# ------------------------------------------------------------ sums and models


@query("A11_A12_variant_sums", sql("vscore", "SELECT variant_id, round(u, 3) AS u, h0, h1, h2, gg, round(k, 6) AS k, mac FROM vscore"))
def a11(c: Cohort) -> DataFrame:
    t = S.variant_scores(c.carriers, gaussian(c))
    return t.select("variant_id", rnd("u", 3), "h0", "h1", "h2", "gg", rnd("k", 6), F.col("mac").cast("long").alias("mac"))


@query("A12_weighted_variant_sums", sql("lscore", "SELECT variant_id, round(u, 7) AS u, round(h0, 7) AS h0, round(h1, 6) AS h1, round(h2, 7) AS h2, round(k, 6) AS k FROM lscore"))
def a12(c: Cohort) -> DataFrame:
    t = S.variant_scores(c.carriers, logistic(c))
    return t.select("variant_id", rnd("u", 7), rnd("h0", 7), rnd("h1", 6), rnd("h2", 7), rnd("k", 6))


CTES["gm"] = "SELECT m.gene_name AS set_id, rare.* EXCLUDE (gene_name) FROM rare JOIN membership m USING (variant_id)"
CTES["gm_fine"] = "SELECT m.gene_name AS set_id, rare_fine.* EXCLUDE (gene_name) FROM rare_fine JOIN membership m ON m.variant_id = rare_fine.variant_id // 3"


def genes(c: Cohort, fine: bool = False, masks: bool = False) -> DataFrame:
    from ..operators.settests import gene_members

    return gene_members(c.rare_index(fine), c.membership_fine if fine else c.membership, masks)


@query("A13_T26_pair_products", sql("gm carriers", """
SELECT set_id, least(a.variant_id, b.variant_id) AS v1, greatest(a.variant_id, b.variant_id) AS v2, sum(a.dosage*b.dosage)::DOUBLE AS s
FROM (SELECT set_id, variant_id, sample_idx, dosage FROM gm JOIN carriers USING (variant_id)) a
JOIN (SELECT set_id, variant_id, sample_idx, dosage FROM gm JOIN carriers USING (variant_id)) b USING (set_id, sample_idx)
WHERE a.variant_id <= b.variant_id GROUP BY 1, 2, 3"""))
def a13(c: Cohort) -> DataFrame:
    """Cross-products per gene from chunked matrix products (the path without a size limit)."""
    from ..operators import gram

    ranked = gram.rank_members(genes(c))
    cells = gram.pair_products(ranked, c.carriers, gaussian(c).vectors.select("sample_idx", "w"), chunk_rows=20_000, tile=64)
    ids = ranked.select("set_id", "j", "variant_id")
    a = ids.withColumnsRenamed({"j": "j1", "variant_id": "va"})
    b = ids.withColumnsRenamed({"j": "j2", "variant_id": "vb"})
    return cells.join(a, ["set_id", "j1"]).join(b, ["set_id", "j2"]).select(
        "set_id", F.least("va", "vb").alias("v1"), F.greatest("va", "vb").alias("v2"), "s")


@query("A14_T17_population_maf", sql("carriers pheno", """
SELECT variant_id, ancestry, sum(dosage)::BIGINT AS mac, round(sum(dosage)/(2.0*n_pop), 9) AS pop_maf
FROM carriers JOIN pheno USING (sample_idx) JOIN (SELECT ancestry, count(*) AS n_pop FROM pheno GROUP BY 1) USING (ancestry) GROUP BY 1, 2, n_pop"""))
def a14(c: Cohort) -> DataFrame:
    from ..operators.settests import population_frequencies

    return population_frequencies(c.carriers, c.phenotype, "ancestry").withColumn("pop_maf", rnd("pop_maf", 9))


@query("A15_N01_gaussian_null", sql("beta sig", "SELECT n, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(s2, 2) AS sigma2 FROM beta CROSS JOIN sig"))
def n01(c: Cohort) -> DataFrame:
    m = gaussian(c)
    return m.vectors.agg(
        F.count("*").alias("n"), *[F.round(F.lit(float(b)), 6).alias(f"b{i}") for i, b in enumerate(m.beta)],
        rnd(F.lit(m.sigma2), 2, "sigma2"))


@query("N01_residuals", sql("nm", "SELECT sample_idx, round(r, 5) AS r FROM nm"))
def n01r(c: Cohort) -> DataFrame:
    return gaussian(c).vectors.select("sample_idx", rnd("r", 5))


@query("N02_logistic_null", sql("lnm", "SELECT sample_idx, round(r, 7) AS r, round(mu, 7) AS mu, round(w, 7) AS w FROM lnm"))
def n02(c: Cohort) -> DataFrame:
    return logistic(c).vectors.select("sample_idx", rnd("r", 7), rnd("mu", 7), rnd("w", 7))


@query("A16_N03_multi_gaussian_null", sql("nm", "SELECT count(*) AS n, round(sum(r*r)/(count(*)-3), 1) AS s11, round(sum(r*r2)/(count(*)-3), 1) AS s12, round(sum(r2*r2)/(count(*)-3), 1) AS s22 FROM nm"))
def n03(c: Cohort) -> DataFrame:
    m = multi(c)
    s = m.extra["residual_cov"]
    return m.vectors.agg(F.count("*").alias("n"), *[
        F.round(F.lit(float(s[a, b])), 1).alias(f"s{a + 1}{b + 1}") for a, b in ((0, 0), (0, 1), (1, 1))])


def multi(c: Cohort) -> NM.NullModel:
    return NM.fit_gaussian_multi(c.phenotype, ["y", "y2"], c.COVARIATES)


_LMU = "1.0/(1.0 + exp(-(b0 + b1*x1 + b2*x2)))"


@query("N04_multi_binary_null", sql("pheno lbeta lbeta2", f"""
WITH a AS (SELECT sample_idx, yb - {_LMU} AS r1, {_LMU} AS m1 FROM pheno CROSS JOIN lbeta),
b AS (SELECT sample_idx, yb2 - {_LMU} AS r2, {_LMU} AS m2 FROM pheno CROSS JOIN lbeta2)
SELECT sample_idx, round(r1, 7) AS r0, round(r2, 7) AS r1, round((m1*(1-m1) + m2*(1-m2))/2, 7) AS w,
  round((SELECT sum(r1*r2)/sqrt(sum(r1*r1)*sum(r2*r2)) FROM a JOIN b USING (sample_idx)), 7) AS rho
FROM a JOIN b USING (sample_idx)"""))
def n04(c: Cohort) -> DataFrame:
    m = NM.fit_logistic_multi(c.phenotype, ["yb", "yb2"], c.COVARIATES)
    return m.vectors.select("sample_idx", rnd("r0", 7), rnd("r1", 7), rnd("w", 7), F.round(F.lit(float(m.extra["residual_cov"][0, 1])), 7).alias("rho"))


LOCI_SQL = "SELECT variant_id, row_number() OVER (ORDER BY variant_id) - 1 AS g FROM variants WHERE variant_id IN (7, 21)"


def two_loci(c: Cohort) -> DataFrame:
    return c.variants.filter(F.col("variant_id").isin(7, 21)).select("variant_id")


@query("C09_P25_known_locus_columns", sql("carriers samples", """
SELECT sample_idx, coalesce(max(dosage) FILTER (WHERE variant_id = 7), 0)::DOUBLE AS g0, coalesce(max(dosage) FILTER (WHERE variant_id = 21), 0)::DOUBLE AS g1
FROM samples LEFT JOIN (SELECT * FROM carriers WHERE variant_id IN (7, 21)) USING (sample_idx) GROUP BY 1"""))
def c09(c: Cohort) -> DataFrame:
    t, names = NM.known_locus_dosages(c.carriers, two_loci(c), c.samples)
    return t.select("sample_idx", *names)


@query("N05_conditional_null")
def n05(c: Cohort) -> DataFrame:
    """Conditional fit: residuals are orthogonal to the added locus columns."""
    t, names = NM.known_locus_dosages(c.carriers, two_loci(c), c.phenotype)
    m = NM.fit_gaussian(t, "y", c.COVARIATES + names)
    return m.vectors.agg(
        F.count("*").alias("n"), *[F.round(F.sum(F.col("r") * F.col(x)), 4).alias(f"orth_{x}") for x in m.x_cols],
        F.round(F.sum(F.col("r") * F.col("r")), 2).alias("rss"))


@query("A20_subset_frequency", sql("carriers samples", """
SELECT variant_id, round(mu, 9) AS mu, round(CASE WHEN 2*mu*(1-mu) > 1e-10 THEN 1/sqrt(2*mu*(1-mu)) ELSE 0 END, 6) AS inv_sd FROM (
  SELECT variant_id, sum(dosage)/(2.0*(SELECT count(*) FROM samples WHERE sample_idx % 3 <> 0)) AS mu FROM carriers WHERE sample_idx % 3 <> 0 GROUP BY 1)"""))
def a20(c: Cohort) -> DataFrame:
    from ..operators.relate import subset_frequencies

    sub = c.samples.filter("sample_idx % 3 <> 0")
    return subset_frequencies(c.carriers, sub, sub.count()).select("variant_id", rnd("mu", 9), rnd("inv_sd", 6))


# --------------------------------------------------------------------- set tests


@query("T04_beta_weights", sql("freq", f"SELECT variant_id, round({beta25()}, 8) AS b25, CASE WHEN maf > 0 AND maf < 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS b11, round(({beta25()})*({beta25()})*pi()*pi()*maf*(1-maf), 8) AS v25 FROM freq"))
def t04(c: Cohort) -> DataFrame:
    return S.beta_columns(c.frequencies()).select("variant_id", rnd("b25", 8), "b11", rnd("v25", 8))


def _burden_sql(weights: dict[str, str], gm: str = "gm", car: str = "carriers", nm: str = "nm", cv: str = "cv", extra: str = "") -> dict[str, str]:
    """CTEs bstat(set_id, weight, wu, wkw, s2): linear burden sums."""
    w = list(weights)
    bs = f"SELECT set_id, sample_idx, {', '.join(f'sum(({weights[k]})*dosage) AS b_{k}' for k in w)} FROM {gm} JOIN {car} USING (variant_id) {extra} GROUP BY 1, 2"
    agg = ", ".join(f"sum(b_{k}*r) AS u_{k}, sum(b_{k}*b_{k}*w) AS g_{k}, sum(b_{k}*w) AS {k}_0, sum(b_{k}*w*x1) AS {k}_1, sum(b_{k}*w*x2) AS {k}_2" for k in w)
    gs = f"SELECT set_id, {agg} FROM bsamp JOIN {nm} USING (sample_idx) GROUP BY 1"
    st = " UNION ALL ".join(f"SELECT set_id, '{k}' AS weight, u_{k} AS wu, g_{k} - {quad(k + '_')} AS wkw, s2 FROM bsums CROSS JOIN {cv}" for k in w)
    return {"bsamp": bs, "bsums": gs, "bstat": st}


@query("T05_burden", sql("", f"SELECT set_id, weight, round(wu, 2) AS wu, round(wkw, 5) AS wkw, round(wu*wu/(s2*wkw), 7) AS stat, round({chi2_1('wu*wu/(s2*wkw)')}, 9) AS p FROM bstat",
                          **_burden_sql({"b25": beta25(), "b11": "1.0", "b25w0": f"({beta25()})*w0"})))
def t05(c: Cohort) -> DataFrame:
    """Burden tests from linear sums: no covariance matrix, no group in one task."""
    m = S.beta_columns(genes(c)).withColumn("b25w0", F.col("b25") * F.col("w0"))
    t = S.burden_statistics(m, c.carriers, gaussian(c), ["b25", "b11", "b25w0"])
    return t.select("set_id", "weight", rnd("wu", 2), rnd("wkw", 5), rnd("stat", 7), rnd("p", 9))


@query("T05_burden_binary", sql("", f"SELECT set_id, weight, round(wu, 6) AS wu, round(wkw, 5) AS wkw, round({chi2_1('wu*wu/(s2*wkw)')}, 8) AS p FROM bstat",
                                 **_burden_sql({"b11": "1.0"}, nm="lnm", cv="lcv")))
def t05b(c: Cohort) -> DataFrame:
    t = S.burden_statistics(S.beta_columns(genes(c)), c.carriers, logistic(c), ["b11"])
    return t.select("set_id", "weight", rnd("wu", 6), rnd("wkw", 5), rnd("p", 8))


_W24 = {f"c{c}t{t}": (f"({beta25()})" if t == 0 else "1.0") + ("" if c == 0 else f"*w{c - 1}") for c in range(12) for t in range(2)}


@query("T11_T12_T24_gene_mask_burden_omnibus", sql("", f"""
SELECT split_part(set_id, '|', 1) AS set_id, split_part(set_id, '|', 2) AS mask,
  round(max(CASE WHEN weight = 'c0t0' THEN p END), 8) AS b_1_25, round(max(CASE WHEN weight = 'c0t1' THEN p END), 8) AS b_1_1,
  round({cauchy("CASE WHEN weight LIKE '%t0' THEN p END", "CASE WHEN weight LIKE '%t0' THEN 1.0 ELSE 0.0 END")}, 7) AS staar_b_1_25,
  round({cauchy("CASE WHEN weight LIKE '%t1' THEN p END", "CASE WHEN weight LIKE '%t1' THEN 1.0 ELSE 0.0 END")}, 7) AS staar_b_1_1
FROM (SELECT set_id, weight, CASE WHEN wkw > 0 THEN {chi2_1('wu*wu/(s2*wkw)')} ELSE 1.0 END AS p FROM bstat) GROUP BY set_id""",
    gmm="SELECT * FROM (SELECT m.gene_name || '|' || mask AS set_id, k.* EXCLUDE (gene_name, mask), count(*) OVER (PARTITION BY m.gene_name, mask) AS n_set FROM masked k JOIN membership m USING (variant_id)) WHERE n_set >= 2",
    **_burden_sql(_W24, gm="gmm")))
def t24(c: Cohort) -> DataFrame:
    """Gene x mask battery: covariance once per gene, sliced per mask, native omnibus."""
    from ..operators import settests as ST

    r = ST.with_omnibus(ST.set_tests(genes(c, masks=True), c.carriers, gaussian(c)))
    p = F.col("p")
    return r.select("set_id", "mask", rnd(p[0], 8, "b_1_25"), rnd(p[1], 8, "b_1_1"),
                    rnd("STAAR-B(1,25)", 7, "staar_b_1_25"), rnd("STAAR-B(1,1)", 7, "staar_b_1_1"))


_RW = {"b25": f"({beta25()})", "b11": "1.0", "b25w3": f"({beta25()})*w3"}
_AC = {"b25": f"({beta25()})*({beta25()})", "b11": "1.0", "b25w3": f"({beta25()})*({beta25()})*w3"}


@query("T08_acat_v", sql("vscore_fine", f"""
SELECT set_id, weight, round({cauchy('p', 'cw')}, 7) AS p FROM (
  SELECT set_id, weight, {chi2_1('u*u/(s2*k)')} AS p, wa AS cw FROM wl JOIN vscore_fine USING (variant_id) WHERE common AND k > 0 AND wa > 0
  UNION ALL
  SELECT b.set_id, b.weight, {chi2_1('wu*wu/(s2*wkw)')} AS p, cw FROM bstat b JOIN
    (SELECT set_id, weight, avg(wa) AS cw FROM wl WHERE NOT common AND wa > 0 GROUP BY 1, 2) q USING (set_id, weight) WHERE wkw > 0
) GROUP BY 1, 2""",
    gt="SELECT *, round(2*maf*(SELECT count(*) FROM customer)) > 10 AS common FROM gm_fine",
    gr="SELECT * FROM gt WHERE NOT common",
    wl=" UNION ALL ".join(f"SELECT set_id, variant_id, common, '{k}' AS weight, ({v})*pi()*pi()*maf*(1-maf) AS wa FROM gt" for k, v in _AC.items()),
    **_burden_sql(_RW, gm="gr", car="carriers_fine")))
def t08(c: Cohort) -> DataFrame:
    """ACAT-V over fine genotypes: common variants singly, rare ones pooled."""
    from ..operators import settests as ST

    r = ST.set_tests(genes(c, fine=True), c.carriers_fine, gaussian(c))
    p = F.col("p")
    return r.select("set_id", F.explode(F.array(
        F.struct(F.lit("b25").alias("weight"), rnd(p[4], 7, "p")), F.struct(F.lit("b11").alias("weight"), rnd(p[5], 7, "p")),
        F.struct(F.lit("b25w3").alias("weight"), rnd(p[4 + 6 * 4], 7, "p")))).alias("s")).select("set_id", "s.*")


_CROSS = ("c00*a.h0*b.h0 + c11*a.h1*b.h1 + c22*a.h2*b.h2 + c01*(a.h0*b.h1 + a.h1*b.h0) + c02*(a.h0*b.h2 + a.h2*b.h0) + c12*(a.h1*b.h2 + a.h2*b.h1)")
_KCTES = dict(
    gv="SELECT set_id, variant_id, maf, u, h0, h1, h2, k FROM gm JOIN vscore USING (variant_id)",
    gc="SELECT set_id, variant_id, sample_idx, dosage FROM gm JOIN carriers USING (variant_id)",
    gx="SELECT a.set_id, a.variant_id AS v1, b.variant_id AS v2, sum(a.dosage*b.dosage)::DOUBLE AS s FROM gc a JOIN gc b USING (set_id, sample_idx) GROUP BY 1, 2, 3",
    kd=f"SELECT a.set_id, a.variant_id AS v1, b.variant_id AS v2, (coalesce(s, 0) - ({_CROSS}))/s2 AS k, a.maf AS m1, b.maf AS m2 FROM gv a JOIN gv b ON a.set_id = b.set_id CROSS JOIN cv LEFT JOIN gx ON gx.set_id = a.set_id AND v1 = a.variant_id AND v2 = b.variant_id",
)
_LIU = """
SELECT set_id, weight, q, c1, c2, c3, c4, CASE WHEN nc THEN greatest(a*a - 2*delta, 0.5) ELSE greatest(1/(sk*sk), 0.5) END AS df, a, CASE WHEN nc THEN delta ELSE 0 END AS delta FROM (
  SELECT *, greatest(sk*a*a*a - a*a, 0) AS delta FROM (
    SELECT *, CASE WHEN nc THEN 1/(sk - sqrt(sk*sk - ku)) ELSE 1/sk END AS a FROM (
      SELECT *, c3/pow(c2, 1.5) AS sk, c4/(c2*c2) AS ku, pow(c3/pow(c2, 1.5), 2) > c4/(c2*c2) AS nc FROM moments)))"""
_LIU_P = """
SELECT set_id, weight, CASE WHEN x <= 0 THEN 1.0 ELSE 1 - exp(-xe/2 + dfe/2*ln(xe/2) - lgamma(dfe/2 + 1))*(1 + list_sum(list_transform(range(1, 400),
  lambda k: exp(k*ln(xe/2) - lgamma(dfe/2 + k + 1) + lgamma(dfe/2 + 1))))) END AS p FROM (
  SELECT *, CASE WHEN delta > 0 THEN pow(df + delta, 2)/(df + 2*delta) ELSE df END AS dfe,
    CASE WHEN delta > 0 THEN x*(df + 2*delta)/(df + delta) ELSE x END AS xe FROM (
    SELECT *, (q - c1)/sqrt(2*c2)*sqrt(2)*a + df + delta AS x FROM liu))"""


def _skat_ctes() -> dict[str, str]:
    wt = {"b25": ("(25*pow(1 - m1, 24))*(25*pow(1 - m2, 24))", "25*pow(1 - maf, 24)"), "b11": ("1.0", "1.0")}
    ka = " UNION ALL ".join(f"SELECT set_id, '{k}' AS weight, v1, v2, k*{a} AS a FROM kd" for k, (a, _) in wt.items())
    q = " UNION ALL ".join(f"SELECT set_id, '{k}' AS weight, sum(pow({b}*u/s2, 2)) AS q FROM gv CROSS JOIN cv GROUP BY 1" for k, (_, b) in wt.items())
    return {
        **_KCTES, "ka": ka, "qs": q,
        "ks": "SELECT x.set_id, x.weight, x.v1, y.v2, sum(x.a*y.a) AS a2 FROM ka x JOIN ka y ON x.set_id = y.set_id AND x.weight = y.weight AND x.v2 = y.v1 GROUP BY 1, 2, 3, 4",
        "moments": "SELECT set_id, weight, q, sum(CASE WHEN v1 = v2 THEN a ELSE 0 END) AS c1, sum(a*a) AS c2, sum(a*a2) AS c3, sum(a2*a2) AS c4 FROM ka JOIN ks USING (set_id, weight, v1, v2) JOIN qs USING (set_id, weight) GROUP BY 1, 2, 3",
        "liu": _LIU, "liup": _LIU_P,
    }


@query("T06_T07_skat", sql("", "SELECT set_id, weight, round(p, 6) AS p FROM liup", **_skat_ctes()))
def t06(c: Cohort) -> DataFrame:
    from ..operators import settests as ST

    r = ST.set_tests(genes(c), c.carriers, gaussian(c))
    p = F.col("p")
    return r.select("set_id", F.explode(F.array(
        F.struct(F.lit("b25").alias("weight"), rnd(p[2], 6, "p")), F.struct(F.lit("b11").alias("weight"), rnd(p[3], 6, "p")))).alias("s")).select("set_id", "s.*")


@query("T26_large_set_path", sql("", "SELECT set_id, weight, round(p, 6) AS p FROM liup", **_skat_ctes()))
def t26(c: Cohort) -> DataFrame:
    """The path for sets no task can hold, forced here for every gene."""
    from ..operators import settests as ST

    r = ST.large_set_tests(genes(c).select("set_id", "variant_id", "maf", *ST.W_COLS), c.carriers, gaussian(c), tile=64)
    p = F.col("p")
    return r.select("set_id", F.explode(F.array(
        F.struct(F.lit("b25").alias("weight"), rnd(p[2], 6, "p")), F.struct(F.lit("b11").alias("weight"), rnd(p[3], 6, "p")))).alias("s")).select("set_id", "s.*")


@query("T01_gene_covariance", sql("", "SELECT set_id, count(*) AS m, round(sum(k), 9) AS v_trace, round(sum(u), 7) AS u_sum FROM (SELECT set_id, u/s2 AS u, gv.k/s2 AS k FROM gv CROSS JOIN cv) GROUP BY 1", gv=_KCTES["gv"]))
def t01(c: Cohort) -> DataFrame:
    t = S.effect_sums(S.variant_scores(c.carriers, gaussian(c)), gaussian(c))
    return genes(c).select("set_id", "variant_id").join(t, "variant_id").groupBy("set_id").agg(
        F.count("*").alias("m"), F.round(F.sum("v_stat"), 9).alias("v_trace"), F.round(F.sum("u_stat"), 7).alias("u_sum"))


@query("T03_S24_cached_scores", sql("", f"""
SELECT set_id, count(*) AS n_cells, round(sum(CASE WHEN v1 = v2 THEN k ELSE 2*k END), 9) AS total FROM kd WHERE v1 <= v2 AND v1 % 2 = 0 AND v2 % 2 = 0 GROUP BY 1""", **_KCTES))
def t03(c: Cohort) -> DataFrame:
    """Stored U and K are sliced to a subset of variants without touching genotypes."""
    from ..operators import scorecache
    from ..session import scratch_path

    path = scratch_path(c.spark, "scores")
    scorecache.save(path, genes(c), c.carriers, gaussian(c))
    k = scorecache.cell_totals(c.spark, path, c.variants.filter("variant_id % 2 = 0").select("variant_id"))
    return k.select("set_id", "n_cells", rnd("total", 9))


@query("T09_T10_cauchy", sql(
    "", "SELECT l_returnflag AS g, round(" + cauchy("p", "w") + ", 7) AS p FROM lp GROUP BY 1",
    lp=f"SELECT l_returnflag, {chi2_1('l_discount*40 + 0.1')} AS p, l_quantity - 10.0 AS w FROM lineitem"))
def t09(c: Cohort) -> DataFrame:
    from ..functions.prob import cauchy_combine, chi2_sf

    t = c.table("lineitem").withColumn("p", chi2_sf(F.col("l_discount") * 40 + 0.1))
    return t.groupBy(F.col("l_returnflag").alias("g")).agg(rnd(cauchy_combine(F.col("p"), F.col("l_quantity") - 10.0), 7, "p"))


@query("X05_tail_functions", f"SELECT l_orderkey, l_linenumber, round({chi2_1('l_quantity/5')}, 9) AS c1, round(exp(-l_quantity/10), 9) AS c2, round(exp(-l_quantity/10)*(1 + l_quantity/10), 9) AS c4 FROM lineitem")
def x05(c: Cohort) -> DataFrame:
    from ..functions.prob import chi2_sf

    x = F.col("l_quantity") / 5
    return c.table("lineitem").select(
        "l_orderkey", "l_linenumber", rnd(chi2_sf(x, 1), 9, "c1"), rnd(chi2_sf(x, 2), 9, "c2"), rnd(chi2_sf(x, 4), 9, "c4"))


# ---------------------------------------------------------------- special modes


def _upper(z: str) -> str:
    """Upper normal tail from the chi-square one."""
    return f"CASE WHEN ({z}) >= 0 THEN ({chi2_1(f'({z})*({z})')})/2 ELSE 1 - ({chi2_1(f'({z})*({z})')})/2 END"


def _slope_sql(t: str) -> str:
    e = f"exp(least(greatest(({t})*g, -500), 500))"
    return f"sum(g*mu*({e}/(1 - mu + mu*{e}) - 1))"


# The same root by plain bisection: bracket by powers of eight, then halve sixty times.
_SPA = {
    "spa_st": f"""SELECT variant_id, score, v, {chi2_1('score*score/v')} AS p_normal FROM (
  SELECT variant_id, sum(dosage*r) AS score, sum(mu*(1-mu)*dosage*dosage) AS v FROM carriers JOIN lnm USING (sample_idx) GROUP BY 1)""",
    "spa_rows": "SELECT variant_id, CAST(dosage AS DOUBLE) AS g, mu FROM carriers JOIN lnm USING (sample_idx) WHERE variant_id IN (SELECT variant_id FROM spa_st WHERE p_normal <= 0.05)",
    "spa_hi": f"""SELECT variant_id, side, a, coalesce(min(CASE WHEN s*side >= a THEN pw END), pow(8.0, 16)) AS hi FROM (
  SELECT r.variant_id, side, pw, abs(any_value(st.score)) AS a, {_slope_sql('side*pw')} AS s
  FROM spa_rows r JOIN spa_st st USING (variant_id), (VALUES (1.0::DOUBLE), (-1.0::DOUBLE)) x(side), (SELECT pow(8.0::DOUBLE, i) AS pw FROM range(17) y(i)) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
    "spa_root": f"""SELECT variant_id, side, a, (lo + hi)/2*side AS t FROM (
  WITH RECURSIVE b AS (SELECT 0 AS it, variant_id, side, a, CASE WHEN hi > 1 THEN hi/8 ELSE 0.0 END AS lo, hi FROM spa_hi
  UNION ALL SELECT it + 1, variant_id, side, a, CASE WHEN s < a THEN mid ELSE lo END, CASE WHEN s < a THEN hi ELSE mid END FROM (
    SELECT it, b.variant_id, side, a, lo, hi, (lo + hi)/2 AS mid, {_slope_sql('side*(lo + hi)/2')}*side AS s FROM b JOIN spa_rows USING (variant_id) WHERE it < 60 GROUP BY it, b.variant_id, side, a, lo, hi))
  SELECT * FROM b WHERE it = 60)""",
    "spa_cum": """SELECT variant_id, side, a, t, sum(ln(1 - mu + mu*e) - t*mu*g) AS k0, sum(mu*(1 - mu)*g*g*e/((1 - mu + mu*e)*(1 - mu + mu*e))) AS k2 FROM (
  SELECT *, exp(least(greatest(t*g, -500), 500)) AS e FROM spa_root JOIN spa_rows USING (variant_id)) GROUP BY 1, 2, 3, 4""",
    "spa_tail": f"""SELECT variant_id, sum(CASE WHEN side > 0 THEN up ELSE 1 - up END) AS p FROM (
  SELECT variant_id, side, CASE WHEN abs(t) <= 1e-12 THEN {_upper('a*side/sqrt(v)')} WHEN k2 <= 0 OR tq < 0 OR abs(w) < 1e-12 THEN 0.5
    ELSE least(greatest({_upper('w')} + exp(-w*w/2)/sqrt(2*pi())*(1/w - 1/(t*sqrt(k2))), 0), 1) END AS up FROM (
    SELECT *, sign(t)*sqrt(greatest(tq, 0)) AS w FROM (SELECT c.*, st.v, 2*(t*a*side - k0) AS tq FROM spa_cum c JOIN spa_st st USING (variant_id)))) GROUP BY 1""",
}


@query("T13_variant_saddlepoint", sql("carriers lnm", """SELECT variant_id, round(p_normal, 8) AS p_normal, round(CASE WHEN v > 0 AND p_normal <= 0.05 THEN least(t.p, 1.0) ELSE p_normal END, 8) AS p
FROM spa_st LEFT JOIN spa_tail t USING (variant_id)""", **_SPA))
def t13(c: Cohort) -> DataFrame:
    from ..operators import spa

    return spa.variant_saddlepoint(c.carriers, logistic(c).vectors).select("variant_id", rnd("p_normal", 8), rnd("p", 8))


@query("T13_saddlepoint_screen", sql("carriers lnm", f"""
SELECT variant_id, round(score, 7) AS score, round(v, 7) AS var, round({chi2_1('score*score/v')}, 8) AS p_normal FROM (
  SELECT variant_id, sum(dosage*r) AS score, sum(mu*(1-mu)*dosage*dosage) AS v FROM carriers JOIN lnm USING (sample_idx) GROUP BY 1)"""))
def t13s(c: Cohort) -> DataFrame:
    from ..operators import spa

    rows = c.carriers.join(logistic(c).vectors.select("sample_idx", "r", "mu"), "sample_idx")
    stats = rows.groupBy("variant_id").agg(
        F.sum(F.col("dosage") * F.col("r")).alias("score"),
        F.sum(F.col("mu") * (1 - F.col("mu")) * F.col("dosage") * F.col("dosage")).alias("var"))
    return spa.normal_screen(stats).select("variant_id", rnd("score", 7), rnd("var", 7), rnd("p_normal", 8))


@query("T14_spa_set_tests")
def t14(c: Cohort) -> DataFrame:
    from ..operators import settests as ST
    from ..operators import spa

    r = spa.spa_set_tests(genes(c), c.carriers, logistic(c))
    return ST.with_omnibus(r).select("set_id", "n_variants", *[rnd(F.col("p")[i], 7, f"p{i}") for i in range(6)], rnd("STAAR-O", 7, "staar_o"))


def populations(c: Cohort) -> list[int]:
    n = {r["ancestry"]: r["count"] for r in c.phenotype.groupBy("ancestry").count().collect()}
    return [n.get(i, 0) for i in range(max(n) + 1)]


@query("T16_ancestry_set_tests")
def t16(c: Cohort) -> DataFrame:
    from ..operators import settests as ST

    sizes = populations(c)
    w11, w25 = ST.ensemble_weights(len(sizes), 2, 7)
    r = ST.ancestry_set_tests(genes(c, fine=True), c.carriers_fine, gaussian(c, ["ancestry"]), "ancestry", w11, w25, sizes)
    return ST.with_omnibus(r).select("set_id", "n_variants", *[rnd(F.col("p")[i], 7, f"p{i}") for i in range(6)], rnd("STAAR-O", 7, "staar_o"))


@query("T17_ancestry_individual")
def t17(c: Cohort) -> DataFrame:
    from ..operators import settests as ST

    sizes = populations(c)
    w11, w25 = ST.ensemble_weights(len(sizes), 2, 7)
    t = ST.ancestry_individual_tests(c.carriers, gaussian(c, ["ancestry"]), "ancestry", w11, w25, sizes)
    return t.select("variant_id", rnd("ai_pvalue", 8), F.transform("pop_mafs", lambda x: F.round(x, 9)).alias("pop_mafs"))


@query("T17_ancestry_unweighted", sql("vscore carriers nm pheno", f"""
WITH pm AS (SELECT variant_id, ancestry, sum(dosage)/(2.0*n) AS pm FROM carriers JOIN pheno USING (sample_idx)
  JOIN (SELECT ancestry, count(*) AS n FROM pheno GROUP BY 1) USING (ancestry) GROUP BY 1, 2, n),
sc AS (SELECT variant_id, sum(d*r) AS u, sum(d) AS h0, sum(d*x1) AS h1, sum(d*x2) AS h2, sum(d*d) AS gg FROM (
  SELECT c.variant_id, sample_idx, r, x1, x2, dosage*25*pow(1 - least(pm, 1-pm), 24) AS d
  FROM carriers c JOIN nm USING (sample_idx) JOIN pm ON pm.variant_id = c.variant_id AND pm.ancestry = nm.ancestry) GROUP BY 1),
two AS (SELECT variant_id, {chi2_1('u*u/(s2*k)')} AS p FROM vscore
  UNION ALL SELECT variant_id, {chi2_1('u*u/(s2*k)')} FROM (SELECT *, gg - {quad()} AS k FROM sc CROSS JOIN cv))
SELECT variant_id, round({cauchy('p')}, 7) AS ai_pvalue FROM two GROUP BY 1"""))
def t17u(c: Cohort) -> DataFrame:
    """Ensemble reduced to its fixed column (all weights one), which SQL can follow."""
    from ..operators import settests as ST

    sizes = populations(c)
    w11, w25 = ST.ensemble_weights(len(sizes), 0, 7)
    t = ST.ancestry_individual_tests(c.carriers, gaussian(c, ["ancestry"]), "ancestry", w11, w25, sizes)
    return t.select("variant_id", rnd("ai_pvalue", 7))


_MS = """
SELECT variant_id, count(*) AS n_carriers, sum(dosage*r) AS u0, sum(dosage*r2) AS u1, sum(dosage) AS h0, sum(dosage*x1) AS h1, sum(dosage*x2) AS h2, sum(dosage*dosage) AS gg
FROM carriers JOIN nm USING (sample_idx) GROUP BY 1"""
_SI = "SELECT s22/det AS i11, -s12/det AS i12, s11/det AS i22 FROM (SELECT *, s11*s22 - s12*s12 AS det FROM (SELECT sum(r*r)/(count(*)-3) AS s11, sum(r*r2)/(count(*)-3) AS s12, sum(r2*r2)/(count(*)-3) AS s22 FROM nm))"


@query("T19_multi_trait_variant", sql("carriers nm cv", f"""
SELECT variant_id, round(q, 7) AS stat, round(exp(-q/2), 9) AS p FROM (
  SELECT variant_id, (i11*u0*u0 + 2*i12*u0*u1 + i22*u1*u1)/(gg - {quad()}) AS q FROM ms CROSS JOIN cv CROSS JOIN si)""", ms=_MS, si=_SI))
def t19(c: Cohort) -> DataFrame:
    from ..operators import settests as ST

    return ST.multi_variant_tests(c.carriers, multi(c)).select("variant_id", rnd("stat", 7), rnd("p", 9))


@query("T20_T21_T22_multi_trait_sets", sql("nm", f"""
SELECT b.set_id, b.weight, round(exp(-(i11*b.wu*b.wu + 2*i12*b.wu*c.wu + i22*c.wu*c.wu)/b.wkw/2), 8) AS p
FROM bstat b JOIN bstat2 c USING (set_id, weight) CROSS JOIN si""", si=_SI,
    nm2="SELECT sample_idx, r2 AS r, w, x1, x2 FROM nm",
    **_burden_sql({"b25": beta25(), "b11": "1.0"}),
    **{k + "2": v.replace("bsamp", "bsamp2").replace("bsums", "bsums2") for k, v in _burden_sql({"b25": beta25(), "b11": "1.0"}, nm="nm2").items()}))
def t20(c: Cohort) -> DataFrame:
    """Joint battery of two traits; the SQL follows its burden rows."""
    from ..operators import settests as ST

    r = ST.multi_set_tests(genes(c), c.carriers, multi(c))
    p = F.col("p")
    return r.select("set_id", F.explode(F.array(
        F.struct(F.lit("b25").alias("weight"), rnd(p[0], 8, "p")), F.struct(F.lit("b11").alias("weight"), rnd(p[1], 8, "p")))).alias("s")).select("set_id", "s.*")


@query("T21_T22_multi_trait_omnibus")
def t22(c: Cohort) -> DataFrame:
    from ..operators import settests as ST

    r = ST.with_omnibus(ST.multi_set_tests(genes(c, fine=True), c.carriers_fine, multi(c)))
    return r.select("set_id", "n_variants", *[rnd(F.col("p")[i], 7, f"p{i}") for i in range(2, 6)], rnd("STAAR-O", 7, "staar_o"))


# ----------------------------------------------------------------------- regions


@query("R03_window_scoring", sql("", f"""
SELECT set_id, round(wu, 2) AS wu, round(wkw, 5) AS wkw, round({chi2_1('wu*wu/(s2*wkw)')}, 8) AS p FROM bstat""",
    wm="""SELECT * FROM (SELECT w.chromosome || ':' || CAST(s AS VARCHAR) || '-' || CAST(s + 500 AS VARCHAR) AS set_id, r.* EXCLUDE (chromosome), count(*) OVER (PARTITION BY w.chromosome, s) AS n_set
FROM (SELECT chromosome, mn + k*250 AS s FROM (SELECT chromosome, min(position) AS mn, max(position) AS mx FROM rare GROUP BY 1), LATERAL (SELECT unnest(range((mx - mn)//250 + 1)) AS k)) w
JOIN rare r ON r.chromosome = w.chromosome AND r.position >= s AND r.position < s + 500) WHERE n_set >= 2""",
    **_burden_sql({"b11": "1.0"}, gm="wm")))
def r03(c: Cohort) -> DataFrame:
    from ..operators import masks as M

    mem = M.sliding_window_members(c.rare_index(), 500)
    keep = M.window_sets(mem)
    mem = mem.join(keep.select("chromosome", "window_start", "window_end", "set_id"), ["chromosome", "window_start", "window_end"])
    t = S.burden_statistics(S.beta_columns(mem), c.carriers, gaussian(c), ["b11"])
    return t.select("set_id", rnd("wu", 2), rnd("wkw", 5), rnd("p", 8))


@query("R03_window_battery")
def r03b(c: Cohort) -> DataFrame:
    from ..operators import masks as M
    from ..operators import settests as ST

    mem = M.sliding_window_members(c.rare_index(), 1000).withColumn("set_id", F.concat_ws(":", "chromosome", F.col("window_start").cast("string")))
    r = ST.with_omnibus(ST.set_tests(mem, c.carriers, gaussian(c)))
    return r.select("set_id", "n_variants", rnd("ACAT-O", 7, "acat_o"), rnd("STAAR-O", 7, "staar_o"))


#: Window lengths in variants, shortest to longest.
SCAN_LENGTHS = list(range(40, 301, 10))


@query("R05_pseudo_residuals")
def r05(c: Cohort) -> DataFrame:
    """Simulated residuals are orthogonal to the covariates by construction."""
    from ..operators import scan

    m = gaussian(c)
    sums = scan.draw_sums(scan.pseudo_residuals(m, covariates=True), m.x_cols)
    return sums.select("draw", "n", *[F.round(x, 6).alias(f"orth_{x}") for x in m.x_cols])


@query("R06_W07_empirical_threshold")
def r06(c: Cohort) -> DataFrame:
    from ..operators import masks as M
    from ..operators import scan

    mx = scan.simulated_maxima(M.scan_ranks(c.rare_index()), c.carriers, gaussian(c), SCAN_LENGTHS)
    return scan.empirical_threshold(mx).select("chromosome", rnd("emthr", 8))


@query("F28_R04_scan_tests")
def f28(c: Cohort) -> DataFrame:
    """Windows of all lengths against the simulated threshold of their chromosome: how many there
    are, the strongest one, and how many are kept."""
    from ..operators import masks as M
    from ..operators import scan
    from ..operators import settests as ST
    from ..session import cut_lineage

    null, ranked = gaussian(c), M.scan_ranks(c.rare_index())
    limits = cut_lineage(scan.empirical_threshold(scan.simulated_maxima(ranked, c.carriers, null, SCAN_LENGTHS)))
    tested = cut_lineage(ST.with_omnibus(scan.scan_tests(ranked, c.carriers, null, SCAN_LENGTHS)).select("chromosome", "STAAR-O"))
    kept = scan.keep_windows(tested, limits).groupBy("chromosome").agg(F.count("*").alias("n_kept"))
    top = tested.groupBy("chromosome").agg(F.count("*").alias("n_windows"), F.max(-F.log10("STAAR-O")).alias("top"))
    out = top.join(kept, "chromosome", "left").join(limits, "chromosome", "left")
    return out.select("chromosome", "n_windows", rnd("top", 6), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), rnd("emthr", 6))


# --------------------------------------------------------------------- selection


@query("C01_O06_forward_selection")
def c01(c: Cohort) -> DataFrame:
    from ..operators import select as SEL

    cand = c.variants.join(c.frequencies().filter("maf > 0.002"), "variant_id").select("chromosome", "variant_id")
    return SEL.forward_selection(cand, c.carriers, gaussian(c), p_threshold=1e-2).withColumn("neg_log10_p", rnd("neg_log10_p", 7))


@query("O06_first_pick", sql("vscore variants freq", f"""
SELECT chromosome, arg_max(variant_id, u*u/k) AS variant_id FROM vscore JOIN variants USING (variant_id) JOIN freq USING (variant_id) WHERE maf > 0.002 GROUP BY 1"""))
def o06(c: Cohort) -> DataFrame:
    """Best single signal per chromosome: the first step of forward selection."""
    t = S.individual_tests(c.carriers, gaussian(c)).join(c.frequencies().filter("maf > 0.002").select("variant_id"), "variant_id")
    return t.join(c.variants, "variant_id").groupBy("chromosome").agg(F.max_by("variant_id", F.struct("neg_log10_p", -F.col("variant_id"))).alias("variant_id"))


# ------------------------------------------------------------------- result tables


def scored_sets(c: Cohort) -> DataFrame:
    """Gene x mask burden results as a plain result table."""
    from ..operators import settests as ST

    mem = genes(c, masks=True)
    r = ST.with_omnibus(ST.set_tests(mem, c.carriers, gaussian(c)))
    return ST.describe_sets(r, mem, c.n_samples)


@query("S20_O05_mask_result_sink")
def s20(c: Cohort) -> DataFrame:
    from ..operators import settests as ST
    from ..session import scratch_path
    from ..sources import sinks

    mem = genes(c, masks=True)
    wide = ST.wide_results(ST.set_tests(mem, c.carriers, gaussian(c)))
    path = scratch_path(c.spark, "masks")
    sinks.write_mask_results(wide, path)
    back = c.spark.read.parquet(path)
    return sinks.nan_report(back).withColumn("n_columns", F.lit(len(back.columns)))


@query("S21_individual_sink", sql("vscore variants freq", "SELECT chromosome, position, ref, alt, mac FROM vscore JOIN variants USING (variant_id) JOIN freq USING (variant_id) WHERE maf > 19.5/(2*n)"))
def s21(c: Cohort) -> DataFrame:
    from ..session import scratch_path
    from ..sources import sinks

    m = gaussian(c)
    t = S.individual_tests(c.carriers, m).join(c.variants, "variant_id").join(
        c.frequencies().filter(F.col("maf") > S.mac_floor(20, m.n)).select("variant_id"), "variant_id")
    path = scratch_path(c.spark, "individual")
    sinks.write_individual_results(t, path)
    return c.spark.read.parquet(path).select("chromosome", "position", "ref", "alt", "mac")


@query("S23_pruned_sink")
def s23(c: Cohort) -> DataFrame:
    from ..operators import select as SEL
    from ..session import scratch_path
    from ..sources import sinks

    cand = c.variants.join(c.frequencies().filter("maf > 0.01"), "variant_id").select("chromosome", "variant_id")
    kept = SEL.forward_selection(cand, c.carriers, gaussian(c), p_threshold=1e-3)
    path = scratch_path(c.spark, "pruned")
    out = kept.join(c.variants.drop("chromosome"), "variant_id").select(
        "chromosome", "position", "ref", "alt", "step", sinks.log10p_text("neg_log10_p").alias("log10p"))
    sinks.write_tsv(out, path)
    return c.spark.read.csv(path, sep="\t", header=True)


def burden_table(c: Cohort) -> DataFrame:
    """Gene x mask table with one p-value column, small enough for SQL to follow."""
    from ..operators import masks as M

    rows = M.mask_members(c.rare_index().drop("gene_name")).join(c.membership, "variant_id")
    keys = ["gene_name", "mask"]
    t = S.burden_statistics(S.beta_columns(rows), c.carriers, gaussian(c), ["b11"], keys)
    info = rows.groupBy(*keys).agg(
        F.min_by("chromosome", "variant_id").alias("chromosome"), F.min("position").alias("start"), F.max("position").alias("end"),
        F.count("*").alias("n_variants"), F.sum("ac").cast("long").alias("cmac"))
    return info.filter("n_variants >= 2").join(t.select(*keys, F.col("p").alias("STAAR-O")), keys).withColumn(
        "set_id", F.concat_ws("|", "gene_name", "mask"))


_BT = dict(
    gmm="SELECT m.gene_name || '|' || mask AS set_id, k.* EXCLUDE (gene_name), m.gene_name FROM masked k JOIN membership m USING (variant_id)",
    **_burden_sql({"b11": "1.0"}, gm="gmm"),
    bt=f"""SELECT g.*, {chi2_1('wu*wu/(s2*wkw)')} AS p FROM (SELECT set_id, gene_name, mask, arg_min(chromosome, variant_id) AS chromosome, min(position) AS start, max(position) AS "end",
  count(*) AS n_variants, sum(ac)::BIGINT AS cmac FROM gmm GROUP BY 1, 2, 3 HAVING count(*) >= 2) g JOIN bstat USING (set_id)""",
)


@query("C06_manhattan", sql("", """SELECT gene_name, mask, o.off + (start + "end")/2.0 AS genome_x, round(-log10(p), 7) AS neg_log_p FROM bt JOIN off o USING (chromosome)""",
    off="SELECT chromosome, coalesce(sum(len) OVER (ORDER BY CAST(chromosome AS INTEGER) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (VALUES "
        "('1', 249000000), ('2', 243000000), ('3', 198000000), ('4', 190000000), ('5', 182000000), ('6', 171000000), ('7', 159000000), ('8', 145000000), "
        "('9', 138000000), ('10', 134000000), ('11', 135000000), ('12', 133000000), ('13', 114000000), ('14', 107000000), ('15', 102000000), ('16', 90000000), "
        "('17', 84000000), ('18', 80000000), ('19', 59000000), ('20', 65000000), ('21', 47000000), ('22', 51000000)) t(chromosome, len)", **_BT))
def c06(c: Cohort) -> DataFrame:
    from ..operators import report as R

    return R.manhattan(burden_table(c)).select("gene_name", "mask", "genome_x", rnd("neg_log_p", 7))


@query("C07_W03_qq", sql("", """SELECT mask, i, round(-log10((i + 0.5)/n), 9) AS expected, round(-log10(p), 7) AS observed FROM (
  SELECT mask, p, row_number() OVER (PARTITION BY mask ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY mask) AS n FROM bt) WHERE i % greatest(1, n // 10) = 0 OR i >= n - 5""", **_BT))
def c07(c: Cohort) -> DataFrame:
    from ..operators import report as R

    return R.qq_points(burden_table(c), keep=10, tail=5).select("mask", "i", rnd("expected", 9), rnd("observed", 7))


@query("C08_A18_volcano", sql("", """SELECT gene_name, chromosome, arg_min(mask, (round(p, 12), mask)) AS mask, round(min(p), 8) AS p, greatest(arg_min(cmac, (round(p, 12), mask)), 1) AS cmac, min(p) < 2.5e-6 AS significant FROM bt GROUP BY 1, 2""", **_BT))
def c08(c: Cohort) -> DataFrame:
    from ..operators import report as R

    return R.volcano(burden_table(c)).select("gene_name", "chromosome", "mask", rnd("p", 8), F.col("cmac").cast("long").alias("cmac"), "significant")


@query("O05_sorted_sets", sql("", "SELECT set_id, round(p, 8) AS p FROM bt", **_BT))
def o05(c: Cohort) -> DataFrame:
    from ..operators import report as R

    return R.sorted_sets(burden_table(c)).select("set_id", rnd("STAAR-O", 8, "p"))
