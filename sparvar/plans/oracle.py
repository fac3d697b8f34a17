"""ANSI SQL equivalents of the cohort mapping, as named common table expressions.

``sql("carriers null_model", body)`` prefixes ``body`` with the named CTEs and
everything they depend on.
"""

from __future__ import annotations

import re

N_CHANNELS = 11


def _phred(c: int) -> str:
    return f"CASE WHEN (p_size*{c + 1}) % 40 = 0 THEN NULL ELSE CAST((p_size*{c + 1}) % 40 AS DOUBLE) END"


def _weight(c: int) -> str:
    return f"CASE WHEN (p_size*{c + 1}) % 40 = 0 THEN 0.0 ELSE 1.0 - pow(10.0, -((p_size*{c + 1}) % 40)/10.0) END"


CTES: dict[str, str] = {}

CTES["variants"] = """
SELECT p_partkey AS variant_id, CAST(1 + p_partkey % 22 AS VARCHAR) AS chromosome,
  CAST(1000 + 50*(p_partkey // 22) AS INTEGER) AS position,
  substr('ACGT', CAST(p_partkey % 4 AS INTEGER) + 1, 1) AS ref,
  substr('ACGT', CAST((p_partkey % 4 + 1 + (p_partkey // 4) % 3) % 4 AS INTEGER) + 1, 1) AS alt
FROM part"""

CTES["carriers"] = """
SELECT l_partkey AS variant_id, o_custkey AS sample_idx, CAST(least(count(*), 2) AS INTEGER) AS dosage
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""

CTES["carriers_fine"] = """
SELECT l_partkey*3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS variant_id, o_custkey AS sample_idx, CAST(least(count(*), 2) AS INTEGER) AS dosage
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""
CTES["annot_fine"] = "SELECT * REPLACE (variant_id*3 + k AS variant_id) FROM annot CROSS JOIN (SELECT unnest(range(3)) AS k)"

for _name in ("", "_fine"):
    CTES["freq" + _name] = f"""
SELECT variant_id, CAST(sum(dosage) AS BIGINT) AS ac, sum(dosage)/(2.0*n) AS af,
  least(sum(dosage)/(2.0*n), 1.0 - sum(dosage)/(2.0*n)) AS maf
FROM carriers{_name} CROSS JOIN (SELECT count(*) AS n FROM customer) GROUP BY variant_id, n"""
    CTES["vindex" + _name] = f"""
SELECT * FROM annot{_name} JOIN freq{_name} USING (variant_id)"""
    CTES["rare" + _name] = f"SELECT * FROM vindex{_name} WHERE ac <= 35"

CTES["annot"] = f"""
SELECT v.variant_id, v.chromosome, v.position, v.ref, v.alt,
  CAST(v.position + length(v.ref) - 1 AS INTEGER) AS end_position,
  p_brand AS gene_name,
  CASE p_type WHEN 'LARGE' THEN 'splicing' WHEN 'STANDARD' THEN 'UTR3' ELSE 'exonic' END AS region_type,
  CASE p_type WHEN 'SMALL' THEN 'stopgain' WHEN 'ECONOMY' THEN 'nonsynonymous SNV'
    WHEN 'MEDIUM' THEN 'synonymous SNV' WHEN 'PROMO' THEN 'frameshift deletion' ELSE '' END AS consequence,
  CASE WHEN p_size % 4 <> 0 THEN CAST(CAST(p_size/50.0 AS FLOAT) AS DOUBLE) ELSE 0.0 END AS revel,
  CASE p_size % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'T' ELSE '' END AS metasvm_pred,
  CASE WHEN p_size % 17 = 0 THEN 'GH' || CAST(p_size AS VARCHAR) ELSE '' END AS genehancer,
  p_size % 5 = 0 AS is_cage_promoter, p_size % 7 = 0 AS is_cage_enhancer,
  p_size % 11 = 0 AS is_ccre_promoter, p_size % 13 = 0 AS is_ccre_enhancer,
  {', '.join(f'{_phred(c)} AS ph{c}' for c in range(N_CHANNELS))},
  {', '.join(f'{_weight(c)} AS w{c}' for c in range(N_CHANNELS))}
FROM variants v JOIN part ON p_partkey = v.variant_id"""

CTES["membership"] = """
SELECT DISTINCT p_partkey AS variant_id, g AS gene_name FROM (
  SELECT p_partkey, p_brand AS g FROM part
  UNION ALL SELECT p_partkey, 'Brand#' || CAST(p_partkey % 25 + 1 AS VARCHAR) FROM part WHERE p_partkey % 10 = 0)"""

CTES["samples"] = "SELECT c_custkey AS sample_idx, c_name AS sample_id FROM customer"

CTES["pheno"] = """
SELECT c_custkey AS sample_idx, c_name AS sample_id, c_acctbal AS y,
  CASE WHEN c_acctbal > 4500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS yb,
  c_acctbal*0.5 + (c_custkey % 7)*300 AS y2,
  CASE WHEN c_acctbal + (c_custkey % 7)*900 > 7000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS yb2,
  CAST(c_nationkey AS DOUBLE) AS x1,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x2,
  CAST(n_regionkey AS INTEGER) AS ancestry
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _inverse(src: str, a="a") -> str:
    """Adjugate inverse of a symmetric 3x3 held in columns a00..a22."""
    return f"""
SELECT *, (a11*a22 - a12*a12)/det AS c00, (a02*a12 - a01*a22)/det AS c01, (a01*a12 - a02*a11)/det AS c02,
  (a00*a22 - a02*a02)/det AS c11, (a01*a02 - a00*a12)/det AS c12, (a00*a11 - a01*a01)/det AS c22
FROM (SELECT *, a00*(a11*a22 - a12*a12) - a01*(a01*a22 - a12*a02) + a02*(a01*a12 - a11*a02) AS det FROM {src})"""


CTES["ne_sums"] = """
SELECT CAST(count(*) AS DOUBLE) AS a00, sum(x1) AS a01, sum(x2) AS a02, sum(x1*x1) AS a11, sum(x1*x2) AS a12,
  sum(x2*x2) AS a22, sum(y) AS t0, sum(x1*y) AS t1, sum(x2*y) AS t2, sum(y2) AS s0, sum(x1*y2) AS s1, sum(x2*y2) AS s2
FROM pheno"""
CTES["ne"] = _inverse("ne_sums")
CTES["beta"] = """
SELECT c00*t0 + c01*t1 + c02*t2 AS b0, c01*t0 + c11*t1 + c12*t2 AS b1, c02*t0 + c12*t1 + c22*t2 AS b2,
  c00*s0 + c01*s1 + c02*s2 AS e0, c01*s0 + c11*s1 + c12*s2 AS e1, c02*s0 + c12*s1 + c22*s2 AS e2 FROM ne"""
CTES["nm"] = """
SELECT sample_idx, ancestry, y - b0 - b1*x1 - b2*x2 AS r, y2 - e0 - e1*x1 - e2*x2 AS r2, 1.0::DOUBLE AS w, x1, x2
FROM pheno CROSS JOIN beta"""
CTES["sig"] = "SELECT sum(r*r)/(count(*) - 3) AS s2, count(*) AS n FROM nm"
CTES["cv"] = "SELECT c00, c01, c02, c11, c12, c22, sig.s2, n FROM ne CROSS JOIN sig"

def _irls(y: str) -> str:
    """Logistic coefficients by reweighted least squares, a fixed 15 rounds."""
    mu = "1.0/(1.0 + exp(-(b0 + b1*x1 + b2*x2)))"
    return f"""
SELECT * FROM (WITH RECURSIVE it(i, b0, b1, b2) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    ((a11*a22 - a12*a12)*t0 + (a02*a12 - a01*a22)*t1 + (a01*a12 - a02*a11)*t2)/det,
    ((a02*a12 - a01*a22)*t0 + (a00*a22 - a02*a02)*t1 + (a01*a02 - a00*a12)*t2)/det,
    ((a01*a12 - a02*a11)*t0 + (a01*a02 - a00*a12)*t1 + (a00*a11 - a01*a01)*t2)/det
  FROM (SELECT *, a00*(a11*a22 - a12*a12) - a01*(a01*a22 - a12*a02) + a02*(a01*a12 - a11*a02) AS det FROM (
    SELECT i, sum(w) AS a00, sum(w*x1) AS a01, sum(w*x2) AS a02, sum(w*x1*x1) AS a11, sum(w*x1*x2) AS a12,
      sum(w*x2*x2) AS a22, sum(w*z) AS t0, sum(w*x1*z) AS t1, sum(w*x2*z) AS t2
    FROM (SELECT i, x1, x2, mu*(1-mu) AS w, eta + ({y} - mu)/(mu*(1-mu)) AS z
      FROM (SELECT i, x1, x2, {y}, b0 + b1*x1 + b2*x2 AS eta, {mu} AS mu FROM it CROSS JOIN pheno WHERE i < 15))
    GROUP BY i)))
SELECT b0, b1, b2 FROM it WHERE i = 15)"""


CTES["lbeta"] = _irls("yb")
CTES["lbeta2"] = _irls("yb2")
CTES["lnm"] = """
SELECT sample_idx, yb - mu AS r, mu*(1-mu) AS w, mu, x1, x2 FROM (
  SELECT sample_idx, yb, x1, x2, 1.0/(1.0 + exp(-(b0 + b1*x1 + b2*x2))) AS mu FROM pheno CROSS JOIN lbeta)"""
CTES["lsums"] = """
SELECT sum(w) AS a00, sum(w*x1) AS a01, sum(w*x2) AS a02, sum(w*x1*x1) AS a11, sum(w*x1*x2) AS a12, sum(w*x2*x2) AS a22 FROM lnm"""
CTES["lcv"] = f"SELECT c00, c01, c02, c11, c12, c22, 1.0::DOUBLE AS s2, n FROM ({_inverse('lsums')}) CROSS JOIN (SELECT count(*) AS n FROM lnm)"


def quad(h: str = "h") -> str:
    return (f"(c00*{h}0*{h}0 + c11*{h}1*{h}1 + c22*{h}2*{h}2 + "
            f"2*(c01*{h}0*{h}1 + c02*{h}0*{h}2 + c12*{h}1*{h}2))")


def _scores(car: str, nm: str, cv: str) -> str:
    return f"""
SELECT *, gg - {quad()} AS k FROM (
  SELECT variant_id, sum(dosage*r) AS u, sum(dosage*w) AS h0, sum(dosage*w*x1) AS h1, sum(dosage*w*x2) AS h2,
    sum(CAST(dosage AS DOUBLE)*dosage*w) AS gg, CAST(sum(dosage) AS BIGINT) AS mac
  FROM {car} JOIN {nm} USING (sample_idx) GROUP BY variant_id) CROSS JOIN {cv}"""


CTES["vscore"] = _scores("carriers", "nm", "cv")
CTES["vscore_fine"] = _scores("carriers_fine", "nm", "cv")
CTES["lscore"] = _scores("carriers", "lnm", "lcv")


def chi2_1(t: str) -> str:
    """Chi-square(1) tail through the positive-term series of erf."""
    x = f"sqrt(({t})/2)"
    # Term i is (2x^2)^i / (2i+1)!!, with the double factorial through lgamma.
    terms = (f"list_sum(list_transform(range(1, 110), lambda i: exp(i*ln(2*{x}*{x}) - (i + 1)*ln(2.0) "
             f"- lgamma(i + 1.5) + 0.5*ln(pi()))))")
    return f"CASE WHEN ({t}) > 0 THEN 1 - 2*{x}/sqrt(pi())*exp(-{x}*{x})*(1 + {terms}) ELSE 1.0 END"


def cauchy(p: str, w: str = "1.0") -> str:
    """Aggregate: weighted Cauchy combination of p-values away from 0 and 1."""
    return (f"0.5 - atan(sum(CASE WHEN {w} > 0 THEN {w}*tan((0.5 - least({p}, 1-1e-15))*pi()) END)"
            f"/sum(CASE WHEN {w} > 0 THEN {w} END))/pi()")


def beta25(m: str = "maf") -> str:
    return f"CASE WHEN {m} > 0 AND {m} < 0.5 THEN 25*pow(1 - {m}, 24) ELSE 0.0 END"


def sql(names: str, body: str, **extra: str) -> str:
    """``WITH ... body``; extra keyword CTEs are placed before the body."""
    pool = {**CTES, **extra}
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in pool:
            if other != name and re.search(rf"(?<![\w.]){other}(?![\w])", pool[name]):
                need(other)
        order.append(name)

    for name in names.split():
        need(name)
    for name in extra:
        need(name)
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({pool[n].strip()})" for n in order)
    body = body.strip()
    # A body with CTEs of its own continues the list.
    return head + ",\n" + body[5:] if body.startswith("WITH ") else head + "\n" + body
