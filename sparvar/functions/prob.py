"""Tail probabilities and p-value combination.

The normal and integer-df chi-square tails are plain column expressions, so the
score tests stay inside generated code.  Only the chi-square tail with a
fractional number of degrees of freedom needs an Arrow batch function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

P_MIN = 5e-324
PI = math.pi

# Rational approximation of erf/erfc by W. J. Cody,
# "Rational Chebyshev approximations for the error function" (1969).
_ERF_NUM = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02,
            3.20937758913846947e03, 1.85777706184603153e-1]
_ERF_DEN = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03,
            2.84423683343917062e03]
_MID_NUM = [5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01,
            2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03,
            2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
_MID_DEN = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02,
            1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03,
            3.43936767414372164e03, 1.23033935480374942e03]
_FAR_NUM = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
            1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
_FAR_DEN = [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1,
            6.05183413124413191e-2, 2.33520497626869185e-3]


def _horner(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0``."""
    z = x * x
    near = 1.0 - x * _horner([_ERF_NUM[4]] + _ERF_NUM[:4], z) / _horner([1.0] + _ERF_DEN, z)
    # exp(-x^2) is split to keep full relative accuracy in the tail.
    head = F.floor(x * 16.0) / 16.0
    decay = F.exp(-head * head) * F.exp(-(x - head) * (x + head))
    mid = decay * _horner([_MID_NUM[8]] + _MID_NUM[:8], x) / _horner([1.0] + _MID_DEN, x)
    iz = 1.0 / z
    far_ratio = iz * _horner([_FAR_NUM[5]] + _FAR_NUM[:5], iz) / _horner([1.0] + _FAR_DEN, iz)
    far = decay * (1.0 / math.sqrt(PI) - far_ratio) / x
    return F.when(x <= 0.46875, near).when(x <= 4.0, mid).when(x < 27.5, far).otherwise(0.0)


def normal_cdf(z: Column) -> Column:
    half = 0.5 * erfc(F.abs(z) / math.sqrt(2.0))
    return F.when(z > 0, 1.0 - half).otherwise(half)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2.0) / math.sqrt(2.0 * PI)


def chi2_sf(x: Column, df: int = 1) -> Column:
    """Upper chi-square tail for a whole number of degrees of freedom.

    Non-positive or non-finite statistics give 1; underflow gives the smallest
    positive double so that later combination never meets a zero.
    """
    h = x / 2.0
    if df % 2:
        tail = erfc(F.sqrt(h))
        term = F.sqrt(h) * 2.0 / math.sqrt(PI) * F.exp(-h)
        for j in range(df // 2):
            if j:
                term = term * h / (j + 0.5)
            tail = tail + term
    else:
        poly, coef = F.lit(1.0), 1.0
        for j in range(1, df // 2):
            coef /= j
            poly = poly + F.pow(h, F.lit(float(j))) * coef
        tail = F.exp(-h) * poly
    bad = x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))
    return F.when(bad, 1.0).otherwise(F.greatest(tail, F.lit(P_MIN)))


def _cauchy_point(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(P_MIN)), F.lit(1.0 - 1e-15))
    # 1/(p*pi) overflows at the smallest p; the cap keeps infinities out of sums.
    return F.when(q < 1e-16, F.least(1.0 / (q * PI), F.lit(1e300))).otherwise(F.tan((0.5 - q) * PI))


def _cauchy_p(t: Column) -> Column:
    p = (
        F.when(t > 1e15, 1.0 / (PI * t))
        .when(t < -1e15, 1.0 + 1.0 / (PI * t))
        .otherwise(0.5 - F.atan(t) / PI)
    )
    return F.least(F.greatest(p, F.lit(P_MIN)), F.lit(1.0))


def cauchy_combine(p: Column, w: Column | None = None) -> Column:
    """Aggregate expression: weighted Cauchy combination of a group's p-values.

    NaN p-values and non-positive weights are skipped; null when nothing is left.
    """
    w = F.lit(1.0) if w is None else w
    use = p.isNotNull() & ~F.isnan(p) & w.isNotNull() & ~F.isnan(w) & (w > 0)
    top = F.sum(F.when(use, w * _cauchy_point(p)))
    bottom = F.sum(F.when(use, w))
    return F.when(bottom > 0, _cauchy_p(top / bottom))


def neg_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p)).otherwise(F.lit(float("inf")))


# ---------------------------------------------------------------- inside tasks


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function, element-wise."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    a, x = a.ravel(), x.ravel()
    out = np.ones(a.shape)
    lg = np.array([math.lgamma(v) if v > 0 else np.nan for v in a])
    pos = x > 0
    low = pos & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1.0 / aa
        total = term.copy()
        k = aa.copy()
        for _ in range(5000):
            k = k + 1.0
            term = term * xx / k
            total += term
            if (np.abs(term) <= np.abs(total) * 1e-16).all():
                break
        out[low] = 1.0 - total * np.exp(-xx + aa * np.log(xx) - lg[low])
    high = pos & ~low
    if high.any():
        aa, xx = a[high], x[high]
        tiny = 1e-300
        b = xx + 1.0 - aa
        c = np.full(xx.shape, 1.0 / tiny)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 5000):
            an = -i * (i - aa)
            b = b + 2.0
            d = an * d + b
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1.0 / d
            step = d * c
            h = h * step
            if (np.abs(step - 1.0) <= 1e-15).all():
                break
        out[high] = np.exp(-xx + aa * np.log(xx) - lg[high]) * h
    return out


def liu_pvalue(q, c1, c2, c3, c4) -> np.ndarray:
    """Tail of a chi-square mixture from its statistic and eigenvalue power sums.

    Four-moment matching (Liu, Tang & Zhang 2009, with the kurtosis-preserving
    modification): the mixture is replaced by a scaled chi-square, non-central
    when the squared skewness exceeds the kurtosis term and then reduced to a
    central one by Patnaik's two moments.
    """
    q, c1, c2, c3, c4 = (np.atleast_1d(np.asarray(v, float)) for v in (q, c1, c2, c3, c4))
    out = np.full(q.shape, np.nan)
    out[(c2 <= 0) & np.isfinite(q)] = 1.0
    ok = np.isfinite(q) & (c2 > 0)
    if not ok.any():
        return out
    q, c1, c2, c3, c4 = (v[ok] for v in (q, c1, c2, c3, c4))
    skew = c3 / c2**1.5
    kurt = c4 / c2**2
    nc = skew**2 > kurt
    root = np.sqrt(np.where(nc, skew**2 - kurt, 0.0))
    scale = np.where(nc, 1.0 / np.where(nc, skew - root, 1.0), 1.0 / skew)
    delta = np.where(nc, np.maximum(skew * scale**3 - scale**2, 0.0), 0.0)
    df = np.where(nc, np.maximum(scale**2 - 2 * delta, 0.5), np.maximum(1.0 / skew**2, 0.5))
    x = (q - c1) / np.sqrt(2 * c2) * math.sqrt(2.0) * scale + df + delta
    dfe = np.where(delta > 0, (df + delta) ** 2 / (df + 2 * delta), df)
    xe = np.where(delta > 0, x * (df + 2 * delta) / (df + delta), x)
    p = gamma_q(dfe / 2, np.maximum(xe, 0.0) / 2)
    out[ok] = np.where(x <= 0, 1.0, np.maximum(p, P_MIN))
    return out


def chi2_sf_np(x: np.ndarray, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    p = np.maximum(gamma_q(np.full(x.shape, df / 2), np.maximum(np.nan_to_num(x), 0.0).ravel() / 2), P_MIN)
    return np.where(np.isfinite(x) & (x > 0), p.reshape(x.shape), 1.0)


def chi2_1_sf_np(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    good = np.isfinite(x) & (x > 0)
    root = np.sqrt(np.where(good, x, 0.0) / 2)
    p = np.array([math.erfc(v) for v in root.ravel()]).reshape(x.shape)
    return np.where(good, np.maximum(p, P_MIN), 1.0)


def cauchy_np(p, w=None) -> float:
    p = np.asarray(p, float)
    w = np.ones_like(p) if w is None else np.asarray(w, float)
    use = ~np.isnan(p) & (w > 0)
    if not use.any():
        return math.nan
    p, w = np.clip(p[use], P_MIN, 1 - 1e-15), w[use]
    with np.errstate(over="ignore", divide="ignore"):
        t = np.where(p < 1e-16, np.minimum(1 / (p * PI), 1e300), np.tan((0.5 - p) * PI))
    t = float((w * t).sum() / w.sum())
    if t > 1e15:
        r = 1 / (PI * t)
    elif t < -1e15:
        r = 1 + 1 / (PI * t)
    else:
        r = 0.5 - math.atan(t) / PI
    return min(max(r, P_MIN), 1.0)


@F.pandas_udf(DoubleType())
def liu_tail(q: pd.Series, c1: pd.Series, c2: pd.Series, c3: pd.Series, c4: pd.Series) -> pd.Series:
    """Column form of :func:`liu_pvalue` for statistics aggregated by Spark."""
    return pd.Series(liu_pvalue(q, c1, c2, c3, c4))
