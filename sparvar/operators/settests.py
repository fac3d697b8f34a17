"""Set-based association tests: burden, SKAT, ACAT-V and their omnibus.

Sets up to ``DENSE_LIMIT`` variants are tested from their covariance matrix in
one grouped task each.  Larger ones are never decomposed: every test comes from sums
over runs of rows and their non-zero cells (``setsums``; ``large_set_tests``, and its
kin for several traits and for ancestry weightings).  No test has a size limit.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prob import cauchy_np, chi2_1_sf_np, chi2_sf_np, liu_pvalue
from ..schemas import CHANNELS
from . import gram
from .nullmodel import NullModel
from .score import attach_null, h_cols, variant_scores

DENSE_LIMIT = 2000
COUNT_LIMIT = 10.0
LAMBDA_MIN = 1e-8
#: Paths a task holds at once, and how many dense products a path costs.
PATH_BLOCK = 1 << 18
DENSE_PATHS = 32
#: Matrix cells of weightings decomposed together.
SKAT_CELLS = 1 << 18
# Result column names.
TESTS = ["Burden(1,25)", "Burden(1,1)", "SKAT(1,25)", "SKAT(1,1)", "ACAT-V(1,25)", "ACAT-V(1,1)"]
OMNIBUS = ["STAAR-B(1,25)", "STAAR-B(1,1)", "STAAR-S(1,25)", "STAAR-S(1,1)", "STAAR-A(1,25)", "STAAR-A(1,1)"]
W_COLS = [f"w{i}" for i in range(len(CHANNELS))]
N_P = 6 * (1 + len(CHANNELS))
RESULT = "set_id string, mask string, n_variants int, p array<double>"


# ------------------------------------------------------------ inside one task


def shape_weights(maf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Beta(1,25), Beta(1,1)) densities and the ACAT denominators."""
    ok = (maf > 0) & (maf < 0.5)
    b = np.vstack([np.where(ok, 25 * (1 - maf) ** 24, 0.0), ok.astype(float)])
    safe = np.where(ok, maf, 0.25)
    den = np.where(ok, 1.0 / (np.pi**2 * safe * (1 - safe)), 1.0)
    return b, den


def power_sums(a: np.ndarray) -> tuple[float, float, float, float]:
    """Sums of eigenvalue powers 1-4 over eigenvalues above the floor."""
    lam = np.linalg.eigvalsh(a)
    lam = lam[lam > LAMBDA_MIN]
    return tuple(float((lam**k).sum()) for k in (1, 2, 3, 4))


def skat_p(q: float, sums) -> float:
    return 1.0 if sums[0] == 0.0 and np.isfinite(q) else float(liu_pvalue(q, *sums)[0])


def battery(u: np.ndarray, k: np.ndarray, maf: np.ndarray, chan: np.ndarray, n: int, s2: float = 1.0) -> np.ndarray:
    """72 p-values: base tests first, then six per channel.  ``chan`` is 11 x m."""
    beta, den = shape_weights(maf)
    common = np.round(2 * maf * n) > COUNT_LIMIT
    var = s2 * np.diag(k)
    with np.errstate(divide="ignore", invalid="ignore"):
        single = chi2_1_sf_np(np.where(var > 0, u**2 / var, 0.0))
    usable = common & (var > 0)
    out = np.empty((1 + len(chan), 6))
    every = np.vstack([np.ones(len(u)), chan])
    skat = _skat_batch(u, k, np.sqrt(every)[:, None, :] * beta[None], s2)
    for c in range(1 + len(chan)):
        a = every[c]
        out[c, 2:4] = skat[c]
        for t in range(2):
            wb = beta[t] * a
            v = s2 * wb @ k @ wb
            out[c, t] = chi2_1_sf_np(np.array([(wb @ u) ** 2 / v]))[0] if v > 0 else 1.0
            wa = a * beta[t] ** 2 / den
            pick = usable & (wa != 0)
            ps, cw = list(single[pick]), list(wa[pick])
            rare = ~common & (wa != 0)
            if rare.any():
                wr = wb[rare]
                vr = s2 * wr @ k[np.ix_(rare, rare)] @ wr
                if vr > 0:
                    ps.append(chi2_1_sf_np(np.array([(wr @ u[rare]) ** 2 / vr]))[0])
                    cw.append(wa[rare].mean())
            out[c, 4 + t] = cauchy_np(ps, cw) if ps else 1.0
    return out.ravel()


def _skat_batch(u: np.ndarray, k: np.ndarray, ws: np.ndarray, s2: float) -> np.ndarray:
    """SKAT p-values of all weightings (channels x shapes x variants); matrices of small sets are decomposed together."""
    flat = ws.reshape(-1, len(u))
    together = max(1, SKAT_CELLS // max(1, k.size))
    p = np.empty(len(flat))
    for lo in range(0, len(flat), together):
        w = flat[lo:lo + together]
        lam = np.linalg.eigvalsh(s2 * w[:, :, None] * k * w[:, None, :])
        lam = np.where(lam > LAMBDA_MIN, lam, 0.0)
        sums = [(lam**x).sum(1) for x in (1, 2, 3, 4)]
        q = ((w * u) ** 2).sum(1)
        p[lo:lo + together] = np.where((sums[0] == 0.0) & np.isfinite(q), 1.0, liu_pvalue(q, *sums))
    return p.reshape(ws.shape[:2])


def covariance(cells: pd.DataFrame, m: int, h: np.ndarray, inv: np.ndarray, value: str = "s") -> np.ndarray:
    """Projected covariance from upper-triangle cross-product cells."""
    k = np.zeros((m, m))
    a, b, v = cells["j1"].to_numpy(), cells["j2"].to_numpy(), cells[value].to_numpy()
    k[a, b] = v
    k[b, a] = v
    return k - h @ inv @ h.T


def _mask_slices(v: pd.DataFrame, minimum: int):
    """(mask, member positions) for every mask of a set; None means the whole set."""
    if "masks" not in v.columns:
        if len(v) >= minimum:
            yield None, np.arange(len(v))
        return
    hits: dict[str, list[int]] = {}
    for pos, names in enumerate(v["masks"]):
        for name in names:
            hits.setdefault(name, []).append(pos)
    for name, idx in hits.items():
        if len(idx) >= minimum:
            yield name, np.asarray(idx)


# --------------------------------------------------------------------- Spark


def set_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("set_id").agg(F.count("*").alias("m"))


def split_by_size(members: DataFrame, limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(members of dense sets, members of larger sets), None without any; one counting job."""
    sizes = set_sizes(members)
    n = sizes.agg(F.count_if(F.col("m") <= limit).alias("small"), F.count_if(F.col("m") > limit).alias("large")).first()
    if not n["large"]:
        return members, None
    if not n["small"]:
        return None, members
    big = sizes.filter(F.col("m") > limit).select("set_id")
    return members.join(big, "set_id", "left_anti"), members.join(big, "set_id", "left_semi")


def tested_by_size(members: DataFrame, limit: int, dense, large) -> DataFrame:
    """Tests of small sets by ``dense`` and of others by ``large``, both from members to results."""
    small, rest = split_by_size(members, limit)
    parts = [f(m) for f, m in ((dense, small), (large, rest)) if m is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _scored_members(ranked: DataFrame, carriers: DataFrame, null: NullModel) -> DataFrame:
    """Members with u and h; variants without carriers in the model get zeros."""
    needed = carriers.join(ranked.select("variant_id").distinct(), "variant_id", "left_semi")
    sums = variant_scores(needed, null).select("variant_id", "u", "gg", *h_cols(null))
    return ranked.join(sums, "variant_id", "left").fillna(0.0, subset=["u", "gg", *h_cols(null)])


def set_tests(
    members: DataFrame, carriers: DataFrame, null: NullModel, minimum: int = 2, limit: int | None = None
) -> DataFrame:
    """Test battery per set (and mask): set_id, mask, n_variants, p[72].

    ``members``: set_id, variant_id, maf, w0..w10 and optionally ``masks``
    (array of mask names; the covariance is computed once per set and sliced).
    """
    limit = limit or DENSE_LIMIT
    has_masks = "masks" in members.columns
    cols = ["set_id", "variant_id", "maf", *W_COLS] + (["masks"] if has_masks else [])
    own = members.select(*cols).withColumn("set_id", F.col("set_id").cast("string"))
    return tested_by_size(own, limit, lambda m: dense_set_tests(m, carriers, null, minimum), lambda m: large_set_tests(m, carriers, null, minimum))


def dense_set_tests(members: DataFrame, carriers: DataFrame, null: NullModel, minimum: int = 2) -> DataFrame:
    ranked = gram.rank_members(members)
    cells = gram.pair_products(ranked, carriers, null.vectors.select("sample_idx", "w"))
    scored = _scored_members(ranked, carriers, null)
    hs, inv, n, s2 = h_cols(null), null.cov_inv, null.n, null.sigma2

    def test(key, v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("j").reset_index(drop=True)
        k = covariance(c, len(v), v[hs].to_numpy(float), inv) / s2
        u = v["u"].to_numpy(float) / s2
        rows = []
        for mask, idx in _mask_slices(v, minimum):
            s = v.iloc[idx]
            p = battery(u[idx], k[np.ix_(idx, idx)], s["maf"].to_numpy(float), s[W_COLS].to_numpy(float).T, n)
            rows.append((key[0], mask, len(idx), p))
        return pd.DataFrame(rows, columns=["set_id", "mask", "n_variants", "p"])

    return scored.groupBy("set_id").cogroup(cells.groupBy("set_id")).applyInPandas(test, RESULT)


def _combine(ps: Column) -> Column:
    """Equal-weight Cauchy combination of an array, without a shuffle."""
    ok = F.filter(ps, lambda p: p.isNotNull() & ~F.isnan(p))
    from ..functions.prob import _cauchy_p, _cauchy_point

    total = F.aggregate(ok, F.lit(0.0), lambda acc, p: acc + _cauchy_point(p))
    return F.when(F.size(ok) > 0, _cauchy_p(total / F.size(ok)))


def with_omnibus(results: DataFrame) -> DataFrame:
    """STAAR-B/S/A, ACAT-O and STAAR-O from the p array (native, row by row)."""
    p = F.col("p")
    cols = {
        name: _combine(F.array(*[F.get(p, F.lit(6 * c + t)) for c in range(N_P // 6)]))
        for t, name in enumerate(OMNIBUS)
    }
    cols["ACAT-O"] = _combine(F.slice(p, 1, 6))
    cols["STAAR-O"] = _combine(p)
    return results.withColumns(cols)


def wide_results(results: DataFrame) -> DataFrame:
    """One named column per test and channel, as written to result tables."""
    p = F.col("p")
    named = [F.get(p, F.lit(t)).alias(name) for t, name in enumerate(TESTS)]
    named += [
        F.get(p, F.lit(6 * (c + 1) + t)).alias(f"{name}-{ch}")
        for c, ch in enumerate(CHANNELS) for t, name in enumerate(TESTS)
    ]
    full = with_omnibus(results)
    rest = [x for x in results.columns if x != "p"]
    return full.select(*rest, *named, *OMNIBUS, "ACAT-O", "STAAR-O", F.lit(float("nan")).alias("emthr"))


def long_results(results: DataFrame) -> DataFrame:
    """(set_id, mask, test, channel, p) rows; the base tests have channel ``base``."""
    names = F.array(*[F.lit(x) for x in TESTS])
    chans = F.array(F.lit("base"), *[F.lit(x) for x in CHANNELS])
    flat = results.select("set_id", "mask", F.posexplode("p").alias("_i", "p"))
    return flat.select(
        "set_id", "mask", F.get(names, F.col("_i") % 6).alias("test"),
        F.get(chans, F.floor(F.col("_i") / 6).cast("int")).alias("channel"), "p",
    )


def collect_p(long: DataFrame, keys: list[str]) -> DataFrame:
    """Back from (keys, slot, p) rows to the p array; groups have at most 72 rows."""
    m = F.map_from_entries(F.collect_list(F.struct("slot", "p")))
    return long.groupBy(*keys).agg(m.alias("_m")).withColumn(
        "p", F.transform(F.sequence(F.lit(0), F.lit(N_P - 1)), lambda i: F.col("_m")[i])
    ).drop("_m")


def gene_members(index: DataFrame, membership: DataFrame, masks: bool = True) -> DataFrame:
    """Gene sets over a variant index, with each variant's mask names attached."""
    from .masks import mask_array

    rows = index.drop("gene_name").join(membership.filter("gene_name != ''"), "variant_id").withColumn("set_id", F.col("gene_name"))
    if masks:
        rows = rows.withColumn("masks", mask_array())
    return rows


def describe_sets(results: DataFrame, members: DataFrame, n_samples: int) -> DataFrame:
    """Adds chromosome, extent and cumulative allele count to gene x mask results."""
    info = members.withColumn("mask", F.explode("masks")).groupBy("set_id", "mask").agg(
        F.min_by("chromosome", "variant_id").alias("chromosome"),
        F.sum(F.round(2 * F.col("maf") * n_samples)).cast("long").alias("cmac"),
    )
    extent = members.groupBy("set_id").agg(F.min("position").alias("start"), F.max("position").alias("end"))
    return results.join(info, ["set_id", "mask"]).join(extent, "set_id").withColumn("gene_name", F.col("set_id"))


# ------------------------------------------------------------------ large sets


def _weight_columns(df: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """b_t*a for burden, b_t*sqrt(a) for SKAT and ACAT weights, per channel and shape."""
    from .score import beta_columns

    df = beta_columns(df)
    slots = [(c, t) for c in range(N_P // 6) for t in range(2)]
    new = {}
    for c, t in slots:
        a = F.lit(1.0) if c == 0 else F.col(f"w{c - 1}")
        b, v = ("b25", "v25") if t == 0 else ("b11", "v11")
        new[f"wb_{c}_{t}"] = F.col(b) * a
        new[f"ws_{c}_{t}"] = F.col(b) * F.sqrt(a)
        new[f"wa_{c}_{t}"] = F.col(v) * a
    return df.withColumns(new), slots


def _large_members(members: DataFrame) -> DataFrame:
    return members.select("set_id", "variant_id", "maf", *W_COLS, *[c for c in ("masks",) if c in members.columns])


def large_set_tests(members: DataFrame, carriers: DataFrame, null: NullModel, minimum: int = 2, tile: int = 512) -> DataFrame:
    """The same battery for sets too large for one task."""
    from ..session import cut_lineage
    from .setsums import one_trait, tested_sets

    needed = carriers.join(members.select("variant_id").distinct(), "variant_id", "left_semi")
    hs = h_cols(null)
    sums = variant_scores(needed, null).select("variant_id", "u", *hs, F.col("n_carriers").alias("load"))
    scored = cut_lineage(gram.rank_members(_large_members(members)).join(sums, "variant_id", "left").fillna(0.0, subset=["u", "load", *hs]))  # read by cells, runs and tests
    cells = gram.pair_products(scored, carriers, null.vectors.select("sample_idx", "w"))
    prepare, finish = one_trait(hs, null.cov_inv, null.n, null.sigma2, W_COLS, minimum)
    return tested_sets(scored, cells, null.n, prepare, finish, tile)


def _by_mask(every: DataFrame, sizes: DataFrame) -> DataFrame:
    """(set_id, slot, p) rows to one row per set and mask; a slot without any usable variant is 1, a NaN stays."""
    slots_all = sizes.select("set_id", F.explode(F.sequence(F.lit(0), F.lit(N_P - 1))).alias("slot"))
    filled = slots_all.join(every, ["set_id", "slot"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    arrays = collect_p(filled, ["set_id"]).join(sizes, "set_id")
    mask = F.split_part("set_id", F.lit("\u0001"), F.lit(2))
    return arrays.select(
        F.split_part("set_id", F.lit("\u0001"), F.lit(1)).alias("set_id"),
        F.when(mask != "", mask).alias("mask"), F.col("n_variants").cast("int").alias("n_variants"), "p",
    )


class Cells:
    """A symmetric matrix by its non-zero cells, rows in order."""

    def __init__(self, j1: np.ndarray, j2: np.ndarray, s: np.ndarray, m: int):
        off = j1 != j2
        r, c, v = np.r_[j1, j2[off]].astype(np.int64), np.r_[j2, j1[off]].astype(np.int64), np.r_[s, s[off]]
        order = np.lexsort((c, r))
        self.r, self.c, self.v, self.m = r[order], c[order], v[order], m
        self.at = np.searchsorted(self.r, np.arange(m + 1))
        self.degree = np.diff(self.at)
        self.paths = float((self.degree.astype(float) ** 2).sum())

    def few(self) -> bool:
        """Whether paths of two cells cost less than the whole matrix."""
        return self.paths * DENSE_PATHS < float(self.m) ** 3

    def diagonal(self, v: np.ndarray) -> np.ndarray:
        own = self.r == self.c
        return np.bincount(self.r[own], v[own], self.m)

    def columns(self, idx: np.ndarray) -> np.ndarray:
        """Columns ``idx`` (ascending) as a dense matrix."""
        new = np.full(self.m, -1)
        new[idx] = np.arange(len(idx))
        at, out = np.flatnonzero(new[self.c] >= 0), np.zeros((self.m, len(idx)))
        out[self.r[at], new[self.c[at]]] = self.v[at]
        return out

    def subset(self, idx: np.ndarray) -> tuple[Cells, np.ndarray]:
        """The cells between rows ``idx`` (ascending) and their places among all cells."""
        new = np.full(self.m, -1)
        new[idx] = np.arange(len(idx))
        places = np.flatnonzero((new[self.r] >= 0) & (new[self.c] >= 0))
        sub = copy(self)
        sub.r, sub.c, sub.v, sub.m = new[self.r[places]], new[self.c[places]], self.v[places], len(idx)
        sub.at = np.searchsorted(sub.r, np.arange(sub.m + 1))
        sub.degree = np.diff(sub.at)
        sub.paths = float((sub.degree.astype(float) ** 2).sum())
        return sub, places

    def path_traces(self, w: np.ndarray, lo: int, hi: int, values: list[np.ndarray] | None = None) -> np.ndarray:
        """Traces of the first four powers of WSW over rows ``lo`` to ``hi``; with several ``values`` of the cells, of each."""
        several = [self.v] if values is None else values
        sums, w2 = np.zeros((len(several), w.shape[1], 4)), np.asfortranarray(w**2)
        of_row = np.add.reduceat(np.r_[self.degree[self.c], 0], np.minimum(self.at[:-1], len(self.c))) * (self.degree > 0)
        ends, reached = np.cumsum(of_row[lo:hi]), np.empty(self.m, np.int64)
        while lo < hi:
            done = ends[len(ends) - (hi - lo)] - of_row[lo]
            top = max(lo + 1, lo + int(np.searchsorted(ends[len(ends) - (hi - lo) :], done + PATH_BLOCK, side="right")))
            e = slice(self.at[lo], self.at[top])
            r, c = self.r[e], self.c[e]
            count = self.degree[c]
            first = np.repeat(np.arange(len(c)), count)
            second = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.at[c], count)
            # Of both orders of a pair one is enough.
            upper = self.c[second] >= r[first]
            first, second = first[upper], second[upper]
            reached[:] = -1
            reached[self.c[second]] = 0
            cols = np.flatnonzero(reached == 0)
            reached[cols] = np.arange(len(cols))
            own, met = (r - lo) * len(cols) + reached[c], np.flatnonzero((reached[c] >= 0) & (c >= r))
            key = (r[first] - lo) * len(cols) + reached[self.c[second]]
            # Any cell is reached by a path of two when its row holds a diagonal; without one it may not be.
            if (top - lo) * len(cols) <= 2 * len(key):
                i, j, place, starts = np.repeat(np.arange(lo, top), len(cols)), np.tile(cols, top - lo), own[met], None
            else:
                order = np.argsort(key, kind="stable")
                first, second, key = first[order], second[order], key[order]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                cell = key[starts]
                i, j = cell // len(cols) + lo, cols[cell % len(cols)]
                place = np.minimum(np.searchsorted(cell, own[met]), len(cell) - 1)
                met, place = met[cell[place] == own[met]], place[cell[place] == own[met]]
            twice, often = np.where(i == j, 1.0, 2.0), np.where(r == c, 1.0, 2.0)[met]
            vals = [(v[e], v[second]) for v in several]
            for x in range(w.shape[1]):
                ends2, both, between = twice * w2[i, x] * w2[j, x], w2[r, x] * w2[c, x], w2[c, x]
                for y, (v, onward) in enumerate(vals):
                    val = (v * between)[first] * onward
                    square = np.bincount(key, val, len(i)) if starts is None else np.add.reduceat(val, starts)
                    cell = v * both
                    sums[y, x] += [(v * w2[r, x])[r == c].sum(), v @ cell, (cell[met] * often) @ square[place], (ends2 * square) @ square]
            lo = top
        return sums[0] if values is None else sums

    def times(self, w: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """WSW x for one weighting."""
        wx = w[:, None] * x
        return w[:, None] * np.column_stack([np.bincount(self.r, v * wx[self.c, q], self.m) for q in range(x.shape[1])])

    def projection_traces(self, w: np.ndarray, h: np.ndarray, inv: np.ndarray, v: np.ndarray | None = None) -> np.ndarray:
        """What the traces of W(S - H inv H')W differ by from those of WSW, over all rows."""
        v = self.v if v is None else v
        sums, tr = np.zeros((w.shape[1], 4)), np.trace
        for x in range(w.shape[1]):
            b = w[:, x, None] * h
            y = self.times(w[:, x], b, v)
            z = self.times(w[:, x], y, v)
            p0, p1, p2, p3 = (inv @ t for t in (b.T @ b, b.T @ y, y.T @ y, y.T @ z))
            sums[x] = [
                -tr(p0), -2 * tr(p1) + tr(p0 @ p0),
                -3 * tr(p2) + 3 * tr(p1 @ p0) - tr(p0 @ p0 @ p0),
                -4 * tr(p3) + 4 * tr(p2 @ p0) + 2 * tr(p1 @ p1) - 4 * tr(p1 @ p0 @ p0) + tr(p0 @ p0 @ p0 @ p0),
            ]
        return sums

    def rows(self, h: np.ndarray, inv: np.ndarray, lo: int, hi: int, v: np.ndarray) -> np.ndarray:
        """Rows of S - H inv H'."""
        k = -(h[lo:hi] @ inv @ h.T)
        e = slice(self.at[lo], self.at[hi])
        k[self.r[e] - lo, self.c[e]] += v[e]
        return k

    def tile_traces(self, w: np.ndarray, h: np.ndarray, inv: np.ndarray, lo: int, hi: int, tile: int, v: np.ndarray | None = None) -> np.ndarray:
        """Traces of the first four powers of WKW over rows ``lo`` to ``hi``, tile by tile; ``lo`` starts a tile, ``hi`` ends one or the set."""
        sums, v = np.zeros((w.shape[1], 4)), self.v if v is None else v
        for p in range(lo, hi, tile):
            sa = slice(p, min(p + tile, hi))
            ka = self.rows(h, inv, sa.start, sa.stop, v)
            for q in range(p, self.m, tile):
                sb = slice(q, min(q + tile, self.m))
                kb = ka if q == p else self.rows(h, inv, sb.start, sb.stop, v)
                twice = 1.0 if q == p else 2.0
                for x in range(w.shape[1]):
                    wx = w[:, x]
                    la, lb = ka * wx[None, :] * wx[sa, None], kb * wx[None, :] * wx[sb, None]
                    cell, square = la[:, sb], la @ lb.T
                    sums[x] += [
                        np.trace(cell) if q == p else 0.0, twice * (cell**2).sum(),
                        twice * (cell * square).sum(), twice * (square**2).sum(),
                    ]
        return sums


# ------------------------------------------------------------------ multi-trait


def multi_battery(s: np.ndarray, k0: np.ndarray, sinv: np.ndarray, maf: np.ndarray, chan: np.ndarray, n: int) -> np.ndarray:
    """Joint tests of several traits; covariance factorises as residual x genotype."""
    t = sinv.shape[0]
    lam_s = np.maximum(np.linalg.eigvalsh(sinv), 0.0)
    beta, den = shape_weights(maf)
    common = np.round(2 * maf * n) > COUNT_LIMIT
    diag = np.diag(k0)
    good = (diag > 0) & np.isfinite(diag)
    quad = np.einsum("ja,ab,jb->j", s, sinv, s)
    single = np.where(good, chi2_sf_np(quad / np.where(good, diag, 1.0), t), 1.0)

    def burden(w: np.ndarray) -> float:
        v = w @ k0 @ w
        if not (v > 0 and np.isfinite(v)):
            return 1.0
        b = w @ s
        return float(chi2_sf_np(np.array([b @ sinv @ b / v]), t)[0])

    out = np.empty((1 + len(chan), 6))
    for c in range(1 + len(chan)):
        a = np.ones(len(maf)) if c == 0 else chan[c - 1]
        for x in range(2):
            wb, ws, wa = beta[x] * a, beta[x] * np.sqrt(a), a * beta[x] ** 2 / den
            out[c, x] = burden(wb)
            q = float((((ws[:, None] * s) @ sinv) ** 2).sum())
            mu = np.maximum(np.linalg.eigvalsh(ws[:, None] * k0 * ws[None, :]), 0.0)
            lam = np.outer(lam_s, mu).ravel()
            lam = lam[lam > LAMBDA_MIN]
            out[c, 2 + x] = skat_p(q, tuple(float((lam**e).sum()) for e in (1, 2, 3, 4)))
            pick = common & (wa != 0)
            ps, cw = list(single[pick]), list(wa[pick])
            rare = ~common & (wa != 0)
            if rare.any():
                ps.append(burden(np.where(rare, wb, 0.0)))
                cw.append(wa[rare].mean())
            out[c, 4 + x] = cauchy_np(ps, cw) if ps else 1.0
    return out.ravel()


def multi_variant_scores(carriers: DataFrame, null: NullModel) -> DataFrame:
    """Per variant: one u per trait, h, gg and the projected (unscaled) variance."""
    from .score import quad_form

    t = len(null.extra["traits"])
    d = F.col("dosage").cast("double")
    agg = attach_null(carriers, null).groupBy("variant_id").agg(
        *[F.sum(d * F.col(f"r{i}")).alias(f"u{i}") for i in range(t)],
        *[F.sum(d * F.col("w") * F.col(x)).alias(h) for x, h in zip(null.x_cols, h_cols(null))],
        F.sum(d * d * F.col("w")).alias("gg"), F.sum(d).alias("mac"),
    )
    return agg.withColumn("k", F.col("gg") - quad_form(null.cov_inv, h_cols(null)))


def multi_variant_tests(carriers: DataFrame, null: NullModel) -> DataFrame:
    """Joint chi-square over the traits per variant, fully native."""
    from ..functions.prob import chi2_sf
    from .score import quad_form

    t = len(null.extra["traits"])
    us = [f"u{i}" for i in range(t)]
    stat = quad_form(null.extra["residual_inv"], us) / F.col("k")
    return multi_variant_scores(carriers, null).withColumn("stat", F.when(F.col("k") > 0, stat)).withColumn(
        "p", F.when(F.col("k") > 0, chi2_sf(F.col("stat"), t)).otherwise(1.0))


def multi_set_tests(members: DataFrame, carriers: DataFrame, null: NullModel, minimum: int = 2, limit: int | None = None) -> DataFrame:
    """Joint battery per set and mask for several traits."""
    has_masks = "masks" in members.columns
    cols = ["set_id", "variant_id", "maf", *W_COLS] + (["masks"] if has_masks else [])
    own = members.select(*cols).withColumn("set_id", F.col("set_id").cast("string"))
    return tested_by_size(own, limit or DENSE_LIMIT, lambda m: dense_multi_set_tests(m, carriers, null, minimum), lambda m: large_multi_set_tests(m, carriers, null, minimum))


def dense_multi_set_tests(members: DataFrame, carriers: DataFrame, null: NullModel, minimum: int = 2) -> DataFrame:
    ranked = gram.rank_members(members)
    cells = gram.pair_products(ranked, carriers, null.vectors.select("sample_idx", "w"))
    t = len(null.extra["traits"])
    us, hs = [f"u{i}" for i in range(t)], h_cols(null)
    scored = ranked.join(multi_variant_scores(carriers, null).select("variant_id", *us, *hs), "variant_id", "left").fillna(0.0, subset=us + hs)
    inv, sinv, n = null.cov_inv, null.extra["residual_inv"], null.n

    def test(key, v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("j").reset_index(drop=True)
        k = covariance(c, len(v), v[hs].to_numpy(float), inv)
        s = v[us].to_numpy(float)
        rows = []
        for mask, idx in _mask_slices(v, minimum):
            f = v.iloc[idx]
            p = multi_battery(s[idx], k[np.ix_(idx, idx)], sinv, f["maf"].to_numpy(float), f[W_COLS].to_numpy(float).T, n)
            rows.append((key[0], mask, len(idx), p))
        return pd.DataFrame(rows, columns=["set_id", "mask", "n_variants", "p"])

    return scored.groupBy("set_id").cogroup(cells.groupBy("set_id")).applyInPandas(test, RESULT)


def large_multi_set_tests(members: DataFrame, carriers: DataFrame, null: NullModel, minimum: int = 2, tile: int = 512) -> DataFrame:
    """The joint battery for sets too large for one task.

    The covariance is residual x genotype: eigenvalue powers of the product are products of
    power sums, so the genotype's cells serve all traits at once.
    """
    from ..session import cut_lineage
    from .setsums import Layer, battery_p, moments_p, tested_sets

    sinv, hs, inv = null.extra["residual_inv"], h_cols(null), null.cov_inv
    t = sinv.shape[0]
    us = [f"u{i}" for i in range(t)]
    needed = carriers.join(members.select("variant_id").distinct(), "variant_id", "left_semi")
    sums = multi_variant_scores(needed, null).select("variant_id", *us, *hs, F.col("mac").alias("load"))
    scored = cut_lineage(gram.rank_members(_large_members(members)).join(sums, "variant_id", "left").fillna(0.0, subset=[*us, *hs, "load"]))  # read by cells, runs and tests
    cells = gram.pair_products(scored, carriers, null.vectors.select("sample_idx", "w"))
    lam = np.maximum(np.linalg.eigvalsh(sinv), 0.0)
    powers = np.array([float((lam**e).sum()) for e in (1, 2, 3, 4)])

    def prepare(v: pd.DataFrame, c: pd.DataFrame):
        whole = Cells(c["j1"].to_numpy(), c["j2"].to_numpy(), c["s"].to_numpy(), len(v))
        u, h = v[us].to_numpy(float), v[hs].to_numpy(float)
        k = whole.diagonal(whole.v) - ((h @ inv) * h).sum(1)
        good = (k > 0) & np.isfinite(k)
        single = np.where(good, chi2_sf_np(((u @ sinv) * u).sum(1) / np.where(good, k, 1.0), t), 1.0)
        size2 = ((u @ sinv) ** 2).sum(1)
        layers = lambda idx, e: [Layer(whole.v[e], u[idx], h[idx], inv, single[idx], size2[idx])]
        return whole, v["maf"].to_numpy(float), v[W_COLS].to_numpy(float).T, list(_mask_slices(v, minimum)), layers

    def burden(u: np.ndarray, v: np.ndarray) -> float:
        return float(chi2_sf_np(np.array([u @ sinv @ u / v[0, 0]]), t)[0]) if v[0, 0] > 0 and np.isfinite(v[0, 0]) else 1.0

    def finish(total: np.ndarray) -> np.ndarray:
        return battery_p(total.reshape(24, -1), t, 1, inv, burden, lambda q, c: moments_p(q, c * powers))

    return tested_sets(scored, cells, null.n, prepare, finish, tile)


# ------------------------------------------------------------ ancestry-informed


def ensemble_weights(n_pops: int, n_base: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two population x (1 + n_base) tables: a column of ones, then absolute normals."""
    rng = np.random.default_rng(seed)
    tables = []
    for _ in range(2):
        t = np.ones((n_pops, 1 + n_base))
        t[:, 1:] = np.abs(rng.standard_normal((n_pops, n_base)))
        tables.append(t)
    return tables[0], tables[1]


def ancestry_set_tests(
    members: DataFrame, carriers: DataFrame, null: NullModel, ancestry: str, w11: np.ndarray, w25: np.ndarray,
    pop_sizes: list[int], minimum: int = 2, limit: int | None = None,
) -> DataFrame:
    """Ensemble over population weightings, combined element-wise.

    Scores and cross-products are kept per population once; every weighting is
    then algebra on those, never another pass over genotypes.  ``ancestry`` must
    be a 0-based population code among the null model's kept columns.
    """
    has_masks = "masks" in members.columns
    cols = ["set_id", "variant_id", "maf", *W_COLS] + (["masks"] if has_masks else [])
    own, rest = members.select(*cols).withColumn("set_id", F.col("set_id").cast("string")), (carriers, null, ancestry, w11, w25, pop_sizes, minimum)
    return tested_by_size(own, limit or DENSE_LIMIT, lambda m: dense_ancestry_set_tests(m, *rest), lambda m: large_ancestry_set_tests(m, *rest))


def large_ancestry_set_tests(
    members: DataFrame, carriers: DataFrame, null: NullModel, ancestry: str, w11: np.ndarray, w25: np.ndarray,
    pop_sizes: list[int], minimum: int = 2, tile: int = 512,
) -> DataFrame:
    """The ensemble for sets too large for one task: every weighting takes the same cells, kept per population."""
    from ..session import cut_lineage
    from .setsums import Layer, battery_p, combined, moments_p, single_burden, single_p, tested_sets

    np_, hs, inv, n, s2 = len(pop_sizes), h_cols(null), null.cov_inv, null.n, null.sigma2
    sums, pop_cols = _population_sums(carriers.join(members.select("variant_id").distinct(), "variant_id", "left_semi"), null, ancestry, np_)
    load = sum((F.col(f"mac_{p}") for p in range(np_)), F.lit(0.0)).alias("load")
    scored = cut_lineage(gram.rank_members(_large_members(members)).join(sums, "variant_id", "left").fillna(0.0, subset=pop_cols).select("*", load))  # read by cells, runs and tests
    cells = gram.pair_products(scored, carriers, null.vectors.select("sample_idx", "w", ancestry), stratum=ancestry).withColumnRenamed(ancestry, "_pop")
    sizes = np.asarray(pop_sizes, float)

    def prepare(v: pd.DataFrame, c: pd.DataFrame):
        m = len(v)
        u, mac, h = _by_population(v, hs, np_)
        key, at = np.unique(c["j1"].to_numpy().astype(np.int64) * m + c["j2"].to_numpy(), return_inverse=True)
        values = np.zeros((np_, len(key)))
        values[c["_pop"].to_numpy(), at] = c["s"].to_numpy()
        # The cells carry their place among the pairs, in whatever order they end up.
        whole = Cells(key // m, key % m, np.arange(len(key)), m)
        places = whole.v
        own = np.stack([whole.diagonal(x[places]) for x in values])
        pooled = np.clip(mac.sum(0) / (2.0 * n), 1e-10, 0.499)

        def layers(idx: np.ndarray, e: np.ndarray) -> list:
            out = []
            for g in _ensemble(mac[:, idx], sizes, w11, w25):
                uu, hh = g @ u[:, idx], np.tensordot(g, h[:, idx, :], axes=1)
                var = s2 * (g**2 @ own[:, idx] - ((hh @ inv) * hh).sum(1))
                out.append(Layer(s2 * (g**2 @ values[:, places[e]]), uu[:, None], hh, inv * s2, single_p(uu, var), uu**2))
            return out

        return whole, pooled, v[W_COLS].to_numpy(float).T, list(_mask_slices(v, minimum)), layers

    def finish(total: np.ndarray) -> np.ndarray:
        each = lambda k, f: battery_p(f, 1, 1, inv * s2, single_burden, moments_p)
        return combined(total.reshape(2 * w11.shape[1], 24, -1), each)

    return tested_sets(scored, cells, n, prepare, finish, tile)


def _population_sums(carriers: DataFrame, null: NullModel, ancestry: str, np_: int) -> tuple[DataFrame, list[str]]:
    """One row per variant with u, mac and h of the populations side by side (few populations), and the columns' names."""
    hs, d = h_cols(null), F.col("dosage").cast("double")
    by_pop = attach_null(carriers, null, [ancestry]).groupBy("variant_id", ancestry).agg(
        F.sum(d * F.col("r")).alias("u"), F.sum(d).alias("mac"),
        *[F.sum(d * F.col("w") * F.col(x)).alias(h) for x, h in zip(null.x_cols, hs)],
    )
    fields = ["u", "mac", *hs]
    wide = by_pop.groupBy("variant_id").agg(*[
        F.sum(F.when(F.col(ancestry) == p, F.col(f)).otherwise(0.0)).alias(f"{f}_{p}") for p in range(np_) for f in fields
    ])
    return wide, [f"{f}_{p}" for p in range(np_) for f in fields]


def _by_population(v: pd.DataFrame, hs: list[str], np_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = np.stack([v[f"u_{p}"].to_numpy(float) for p in range(np_)])
    mac = np.stack([v[f"mac_{p}"].to_numpy(float) for p in range(np_)])
    return u, mac, np.stack([v[[f"{x}_{p}" for x in hs]].to_numpy(float) for p in range(np_)])


def _ensemble(mac: np.ndarray, sizes: np.ndarray, w11: np.ndarray, w25: np.ndarray):
    """Population weights of every weighting for the variants whose counts are given."""
    pm = np.where(sizes[:, None] > 0, mac / (2 * np.maximum(sizes, 1))[:, None], 0.0)
    mean = np.minimum(pm, 1 - pm).mean(1)
    ap = np.where((mean > 0) & (mean < 0.5), 25 * (1 - mean) ** 24, 0.0)
    for col in range(w11.shape[1]):
        yield from (w11[:, col], ap * w25[:, col])


def dense_ancestry_set_tests(
    members: DataFrame, carriers: DataFrame, null: NullModel, ancestry: str, w11: np.ndarray, w25: np.ndarray,
    pop_sizes: list[int], minimum: int = 2,
) -> DataFrame:
    ranked = gram.rank_members(members)
    pops = null.vectors.select("sample_idx", "w", ancestry)
    cells = gram.pair_products(ranked, carriers, pops, stratum=ancestry)
    hs, inv, n, s2 = h_cols(null), null.cov_inv, null.n, null.sigma2
    np_ = len(pop_sizes)
    wide, pop_cols = _population_sums(carriers, null, ancestry, np_)
    scored = ranked.join(wide, "variant_id", "left").fillna(0.0, subset=pop_cols)
    sizes = np.asarray(pop_sizes, float)

    def test(key, v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("j").reset_index(drop=True)
        m = len(v)
        u, mac, h = _by_population(v, hs, np_)
        s = np.zeros((np_, m, m))
        pc, a, b, val = c[ancestry].to_numpy(), c["j1"].to_numpy(), c["j2"].to_numpy(), c["s"].to_numpy()
        s[pc, a, b] = val
        s[pc, b, a] = val
        rows = []
        for mask, idx in _mask_slices(v, minimum):
            f = v.iloc[idx]
            chan = f[W_COLS].to_numpy(float).T
            pooled = np.clip(mac[:, idx].sum(0) / (2.0 * n), 1e-10, 0.499)
            runs = []
            for g in _ensemble(mac[:, idx], sizes, w11, w25):
                hh = np.tensordot(g, h[:, idx, :], axes=1)
                k = np.tensordot(g**2, s[:, idx][:, :, idx], axes=1) - hh @ inv @ hh.T
                runs.append(battery(g @ u[:, idx], k, pooled, chan, n, s2))
            runs = np.asarray(runs)
            p = np.array([cauchy_np(runs[:, i]) for i in range(runs.shape[1])])
            rows.append((key[0], mask, len(idx), p))
        return pd.DataFrame(rows, columns=["set_id", "mask", "n_variants", "p"])

    return scored.groupBy("set_id").cogroup(cells.groupBy("set_id")).applyInPandas(test, RESULT)


def population_frequencies(carriers: DataFrame, groups: DataFrame, ancestry: str) -> DataFrame:
    """Unfolded allele frequency per variant and population."""
    sizes = groups.groupBy(ancestry).agg(F.count("*").alias("n_pop"))
    counts = carriers.join(groups.select("sample_idx", ancestry), "sample_idx").groupBy("variant_id", ancestry).agg(
        F.sum("dosage").cast("long").alias("mac"))
    return counts.join(F.broadcast(sizes), ancestry).select(  # one row per population
        "variant_id", ancestry, "mac", (F.col("mac") / (2.0 * F.col("n_pop"))).alias("pop_maf"))


def ancestry_individual_tests(carriers: DataFrame, null: NullModel, ancestry: str, w11: np.ndarray, w25: np.ndarray, pop_sizes: list[int]) -> DataFrame:
    """Single-variant ensemble p-value, native: per-population sums, then weightings."""
    from ..functions.prob import cauchy_combine, chi2_sf
    from ..functions.variant import beta_weight

    hs = h_cols(null)
    np_ = len(pop_sizes)
    d = F.col("dosage").cast("double")
    rows = attach_null(carriers, null, [ancestry])
    aggs = []
    for p in range(np_):
        here = F.col(ancestry) == p

        def only(c: Column, here=here) -> Column:
            return F.sum(F.when(here, c).otherwise(0.0))

        aggs += [only(d * F.col("r")).alias(f"u_{p}"), only(d * d * F.col("w")).alias(f"gg_{p}"), only(d).alias(f"mac_{p}")]
        aggs += [only(d * F.col("w") * F.col(x)).alias(f"{h}_{p}") for x, h in zip(null.x_cols, hs)]
    agg = rows.groupBy("variant_id").agg(*aggs)
    agg = agg.withColumns({f"pm_{p}": F.col(f"mac_{p}") / (2.0 * max(pop_sizes[p], 1)) for p in range(np_)})
    agg = agg.withColumns({
        f"ap_{p}": beta_weight(F.least(F.col(f"pm_{p}"), 1.0 - F.col(f"pm_{p}")), 1, 25) for p in range(np_)
    })
    # One row per weighting; the grouping by variant is kept, so no further shuffle.
    runs = [
        F.struct(F.lit(kind).alias("scaled"), *[F.lit(float(table[p, col])).alias(f"v{p}") for p in range(np_)])
        for col in range(w11.shape[1]) for kind, table in ((False, w11), (True, w25))
    ]
    long = agg.withColumn("run", F.explode(F.array(*runs)))
    long = long.withColumns({
        f"s_{p}": F.col(f"run.v{p}") * F.when(F.col("run.scaled"), F.col(f"ap_{p}")).otherwise(1.0) for p in range(np_)
    })

    def mix(f: str, power: int = 1) -> Column:
        acc = F.lit(0.0)
        for p in range(np_):
            acc = acc + F.pow(F.col(f"s_{p}"), F.lit(float(power))) * F.col(f"{f}_{p}")
        return acc

    from .score import quad_form

    mixed = long.select(
        "variant_id", F.array(*[f"pm_{p}" for p in range(np_)]).alias("pop_mafs"),
        mix("u").alias("u"), mix("gg", 2).alias("gg"), *[mix(h).alias(h) for h in hs],
    ).withColumn("k", F.col("gg") - quad_form(null.cov_inv, hs))
    stat = F.when(F.col("k") > 0, F.col("u") * F.col("u") / (null.sigma2 * F.col("k")))
    tested = mixed.withColumn("stat", stat).withColumn("p", F.when(F.col("stat").isNotNull(), chi2_sf(F.col("stat"))).otherwise(1.0))
    return tested.groupBy("variant_id").agg(F.first("pop_mafs").alias("pop_mafs"), cauchy_combine(F.col("p")).alias("ai_pvalue"))
