"""The tiled paths of set tests against the dense ones, on one small cohort."""

import numpy as np
import pytest

from sparvar.operators import nullmodel as NM
from sparvar.operators import settests as ST


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(4)
    n, m = 80, 60
    pheno = spark.createDataFrame(
        [(i, float(a), float(0.6 * a + b), float(c), int(i % 3)) for i, (a, b, c) in enumerate(rng.normal(size=(n, 3)))], "sample_idx long, y double, y2 double, x1 double, pop int")
    g = rng.binomial(2, rng.uniform(0.02, 0.3, m), (n, m))
    g[:, 7] = 0  # nobody carries it
    carriers = spark.createDataFrame([(v, i, int(g[i, v])) for i in range(n) for v in range(m) if g[i, v]], "variant_id long, sample_idx long, dosage int")
    rows = []
    for v in range(m):
        maf = float(g[:, v].mean() / 2)
        w = [float(x) for x in rng.uniform(0, 1, 11) * (rng.random(11) > 0.2)]
        names = [k for k, hit in (("all", True), ("half", v % 2 == 0), ("few", v < 3)) if hit]
        rows.append(("s1" if v < 45 else "s2", v, min(maf, 1 - maf), *w, names))
    members = spark.createDataFrame(rows, "set_id string, variant_id long, maf double, " + ", ".join(f"w{i} double" for i in range(11)) + ", masks array<string>")
    return pheno.cache(), carriers.cache(), members.cache()


def by_set(frame):
    return {(r.set_id, r["mask"]): (r.n_variants, np.array(r.p)) for r in frame.collect()}


def same(large, dense):
    large, dense = by_set(large), by_set(dense)
    assert set(large) == set(dense) and len(dense) == 5
    for k in dense:
        assert large[k][0] == dense[k][0]
        assert np.allclose(large[k][1], dense[k][1], rtol=1e-5, atol=1e-9, equal_nan=True), (k, np.abs(large[k][1] - dense[k][1]).argmax())


def test_one_trait(cohort):
    pheno, carriers, members = cohort
    null = NM.fit_gaussian(pheno, "y", ["x1"])
    same(ST.large_set_tests(members, carriers, null, tile=16), ST.dense_set_tests(members, carriers, null))


def test_several_traits(cohort):
    pheno, carriers, members = cohort
    null = NM.fit_gaussian_multi(pheno, ["y", "y2"], ["x1"])
    same(ST.large_multi_set_tests(members, carriers, null, tile=16), ST.dense_multi_set_tests(members, carriers, null))
    # The public call takes the same sets by either path.
    same(ST.multi_set_tests(members, carriers, null, limit=20), ST.multi_set_tests(members, carriers, null))


def test_ancestry(cohort):
    pheno, carriers, members = cohort
    null = NM.fit_gaussian(pheno, "y", ["x1"], ["pop"])
    sizes = [27, 27, 26]
    w11, w25 = ST.ensemble_weights(3, 1, 5)
    args = (carriers, null, "pop", w11, w25, sizes)
    same(ST.large_ancestry_set_tests(members, *args, tile=16), ST.dense_ancestry_set_tests(members, *args))


def test_nan_stays(spark, cohort):
    """A missing slot is 1, a NaN is no result and stays one."""
    sizes = spark.createDataFrame([("a\u0001m", 4)], "set_id string, n_variants long")
    every = spark.createDataFrame([("a\u0001m", 0, float("nan")), ("a\u0001m", 1, 0.25)], "set_id string, slot int, p double")
    row = ST._by_mask(every, sizes).first()
    assert (row.set_id, row["mask"], row.n_variants) == ("a", "m", 4) and np.isnan(row.p[0]) and row.p[1] == 0.25 and set(row.p[2:]) == {1.0}


def test_traces_of_few_cells_and_of_many():
    rng = np.random.default_rng(3)
    for m, share in ((60, 0.05), (60, 0.3), (150, 0.02)):
        g = (rng.random((400, m)) < share) * rng.integers(1, 3, (400, m)).astype(float)
        g[:, ::7] = 0
        om, x, w = rng.random(400), np.c_[np.ones(400), rng.random(400)], rng.random((m, 3))
        s, h, inv = g.T @ (om[:, None] * g), g.T @ (om[:, None] * x), np.linalg.inv(x.T @ (om[:, None] * x))
        k = s - h @ inv @ h.T
        want = [[np.trace(np.linalg.matrix_power(w[:, i, None] * k * w[None, :, i], e)) for e in (1, 2, 3, 4)] for i in range(3)]
        a, b = np.nonzero(np.triu(s))
        cells = ST.Cells(a, b, s[a, b], m)
        runs = [(lo, min(lo + 13, m)) for lo in range(0, m, 13)]
        assert np.allclose(sum(cells.path_traces(w, *r) for r in runs) + cells.projection_traces(w, h, inv), want, rtol=1e-9)
        assert np.allclose(sum(cells.tile_traces(w, h, inv, lo, min(lo + 32, m), 8) for lo in range(0, m, 32)), want, rtol=1e-9)


def test_pair_products_by_sample_and_by_tile_agree(spark, monkeypatch):
    from sparvar.operators import gram

    rng = np.random.default_rng(4)
    g = (rng.random((40, 30)) < 0.2) * rng.integers(1, 3, (40, 30))
    carriers = spark.createDataFrame([(int(j), int(i), int(g[i, j])) for i, j in zip(*np.nonzero(g))], "variant_id long, sample_idx long, dosage int")
    ranked = spark.createDataFrame([("s", j, j) for j in range(30)] + [("t", j, j - 20) for j in range(20, 30)], "set_id string, variant_id long, j int")
    weights = spark.createDataFrame([(i, 0.5 + i) for i in range(40)], "sample_idx long, w double")
    want = g.T @ ((0.5 + np.arange(40))[:, None] * g)
    for few in (0, 5, 64):  # all by tile, some, none
        monkeypatch.setattr(gram, "FEW", few)
        got = {(r.set_id, r.j1, r.j2): r.s for r in gram.pair_products(ranked, carriers, weights, chunk_rows=50, tile=8).collect()}
        full = {("s", i, j): want[i, j] for i in range(30) for j in range(i, 30) if want[i, j]}
        full |= {("t", i - 20, j - 20): want[i, j] for i in range(20, 30) for j in range(i, 30) if want[i, j]}
        assert got.keys() == full.keys() and all(abs(got[k] - full[k]) < 1e-9 for k in full)
