"""Sets tested from sums over runs of rows, against the dense tests."""

import numpy as np
import pytest

from sparvar.operators import gram, mixed, setsums
from sparvar.operators import nullmodel as NM
from sparvar.operators import settests as ST


@pytest.fixture(scope="module")
def families(spark):
    rng = np.random.default_rng(8)
    n, m = 90, 40
    pheno = spark.createDataFrame([(i, float(a + (i // 3 % 4)), float(b + 0.5 * a), float(c), int(i % 3)) for i, (a, b, c) in enumerate(rng.normal(size=(n, 3)))], "sample_idx long, y double, y2 double, x1 double, pop int")
    kin = spark.createDataFrame([(i, j, 0.5) for f in range(0, n, 3) for i in range(f, f + 3) for j in range(i + 1, f + 3)], "i long, j long, value double")
    g = rng.binomial(2, rng.uniform(0.02, 0.3, m), (n, m))
    carriers = spark.createDataFrame([(v, i, int(g[i, v])) for i in range(n) for v in range(m) if g[i, v]], "variant_id long, sample_idx long, dosage int")
    rows = [("s", v, float(min(f := g[:, v].mean() / 2, 1 - f)), *[float(x) for x in rng.uniform(0, 1, 11)], [k for k, hit in (("all", True), ("half", v % 2 == 0)) if hit]) for v in range(m)]
    members = spark.createDataFrame(rows, "set_id string, variant_id long, maf double, " + ", ".join(f"w{i} double" for i in range(11)) + ", masks array<string>")
    return pheno.cache(), kin.cache(), carriers.cache(), members.cache()


def test_several_traits_of_relatives(families):
    """Sets over the limit are not decomposed (they were, whatever their size)."""
    pheno, kin, carriers, members = families
    model = mixed.fit_reml(mixed.build_families(pheno, [kin], ["y", "y2"], ["x1"]), tol=1e-4)
    want, got = ({r["mask"]: r for r in mixed.kinship_multi_set_tests(members, carriers, model, limit=x).collect()} for x in (None, 10))
    assert set(want) == set(got) == {"all", "half"}
    for k, r in want.items():
        assert got[k].n_variants == r.n_variants and np.allclose(got[k].p, r.p, rtol=1e-5, atol=1e-9), k


def test_ensemble_reads_genotypes_once(families, monkeypatch):
    pheno, _, carriers, members = families
    null, calls, real = NM.fit_gaussian(pheno, "y", ["x1"], ["pop"]), [], gram.pair_products
    monkeypatch.setattr(gram, "pair_products", lambda *a, **k: calls.append(1) or real(*a, **k))
    w11, w25 = ST.ensemble_weights(3, 2, 5)
    ST.ancestry_set_tests(members, carriers, null, "pop", w11, w25, [30, 30, 30], limit=10)
    assert len(calls) == 1  # once a weighting before


@pytest.mark.parametrize("rows", [16, 8192])
def test_runs_of_a_set_add_up(families, monkeypatch, rows):
    """Many cells are cut into runs by rows; the cells of a set go out once a run."""
    pheno, _, carriers, members = families
    monkeypatch.setattr(setsums, "RUN_ROWS", rows)
    null = NM.fit_gaussian(pheno, "y", ["x1"])
    want, got = ({r["mask"]: r.p for r in f(members, carriers, null).collect()} for f in (ST.dense_set_tests, lambda *a: ST.large_set_tests(*a, tile=8)))
    assert want.keys() == got.keys() and all(np.allclose(got[k], p, rtol=1e-5, atol=1e-9) for k, p in want.items())


def test_store_keeps_products_and_no_pairs(spark, families, tmp_path):
    from sparvar.operators import scorecache

    pheno, _, carriers, members = families
    null, path = NM.fit_gaussian(pheno, "y", ["x1"]), str(tmp_path / "c")
    few = carriers.where("sample_idx % 3 = 0")
    scorecache.save(path, members, few, null)
    subset = members.where("variant_id % 2 = 0").select("variant_id")
    pairs = scorecache.load_cells(spark, path, subset).toPandas()
    got = scorecache.cell_totals(spark, path, subset).first()
    assert len(pairs) == got.n_cells == 20 * 21 // 2
    assert np.isclose(got.total, np.where(pairs.v1 == pairs.v2, pairs.k, 2 * pairs.k).sum())
    assert spark.read.parquet(f"{path}/s").count() < 40 * 41 // 2  # every pair was a row before


def pooled(rng, m):
    import pandas as pd

    g = (rng.random((300, m)) < 0.02) * 1.0
    side = np.c_[np.ones(300), rng.random(300)]
    h, inv = g.T @ side, np.linalg.inv(side.T @ side)
    s = g.T @ g
    a, b = np.nonzero(np.triu(s))
    v = pd.DataFrame({"maf": rng.uniform(0.001, 0.2, m), "mac_total": 5, "n_total": 300, "position": np.arange(m), **{f"w{i}": rng.random(m) for i in range(11)}})
    return v, a, b, s, h, inv


def test_pooled_mask_of_many_variants(monkeypatch):
    """Sums and decomposition agree; sets of more than 2,000 variants were refused before."""
    from sparvar.operators import meta as M

    rng = np.random.default_rng(2)
    v, a, b, s, h, inv = pooled(rng, 300)
    u, cells = rng.normal(size=300) * 3, ST.Cells(a, b, s[a, b], 300)
    assert cells.few()
    small = M._row("s", "m", v, u, cells, h, inv)
    monkeypatch.setattr(M, "SMALL", 1000)
    want = M._row("s", "m", v, u, cells, h, inv)
    k = s - h @ inv @ h.T
    assert small[:7] == want[:7] and np.allclose(small[7:9], (u.sum() / k.sum(), k.sum() ** -0.5)) and np.allclose(small[9], want[9], rtol=1e-5, atol=1e-9)


@pytest.mark.parametrize("per_study", [False, True])
def test_loci_are_thin_products(per_study):
    import pandas as pd

    from sparvar.operators import meta as M

    rng, m, c, studies = np.random.default_rng(5), 30, np.array([3, 11]), []
    for _ in range(2):
        _, a, b, s, h, inv = pooled(rng, m)
        studies.append((a, b, s, h @ np.linalg.cholesky(inv), rng.normal(size=m)))
    v = pd.DataFrame({"is_test": ~np.isin(np.arange(m), c), "u_meta": sum(x[4] for x in studies)})
    v["g"] = [[{"study_idx": k, "g": x[3][i]} for k, x in enumerate(studies)] for i in range(m)]
    v["studies"] = [[{"study_idx": k, "u": x[4][i]} for k, x in enumerate(studies)] for i in range(m)]
    cells = pd.concat([pd.DataFrame({"study_idx": k, "j1": x[0], "j2": x[1], "s": x[2][x[0], x[1]]}) for k, x in enumerate(studies)])
    u, whole, h, inv = M._given(v, cells, per_study)
    ks = [x[2] - x[3] @ x[3].T for x in studies]
    parts = list(zip(ks, [x[4] for x in studies])) if per_study else [(sum(ks), v["u_meta"].to_numpy())]
    want_u, want_k = np.zeros(m), np.zeros((m, m))
    for k, us in parts:
        f = np.linalg.solve(k[np.ix_(c, c)] + M.RIDGE * np.eye(2), k[c]).T
        want_u, want_k = want_u + us - f @ us[c], want_k + k - f @ k[c]
    assert np.allclose(u, want_u) and np.allclose(whole.rows(h, inv, 0, m, whole.v), want_k)
