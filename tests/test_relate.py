"""Relatedness against whole matrices on a small structured cohort."""

import numpy as np
import pytest

from sparvar.operators import relate as R

N, M = 75, 60


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(4)
    pops = rng.integers(0, 3, N)
    p = rng.uniform(0.05, 0.5, (3, M))
    g = rng.binomial(2, p[pops])
    g[:, 7] = 0
    # Second members of the first pairs repeat most of the first one's genotypes.
    links = [(3 * k, 3 * k + 1) for k in range(12)] + [(1, 2), (4, 5)]
    for i, j in links:
        same = rng.random(M) < 0.8
        g[j, same] = g[i, same]
    g[74] = 0
    samples = spark.createDataFrame([(i, f"s{i}") for i in range(N)], "sample_idx long, sample_id string")
    carriers = spark.createDataFrame([(v, i, int(g[i, v])) for i in range(N) for v in range(M) if g[i, v]], "variant_id long, sample_idx long, dosage int")
    variants = spark.createDataFrame([(v, ("1", "2", "X")[v % 3], 1000 + 7000 * (v // 3), "A", "C") for v in range(M)], "variant_id long, chromosome string, position int, ref string, alt string")
    pairs = spark.createDataFrame([(i, j, 0.1 + 0.01 * (i % 9)) for i, j in links], "i long, j long, prop_ibd double")
    return g, samples, carriers, variants, pairs, links


def far_counts(g, who, cutoff):
    out = {}
    for i in who:
        n = 0
        for j in range(len(g)):
            het = (g[i] == 1).sum() + (g[j] == 1).sum()
            opposite = ((g[i] == 2) & (g[j] == 0)).sum() + ((g[i] == 0) & (g[j] == 2)).sum()
            n += j != i and het > 0 and (((g[i] == 1) & (g[j] == 1)).sum() - 2 * opposite) / het < cutoff
        out[i] = n
    return out


@pytest.mark.parametrize("shape", [{}, {"width": 16, "rows": 8, "columns": 10}])
@pytest.mark.parametrize("strided", [None, 20])
def test_divergence(cohort, shape, strided):
    g, samples, carriers, variants, pairs, links = cohort
    who = sorted({x for pair in links for x in pair}) + [74]
    related = samples.where(samples.sample_idx.isin(who))
    got = {r.sample_idx: r.divergence for r in R.divergence(carriers, variants, related.union(related), samples, strided, cutoff=-0.3, **shape).collect()}
    order = [v for c in range(3) for v in range(c, M, 3)]
    use = order if strided is None else order[:: M // strided][:strided]
    assert got == far_counts(g[:, use], who, -0.3)
    assert len(set(got.values())) > 3


def test_divergence_of_empty_tables(cohort):
    g, samples, carriers, variants, _, _ = cohort
    none = samples.where("false")
    assert R.divergence(carriers, variants, none, samples).count() == 0
    assert R.divergence(carriers, variants, none, none).count() == 0
    # Without a call there is no heterozygote, so nobody is far.
    assert {r.divergence for r in R.divergence(carriers.where("false"), variants, samples, samples).collect()} == {0}


@pytest.mark.parametrize("piece", [4, 2048])
@pytest.mark.parametrize("cutoff", [-0.3, 0.01])
def test_divergence_by_shared_variants(spark, cohort, piece, cutoff):
    g, samples, carriers, variants, _, links = cohort
    who = sorted({x for pair in links for x in pair}) + [74]
    calls = carriers.withColumnRenamed("dosage", "d")
    mine = samples.where(samples.sample_idx.isin(who)).select("sample_idx")
    out = R._far_by_shared(calls, mine, samples.select("sample_idx"), cutoff, 75, piece, kinds=8)
    got = {r.sample_idx: r.divergence for r in out.collect()}
    assert got == far_counts(g, who, cutoff)
    assert len(set(got.values())) > 3


def test_rare_variants_are_joined_not_multiplied(spark, cohort, monkeypatch):
    _, samples, _, variants, _, _ = cohort
    called = []
    monkeypatch.setattr(R, "_far_by_shared", lambda *a: called.append(a))
    rare = spark.createDataFrame([(v, v, 1) for v in range(60)], "variant_id long, sample_idx long, dosage int")
    R.divergence(rare, variants, samples, samples)
    assert called


def standardised(g, train):
    mu = g[train].mean(0) / 2
    var = 2 * mu * (1 - mu)
    keep = var > 1e-10
    return (g[:, keep] - 2 * mu[keep]) / np.sqrt(var[keep])


@pytest.fixture(scope="module")
def scores(cohort):
    g, samples, carriers, variants, pairs, _ = cohort
    none = samples.selectExpr("sample_idx", "0L AS divergence")
    unrelated = R.unrelated_subset(pairs, samples, none)
    out, ev = R.principal_components(carriers, samples, unrelated, 2)
    pcs = np.zeros((N, 2))
    for r in out.collect():
        pcs[r.sample_idx] = r.pc1, r.pc2
    return sorted(r.sample_idx for r in unrelated.collect()), pcs, ev


def test_components_equal_a_dense_decomposition(cohort, scores):
    g = cohort[0]
    train, pcs, ev = scores
    z = standardised(g, train)
    u, s, vt = np.linalg.svd(z[train], full_matrices=False)
    assert np.allclose(ev, s[:2] ** 2, rtol=1e-6)
    assert np.allclose(pcs[train].T @ pcs[train], np.eye(2), atol=1e-8)
    want = z @ vt[:2].T / s[:2]
    sign = np.sign((want * pcs).sum(0))
    assert np.allclose(pcs, want * sign, atol=1e-4)


def dense_kinship(g, pcs, train):
    x = np.column_stack([np.ones(N), pcs])
    beta = np.linalg.solve(x[train].T @ x[train], x[train].T @ g[train])
    mu = np.clip(x @ beta, 1e-4, 1.9999)
    sd = np.sqrt(2 * mu * (1 - mu / 2))
    return (g - mu) @ (g - mu).T / (sd @ sd.T)


def test_whole_job(cohort, scores):
    """Kinship does not depend on the signs of components, so the job is compared with dense algebra."""
    g, samples, carriers, variants, pairs, links = cohort
    ends = pairs.selectExpr("explode(array(i, j)) AS sample_idx").distinct()
    div = R.divergence(carriers, variants, ends, samples)
    out = R.relatedness_matrix(pairs, carriers, variants, samples, div, 2, 3, n_iter=6)
    train = sorted(r.sample_idx for r in out["unrelated"].collect())
    # No kept sample has a kept relative, and all without relatives are kept.
    assert not any(i in train and j in train for i, j in links)
    assert set(range(N)) - {x for pair in links for x in pair} <= set(train)
    z = standardised(g, train)
    u, s, vt = np.linalg.svd(z[train], full_matrices=False)
    kin = dense_kinship(g, z @ vt[:2].T / s[:2], train)
    limit = R.kinship_threshold(3)
    want = {(i, i) for pair in links for i in pair}
    for i, j in links:
        if kin[i, j] >= limit:
            want |= {(i, j), (j, i)}
    rows = out["kinship"].collect()
    assert {(r.i, r.j) for r in rows} == want and len(rows) == len(want)
    assert any(r.i != r.j for r in rows)
    assert all(np.isclose(r.kinship, kin[r.i, r.j], atol=1e-4) for r in rows)


def test_kinship_blocks_add_up(cohort, scores, spark):
    g, samples, carriers, variants, pairs, links = cohort
    train, pcs, _ = scores
    frame = spark.createDataFrame([(i, *map(float, pcs[i])) for i in range(N)], "sample_idx long, pc1 double, pc2 double")
    beta = R.ancestry_regression(carriers, frame, samples.where(samples.sample_idx.isin(train)), ["pc1", "pc2"])
    want = dense_kinship(g, pcs, train)
    for size in (7, 20_000):
        rows = R.pair_kinship(R.with_self_pairs(pairs), carriers, variants, frame, beta, ["pc1", "pc2"], block_variants=size).collect()
        assert len(rows) == len(links) + len({x for pair in links for x in pair})
        assert all(np.isclose(r.kinship, want[r.i, r.j], rtol=1e-8) for r in rows)


def test_refined_threshold_drops_what_ties_components(spark):
    # A path of five broken at its weakest links until no component exceeds three.
    kin = spark.createDataFrame([(0, 1, 0.2), (1, 2, 0.2), (2, 3, 0.1), (3, 4, 0.3), (0, 0, 0.5), (4, 4, 0.5)], "i long, j long, kinship double")
    t, comp, raised = R.refine_threshold(kin, 0.09, 3)
    assert raised and 0.1 <= t < 0.1 * 2**0.01
    assert {(r.sample, r.component) for r in comp.collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)}
    assert [(r.i, r.j) for r in R.new_component_pairs(comp, kin).collect()] == [(0, 2)]
    t, comp, raised = R.refine_threshold(kin, 0.09, 5)
    assert (t, raised) == (0.09, False)
    # A limit that no pair meets ends with no components.
    assert R.refine_threshold(kin, 0.09, 1)[1].count() == 0


def test_expected_sums_visit_distinct_coordinates_once(spark):
    # 2e11 combinations of a pair and a variant, 147 of distinct coordinates.
    from sparvar.operators.kinblocks import expected_sums

    pairs = spark.range(400_000).selectExpr("id AS i", "id + 1 AS j")
    x = spark.range(400_001).selectExpr("id AS sample_idx", "array(1D, id % 7 / 7D) AS x")
    coefs = spark.range(500_000).selectExpr("id AS variant_id", "array(id % 3 - 0.5D, 0.25D) AS b")
    n = np.array([166_667, 166_667, 166_666])
    out = expected_sums(pairs, x, coefs, 1e-4, 1.9999, 20_000)
    assert out.count() == 400_000
    for r in out.where("i < 7").collect():
        mi, mj = (np.clip(np.arange(3) - 0.5 + 0.25 * (s % 7) / 7, 1e-4, 1.9999) for s in (r.i, r.j))
        assert np.isclose(r.mm, (n * mi * mj).sum()) and np.isclose(r.sd, (n * np.sqrt(4 * mi * (1 - mi / 2) * mj * (1 - mj / 2))).sum())


def test_threshold_is_raised_before_a_large_component_is_complete(spark, monkeypatch):
    # A chain of all samples used to be labelled to its end before its size was looked at.
    n = 400
    rows = [(i, i + 1, 0.3 if i % 3 != 2 else 0.089 + (i % 5) * 0.0005) for i in range(n - 1)]
    pairs = spark.createDataFrame(rows, "i long, j long, kinship double")
    steps = []
    real = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: steps.append(1) or real(df))
    assert R.connected_components(pairs, most=3) is None
    assert len(steps) <= 4
    threshold, comp, raised = R.refine_threshold(pairs, R.kinship_threshold(2), 3)
    assert raised and threshold >= 0.091
    assert {(r["sample"], r["component"]) for r in comp.collect()} == {(i, i // 3 * 3) for i in range(n) if i < 399}


def test_components_up_to_the_limit_are_complete(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (7, 5)], "i long, j long")
    whole = {(0, 0), (1, 0), (2, 0), (3, 0), (5, 5), (7, 5)}
    assert {(r["sample"], r["component"]) for r in R.connected_components(pairs, most=4).collect()} == whole
    assert R.connected_components(pairs, most=3) is None
