"""Statistics against closed forms and numpy, guards, and look-ups."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparvar.functions import prob
from sparvar.functions import variant as V
from sparvar.operators import report, scorecache, settests, spa
from sparvar.operators.nullmodel import fit_gaussian, fit_logistic
from sparvar.session import scratch_root
from sparvar.sources import tabular, vcf


def normal_sf(z):
    return math.erfc(z / math.sqrt(2)) / 2


def test_tails(spark):
    z = [-8.0, -3.0, -0.5, 0.0, 0.7, 2.0, 6.0]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select("z", prob.normal_cdf(F.col("z")).alias("p"), prob.chi2_sf(F.col("z") * F.col("z"), 1).alias("c")).collect()
    for r in rows:
        assert r.p == pytest.approx(normal_sf(-r.z), rel=1e-6)
        assert r.c == pytest.approx(2 * normal_sf(abs(r.z)), rel=1e-6)
    # The moment match of a single chi-square(1) is that chi-square.
    assert float(prob.liu_pvalue(3.84, 1, 1, 1, 1)[0]) == pytest.approx(2 * normal_sf(math.sqrt(3.84)), rel=1e-3)
    assert prob.cauchy_np([0.3, 0.3, 0.3]) == pytest.approx(0.3)


def test_chromosome_lists():
    assert V.parse_chromosome_spec(" chr2, 1-3,M ,x") == ["1", "2", "3", "X", "MT"]
    assert V.parse_chromosome_spec("4 - 6,,21-22") == ["4", "5", "6", "21", "22"]
    for bad in ("", "0-3", "5-2", "1-23", "Z", "1-X", ","):
        with pytest.raises(ValueError, match="no list of chromosomes"):
            V.parse_chromosome_spec(bad)


def test_column_and_sample_id_lookup():
    assert tabular.resolve_column("age", ["Age", "sex"]) == "Age"
    assert tabular.resolve_column("age", ["AGE", "age", "Age"]) == "age"
    assert tabular.resolve_column("age", ["x", "years"], {"age": "years"}) == "years"
    for wanted, cols, explicit in (("age", ["AGE", "Age"], None), ("age", ["age"], {"age": "gone"}), ("age", [], None)):
        with pytest.raises(ValueError, match="no column for"):
            tabular.resolve_column(wanted, cols, explicit)
    assert tabular.resolve_sample_id(["x", "IID"]) == "IID"
    assert tabular.resolve_sample_id(["ID", "IID"]) == "ID"
    assert tabular.resolve_sample_id(["a", "b"]) == "a"
    assert tabular.resolve_sample_id(["a", "key"], {"id": "key"}) == "key"


def test_trimming_long_alleles(spark):
    core = "ACGT" * 300
    rows = [("A", "T", 5), ("GG" + core + "A", "GG" + core + "T", 100), ("CA", "CAA", 7), (core, core + "G", 1)]
    got = spark.createDataFrame(rows, "ref string, alt string, pos int").select(V.parsimonious("ref", "alt", "pos").alias("v")).select("v.*").collect()
    for (r, a, p), g in zip(rows, got, strict=True):
        while len(r) > 1 and len(a) > 1 and r[-1] == a[-1]:
            r, a = r[:-1], a[:-1]
        while len(r) > 1 and len(a) > 1 and r[0] == a[0]:
            r, a, p = r[1:], a[1:], p + 1
        assert (g.ref, g.alt, g.position) == (r, a, p)


def test_scratch_needs_a_shared_folder_off_local_masters():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session())


def test_best_mask_is_stable_when_masks_tie(spark):
    rows = [("g", "1", "b", 0.25, 3, 9), ("g", "1", "a", 0.25 + 1e-15, 3, 9), ("h", "1", "a", float("nan"), 1, 1), ("h", "1", "c", 0.5, 1, 1)]
    df = spark.createDataFrame(rows, "gene_name string, chromosome string, mask string, `STAAR-O` double, n_variants int, cmac int")
    assert {(r.gene_name, r["mask"]) for r in report.best_per_gene(df).collect()} == {("g", "a"), ("h", "c")}


def test_header_guard(spark, tmp_path):
    for name, cols in (("a", "s1\ts2"), ("b", "s1\ts3")):
        (tmp_path / f"{name}.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + cols + "\n")
    paths = [str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")]
    with pytest.raises(ValueError, match="sample columns differ"):
        vcf.check_same_samples(spark, paths)
    assert vcf.check_same_samples(spark, paths[:1]).count() == 2


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    n, m = 120, 30
    g = (rng.random((n, m)) < 0.06).astype(int) + (rng.random((n, m)) < 0.01)
    x = rng.standard_normal(n)
    y = 0.4 * x + 0.5 * g[:, 3] + rng.standard_normal(n)
    pheno = spark.createDataFrame(pd.DataFrame({"sample_idx": np.arange(n), "x1": x, "y": y, "b": (y > 0.6).astype(float)}))
    i, j = np.nonzero(g)
    carriers = spark.createDataFrame(pd.DataFrame({"variant_id": j, "sample_idx": i, "dosage": g[i, j]}))
    maf = np.clip(g.mean(0) / 2, 1e-3, 0.49)
    members = pd.DataFrame({"set_id": "s", "variant_id": np.arange(m), "maf": maf} | {c: rng.random(m) for c in settests.W_COLS})
    return g, x, y, pheno, carriers, spark.createDataFrame(members), members


def test_scores_equal_dense_algebra(cohort, spark, tmp_path):
    g, x, y, pheno, carriers, members, frame = cohort
    null = fit_gaussian(pheno, "y", ["x1"])
    design = np.column_stack([np.ones(len(x)), x])
    r = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    s2 = float(r @ r / (len(y) - 2))
    hat = design @ np.linalg.inv(design.T @ design) @ design.T
    k = g.T @ (np.eye(len(x)) - hat) @ g
    assert null.sigma2 == pytest.approx(s2)
    scorecache.save(str(tmp_path / "c"), members, carriers, null)
    cells = scorecache.load_cells(spark, str(tmp_path / "c"), members.select("variant_id")).toPandas()
    assert len(cells) == len(frame) * (len(frame) + 1) // 2
    assert np.allclose(cells["k"], k[cells["v1"], cells["v2"]] / s2)
    u = spark.read.parquet(str(tmp_path / "c" / "u")).toPandas()
    assert np.allclose(u["u"], (g.T @ r)[u["variant_id"]] / s2)
    loaded = scorecache.load_null(spark, str(tmp_path / "c"), n_expected=len(y))
    assert loaded.sigma2 == pytest.approx(s2) and np.allclose(loaded.cov_inv, null.cov_inv)
    with pytest.raises(ValueError, match="samples"):
        scorecache.load_null(spark, str(tmp_path / "c"), n_expected=3)


def test_large_sets_give_the_values_of_dense_ones(cohort):
    *_, pheno, carriers, members, _ = cohort
    null = fit_gaussian(pheno, "y", ["x1"])
    dense = settests.set_tests(members, carriers, null).first()
    large = settests.set_tests(members, carriers, null, limit=4).first()
    assert dense.n_variants == large.n_variants
    assert np.allclose(dense.p, large.p, rtol=1e-5, atol=1e-9)


def test_saddlepoint_is_near_normal_for_balanced_and_exact_in_form(cohort, spark):
    *_, pheno, carriers, _, _ = cohort
    null = fit_logistic(pheno, "b", ["x1"])
    got = spa.variant_saddlepoint(carriers, null.vectors).toPandas()
    assert ((got["p"] > 0) & (got["p"] <= 1)).all() and got["exact"].any()
    assert (np.abs(np.log10(got.loc[got["exact"], "p"] / got.loc[got["exact"], "p_normal"])) < 1.5).all()


def test_trimming_works_out_each_run_once(spark):
    from random import Random

    rng = Random(5)
    rows = [("".join(rng.choices("ACG", k=rng.randint(0, 9))), "".join(rng.choices("AC", k=rng.randint(0, 9))), 100) for _ in range(400)]
    rows += [("A" * 900 + "C" + "A" * 70, "A" * 900 + "G" + "A" * 70, 1), ("AC" * 500, "AC" * 480, 5), (None, "A", 3), ("GGATC", "GGCTC", 7)]

    def trim(r, a, p):
        if r is None or not r or not a or r == a:
            return r, a, p
        while min(len(r), len(a)) > 1 and r[-1] == a[-1]:
            r, a = r[:-1], a[:-1]
        while min(len(r), len(a)) > 1 and r[0] == a[0]:
            r, a, p = r[1:], a[1:], p + 1
        return r, a, p

    df = spark.createDataFrame(rows, "r string, a string, p int").select("r", "a", "p", V.parsimonious("r", "a", "p").alias("v"))
    assert [(x.v.ref, x.v.alt, x.v.position) for x in df.collect() if x.r] == [trim(*x) for x in rows if x[0]]
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 2


def test_weightings_of_a_small_set_are_decomposed_together(monkeypatch):
    # A decomposition for each of 24 weightings took most of the time of small windows.
    import numpy as np

    from sparvar.operators import settests as ST

    rng = np.random.default_rng(2)
    n, m = 300, 15
    g = rng.binomial(2, rng.uniform(0.005, 0.1, m), (n, m)).astype(float)
    g[:, 3] = 0
    k, u, maf, chan = g.T @ g - n * np.outer(g.mean(0), g.mean(0)), g.T @ rng.normal(size=n), g.mean(0) / 2, rng.uniform(0, 1, (11, m))
    chan[4] = 0
    beta, _ = ST.shape_weights(maf)
    want = []
    for a in [np.ones(m), *chan]:
        for t in range(2):
            ws = beta[t] * np.sqrt(a)
            want.append(ST.skat_p(float(((ws * u) ** 2).sum()), ST.power_sums(ws[:, None] * k * ws[None, :])))
    calls = []
    real = np.linalg.eigvalsh
    monkeypatch.setattr(np.linalg, "eigvalsh", lambda x: calls.append(1) or real(x))
    got = ST.battery(u, k, maf, chan, n).reshape(12, 6)[:, 2:4].ravel()
    assert len(calls) == 1 and np.allclose(got, want, rtol=1e-9)
    monkeypatch.setattr(ST, "SKAT_CELLS", 500)
    assert np.allclose(ST.battery(u, k, maf, chan, n).reshape(12, 6)[:, 2:4].ravel(), want, rtol=1e-9)
