"""Pooled covariance of sets whose variants lie in several segments."""

from pyspark.sql import functions as F

from sparvar.operators import gram
from sparvar.operators import meta as M
from sparvar.operators.nullmodel import fit_gaussian
from sparvar.plans.cohort import Cohort
from sparvar.session import cut_lineage


def test_covariance_between_segments(spark, sf):
    c = Cohort(spark, sf)
    index = cut_lineage(c.rare_index().where("chromosome = '3'"))
    carriers = cut_lineage(c.carriers.join(index.select("variant_id"), "variant_id"))
    null = fit_gaussian(c.phenotype, "y", c.COVARIATES)
    members = cut_lineage(gram.rank_members(index.select(F.lit("s").alias("set_id"), "variant_id", "chromosome", "position", *[f("ref", "alt").alias(n) for f, n in ((F.least, "ref"), (F.greatest, "alt"))])))

    def cells(limit):
        segments = cut_lineage(M.union_studies([M.emit_sumstats(index, carriers, null, limit=limit)[1]]))
        return {(r.j1, r.j2): r.s for r in M.covariance_cells(members, segments).collect()}

    whole, cut = cells(2000), cells(3)
    m = members.count()
    assert m > 6 and len(whole) == m * (m + 1) // 2 and whole.keys() == cut.keys()
    assert all(abs(whole[k] - v) <= 1e-9 * max(1e-6, abs(v)) for k, v in cut.items())
