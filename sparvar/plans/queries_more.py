"""Pooling of studies and relatedness as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import meta as M
from ..operators import relate as R
from ..operators import score as S
from .cohort import Cohort
from .oracle import CTES, sql
from .queries_score import gaussian
from .registry import ORACLES, query, rnd

# Both studies use the residuals of the common null; study 1 names every fourth site's alleles the other way round.
CTES["study_sums"] = """
SELECT s.study, v.variant_id, v.chromosome, v.position, least(v.ref, v.alt) AS a, greatest(v.ref, v.alt) AS b,
  CASE WHEN v.ref <= v.alt THEN 1 ELSE -1 END * s.u AS u, s.mac, s.n
FROM (SELECT sample_idx % 2 AS study, variant_id, sum(dosage*r) AS u, sum(dosage)::BIGINT AS mac, any_value(t.n) AS n
  FROM carriers JOIN nm USING (sample_idx) JOIN (SELECT sample_idx % 2 AS st, count(*) AS n FROM nm GROUP BY 1) t ON t.st = sample_idx % 2 GROUP BY 1, 2) s
JOIN variants v USING (variant_id)"""


def studies(c: Cohort) -> DataFrame:
    """Summary rows of the two studies, with the columns that pooling takes."""
    null = gaussian(c)
    index = c.variant_index().drop("maf", "ac", "k", "u")
    index = index.select("variant_id", "chromosome", "position", "ref", "alt", *M.TEXT_FIELDS, F.col("cadd_phred").alias("cadd_phred_raw"), "revel", *M.FLAG_FIELDS, *M.W_COLS)
    out = []
    for k in (0, 1):
        own = null.vectors.where(F.col("sample_idx") % 2 == k)
        n = own.count()
        part = S.attach_null(c.carriers, null).where(F.col("sample_idx") % 2 == k).groupBy("variant_id").agg(
            F.sum(F.col("dosage") * F.col("r")).alias("u_stat"), F.sum("dosage").cast("long").alias("mac"))
        rows = index.join(part, "variant_id").withColumns({"n_obs": F.lit(n), "maf": F.col("mac") / (2.0 * n), "segment_id": F.lit(0)})
        if k:
            turned = F.col("variant_id") % 4 == 0
            rows = rows.withColumns({
                "ref": F.when(turned, F.col("alt")).otherwise(F.col("ref")), "alt": F.when(turned, F.col("ref")).otherwise(F.col("alt")),
                "u_stat": F.when(turned, -F.col("u_stat")).otherwise(F.col("u_stat")),
            })
        out.append(rows.drop("variant_id"))
    return M.union_studies(out)


@query("M02_A06_A07_merged_variants", sql("study_sums", """
SELECT chromosome, position, a AS ref, b AS alt, round(sum(u), 4) AS u_meta, sum(mac)::BIGINT AS mac_total, sum(n)::BIGINT AS n_total,
  round(sum(mac)/(2.0*sum(n)), 9) AS maf, count(*) AS n_studies FROM study_sums GROUP BY 1, 2, 3, 4""", nm=CTES["nm"]))
def m02(c: Cohort) -> DataFrame:
    """Pooled scores do not depend on which allele a study calls the alternate one."""
    t = M.merge_variants(studies(c), 2.0)
    return t.select("chromosome", "position", "ref", "alt", rnd("u_meta", 4), F.col("mac_total").cast("long").alias("mac_total"), F.col("n_total").cast("long").alias("n_total"),
                    rnd("maf", 9), F.size("studies").cast("long").alias("n_studies"))


@query("A19_study_summary", sql("study_sums", "SELECT CAST(study AS INTEGER) AS study_idx, count(*) AS n_variants, CAST(max(n) AS INTEGER) AS n_samples FROM study_sums GROUP BY 1"))
def a19(c: Cohort) -> DataFrame:
    return M.study_summary(studies(c)).select("study_idx", "n_variants", F.col("n_samples").cast("int").alias("n_samples"))


@query("M_known_loci_match", sql("study_sums", """
SELECT chromosome, position, a AS ref, b AS alt FROM study_sums GROUP BY 1, 2, 3, 4, variant_id HAVING variant_id % 50 = 3 OR variant_id % 50 = 4"""))
def m_known(c: Cohort) -> DataFrame:
    """Known loci are found in either allele order, or by position alone."""
    v = c.variants
    loci = v.where("variant_id % 50 = 3").select("chromosome", "position", F.col("alt").alias("ref"), F.col("ref").alias("alt")).unionByName(
        v.where("variant_id % 50 = 4").select("chromosome", "position", F.lit("*").alias("ref"), F.lit("*").alias("alt")))
    return M.match_known_loci(M.merge_variants(studies(c), 2.0), loci).select("chromosome", "position", "ref", "alt")


# ----------------------------------------------------------------- relatedness


def king_pairs(c: Cohort) -> DataFrame:
    """Consecutive members of a family, by index."""
    rows = c.king_rows.select(F.col("ID1").alias("id1"), F.col("ID2").alias("id2"), F.col("PropIBD").cast("double").alias("prop_ibd"))
    return R.index_pairs(rows, c.samples)


_PAIRS = "SELECT sample_idx AS i, sample_idx + 1 AS j FROM samples WHERE sample_idx % 3 <> 2 AND sample_idx + 1 IN (SELECT sample_idx FROM samples)"


@query("G02_components", sql("samples", f"""
SELECT * FROM (WITH RECURSIVE p AS ({_PAIRS}), b AS (SELECT i, j FROM p UNION SELECT j, i FROM p),
r AS (SELECT i AS a, i AS b FROM b UNION SELECT r.a, b.j FROM r JOIN b ON b.i = r.b)
SELECT a AS sample, min(b) AS component FROM r GROUP BY 1)"""))
def g02(c: Cohort) -> DataFrame:
    return R.connected_components(king_pairs(c))


# A family is a path, so its middle goes first; of a lone pair the smaller index goes unless its partner ranks higher.
@query("G04_unrelated_subset", sql("samples", f"""
SELECT * FROM (WITH p AS ({_PAIRS}), e AS (SELECT i AS x, j AS y FROM p UNION ALL SELECT j, i FROM p), d AS (SELECT x, count(*) AS n FROM e GROUP BY 1),
gone AS (SELECT d.x FROM d WHERE n = 2 UNION SELECT e.x FROM e JOIN d a ON a.x = e.x JOIN d b ON b.x = e.y WHERE a.n = 1 AND b.n = 1 AND e.x < e.y)
SELECT sample_idx FROM samples WHERE sample_idx NOT IN (SELECT x FROM gone))"""))
def g04(c: Cohort) -> DataFrame:
    none = c.samples.select("sample_idx", F.lit(0).cast("long").alias("divergence"))
    return R.unrelated_subset(king_pairs(c), c.samples, none)


@query("G09_threshold_symmetric", sql("samples", """
WITH k AS (SELECT a.sample_idx AS i, b.sample_idx AS j, CASE WHEN a.sample_idx = b.sample_idx THEN 0.5 ELSE ((a.sample_idx + b.sample_idx) % 11)/22.0 END AS kinship
  FROM samples a JOIN samples b ON a.sample_idx // 3 = b.sample_idx // 3 AND a.sample_idx <= b.sample_idx)
SELECT i, j, round(kinship, 9) AS kinship FROM k WHERE i = j OR kinship >= pow(2, -3.5) UNION ALL
SELECT j, i, round(kinship, 9) FROM k WHERE i < j AND kinship >= pow(2, -3.5)"""))
def g09(c: Cohort) -> DataFrame:
    value = F.when(F.col("i") == F.col("j"), 0.5).otherwise((F.col("i") + F.col("j")) % 11 / 22.0)
    own = c.samples.select(F.col("sample_idx").alias("i"), F.col("sample_idx").alias("j"))
    kin = c.kin_pairs.select("i", "j").unionByName(own).withColumn("kinship", value)
    return R.threshold_symmetric(kin, R.kinship_threshold(2)).select("i", "j", rnd("kinship", 9))


@query("G05_to_variant_space", sql("carriers samples", """
WITH n AS (SELECT count(*) AS n FROM samples), s AS (SELECT variant_id, sum(dosage)/(2.0*any_value(n)) AS mu FROM carriers CROSS JOIN n GROUP BY 1),
g AS (SELECT variant_id, sum(dosage*((sample_idx % 7) - 3.0)) AS d FROM carriers GROUP BY 1), t AS (SELECT sum((sample_idx % 7) - 3.0) AS total FROM samples)
SELECT variant_id, round((d - 2*mu*total)/sqrt(2*mu*(1 - mu)), 6) AS x0 FROM s JOIN g USING (variant_id) CROSS JOIN t"""))
def g05(c: Cohort) -> DataFrame:
    """Standardised genotypes times a vector, from carriers alone."""
    stats = R.subset_frequencies(c.carriers, c.samples, c.n_samples)
    h = c.samples.select("sample_idx", ((F.col("sample_idx") % 7) - 3.0).alias("h0"))
    out = R.to_variant_space(c.carriers, stats, h, 1)
    column = next(x for x in out.columns if x != "variant_id")
    return out.select("variant_id", F.round(F.col(column), 6).alias("x0"))


@query("G06_to_sample_space", sql("carriers samples", """
SELECT * FROM (WITH n AS (SELECT count(*) AS n FROM samples), m AS (SELECT variant_id, sum(dosage)/(2.0*any_value(n)) AS mu FROM carriers CROSS JOIN n GROUP BY 1),
s AS (SELECT variant_id, mu, 1/sqrt(2*mu*(1 - mu)) AS inv, (variant_id % 5) - 2.0 AS x FROM m),
base AS (SELECT sum(2*mu*inv*x) AS b FROM s), g AS (SELECT sample_idx, sum(dosage*inv*x) AS d FROM carriers JOIN s USING (variant_id) GROUP BY 1)
SELECT sample_idx, round(coalesce(d, 0) - b, 6) AS h0 FROM samples LEFT JOIN g USING (sample_idx) CROSS JOIN base)"""))
def g06(c: Cohort) -> DataFrame:
    stats = R.subset_frequencies(c.carriers, c.samples, c.n_samples)
    x = stats.select("variant_id", ((F.col("variant_id") % 5) - 2.0).alias("x0"))
    return R.to_sample_space(c.carriers, stats, x, c.samples, 1).select("sample_idx", rnd("h0", 6))


# ------------------------------------------------------------------------ sinks


@query("S22_kinship_table", sql("samples", """
WITH k AS (SELECT a.sample_id AS ID1, b.sample_id AS ID2, ((a.sample_idx + b.sample_idx) % 11)/22.0 AS kinship
  FROM samples a JOIN samples b ON a.sample_idx // 3 = b.sample_idx // 3 AND a.sample_idx < b.sample_idx)
SELECT ID1, ID2, printf('%.6f', CAST(kinship AS DOUBLE)) AS Kinship FROM k"""))
def s22(c: Cohort) -> DataFrame:
    """The written kinship table, read back as text."""
    from ..session import scratch_path
    from ..sources import sinks

    path = scratch_path(c.spark, "kinship")
    sinks.write_kinship(c.kin_pairs.select("i", "j", ((F.col("i") + F.col("j")) % 11 / 22.0).alias("kinship")), c.samples, path)
    return c.spark.read.csv(path, sep="\t", header=True)


@query("S22_component_scores", sql("carriers samples", """
SELECT sample_id, printf('%.6f', CAST(coalesce(d, 0) AS DOUBLE)/3) AS PC1, printf('%.6f', CAST(sample_idx % 7 AS DOUBLE)/7 - 0.25) AS PC2
FROM samples LEFT JOIN (SELECT sample_idx, sum(dosage) AS d FROM carriers GROUP BY 1) USING (sample_idx)"""))
def s22_scores(c: Cohort) -> DataFrame:
    """Two score columns of every sample (its burden and a pattern), written and read back as text."""
    from ..session import scratch_path
    from ..sources import sinks

    burden = c.carriers.groupBy("sample_idx").agg(F.sum("dosage").alias("d"))
    scores = c.samples.select("sample_idx").join(burden, "sample_idx", "left").select(
        "sample_idx", (F.coalesce("d", F.lit(0)) / 3).alias("a"), (F.col("sample_idx") % 7 / 7.0 - 0.25).alias("b"))
    path = scratch_path(c.spark, "scores")
    sinks.write_component_scores(scores, ["a", "b"], c.samples, path)
    return c.spark.read.csv(path, sep="\t", header=True)


@query("S22_unrelated_list", ORACLES["G04_unrelated_subset"].replace("SELECT sample_idx FROM samples WHERE sample_idx NOT IN", "SELECT sample_id FROM samples WHERE sample_idx NOT IN"))
def s22_unrelated(c: Cohort) -> DataFrame:
    from ..session import scratch_path
    from ..sources import sinks

    path = scratch_path(c.spark, "unrelated")
    sinks.write_unrelated(g04(c), c.samples, path)
    return c.spark.read.text(path).withColumnRenamed("value", "sample_id")
