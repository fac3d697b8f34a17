"""Summary statistics per study, pooling, and conditional analysis."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import orient
from ..session import cut_lineage
from . import gram
from .masks import SEGMENT_BP, assign_segments, mask_array
from .nullmodel import NullModel
from .score import h_cols, variant_scores
from .setsums import Layer, battery_p, moments_p, run_sums, single_burden, single_p
from .settests import W_COLS, Cells, battery

FORMAT_VERSION = 3
RIDGE = 1e-8
#: Masks of more variants are tested from sums where few of their pairs share a carrier; rows of a tile there.
SMALL = 256
TILE = 512
TEXT_FIELDS = ["gene_name", "region_type", "consequence", "metasvm_pred", "genehancer"]
FLAG_FIELDS = ["is_cage_promoter", "is_cage_enhancer", "is_ccre_promoter", "is_ccre_enhancer"]


# ---------------------------------------------------------------------- export


def emit_sumstats(index: DataFrame, carriers: DataFrame, null: NullModel, width: int = SEGMENT_BP, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(variants, segments) of one study, statistics pre-divided by sigma^2.

    ``index``: variant_id, chromosome, position, ref, alt, maf, annotation and
    weights.  A segment holds at most ``limit`` variants.  Its row lists their sites, ``g`` of
    each, whose inner products are the projection, and ``cross``, the non-zero products of two
    of its variants; two segments of a chromosome that share carriers have a row of their own
    (``other_id``).  Pairs without a common carrier follow from ``g`` and are not stored.
    """
    from .cohort import ordered_rank

    seg = assign_segments(index, width, limit)
    hs, s2, n = h_cols(null), null.sigma2, null.n
    scores = variant_scores(carriers, null).select("variant_id", "u", "k", *hs)
    rows = cut_lineage(seg.join(scores, "variant_id", "left").fillna(0.0, subset=["u", "k", *hs]))  # read by variants, sites and products
    variants = rows.select(
        "chromosome", "position", "ref", "alt", "maf",
        F.round(2 * F.col("maf") * n).cast("int").alias("mac"), F.lit(n).cast("int").alias("n_obs"),
        (F.col("u") / s2).alias("u_stat"), (F.col("k") / s2).alias("v_stat"), "segment_id",
        *TEXT_FIELDS, F.col("cadd_phred").alias("cadd_phred_raw"), "revel", *FLAG_FIELDS, *W_COLS,
    )
    at = ["chromosome", "segment_id"]
    ranked = ordered_rank(rows, at, F.floor(F.col("position") / 4096), ["position", "ref", "alt"], "j").withColumn("j", F.col("j").cast("int"))
    root = np.linalg.cholesky(null.cov_inv / s2)
    g = F.array(*[sum((F.lit(float(root[i, q])) * F.col(h) for i, h in enumerate(hs)), F.lit(0.0)) for q in range(len(hs))])
    sites = ranked.select(*at, "j", "position", "ref", "alt", g.alias("g")).groupBy(*at).agg(
        F.sort_array(F.collect_list(F.struct("j", "position", "ref", "alt", "g"))).alias("z"))  # at most one segment's variants
    sites = sites.select(*at, F.size("z").alias("n_variants"), F.col("z.position").alias("positions"), F.col("z.ref").alias("refs"), F.col("z.alt").alias("alts"), F.col("z.g").alias("g"))
    whole = ranked.select(F.col("chromosome").alias("set_id"), "variant_id", (F.col("segment_id").cast("long") * limit + F.col("j")).cast("int").alias("j"))
    every = gram.pair_products(whole, carriers, null.vectors.select("sample_idx", "w")).select(
        F.col("set_id").alias("chromosome"), *[F.floor(F.col(f"j{i}") / limit).cast("int").alias(name) for i, name in ((1, "segment_id"), (2, "other_id"))],
        F.struct((F.col("j1") % limit).alias("i"), (F.col("j2") % limit).alias("j"), (F.col("s") / s2).alias("s")).alias("z"))
    products = cut_lineage(every.groupBy(*at, "other_id").agg(F.collect_list("z").alias("cross")))
    own = products.where("segment_id = other_id").drop("other_id")
    return variants, sites.join(own, at, "left").unionByName(products.where("segment_id < other_id"), allowMissingColumns=True)


def study_metadata(spark: SparkSession, null: NullModel, trait: str, covariates: list[str], maf_cutoff: float, width: int = SEGMENT_BP) -> DataFrame:
    return spark.createDataFrame(
        [(FORMAT_VERSION, null.kind, trait, null.n, float(null.sigma2), maf_cutoff, covariates, width)],
        "version int, trait_type string, trait_name string, n_samples long, sigma2 double, maf_cutoff double, covariates array<string>, segment_size int")


def write_study(path: str, variants: DataFrame, segments: DataFrame, metadata: DataFrame, mode: str = "errorifexists") -> None:
    from ..sources.sinks import write_partitioned, write_table

    write_partitioned(variants, f"{path}/variants", ["chromosome"], mode)
    write_partitioned(segments, f"{path}/segments", ["chromosome"], mode)
    write_table(metadata, f"{path}/study", mode)


def check_studies(meta: DataFrame) -> None:
    """Same format version, trait type and segment size everywhere (one small job)."""
    r = meta.agg(
        F.count("*").alias("n"), F.min("version").alias("v0"), F.max("version").alias("v1"),
        F.collect_set("trait_type").alias("types"), F.collect_set("segment_size").alias("sizes"),
    ).first()
    if not r["n"]:
        raise ValueError("at least one study is needed")
    if r["v0"] != FORMAT_VERSION or r["v1"] != FORMAT_VERSION:
        raise ValueError(f"unsupported study version, expected {FORMAT_VERSION}")
    if len(r["types"]) > 1:
        raise ValueError(f"studies differ in trait type: {', '.join(sorted(r['types']))}")
    if len(r["sizes"]) > 1:
        raise ValueError(f"studies differ in segment size: {sorted(r['sizes'])}")


def read_studies(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(variants, segments) of all studies with study_idx, after compatibility checks."""
    from ..sources.tabular import read_parquet

    check_studies(reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/study") for p in paths]))
    return (union_studies([read_parquet(spark, f"{p}/variants") for p in paths]),
            union_studies([read_parquet(spark, f"{p}/segments") for p in paths]))


def union_studies(frames: list[DataFrame]) -> DataFrame:
    tagged = [f.withColumn("study_idx", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# --------------------------------------------------------------------- pooling


def merge_variants(studies: DataFrame, maf_cutoff: float) -> DataFrame:
    """One row per site in lexicographic allele order.

    The MAF filter acts per study before pooling.  Text annotation comes from
    the first study with a non-empty value, other fields from the first study.
    """
    a, b, sign = orient("ref", "alt")

    def first(c: str) -> Column:
        return F.min_by(c, "study_idx").alias(c)

    def first_text(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c) != "", F.col("study_idx"))).alias(c)

    rows = studies.filter(F.col("maf") < maf_cutoff).withColumns({"_a": a, "_b": b, "_u": sign * F.col("u_stat")})
    pooled = rows.groupBy("chromosome", "position", F.col("_a").alias("ref"), F.col("_b").alias("alt")).agg(
        F.sum("_u").alias("u_meta"), F.sum("mac").alias("mac_total"), F.sum("n_obs").alias("n_total"),
        *[first_text(c) for c in TEXT_FIELDS], first("cadd_phred_raw"), first("revel"),
        *[F.bool_or(c).alias(c) for c in FLAG_FIELDS], *[first(w) for w in W_COLS],
        # At most one entry per study and orientation.
        F.sort_array(F.collect_list(F.struct("study_idx", "segment_id", F.col("_u").alias("u")))).alias("studies"),
    )
    return pooled.fillna("", subset=TEXT_FIELDS).withColumn("maf", F.when(
        F.col("n_total") > 0, F.col("mac_total") / (2.0 * F.col("n_total"))).otherwise(0.0))


def match_known_loci(variants: DataFrame, loci: DataFrame) -> DataFrame:
    """Variants at a known locus: same position and wildcard or same alleles in either order."""
    l = loci.select(
        "chromosome", "position", (F.col("ref") == "*").alias("_any"),
        F.least("ref", "alt").alias("_la"), F.greatest("ref", "alt").alias("_lb"))
    hit = F.col("_any") | ((F.least("ref", "alt") == F.col("_la")) & (F.greatest("ref", "alt") == F.col("_lb")))
    ids = variants.join(l, ["chromosome", "position"]).filter(hit).select("chromosome", "position", "ref", "alt").distinct()
    return variants.join(ids, ["chromosome", "position", "ref", "alt"], "left_semi")


def found_members(members: DataFrame, segments: DataFrame) -> DataFrame:
    """(set_id, j) at its places in the studies: study_idx, chromosome, segment_id, idx, sign ``sg`` and signed ``g``.

    ``members``: set_id, j, chromosome, position, ref, alt in canonical order; a stored variant may be flipped.
    """
    a, b, sign = orient("r", "a")
    at = ["study_idx", "chromosome", "segment_id"]
    local = segments.where("other_id is null").select(*at, F.posexplode(F.arrays_zip(
        F.col("positions").alias("p"), F.col("refs").alias("r"), F.col("alts").alias("a"), "g")).alias("idx", "z")).select(*at, "idx", "z.*")
    local = local.select(*at, "idx", F.col("p").alias("position"), a.alias("ref"), b.alias("alt"), sign.alias("sg"), F.transform("g", lambda x: x * sign).alias("g"))
    found = members.select("set_id", "j", "chromosome", "position", "ref", "alt").join(local, ["chromosome", "position", "ref", "alt"])
    return cut_lineage(found)  # read several times


def _side(found: DataFrame, k: int, *rest: str) -> DataFrame:
    segment = "segment_id" if k == 1 else "other_id"
    return found.select("set_id", "study_idx", "chromosome", F.col("segment_id").alias(segment), F.col("idx").alias("ij"[k - 1]), F.col("j").alias(f"n{k}"), F.col("sg").alias(f"g{k}"), *[F.col(x).alias(f"{x}{k}_") for x in rest])


#: Two places of one member make its own cell, from both sides.
_TWICE = "CASE WHEN n1 = n2 AND (segment_id <> other_id OR i <> j) THEN 2.0 ELSE 1.0 END"
_SPOTS = ("least(n1, n2) AS j1", "greatest(n1, n2) AS j2")


def shared_cells(found: DataFrame, segments: DataFrame, by_study: bool = False) -> DataFrame:
    """(set_id[, study_idx], j1 <= j2, s): non-zero products of set members, before the projection, summed over studies."""
    at = ["study_idx", "chromosome", "segment_id"]
    other = F.coalesce("other_id", "segment_id").alias("other_id")
    stored = segments.select(*at, other, F.explode("cross").alias("z")).select(*at, "other_id", "z.*")
    both = stored.join(_side(found, 1), [*at, "i"]).join(_side(found, 2), ["set_id", "study_idx", "chromosome", "other_id", "j"])
    return both.selectExpr("set_id", "study_idx", *_SPOTS, f"s * g1 * g2 * {_TWICE} AS s").groupBy(*_keys(by_study), "j1", "j2").agg(F.sum("s").alias("s"))


def _keys(by_study: bool) -> list[str]:
    return ["set_id"] + (["study_idx"] if by_study else [])


def covariance_cells(members: DataFrame, segments: DataFrame, by_study: bool = False) -> DataFrame:
    """(set_id[, study_idx], j1 <= j2, s): covariance of set members summed over studies.

    Every pair is a row, which is quadratic in a set; tests work from :func:`shared_cells`.
    """
    found = found_members(members, segments)
    pairs = _side(found, 1, "g").join(_side(found, 2, "g"), ["set_id", "study_idx", "chromosome"]).where("segment_id < other_id OR (segment_id = other_id AND i <= j)")
    dot = F.aggregate(F.zip_with("g1_", "g2_", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    lost = pairs.withColumn("s", -dot).selectExpr("set_id", "study_idx", *_SPOTS, f"s * {_TWICE} AS s")
    shared = shared_cells(found, segments, True).select("set_id", "study_idx", "j1", "j2", "s")
    return shared.unionByName(lost).groupBy(*_keys(by_study), "j1", "j2").agg(F.sum("s").alias("s"))


def meta_members(merged: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Gene x mask members over merged variants, numbered within each gene."""
    rows = merged.filter("gene_name != ''").withColumn("set_id", F.concat_ws("|", "chromosome", "gene_name")).withColumn("masks", mask_array(names))
    key = F.xxhash64("position", "ref", "alt")
    return gram.rank_members(rows.withColumn("variant_id", key)).drop("variant_id")


RESULT = (
    "set_id string, mask string, n_variants int, cmac long, n_total long, start int, end int, "
    "burden_beta double, burden_se double, p array<double>"
)
COLUMNS = ["set_id", "mask", "n_variants", "cmac", "n_total", "start", "end", "burden_beta", "burden_se", "p"]


def _row(key: str, mask: str, v: pd.DataFrame, u: np.ndarray, cells: Cells, h: np.ndarray, inv: np.ndarray) -> tuple:
    """Battery and burden effect of a mask whose covariance is its cells less ``h inv h'``."""
    n = int(v["n_total"].max())
    one = float(cells.v.sum() - h.sum(0) @ inv @ h.sum(0))
    beta, se = (float(u.sum()) / one, one**-0.5) if one > 0 and np.isfinite(one) else (np.nan, np.nan)
    maf, chan = v["maf"].to_numpy(float), v[W_COLS].to_numpy(float).T
    if len(v) > SMALL and cells.few():
        single = single_p(u, cells.diagonal(cells.v) - ((h @ inv) * h).sum(1))
        sums = run_sums(cells, [Layer(cells.v, u[:, None], h, inv, single, u**2)], maf, chan, n, 0, len(v), TILE)
        p = battery_p(sums[0], 1, 1, inv, single_burden, moments_p)
    else:
        p = battery(u, cells.rows(h, inv, 0, len(v), cells.v), maf, chan, n)
    return (key, mask, len(v), int(v["mac_total"].sum()), n, int(v["position"].min()), int(v["position"].max()), beta, se, p)


def _slices(v: pd.DataFrame, minimum: int):
    hits: dict[str, list[int]] = {}
    for pos, (names, test) in enumerate(zip(v["masks"], v["is_test"])):
        if test:
            for name in names:
                hits.setdefault(name, []).append(pos)
    for name, idx in sorted(hits.items()):
        if len(idx) >= minimum:
            yield name, np.asarray(idx)


VALUE_COLS = ["set_id", "j", "position", "maf", "mac_total", "n_total", "u_meta", "masks", *W_COLS]


def _tested(members: DataFrame, segments: DataFrame, per_study: bool, minimum: int) -> DataFrame:
    """Battery of every mask given the members that are not ``is_test``.

    A task takes one set: its members and its non-zero products, a row a study.
    """
    found = found_members(members, segments)
    sides = found.groupBy("set_id", "j").agg(F.collect_list(F.struct("study_idx", "g")).alias("g"))  # an entry a study and orientation
    v = members.select(*VALUE_COLS, "is_test", "studies").join(sides, ["set_id", "j"], "left")
    cells = shared_cells(found, segments, True).withColumnRenamed("set_id", "k_set")
    # A count of its own: sets are few bytes, which would meet in few tasks.
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def test(key: tuple, v: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("j").reset_index(drop=True)
        u, whole, h, inv = _given(v, c, per_study)
        rows = []
        for mask, i in _slices(v, minimum):
            rows.append(_row(key[0], mask, v.iloc[i], u[i], whole.subset(i)[0], h[i], inv))
        return pd.DataFrame(rows, columns=COLUMNS)

    return v.repartition(parts, "set_id").groupBy("set_id").cogroup(cells.repartition(parts, "k_set").groupBy("k_set")).applyInPandas(test, RESULT)


def _given(v: pd.DataFrame, c: pd.DataFrame, per_study: bool) -> tuple[np.ndarray, Cells, np.ndarray, np.ndarray]:
    """Scores, cells and projection of all members given the loci among them.

    Loci take thin products off the covariance, as covariates do: K - K_c (K_cc + ridge)^-1 K_c'.
    """
    m, cond = len(v), np.flatnonzero(~v["is_test"].to_numpy(bool))
    listed = [(i, e["study_idx"], np.asarray(e["g"], float)) for i, es in enumerate(v["g"]) if es is not None for e in es]
    studies = sorted({s for _, s, _ in listed})
    width = len(listed[0][2]) if listed else 0
    sides = {s: np.zeros((m, width)) for s in studies}
    for i, s, g in listed:
        sides[s][i] += g
    u = v["u_meta"].to_numpy(float)
    pooled = c.groupby(["j1", "j2"], as_index=False)["s"].sum()
    whole = Cells(pooled["j1"].to_numpy(), pooled["j2"].to_numpy(), pooled["s"].to_numpy(), m)
    every = np.hstack([sides[s] for s in studies]) if studies else np.zeros((m, 0))
    thin, inner = [every], [np.eye(every.shape[1])]
    if len(cond):
        parts = [(u, whole, every)]
        if per_study:
            parts = []
            for s in studies:
                own = c[c["study_idx"] == s]
                # A site counts with its first entry in a study.
                first = [next((e["u"] for e in es if e["study_idx"] == s), 0.0) for es in v["studies"]]
                parts.append((np.array(first, float), Cells(own["j1"].to_numpy(), own["j2"].to_numpy(), own["s"].to_numpy(), m), sides[s]))
        u = np.zeros(m)
        for us, cells, h in parts:
            k = cells.columns(cond) - h @ h[cond].T
            back = np.linalg.inv(k[cond] + RIDGE * np.eye(len(cond)))
            u = u + us - k @ (back @ us[cond])
            thin.append(k)
            inner.append(back)
    h, inv = np.hstack(thin), np.zeros((sum(map(len, inner)),) * 2)
    at = 0
    for b in inner:
        inv[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return u, whole, h, inv


def meta_tests(members: DataFrame, segments: DataFrame, minimum: int = 2) -> DataFrame:
    """Pooled battery and burden effect per gene x mask."""
    return _tested(members.withColumn("is_test", F.lit(True)), segments, False, minimum)


def conditional_members(members: DataFrame, merged: DataFrame, loci: DataFrame) -> DataFrame:
    """Set members plus the chromosome's known loci; loci inside the gene stay plain members."""
    known = match_known_loci(merged, loci)
    genes = members.select("set_id", "chromosome").distinct()
    extra = genes.join(known, "chromosome").join(members.select("set_id", "position", "ref", "alt"), ["set_id", "position", "ref", "alt"], "left_anti")
    extra = extra.withColumn("masks", F.array().cast("array<string>")).withColumn("is_test", F.lit(False))
    base = members.withColumn("is_test", F.lit(True)).drop("j")
    cols = [c for c in base.columns if c in extra.columns]
    both = base.select(*cols).unionByName(extra.select(*cols)).withColumn("variant_id", F.xxhash64("position", "ref", "alt"))
    return gram.rank_members(both).drop("variant_id")


def conditional_tests(members: DataFrame, segments: DataFrame, per_study: bool = False, minimum: int = 2) -> DataFrame:
    """Pooled battery given known loci (``members`` from :func:`conditional_members`).

    ``per_study`` conditions inside every study before pooling.  A known locus
    that belongs to the tested mask's gene is not conditioned on.
    """
    return _tested(members, segments, per_study, minimum)


def burden_effect(members: DataFrame, segments: DataFrame) -> DataFrame:
    """Unweighted pooled burden effect per set, 1'U / 1'K1, from sums alone: no pair without a common carrier is made."""
    found = found_members(members, segments)
    k = shared_cells(found, segments).groupBy("set_id").agg(F.sum(F.when(F.col("j1") == F.col("j2"), F.col("s")).otherwise(2 * F.col("s"))).alias("s1"))
    sums = found.select("set_id", "study_idx", F.posexplode("g").alias("q", "x")).groupBy("set_id", "study_idx", "q").agg(F.sum("x").alias("x"))
    lost = sums.groupBy("set_id").agg(F.sum(F.col("x") * F.col("x")).alias("p1"))
    u = members.groupBy("set_id").agg(F.sum("u_meta").alias("u1"), F.count("*").alias("n_variants"))
    t = u.join(lost, "set_id").join(k, "set_id", "left").withColumn("k1", F.coalesce("s1", F.lit(0.0)) - F.col("p1"))
    ok = F.col("k1") > 0
    return t.select(
        "set_id", "n_variants", F.when(ok, F.col("u1") / F.col("k1")).alias("burden_beta"),
        F.when(ok, 1.0 / F.sqrt("k1")).alias("burden_se"))


def study_summary(studies: DataFrame) -> DataFrame:
    """Variants and samples per study."""
    return studies.groupBy("study_idx").agg(F.count("*").alias("n_variants"), F.max("n_obs").alias("n_samples"))

