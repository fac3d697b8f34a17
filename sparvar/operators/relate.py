"""Relatedness: pairs, components, unrelated subset, principal components, kinship."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DIVERGENCE_CUTOFF = -0.025
ISAF_MIN, ISAF_MAX = 1e-4, 1.9999


def index_pairs(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Named pairs to ordered sample indices; unknown samples and repeats drop out."""
    a = samples.select(F.col("sample_id").alias("id1"), F.col("sample_idx").alias("_a"))
    b = samples.select(F.col("sample_id").alias("id2"), F.col("sample_idx").alias("_b"))
    known = pairs.join(a, "id1").join(b, "id2")
    return known.groupBy(F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j")).agg(F.min("prop_ibd").alias("prop_ibd"))


def connected_components(pairs: DataFrame, check_every: int = 1, most: int | None = None) -> DataFrame | None:
    """(sample, component) where component is the smallest member index.

    Alternating large-star and small-star steps: every vertex links its
    neighbours to the smallest one, which shortens chains exponentially and
    leaves no vertex with an unbounded neighbour list in memory (only ``min``
    aggregates).  Runs jobs until the edges stop changing, or until a vertex has ``most`` others linked
    to it: then some component has more members than that and the result is None.
    """
    edges = cut_lineage(pairs.select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).filter("a != b").distinct())
    vertices = edges.select(F.explode(F.array("a", "b")).alias("sample")).distinct()
    before = None
    while True:
        # Large star: neighbours above v join the minimum of v's neighbourhood.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # Small star: neighbours below v, and v, join the minimum below v.
        low2 = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low2, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y")))).alias("e")
        ).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a != b").distinct()
        edges = cut_lineage(small)
        # Edge count and label sum together identify a fixed point of the iteration.
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        if most is None:
            r = edges.agg(F.count("*").alias("n"), mark).first()
        else:
            stars = edges.groupBy("b").agg(F.count("*").alias("n"), mark)
            r = stars.agg(F.sum("n").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.max("n").alias("top")).first()
            if r["top"] and r["top"] >= most:
                return None
        now = (r["n"], r["h"])
        if now == before:
            break
        before = now
    labels = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "sample")
    return vertices.join(labels, "sample", "left").select("sample", F.coalesce("component", "sample").alias("component"))


def divergence(carriers: DataFrame, variants: DataFrame, related: DataFrame, samples: DataFrame,
               max_variants: int | None = None, cutoff: float = DIVERGENCE_CUTOFF, width: int = 16_384,
               rows: int = 512, columns: int = 1024) -> DataFrame:
    """(sample_idx, divergence): per related sample, how many others look ancestrally divergent.

    All variants count; ``max_variants`` asks for a strided subset.  A pair is far when
    ``(hethet - 2 homopp) / (het_i + het_j) < cutoff``.  Absent carriers are reference
    homozygotes, so with q the sum of dosage products ``hethet - 2 homopp = q - 2 (hom_i + hom_j)``.
    Where fewer carriers meet on variants than there are pairs, ``_far_by_shared`` looks only at
    pairs that meet.  Otherwise one blocked product decides all pairs, cut in three
    ways (related samples, samples, ``width`` variants); a task holds one block of each kind, adds
    up rare variants carrier by carrier and common ones as matrices, and returns one packed row
    of sums a related sample.  Partial sums are added a (slice of
    64 related samples, block of samples), where the cutoff is applied.  Pairs are never rows there.
    """
    from .cohort import ordered_rank

    people = samples.select("sample_idx").distinct()
    number = F.expr("try_cast(chromosome AS INT)")  # numbered chromosomes first, then the others by name
    rank = F.struct(F.coalesce(number, F.lit(1000)).alias("n"), "chromosome")
    order = ordered_rank(
        variants.select("variant_id", "position", "ref", "alt", rank.alias("_chr")).withColumn("_all", F.lit(0)), ["_all"],
        F.struct("_chr", F.floor(F.col("position") / 4096)), ["_chr", "position", "ref", "alt", "variant_id"], "_ord")
    if max_variants is not None:
        step = max(1, variants.count() // max(1, max_variants))
        order = order.filter((F.col("_ord") % step == 0) & (F.col("_ord") < step * max_variants)).withColumn("_ord", F.floor(F.col("_ord") / step))
    calls = carriers.filter(F.col("dosage").isin(1, 2)).select("variant_id", "sample_idx", F.col("dosage").cast("int").alias("d"))
    used = order.select("variant_id", F.col("_ord").alias("v")) if max_variants is not None else variants.select("variant_id")
    calls = cut_lineage(calls.join(used, "variant_id").join(people, "sample_idx", "left_semi"))
    n_all, mine = people.count(), cut_lineage(related.select("sample_idx").distinct().join(people, "sample_idx", "left_semi"))
    n_mine = mine.count()
    met = calls.join(mine.withColumn("own", F.lit(1)), "sample_idx", "left").groupBy("variant_id").agg(F.count("*").alias("c"), F.count("own").alias("m"))
    met = met.agg(F.sum(F.col("c").cast("double") * F.col("m")).alias("rows"), F.max("c").alias("most")).first()
    if (met["rows"] or 0) <= float(n_mine) * n_all:
        return _far_by_shared(calls, mine, people, cutoff, met["most"] or 0)
    if max_variants is None:
        calls = calls.join(order.select("variant_id", F.col("_ord").alias("v")), "variant_id")
    # At most ``width`` codes a row; the code holds the place within the block and the dosage.
    packed = cut_lineage(calls.groupBy("sample_idx", F.floor(F.col("v") / width).cast("int").alias("vb")).agg(
        F.collect_list(((F.col("v") % width) * 4 + F.col("d")).cast("int")).alias("g"),
        F.count_if(F.col("d") == 1).alias("het"), F.count_if(F.col("d") == 2).alias("hom")))
    nb, na, ns = (max(1, -(-n // size)) for n, size in ((n_all, columns), (n_mine, rows), (n_mine, 64)))
    h = F.xxhash64("sample_idx")

    def deal(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    slot = F.row_number().over(Window.partitionBy("b").orderBy("sample_idx")) - 1  # about ``columns`` rows a block
    sums = packed.groupBy("sample_idx").agg(F.sum("het").alias("het"), F.sum("hom").alias("hom"))
    people = people.join(sums, "sample_idx", "left").fillna(0).withColumn("b", F.pmod(h, F.lit(nb)).cast("int"))
    people = cut_lineage(people.withColumn("slot", slot))
    left = packed.join(mine, "sample_idx").select("sample_idx", "vb", "g", F.pmod(h, F.lit(na)).cast("int").alias("a")).withColumn("b", deal(nb))
    right = packed.join(people.select("sample_idx", "b", "slot"), "sample_idx").select(
        "slot", F.col("vb").alias("of_vb"), F.col("g").alias("of_g"), F.col("b").alias("of_b")).withColumn("of_a", deal(na))

    def multiply(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        b = key[1]
        if x.empty or y.empty:
            return pd.DataFrame({"sample_idx": np.zeros(0, np.int64), "b": np.zeros(0, np.int32), "q": np.zeros(0, object)})
        flat = []
        for rows_at, lists in ((np.arange(len(x)), x["g"]), (y["slot"].to_numpy(np.int64), y["of_g"])):
            code = np.concatenate(lists.to_numpy()).astype(np.int64)
            at = np.repeat(rows_at, lists.map(len).to_numpy())
            flat.append((at, code >> 2, (code & 3).astype(np.float32)))
        total = np.zeros((len(x), int(y["slot"].max()) + 1), np.int32)
        meets = np.prod([np.bincount(v, minlength=width) for _, v, _ in flat], axis=0)
        common = meets * 100 > total.size
        # Rare variants: every carrier of one side with its run of carriers on the other.
        (xr, xv, xd), (yr, yv, yd) = ([c[~common[f[1]]] for c in f] for f in flat)
        by = np.argsort(yv, kind="stable")
        yr, yv, yd = yr[by], yv[by], yd[by]
        low, high = np.searchsorted(yv, xv), np.searchsorted(yv, xv, side="right")
        ends = np.cumsum(high - low)
        for cut in np.split(np.arange(len(xv)), np.searchsorted(ends, np.arange(2_000_000, ends[-1] if len(ends) else 0, 2_000_000))):
            n = (high - low)[cut]
            own = np.repeat(cut, n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[cut], n)
            np.add.at(total, (xr[own], yr[other]), (xd[own] * yd[other]).astype(np.int32))
        # Common ones: dense products of some columns at a time.
        place = np.cumsum(common) - 1
        for start in range(0, int(common.sum()), 2048):
            dense = []
            for (at, v, d), n in zip(flat, total.shape, strict=True):
                inside = common[v] & (place[v] >= start) & (place[v] < start + 2048)
                m = np.zeros((n, 2048), np.float32)
                m[at[inside], place[v[inside]] - start] = d[inside]
                dense.append(m)
            total += (dense[0] @ dense[1].T).astype(np.int32)
        some = np.flatnonzero(total.any(1))
        return pd.DataFrame({"sample_idx": x["sample_idx"].to_numpy()[some], "b": np.full(len(some), b, np.int32),
                             "q": pd.Series([total[r].tobytes() for r in some], dtype=object)})

    products = left.groupBy("a", "b", "vb").cogroup(right.groupBy("of_a", "of_b", "of_vb")).applyInPandas(multiply, "sample_idx long, b int, q binary")
    own = mine.join(people.select("sample_idx", "het", "hom"), "sample_idx").withColumn("b", deal(nb))
    empty = F.lit(None)
    asked = own.select("sample_idx", "b", "het", "hom", empty.cast("binary").alias("q")).unionByName(
        products.select("sample_idx", "b", empty.cast("long").alias("het"), empty.cast("long").alias("hom"), "q"))
    asked = asked.withColumn("s", F.pmod(h, F.lit(ns)).cast("int"))
    members = F.sort_array(F.collect_list(F.struct("slot", "sample_idx", "het", "hom")))
    block = people.groupBy("b").agg(members.alias("m")).select(
        "b", *[F.col(f"m.{c}").alias(c) for c in ("sample_idx", "het", "hom")]).withColumn("s", deal(ns))

    def decide(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"sample_idx": np.zeros(0, np.int64), "divergence": np.zeros(0, np.int64)})
        ids, het, hom = (np.asarray(y[c].iloc[0], np.int64) for c in ("sample_idx", "het", "hom"))
        base = x[x["q"].isna()]
        where = pd.Series(np.arange(len(base)), index=base["sample_idx"].to_numpy())
        q = np.zeros((len(base), len(ids)), np.int64)
        for i, raw in x.loc[x["q"].notna(), ["sample_idx", "q"]].itertuples(index=False):
            row = np.frombuffer(raw, np.int32)
            q[where[i], : len(row)] += row
        mine_id, mine_het, mine_hom = (base[c].to_numpy().astype(np.int64)[:, None] for c in ("sample_idx", "het", "hom"))
        den = mine_het + het
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (den > 0) & ((q - 2 * (mine_hom + hom)) / den < cutoff) & (mine_id != ids)
        return pd.DataFrame({"sample_idx": mine_id[:, 0], "divergence": far.sum(1)})

    part = asked.groupBy("b", "s").cogroup(block.groupBy("b", "s")).applyInPandas(decide, "sample_idx long, divergence long")
    return part.groupBy("sample_idx").agg(F.sum("divergence").alias("divergence"))


def _far_by_shared(calls: DataFrame, mine: DataFrame, people: DataFrame, cutoff: float, most: int, piece: int = 2048, kinds: int = 2048) -> DataFrame:
    """``divergence`` by pairs that share a variant, for carriers ``calls`` with at most ``most`` a variant.

    A pair that shares none has q = 0, so the (het, hom) counts of both samples decide it: samples
    are counted by those.  Sharing only raises the value, so pairs far by counts alone that
    share a variant are added up, and those no longer far taken off.  With a cutoff below zero one sample of
    such a pair has a homozygote.  Carriers of a variant are joined in pieces of about ``piece``.
    """
    counts = calls.groupBy("sample_idx").agg(F.count_if(F.col("d") == 1).alias("het"), F.count_if(F.col("d") == 2).alias("hom"))
    everyone = cut_lineage(people.join(counts, "sample_idx", "left").fillna(0))
    own = everyone.join(mine, "sample_idx", "left_semi")

    every_kind, my_kind = everyone.groupBy("het", "hom").agg(F.count("*").alias("n")), own.select("het", "hom").distinct()
    nb = max(1, -(-every_kind.count() // kinds))
    h = F.xxhash64("het", "hom")
    x = my_kind.withColumn("a", F.pmod(h, F.lit(nb)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    y = every_kind.select(F.col("het").alias("of_het"), F.col("hom").alias("of_hom"), "n", F.pmod(h, F.lit(nb)).cast("int").alias("of_b")).withColumn(
        "of_a", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def count(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        het, hom, n = (y[c].to_numpy(np.int64) for c in ("of_het", "of_hom", "n"))
        far = np.zeros(len(x), np.int64)
        for i, (xt, xm) in enumerate(zip(x["het"].to_numpy(np.int64), x["hom"].to_numpy(np.int64), strict=True)):
            with np.errstate(divide="ignore", invalid="ignore"):
                far[i] = n[(het + xt > 0) & (-2 * (hom + xm) / (het + xt) < cutoff)].sum()
        return pd.DataFrame({"het": x["het"], "hom": x["hom"], "far": far})

    far = x.groupBy("a", "b").cogroup(y.groupBy("of_a", "of_b")).applyInPandas(count, "het long, hom long, far long").groupBy("het", "hom").agg(F.sum("far").alias("far"))

    def is_far(q, hom, het):
        return F.try_divide((q - 2 * hom).cast("double"), het.cast("double")) < cutoff

    rows = calls.select("variant_id", "sample_idx", "d").join(everyone, "sample_idx")
    pieces = F.lit(1)
    if most > piece:
        size = calls.groupBy("variant_id").agg(F.count("*").alias("size"))
        rows, pieces = rows.join(size, "variant_id"), F.ceil(F.col("size") / piece)
    part = F.pmod(F.xxhash64("sample_idx"), pieces).cast("int")
    others = F.explode(F.sequence(F.lit(0), pieces.cast("int") - 1))
    with_hom = F.array(F.lit(True), F.lit(False))
    meets = F.when(F.col("hom") > 0, with_hom).otherwise(F.array(F.lit(True))) if cutoff < 0 else with_hom
    left = rows.join(mine, "sample_idx", "left_semi").select(
        "variant_id", F.col("sample_idx").alias("a"), F.col("d").alias("da"), F.col("het").alias("het_a"), F.col("hom").alias("hom_a"),
        part.alias("pa"), F.explode(meets).alias("hom_met"), *([F.col("size")] if most > piece else [])).withColumn("pb", others).drop("size")
    right = rows.select(
        "variant_id", F.col("sample_idx").alias("b"), F.col("d").alias("db"), F.col("het").alias("het_b"), F.col("hom").alias("hom_b"),
        part.alias("pb"), (F.col("hom") > 0).alias("hom_met"), *([F.col("size")] if most > piece else [])).withColumn("pa", others).drop("size")
    het, hom = F.col("het_a") + F.col("het_b"), F.col("hom_a") + F.col("hom_b")
    met = left.join(right, ["variant_id", "hom_met", "pa", "pb"]).where(F.col("a") != F.col("b")).where(is_far(F.lit(0), hom, het))
    met = met.groupBy("a", "b").agg(F.sum(F.col("da") * F.col("db")).alias("q"), F.first(hom).alias("hom"), F.first(het).alias("het"))
    near = met.where(~is_far(F.col("q"), F.col("hom"), F.col("het"))).groupBy(F.col("a").alias("sample_idx")).agg(F.count("*").alias("near"))
    # The sample itself is among those counted.
    alone = F.when(F.coalesce(is_far(F.lit(0), 2 * F.col("hom"), 2 * F.col("het")), F.lit(False)), 1).otherwise(0)
    out = own.join(far, ["het", "hom"]).join(near, "sample_idx", "left")
    return out.select("sample_idx", (F.col("far") - alone - F.coalesce("near", F.lit(0))).cast("long").alias("divergence"))


def unrelated_subset(pairs: DataFrame, samples: DataFrame, div: DataFrame) -> DataFrame:
    """Samples left after repeatedly dropping the most connected one.

    Priority is (relatives desc, divergence asc, kinship sum asc, index asc).
    A vertex that outranks all its remaining neighbours is dropped before any of
    them in the sequential order too, since priorities only fall; so all such
    local maxima go in one round, with the same final set.
    """
    both = pairs.select("i", "j", F.col("prop_ibd").alias("kin")).unionByName(
        pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("prop_ibd").alias("kin")))
    live = cut_lineage(both)
    kin = both.groupBy("i").agg(F.sum("kin").alias("kin_sum"))
    fixed = cut_lineage(kin.join(div.select(F.col("sample_idx").alias("i"), "divergence"), "i", "left").fillna(0, subset=["divergence"]))
    removed = None
    while live.limit(1).count():
        deg = live.groupBy("i").agg(F.count("*").alias("deg")).join(fixed, "i")
        rank = F.struct(F.col("deg"), -F.col("divergence"), -F.col("kin_sum"), -F.col("i"))
        score = deg.select("i", rank.alias("rank"))
        top = live.join(score.withColumnsRenamed({"i": "j", "rank": "rj"}), "j").groupBy("i").agg(F.max("rj").alias("best"))
        drop = cut_lineage(score.join(top, "i").filter(F.col("rank") > F.col("best")).select("i"))
        removed = drop if removed is None else removed.unionByName(drop)
        live = cut_lineage(live.join(drop, "i", "left_anti").join(drop.withColumnRenamed("i", "j"), "j", "left_anti"))
    if removed is None:
        return samples.select("sample_idx")
    return samples.select("sample_idx").join(removed.withColumnRenamed("i", "sample_idx"), "sample_idx", "left_anti")


# ------------------------------------------------------------------------- PCA


def subset_frequencies(carriers: DataFrame, subset: DataFrame, n_subset: int) -> DataFrame:
    """Allele frequency and 1/sd over a sample subset (0 where monomorphic)."""
    p = F.col("ac") / (2.0 * n_subset)
    var = 2.0 * F.col("mu") * (1.0 - F.col("mu"))
    return (
        carriers.join(subset.select("sample_idx"), "sample_idx", "left_semi").groupBy("variant_id").agg(F.sum("dosage").alias("ac"))
        .withColumn("mu", p).withColumn("inv_sd", F.when(var > 1e-10, 1.0 / F.sqrt(var)).otherwise(0.0))
        .select("variant_id", "mu", "inv_sd")
    )


def _cols(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{c}" for c in range(n)]


def to_variant_space(carriers: DataFrame, stats: DataFrame, h: DataFrame, width: int) -> DataFrame:
    """Standardised genotypes times a sample matrix: (variant_id, x0..)."""
    hs, xs = _cols("h", width), _cols("x", width)
    col = h.agg(*[F.sum(c).alias(c) for c in hs]).first()
    prod = carriers.join(h, "sample_idx").groupBy("variant_id").agg(*[F.sum(F.col("dosage") * F.col(c)).alias(c) for c in hs])
    rows = stats.filter("inv_sd > 0").join(prod, "variant_id", "left").fillna(0.0, subset=hs)
    return rows.select("variant_id", *[
        (F.col("inv_sd") * (F.col(c) - 2.0 * F.col("mu") * float(col[c] or 0.0))).alias(x) for c, x in zip(hs, xs)
    ])


def to_sample_space(carriers: DataFrame, stats: DataFrame, x: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """Transposed standardised genotypes times a variant matrix: (sample_idx, h0..)."""
    hs, xs = _cols("h", width), _cols("x", width)
    weighted = stats.join(x, "variant_id")
    base = weighted.agg(*[F.sum(2.0 * F.col("mu") * F.col("inv_sd") * F.col(c)).alias(c) for c in xs]).first()
    prod = carriers.join(weighted, "variant_id").groupBy("sample_idx").agg(
        *[F.sum(F.col("dosage") * F.col("inv_sd") * F.col(c)).alias(h) for c, h in zip(xs, hs)])
    rows = samples.select("sample_idx").join(prod, "sample_idx", "left").fillna(0.0, subset=hs)
    return rows.select("sample_idx", *[(F.col(h) - float(base[c] or 0.0)).alias(h) for h, c in zip(hs, xs)])


def _gram(df: DataFrame, cols: list[str]) -> np.ndarray:
    """X'X of the named columns; partitions return partial matrices, Spark adds them."""
    k = len(cols)

    def partial(batches):
        acc = np.zeros((k, k))
        for pdf in batches:
            m = pdf[cols].to_numpy(float)
            acc += m.T @ m
        r, c = np.triu_indices(k)
        yield pd.DataFrame({"r": r, "c": c, "v": acc[r, c]})

    g = np.zeros((k, k))
    for row in df.select(*cols).mapInPandas(partial, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v")).collect():
        g[row["r"], row["c"]] = g[row["c"], row["r"]] = row["v"]
    return g


def _rotate(df: DataFrame, key: str, src: list[str], m: np.ndarray, out: list[str]) -> DataFrame:
    """Row-wise product with a small fixed matrix."""

    def product(batches):
        for pdf in batches:
            yield pd.concat([pdf[[key]], pd.DataFrame(pdf[src].to_numpy(float) @ m, columns=out, index=pdf.index)], axis=1)

    return df.select(key, *src).mapInPandas(product, f"{key} long, " + ", ".join(f"{c} double" for c in out))


def principal_components(carriers: DataFrame, samples: DataFrame, unrelated: DataFrame, n_pcs: int, n_iter: int = 10, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(sample_idx, pc1..) for all samples and the leading eigenvalues.

    Randomised block-Krylov iteration.  Sample and variant matrices are
    DataFrames; only Gram matrices of the Krylov columns (n_iter * 2 n_pcs wide)
    reach the driver.  Related samples are projected.
    """
    n_unrel = unrelated.count()
    width = 2 * n_pcs
    train = cut_lineage(carriers.join(unrelated.select("sample_idx"), "sample_idx", "left_semi"))
    stats = cut_lineage(subset_frequencies(carriers, unrelated, n_unrel).filter("inv_sd > 0"))
    hs, xs = _cols("h", width), _cols("x", width)
    u = [F.pmod(F.xxhash64("sample_idx", F.lit(seed), F.lit(c), F.lit(k)), F.lit(1 << 30)) for c in range(width) for k in (0, 1)]
    unit = [(v + 0.5) / float(1 << 30) for v in u]
    h = unrelated.select("sample_idx", *[
        (F.sqrt(-2.0 * F.log(unit[2 * c])) * F.cos(2.0 * F.pi() * unit[2 * c + 1])).alias(hs[c]) for c in range(width)])
    h = cut_lineage(h)
    krylov = None
    for it in range(n_iter):
        x = cut_lineage(to_variant_space(train, stats, h, width))
        renamed = x.withColumnsRenamed({c: f"k{it * width + i}" for i, c in enumerate(xs)})
        krylov = renamed if krylov is None else krylov.join(renamed, "variant_id")
        raw = cut_lineage(to_sample_space(train, stats, x, unrelated, width))
        norms = raw.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in hs]).first()
        h = raw.select("sample_idx", *[(F.col(c) / float(norms[c] or 1.0)).alias(c) for c in hs])
    k_cols = [f"k{i}" for i in range(n_iter * width)]
    krylov = cut_lineage(krylov)
    # Scaling the columns first keeps the Gram matrix well conditioned.
    raw_g = _gram(krylov, k_cols)
    scale = np.sqrt(np.maximum(np.diag(raw_g), 1e-300))
    lam, vec = np.linalg.eigh(raw_g / np.outer(scale, scale))
    keep = lam > lam.max() * 1e-10
    basis = (vec[:, keep] / np.sqrt(lam[keep])) / scale[:, None]
    r = int(keep.sum())
    q = cut_lineage(_rotate(krylov, "variant_id", k_cols, basis, _cols("x", r)))
    t = cut_lineage(to_sample_space(train, stats, q, unrelated, r))
    tg = _gram(t, _cols("h", r))
    ev, evec = np.linalg.eigh(tg)
    top = np.argsort(ev)[::-1][:n_pcs]
    ev, evec = ev[top], evec[:, top]
    loadings = _rotate(q, "variant_id", _cols("x", r), evec, _cols("x", n_pcs))
    scores = to_sample_space(carriers, stats, cut_lineage(loadings), samples, n_pcs)
    # Unit-length components over the training samples; others by projection.
    out = scores.select("sample_idx", *[
        (F.col(f"h{c}") / float(np.sqrt(max(ev[c], 1e-300)))).alias(f"pc{c + 1}") for c in range(n_pcs)])
    return out, ev


# --------------------------------------------------------------------- kinship


def kinship_threshold(degree: int) -> float:
    return 2.0 ** -(degree + 1.5)


def ancestry_regression(carriers: DataFrame, pcs: DataFrame, unrelated: DataFrame, pc_cols: list[str]) -> DataFrame:
    """Per variant coefficients of dosage on [1, PCs] over the training samples."""
    from .nullmodel import gram_matrix, gram_sums

    x = ["one", *pc_cols]
    train = pcs.join(unrelated.select("sample_idx"), "sample_idx", "left_semi").withColumn("one", F.lit(1.0))
    inv = np.linalg.inv(gram_matrix(train.agg(*gram_sums(x, [])).first(), len(x)))
    sums = carriers.join(train, "sample_idx").groupBy("variant_id").agg(*[F.sum(F.col("dosage") * F.col(c)).alias(f"_s{i}") for i, c in enumerate(x)])
    betas = []
    for i in range(len(x)):
        acc = F.lit(0.0)
        for j in range(len(x)):
            acc = acc + float(inv[i, j]) * F.col(f"_s{j}")
        betas.append(acc.alias(f"b{i}"))
    return sums.select("variant_id", *betas)


def pair_kinship(pairs: DataFrame, carriers: DataFrame, variants: DataFrame, pcs: DataFrame, beta: DataFrame, pc_cols: list[str],
                 block_variants: int = 20_000) -> DataFrame:
    """Ancestry-adjusted kinship of candidate pairs (and i = j self pairs).

    Numerator and denominator run over every variant, also uncarried ones.
    Expected dosages depend on the sample's PCs and the variant's coefficients, so each combination
    of distinct ones is visited, in blocks of about ``block_variants``; work is split over both and summed.
    Dosages enter through carriers only: with mu the expected dosage,
    ``sum (d_i-mu_i)(d_j-mu_j) = sum mu_i mu_j - sum_carr d_i mu_j - ... + sum d_i d_j``.
    """
    k = len(pc_cols) + 1
    bs = [f"b{i}" for i in range(k)]
    full = variants.select("variant_id").join(beta, "variant_id", "left").fillna(0.0, subset=bs)
    ends = pairs.select(F.explode(F.array("i", "j")).alias("sample_idx")).distinct()
    x = pcs.join(ends, "sample_idx", "left_semi").select("sample_idx", F.array(F.lit(1.0), *pc_cols).alias("x"))
    from .kinblocks import expected_sums

    base = expected_sums(pairs, x, full.select("variant_id", F.array(*bs).alias("b")), ISAF_MIN, ISAF_MAX, block_variants)

    def expected(xcol: str):
        dotted = F.aggregate(F.zip_with(F.array(*bs), F.col(xcol), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.least(F.greatest(dotted, F.lit(ISAF_MIN)), F.lit(ISAF_MAX))

    called = cut_lineage(carriers.join(ends, "sample_idx", "left_semi").select("variant_id", "sample_idx", "dosage"))
    mine = called.join(full, "variant_id")
    partner = pairs.select(F.col("i").alias("sample_idx"), F.col("j").alias("other"), "i", "j").unionByName(
        pairs.filter("i != j").select(F.col("j").alias("sample_idx"), F.col("i").alias("other"), "i", "j"))
    cross = mine.join(partner, "sample_idx").join(x.select(F.col("sample_idx").alias("other"), F.col("x").alias("xo")), "other").groupBy("i", "j").agg(
        F.sum(F.col("dosage") * expected("xo") * F.when(F.col("i") == F.col("j"), 2.0).otherwise(1.0)).alias("dm"))
    gi = called.select("variant_id", F.col("sample_idx").alias("i"), F.col("dosage").alias("di"))
    gj = called.select("variant_id", F.col("sample_idx").alias("j"), F.col("dosage").alias("dj"))
    prod = pairs.select("i", "j").join(gi, "i").join(gj, ["j", "variant_id"]).groupBy("i", "j").agg(F.sum(F.col("di") * F.col("dj")).alias("dd"))
    num = F.col("mm") - F.coalesce("dm", F.lit(0.0)) + F.coalesce("dd", F.lit(0))
    return base.join(cross, ["i", "j"], "left").join(prod, ["i", "j"], "left").select(
        "i", "j", num.alias("num"), F.col("sd").alias("den"),
        F.when(F.col("sd") > 0, num / F.col("sd")).otherwise(0.0).alias("kinship"))


def with_self_pairs(pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"))
    return pairs.select("i", "j").unionByName(ends).distinct()


def threshold_symmetric(kin: DataFrame, threshold: float) -> DataFrame:
    """Self pairs, plus both orientations of every pair at or above the threshold."""
    ok = kin.filter((F.col("i") == F.col("j")) | (F.col("kinship") >= threshold))
    return ok.select(F.explode(F.when(
        F.col("i") == F.col("j"), F.array(F.struct("i", "j", "kinship"))
    ).otherwise(F.array(F.struct("i", "j", "kinship"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "kinship")))).alias("t")).select("t.*")


def refine_threshold(kin: DataFrame, threshold: float, limit: int | None = None) -> tuple[float, DataFrame, bool]:
    """(threshold, components, raised): raised in small steps only where a caller gives a ``limit`` for components."""
    active = cut_lineage(kin.filter((F.col("i") < F.col("j")) & (F.col("kinship") >= threshold)).select("i", "j", "kinship"))
    raised = False
    while True:
        # Too large a component shows long before it is complete.
        comp = connected_components(active, most=limit)
        if comp is not None:
            return threshold, comp, raised
        raised = True
        # Steps that drop no pair leave the components as they are.
        least = active.agg(F.min("kinship").alias("k")).first()["k"]
        threshold *= 2.0 ** 0.01
        while threshold < least:
            threshold *= 2.0 ** 0.01
        active = cut_lineage(active.filter(F.col("kinship") > threshold))


def new_component_pairs(components: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs inside a component not estimated so far; components are bounded by the refinement."""
    a = components.select(F.col("sample").alias("i"), "component")
    b = components.select(F.col("sample").alias("j"), "component")
    return a.join(b, "component").filter("i < j").select("i", "j").join(known.select("i", "j"), ["i", "j"], "left_anti")


def relatedness_matrix(pairs: DataFrame, carriers: DataFrame, variants: DataFrame, samples: DataFrame, div: DataFrame,
                       n_pcs: int, degree: int, n_iter: int = 10, limit: int | None = None) -> dict[str, DataFrame]:
    """Whole job: unrelated subset, PCs, pair kinship, threshold and second pass."""
    carriers, variants = cut_lineage(carriers), cut_lineage(variants)  # read by every step
    unrelated = cut_lineage(unrelated_subset(pairs, samples, div))
    scores, _ = principal_components(carriers, samples, unrelated, n_pcs, n_iter)
    scores = cut_lineage(scores)
    pc_cols = [f"pc{i + 1}" for i in range(n_pcs)]
    beta = cut_lineage(ancestry_regression(carriers, scores, unrelated, pc_cols))
    first = cut_lineage(pair_kinship(with_self_pairs(pairs), carriers, variants, scores, beta, pc_cols))
    t, comp, raised = refine_threshold(first, kinship_threshold(degree), limit)
    kin = first
    if raised:
        extra = cut_lineage(new_component_pairs(comp, first))
        kin = first.unionByName(pair_kinship(extra, carriers, variants, scores, beta, pc_cols))
    return {"kinship": threshold_symmetric(kin, t), "scores": scores, "unrelated": unrelated}
