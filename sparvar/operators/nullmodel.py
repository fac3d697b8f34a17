"""Per-sample regression models under the null.

The data stay distributed: one aggregation yields the (p+1)^2 normal equations,
the driver solves that small system, and residuals are a native projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_SAMPLES = 10


@dataclass
class NullModel:
    """``vectors`` has sample_idx, r, w (working weight) and x0..xp per sample."""

    vectors: DataFrame
    n: int
    x_cols: list[str]
    cov_inv: np.ndarray
    sigma2: float
    kind: str
    beta: np.ndarray
    extra: dict = field(default_factory=dict)


def complete_cases(pheno: DataFrame, genotyped: DataFrame, traits: list[str], covariates: list[str]) -> DataFrame:
    """Genotyped samples with every trait and covariate present, in genotype order keys."""
    return genotyped.select("sample_id", "sample_idx").join(
        pheno.drop("sample_idx").dropna(subset=traits + covariates), "sample_id"
    )


def check_inputs(pheno: DataFrame, traits: list[str], covariates: list[str], ancestry: str | None = None) -> None:
    """Raise, naming columns, on NaN values or unusable group labels (one job)."""
    cols = traits + covariates
    row = value_guards(pheno, cols, ancestry).first()
    bad = [c for c in cols if row[f"nan_{c}"]]
    if bad:
        raise ValueError(f"NaN values in: {', '.join(bad)}")
    if row["n"] < MIN_SAMPLES:
        raise ValueError(f"only {row['n']} complete samples, at least {MIN_SAMPLES} are needed")
    if ancestry and row["missing"]:
        raise ValueError(f"missing labels in '{ancestry}'")
    if ancestry and row["levels"] < 2:
        raise ValueError(f"'{ancestry}' needs at least two populations")


def value_guards(pheno: DataFrame, cols: list[str], ancestry: str | None = None) -> DataFrame:
    """One row of guard counts: n, NaN per column, missing and distinct group labels."""
    exprs = [F.count("*").alias("n"), *[F.count_if(F.isnan(F.col(c).cast("double"))).alias(f"nan_{c}") for c in cols]]
    if ancestry:
        exprs += [F.count_if(F.col(ancestry).isNull()).alias("missing"), F.count_distinct(ancestry).alias("levels")]
    return pheno.agg(*exprs)


def lookup_by_sample(samples: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Attach a per-sample label; a sample without one raises when evaluated."""
    bad = F.raise_error(F.concat(F.lit(f"no {column} for sample "), F.col("sample_id")))
    joined = samples.join(labels.select("sample_id", F.col(column).alias("_v")), "sample_id", "left")
    return joined.withColumn(column, F.coalesce(F.col("_v"), bad.cast(labels.schema[column].dataType))).drop("_v")


def intern_labels(frame: DataFrame, label: str) -> DataFrame:
    """Adds ``code``: 0-based rank of each label by its first sample."""
    first = frame.groupBy(label).agg(F.min("sample_idx").alias("_first"))
    # One row per distinct label reaches the window.
    codes = first.withColumn("code", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int"))
    return frame.join(codes.select(label, "code"), label)


def trait_family(pheno: DataFrame, traits: list[str]) -> DataFrame:
    """binary when a trait has at most two distinct values; one aggregation for all traits."""
    wide = pheno.agg(*[F.count_distinct(t).alias(t) for t in traits])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("trait"), F.col(t).alias("n_distinct"),
                 F.when(F.col(t) <= 2, "binary").otherwise("continuous").alias("family"))
        for t in traits
    ])).alias("s")).select("s.*")


def common_family(pheno: DataFrame, traits: list[str]) -> str:
    kinds = {r["family"] for r in trait_family(pheno, traits).collect()}
    if len(kinds) > 1:
        raise ValueError("continuous and binary traits cannot be mixed in one run")
    return kinds.pop()


def design(pheno: DataFrame, covariates: list[str], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds x0 (intercept) .. xp; keeps the named columns."""
    names = [f"x{i}" for i in range(len(covariates) + 1)]
    cols = [F.lit(1.0).alias("x0")]
    cols += [F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(covariates)]
    kept = [F.col(k) for k in keep if k not in names]
    return pheno.select(*kept, *cols), names


def gram_sums(x: list[str], targets: list[str], weight: Column | None = None) -> list[Column]:
    """Aggregates for X'WX (upper triangle) and X'Wt for each target."""
    w = F.lit(1.0) if weight is None else weight
    out = [
        F.sum(w * F.col(a) * F.col(b)).alias(f"xx_{i}_{j}")
        for i, a in enumerate(x) for j, b in enumerate(x) if j >= i
    ]
    out += [F.sum(w * F.col(a) * F.col(t)).alias(f"xt_{i}_{t}") for i, a in enumerate(x) for t in targets]
    return out


def gram_matrix(row, k: int) -> np.ndarray:
    m = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"xx_{i}_{j}"]
    return m


def dot(coefs, cols: list[str]) -> Column:
    acc = F.lit(0.0)
    for c, name in zip(coefs, cols):
        acc = acc + F.lit(float(c)) * F.col(name)
    return acc


def fit_gaussian(pheno: DataFrame, y: str, covariates: list[str], keep: list[str] = ()) -> NullModel:
    """Ordinary least squares; one job for the sums, one for the residual variance."""
    return fit_gaussian_multi(pheno, [y], covariates, keep)


def fit_gaussian_multi(pheno: DataFrame, traits: list[str], covariates: list[str], keep: list[str] = ()) -> NullModel:
    """All traits share X, so one pass gives every X't and the residual cross-products.

    RSS terms come from a second aggregation over residuals (not y'y - b'X'y,
    which cancels badly).
    """
    frame, x = design(pheno, covariates, ["sample_idx", *traits, *keep])
    k = len(x)
    row = frame.agg(F.count("*").alias("n"), *gram_sums(x, traits)).first()
    n = row["n"]
    if n < MIN_SAMPLES:
        raise ValueError(f"only {n} complete samples, at least {MIN_SAMPLES} are needed")
    inv = np.linalg.inv(gram_matrix(row, k))
    beta = np.column_stack([inv @ np.array([row[f"xt_{i}_{t}"] for i in range(k)]) for t in traits])
    names = ["r"] if len(traits) == 1 else [f"r{j}" for j in range(len(traits))]
    vectors = frame.select(
        "sample_idx", *[c for c in keep if c not in x], *x, F.lit(1.0).alias("w"),
        *[(F.col(t) - dot(beta[:, j], x)).alias(names[j]) for j, t in enumerate(traits)],
    )
    cross = [
        F.sum(F.col(a) * F.col(b)).alias(f"c_{i}_{j}")
        for i, a in enumerate(names) for j, b in enumerate(names) if j >= i
    ]
    cr = vectors.agg(*cross).first()
    cov = np.empty((len(names),) * 2)
    for i in range(len(names)):
        for j in range(i, len(names)):
            cov[i, j] = cov[j, i] = cr[f"c_{i}_{j}"] / (n - k)
    extra = {"residual_cov": cov, "residual_inv": np.linalg.inv(cov), "traits": list(traits)} if len(names) > 1 else {}
    return NullModel(vectors, n, x, inv, float(cov[0, 0]) if len(names) == 1 else 1.0, "continuous",
                     beta[:, 0] if len(names) == 1 else beta, extra)


def _logistic(eta: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(eta, F.lit(-500.0)), F.lit(500.0))))


def irls_beta(frame: DataFrame, y: str, x: list[str], max_iter: int = 25, tol: float = 1e-8) -> np.ndarray:
    """Logistic coefficients; one aggregation job per iteration over a persisted frame."""
    k = len(x)
    beta = np.zeros(k)
    for _ in range(max_iter):
        eta = dot(beta, x)
        mu = _logistic(eta)
        w = F.greatest(mu * (1.0 - mu), F.lit(1e-10))
        z = eta + (F.col(y) - mu) / w
        step = frame.withColumns({"_w": w, "_z": z})
        row = step.agg(*gram_sums(x, ["_z"], F.col("_w"))).first()
        new = np.linalg.solve(gram_matrix(row, k), np.array([row[f"xt_{i}__z"] for i in range(k)]))
        moved = np.abs(new - beta).max()
        beta = new
        if moved < tol:
            break
    return beta


def fit_logistic(pheno: DataFrame, y: str, covariates: list[str], keep: list[str] = ()) -> NullModel:
    """Logistic null: r = y - mu, w = mu(1-mu), (X'WX)^-1 and unit dispersion."""
    frame, x = design(pheno, covariates, ["sample_idx", y, *keep])
    frame = frame.persist()
    try:
        n = frame.count()
        if n < MIN_SAMPLES:
            raise ValueError(f"only {n} complete samples, at least {MIN_SAMPLES} are needed")
        beta = irls_beta(frame, y, x)
        mu = _logistic(dot(beta, x))
        row = frame.withColumn("_w", mu * (1.0 - mu)).agg(*gram_sums(x, [], F.col("_w"))).first()
    finally:
        frame.unpersist()
    plain, _ = design(pheno, covariates, ["sample_idx", y, *keep])
    vectors = plain.select(
        "sample_idx", *[c for c in keep if c not in x], *x, mu.alias("mu"),
        (mu * (1.0 - mu)).alias("w"), (F.col(y) - mu).alias("r"),
    )
    return NullModel(vectors, n, x, np.linalg.inv(gram_matrix(row, len(x))), 1.0, "binary", beta)


def fit_logistic_multi(pheno: DataFrame, traits: list[str], covariates: list[str], keep: list[str] = ()) -> NullModel:
    """Several binary traits: per-trait logistic fits, residual correlation, mean weight."""
    frame, x = design(pheno, covariates, ["sample_idx", *traits, *keep])
    frame = frame.persist()
    try:
        n = frame.count()
        betas = [irls_beta(frame, t, x) for t in traits]
    finally:
        frame.unpersist()
    plain, _ = design(pheno, covariates, ["sample_idx", *traits, *keep])
    k = len(traits)
    mus = [_logistic(dot(b, x)) for b in betas]
    work = F.lit(0.0)
    for m in mus:
        work = work + m * (1.0 - m) / k
    vectors = plain.select(
        "sample_idx", *[c for c in keep if c not in x], *x, work.alias("w"),
        *[m.alias(f"mu{j}") for j, m in enumerate(mus)],
        *[(F.col(t) - m).alias(f"r{j}") for j, (t, m) in enumerate(zip(traits, mus))],
    )
    sums = [F.sum(F.col(f"r{i}") * F.col(f"r{j}")).alias(f"c_{i}_{j}") for i in range(k) for j in range(i, k)]
    row = vectors.agg(*sums, *gram_sums(x, [], F.col("w"))).first()
    c = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            c[i, j] = c[j, i] = row[f"c_{i}_{j}"]
    sd = np.sqrt(np.diag(c))
    corr = c / np.outer(sd, sd)
    np.fill_diagonal(corr, 1.0)
    return NullModel(vectors, n, x, np.linalg.inv(gram_matrix(row, len(x))), 1.0, "binary",
                     np.column_stack(betas),
                     {"residual_cov": corr, "residual_inv": np.linalg.inv(corr), "traits": list(traits)})


def known_locus_dosages(carriers: DataFrame, loci: DataFrame, samples: DataFrame, max_loci: int = 500) -> tuple[DataFrame, list[str]]:
    """Per-sample dosage columns g0..gk for the known loci (absent carrier = 0).

    ``loci`` holds variant_id.  The pivot values are collected, so their number
    is checked first.
    """
    ids = [r["variant_id"] for r in loci.select("variant_id").distinct().orderBy("variant_id").limit(max_loci + 1).collect()]
    if len(ids) > max_loci:
        raise ValueError(f"more than {max_loci} conditioning loci")
    names = [f"g{i}" for i in range(len(ids))]
    hits = carriers.filter(F.col("variant_id").isin(ids))
    wide = hits.groupBy("sample_idx").agg(*[
        F.sum(F.when(F.col("variant_id") == v, F.col("dosage").cast("double")).otherwise(0.0)).alias(g)
        for v, g in zip(ids, names)
    ]) if ids else None
    if wide is None:
        return samples, []
    return samples.join(wide, "sample_idx", "left").fillna(0.0, subset=names), names
