"""Delimited text and Parquet sources, header resolution, and small text formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.variant import normalize_chromosome

# Accepted header spellings per canonical column.
HEADER_ALIASES = {
    "chromosome": ["chromosome", "chr", "chrom", "#chrom", "#chr", "chr_name", "chrom_id", "hg38chrc"],
    "position": ["position", "pos", "bp", "base_pair_location", "bp_hg38", "bp_grch38", "pos_hg38", "start", "chromstart", "beg"],
    "ref": ["ref", "reference", "ref_allele", "other_allele", "nea", "non_effect_allele"],
    "alt": ["alt", "alternate", "alt_allele", "effect_allele", "ea", "tested_allele", "risk_allele"],
    "rsid": ["rsid", "rsids", "snp", "snpid", "variant_id", "markername", "rs", "rs_id"],
    "beta": ["beta", "effect", "effect_size", "b", "log_or"],
    "se": ["se", "stderr", "standard_error", "sebeta"],
    "pvalue": ["pvalue", "p", "pval", "p_value", "p.value", "p_val"],
    "neglog10p": ["log10p", "neglog10p", "mlogp", "log10_p", "nlog10p"],
    "zscore": ["z", "zscore", "z_score", "z_stat"],
    "n": ["n", "neff", "n_eff", "sample_size", "n_total"],
    "pip": ["pip", "posterior_prob", "posterior_inclusion_prob", "pp"],
    "cs_id": ["cs", "cs_id", "credible_set", "cs_index"],
    "odds_ratio": ["or", "odds_ratio"],
    "allele_freq": ["af", "freq", "eaf", "maf", "allele_frequency", "effect_allele_frequency"],
}
# Headers whose allele role varies between studies.
AMBIGUOUS_HEADERS = ["a1", "a2", "allele1", "allele2"]
# Accepted sample id headers.
SAMPLE_ID_HEADERS = [
    "IID", "iid", "FID", "fid", "sample_id", "SampleID", "SAMPLE_ID", "sample",
    "Sample", "SAMPLE", "ID", "id", "SubjectID", "subject_id",
]
_TYPES = {
    "position": "int", "n": "int", "cs_id": "int",
    **dict.fromkeys(["beta", "se", "pvalue", "zscore", "neglog10p", "pip", "odds_ratio", "allele_freq"], "double"),
}
_CANONICAL = {a: name for name, row in HEADER_ALIASES.items() for a in row}


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """Header row, every column as text; casts come later and by name."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False)


def read_parquet(spark: SparkSession, path: str | list[str], partitions_as_text: bool = True) -> DataFrame:
    """Parquet file or partitioned directory; partition values (chromosome) stay strings."""
    if not partitions_as_text:
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    finally:
        spark.conf.set(key, before)


def map_headers(columns: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """(input -> canonical, ambiguous, unmapped) for a header."""
    mapped, ambiguous, unmapped = {}, [], []
    for c in columns:
        key = c.lower().strip()
        if key in AMBIGUOUS_HEADERS:
            ambiguous.append(c)
        elif key in _CANONICAL:
            mapped[c] = _CANONICAL[key]
        else:
            unmapped.append(c)
    return mapped, ambiguous, unmapped


def require_headers(columns: list[str], needed: list[str]) -> None:
    have = set(map_headers(columns)[0].values())
    missing = [n for n in needed if n not in have]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}; found: {', '.join(columns)}")


def header_report(spark: SparkSession, columns: list[str]) -> DataFrame:
    """How each input column was understood, as a table."""
    mapped, ambiguous, _ = map_headers(columns)
    rows = [
        (c, mapped.get(c), "mapped" if c in mapped else "ambiguous" if c in ambiguous else "unmapped")
        for c in columns
    ]
    return spark.createDataFrame(rows, "column string, canonical string, status string")


def canonical_type(name: str) -> str:
    return _TYPES.get(name, "string")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ingest_tabular(df: DataFrame, zero_based: bool = False, numeric_mt: bool = False) -> DataFrame:
    """Canonical columns from a delimited variant table.

    Unmapped columns pass through; rows on other contigs are dropped.  A1/A2
    style columns are read as alt/ref only when neither allele was mapped.
    """
    mapped, ambiguous, unmapped = map_headers(df.columns)
    source: dict[str, str] = {}
    for col, name in mapped.items():
        source.setdefault(name, col)
    if "ref" not in source and "alt" not in source:
        for col in ambiguous:
            source["alt" if col.lower().strip() in ("a1", "allele1") else "ref"] = col
    out = []
    if "chromosome" in source:
        out.append(normalize_chromosome(_quoted(source["chromosome"]), numeric_mt).alias("chromosome"))
    if "position" in source:
        pos = _quoted(source["position"]).try_cast("int")
        out.append((pos + 1 if zero_based else pos).alias("position"))
    for allele in ("ref", "alt"):
        if allele in source:
            out.append(F.upper(F.trim(_quoted(source[allele]).cast("string"))).alias(allele))
    for name, col in source.items():
        if name not in ("chromosome", "position", "ref", "alt"):
            out.append(_quoted(col).try_cast(canonical_type(name)).alias(name))
    out += [_quoted(c) for c in unmapped]
    result = df.select(*out)
    return result.filter("chromosome is not null") if "chromosome" in source else result


def _ranked(columns: list[str], candidates: list[str]) -> str | None:
    """The column that the earliest candidate names."""
    place = {c: k for k, c in reversed([*enumerate(candidates)])}
    return min((c for c in columns if c in place), key=place.__getitem__, default=None)


def resolve_column(wanted: str, columns: list[str], explicit: dict[str, str] | None = None) -> str:
    """The explicit map decides where it names the column; else its own spelling, else the only one alike."""
    alike = [c for c in columns if c.casefold() == wanted.casefold()]
    candidates = [explicit[wanted]] if wanted in (explicit or {}) else [wanted, *(alike if len(alike) == 1 else [])]
    found = _ranked(columns, candidates)
    if found is None:
        raise ValueError(f"no column for {' or '.join(map(repr, dict.fromkeys([wanted, *candidates])))} among {columns}")
    return found


def resolve_sample_id(columns: list[str], explicit: dict[str, str] | None = None) -> str:
    """Mapped id column, first column if it is spelt like an id, known spellings, first column."""
    spelt = {a.casefold() for a in SAMPLE_ID_HEADERS}
    mapped = [explicit["id"]] if "id" in (explicit or {}) else []
    first = [c for c in columns[:1] if c.casefold() in spelt]
    return _ranked(columns, [*mapped, *first, *SAMPLE_ID_HEADERS, *columns[:1]])


def read_phenotype(
    spark: SparkSession, path: str, traits: list[str], covariates: list[str],
    others: list[str] = (), explicit: dict[str, str] | None = None, sep: str = "\t",
) -> DataFrame:
    """sample_id, traits and covariates as doubles, other columns as text."""
    raw = read_delimited(spark, path, sep)
    cols = raw.columns
    sel = [_quoted(resolve_sample_id(cols, explicit)).alias("sample_id")]
    sel += [_quoted(resolve_column(c, cols, explicit)).try_cast("double").alias(c) for c in [*traits, *covariates]]
    sel += [_quoted(resolve_column(c, cols, explicit)).alias(c) for c in others]
    return raw.select(*sel)


def parse_kinship(lines: DataFrame, samples: DataFrame, header: str | None = None) -> DataFrame:
    """Symmetric (i, j, value) triplets from 3-column text.

    Comments, short rows and lines equal to ``header`` are skipped; a value that
    is not a number raises.  Unknown samples are dropped and missing diagonal
    entries become 1.
    """
    parts = F.split(F.trim("value"), "\\s+")
    body = lines.filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    if header is not None:
        body = body.filter(F.col("value") != header)
    rows = body.select(parts.alias("p")).filter(F.size("p") >= 3)
    text = F.get("p", F.lit(2))
    value = F.coalesce(
        text.try_cast("double"),
        F.raise_error(F.concat(F.lit("kinship value is not a number: "), text)).cast("double"),
    )
    raw = rows.select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"), value.alias("value"))
    left = samples.select(F.col("sample_id").alias("a"), F.col("sample_idx").alias("i"))
    right = samples.select(F.col("sample_id").alias("b"), F.col("sample_idx").alias("j"))
    known = raw.join(left, "a").join(right, "b").select("i", "j", "value")
    # One pass makes both orientations of an off-diagonal entry.
    both = known.select(F.explode(F.when(
        F.col("i") == F.col("j"), F.array(F.struct("i", "j", "value"))
    ).otherwise(F.array(
        F.struct("i", "j", "value"),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "value"),
    ))).alias("t")).select("t.*")
    missing = samples.select(F.col("sample_idx").alias("i")).join(
        both.filter("i = j").select("i"), "i", "left_anti"
    ).select("i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    return both.unionByName(missing)


def read_kinship(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """Kinship triplets of one file; its first line is a header if field 3 is no number."""
    lines = spark.read.text(path)
    first = lines.first()
    header = None
    if first is not None and len(tokens := first["value"].split()) >= 3:
        try:
            float(tokens[2])
        except ValueError:
            header = first["value"]
    return parse_kinship(lines, samples, header)


# Inference labels and their degree of relatedness.
KING_DEGREES = {
    "Dup/MZ": 0, "Dup": 0, "MZ": 0, "PO": 1, "FS": 1, "1st": 1,
    "2nd": 2, "HS": 2, "3rd": 3, "4th": 4,
}


def king_degree(label: Column) -> Column:
    """0..4, null for unrelated or unknown labels."""
    out = None
    for name, degree in KING_DEGREES.items():
        cond = F.trim(label) == name
        out = F.when(cond, degree) if out is None else out.when(cond, degree)
    return out


def parse_king(lines: DataFrame, header: str, max_degree: int) -> DataFrame:
    """Related pairs (id1, id2, prop_ibd, degree) from relatedness-segment text.

    ``header`` is the first line; both FID1/FID2 and single-FID layouts work.
    """
    names = [h.lower() for h in header.split()]

    def at(*options: str) -> int:
        for o in options:
            if o.lower() in names:
                return names.index(o.lower())
        raise ValueError(f"missing {'/'.join(options)} column in: {header}")

    two = "fid1" in names
    f1, f2 = (at("FID1"), at("FID2")) if two else (at("FID"), at("FID"))
    i1, i2, ibd, inf = at("ID1"), at("ID2"), at("PropIBD", "Kinship"), at("InfType")
    p = F.split(F.trim("value"), "\\s+")
    body = lines.filter(F.trim("value") != F.lit(re.sub(r"\s+$", "", header.strip()))).select(p.alias("p"))

    def get(i: int) -> Column:
        return F.get("p", F.lit(i))

    return (
        body.filter(F.size("p") >= len(names))
        .select(
            F.concat_ws("_", get(f1), get(i1)).alias("id1"),
            F.concat_ws("_", get(f2), get(i2)).alias("id2"),
            get(ibd).cast("double").alias("prop_ibd"),
            king_degree(get(inf)).alias("degree"),
        )
        .filter(F.col("degree") <= max_degree)
    )


def read_king(spark: SparkSession, path: str, max_degree: int) -> DataFrame:
    lines = spark.read.text(path)
    head = lines.filter(F.lower("value").contains("inftype")).limit(1).collect()
    if not head:
        raise ValueError(f"no header with InfType in {path}")
    return parse_king(lines, head[0]["value"], max_degree)


def parse_known_loci(lines: DataFrame) -> DataFrame:
    """``chr:pos[:ref:alt]`` -> chromosome, position, ref, alt with ``*`` wildcards."""
    p = F.split("value", ":")
    return (
        lines.filter((F.length("value") > 0) & ~F.col("value").startswith("#"))
        .select(
            normalize_chromosome(F.get(p, F.lit(0))).alias("chromosome"),
            F.get(p, F.lit(1)).try_cast("int").alias("position"),
            F.coalesce(F.get(p, F.lit(2)), F.lit("*")).alias("ref"),
            F.coalesce(F.get(p, F.lit(3)), F.lit("*")).alias("alt"),
        )
        .filter("chromosome is not null and position is not null")
    )


def parse_candidates(lines: DataFrame) -> DataFrame:
    """Tab- or colon-separated candidate variants; a malformed line raises."""
    line = F.trim("value")
    p = F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, ":"))
    rows = lines.filter((F.length(line) > 0) & ~line.startswith("#")).select(F.col("value"), p.alias("p"))
    bad = F.raise_error(F.concat(F.lit("expected CHR, POS, REF, ALT but got: "), F.col("value")))
    return rows.select(
        F.coalesce(
            F.when(F.size("p") >= 4, normalize_chromosome(F.get("p", F.lit(0)))), bad.cast("string")
        ).alias("chromosome"),
        F.coalesce(F.get("p", F.lit(1)).try_cast("int"), bad.cast("int")).alias("position"),
        F.get("p", F.lit(2)).alias("ref"),
        F.get("p", F.lit(3)).alias("alt"),
    )
