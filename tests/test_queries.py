"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
NAMES = [
    "S01_delimited_scan", "S04_sorted_table_join", "S13_phenotype_source", "P02_chromosome_tabular", "P03_multiallelic_split", "P04_parsimony", "P13_gt_dosage", "F12_mask_plof",
    "J01_annotate_exact", "J05_tissue_semi_join", "A08_cumulative_count", "W01_dedup_by_maf", "W05_segments", "N01_residuals", "T05_burden", "T13_variant_saddlepoint", "C08_A18_volcano",
    "M02_A06_A07_merged_variants", "M_known_loci_match", "G02_components", "G04_unrelated_subset", "G05_to_variant_space", "G06_to_sample_space", "G03_divergence", "G08_pair_kinship", "G10_refined_pairs", "U02_union_parts",
]


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, sql, name):
    out = entry.queries()[name](spark, sf)
    cols = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in out.collect()), key=str)
    res = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in res.fetchall()), key=str)
    assert sorted(names) == cols and got == want


def test_entry_has_rows_and_optional_queries_are_optional(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pseudo_residuals_run_all_draws(spark, sf):
    from sparvar.operators import scan

    rows = entry.queries()["R05_pseudo_residuals"](spark, sf).collect()
    assert sorted(r.draw for r in rows) == list(range(scan.DEFAULT_DRAWS))
    assert all(r[c] == 0 for r in rows for c in r.asDict() if c.startswith("orth_"))
