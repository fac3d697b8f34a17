"""Joins and searches against all pairs, and the pipeline against its stages by brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvar.llm import decontaminate, jaccard_join, quality, queries, secrets, topk

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(sets[a]), least.get(root(a))) for a, (i, _) in enumerate(rows)), key=str)


def near_rows():
    pick = random.Random(8)
    base = [f"w{pick.randrange(4000)}" for _ in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper()), (2, None), (3, ""), (4, "a b"), (5, "A b"), (6, "\t ")]
    line = " ".join(f"common{i}" for i in range(30))
    for i in range(10, 90):  # near copies at many distances, chains, and a line shared by all
        own = list(base)
        for _ in range(pick.randrange(0, 9)):
            own[pick.randrange(len(own))] = f"e{i}_{pick.randrange(1000)}"
        rows.append((i, " ".join(own)))
    for i in range(100, 140):
        rows.append((i, line + " " + " ".join(f"u{i}_{k}" for k in range(pick.randrange(3, 60)))))
    chain = [f"c{k}" for k in range(100)]
    for i in range(150, 190):
        rows.append((i, " ".join(chain[(i - 150) :] + [f"n{k}" for k in range(i - 150)])))
    return rows + [(10, "a b c d e f"), (10, "a b c d e f"), (11, "a b c d e f"), (None, rows[0][1]), (200, "z " * 5000), (201, "z " * 700)]


def test_components_equal_all_pairs(make):
    rows = near_rows()
    got = jaccard_join.near_components(make(rows)).select("doc_id", "n_shingles", "component_id").collect()
    # Two texts of id 10 and 11 have one label each, by their sets.
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert jaccard_join.near_components(make([])).count() == 0
    assert jaccard_join.near_components(make([(1, None), (2, "")])).count() == 2


def brute_top(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append([int(np.floor(64 * x)) for x in v])
    out = []
    for q in (i for i in ok if i % 20 == 0):
        for own in ok[q]:
            near = sorted(((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i in ok if i != q for v in ok[i] if len(v) == len(own)))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize(("bucket", "block"), [(16, 3), (4096, 512)])
def test_top_k(spark, bucket, block):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(12) * rng.choice([0.1, 1, 3])).tolist()) for i in range(150)]
    rows += [(i, [1.0] * 12) for i in range(150, 210)] + [(300, None), (301, [float("nan")] * 12), (302, [None] + [1.0] * 11), (None, [1.0] * 12), (320, [0.0] * 12), (340, [1.0, 2.0]), (341, [2.0, 1.0]), (360, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("bucket", F.lit("b"))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, F.col("id") % 20 == 0, k=7, bucket=bucket, query_block=block).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 7)
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_pruning_drops_work_but_no_result():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-60, 60, (2000, 24)).astype(float)
    lengths = np.sqrt((vectors**2).sum(1))
    order = np.argsort(-lengths)
    vectors, lengths = vectors[order], lengths[order]
    for query in (vectors[5] + rng.integers(-3, 3, 24), vectors[1999]):
        scores = vectors @ query
        bound = np.sort(scores)[-20]
        rows = topk.search_pair(query, bound, vectors, lengths)
        assert set(np.flatnonzero(scores >= bound)) <= set(rows.tolist()) and len(rows) < len(vectors)


def test_pipeline_stages(spark, tmp_path, make):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (9003, "copy " * 40, "en", "s", 200), (9003, "copy " * 40, "en", "s", 200), (None, "no id stands here but words do", "en", "s", 30)], docs.schema)
    docs = docs.unionByName(extra)
    steps, seen = dict(P.STAGES), []
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, before.count(), docs.count()))
        if name != "tokens":
            assert docs.columns == before.columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "quality":
            want = quality.classify(before).where("kept").count()
            assert docs.count() == want
        elif name == "near_duplicates":
            label = brute_components(rows)
            roots = {i for i, _, c in label if i is not None and c == i}
            assert {r.doc_id for r in docs.collect() if r.doc_id is not None} == roots and docs.where("doc_id IS NULL").count() == before.where("doc_id IS NULL").count()
            assert docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
        elif name == "decontamination":
            bad = decontaminate.find_contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated")
            assert docs.count() == before.count() - bad.count()
        elif name == "secrets":
            left = [secrets.scan_text(r.text or "")[0] for r in docs.collect()]
            assert docs.count() == before.count() and not any(left)
        else:
            assert docs.count() == before.count() and docs.where("size(ids) <> n_tokens").isEmpty()
    assert steps and all(b >= a for _, b, a in seen)
    assert P.run(spark, sf).count() > 0 and queries.SEPARATOR


CLASHES = ["score", "posterior", "kept", "text_crc", "nth", "alone", "n_words", "hit_words", "items", "contaminated", "base", "spans", "body", "row", "corpus_1", "g_id", "a b.c"]


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHES])
    nameless = spark.createDataFrame([(None, "words without an id stand here, said one clerk to another over tea", "en", "s", 66, *["x"] * len(CLASHES))] * 3, docs.schema)
    docs = docs.unionByName(nameless)
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs.count(), spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert 0 < len(rows) <= before and sum(r.doc_id is None for r in rows) == 3
        assert all(r[c] == (f"{c}{r.doc_id}" if r.doc_id is not None else "x") for r in rows for c in CLASHES)
    last = P.encode_pieces(spark, docs.withColumnsRenamed({"body": "ids", "base": "n_tokens"}), sf)
    assert last.count() == docs.count() and last.where("size(ids) <> n_tokens").isEmpty()


def test_shingles_that_many_share_open_no_region(spark, make, monkeypatch):
    """Texts that share a line but are not alike are met by none, at any number of parts."""
    kept = []
    write = jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label: kept.append((label, write(df, label))) or kept[-1][1])
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "RUN_TEXTS", 7)
    line = " ".join(f"common{k}" for k in range(12))
    rows = [(i, line + " " + " ".join(f"u{i}_{k}" for k in range(20))) for i in range(120)]
    rows += [(200 + i, rows[0][1] + f" more{i}") for i in range(3)] + [(300, rows[5][1])]
    got = jaccard_join.near_components(make(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert {r.node for r in dict(kept)["shared"].select("node").collect()} == {0, 200, 201, 202}


def test_many_rounds_of_few_pivots_lose_no_link(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 8)
    rows = near_rows()
    got = jaccard_join.near_components(make(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
