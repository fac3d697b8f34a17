"""One query for each operator of this subpackage, with SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from . import codebooks, dac, decontaminate, fim, jaccard_join, lm_scores, quality, secrets, sentencepieces, separators, substring_dedup, topk, toxicity

#: End-of-document ids of the public byte-level vocabulary and of token id files.
SEPARATOR = 50256
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


#: Folder-independent name of the public tokenizer files' package; a path may be given instead.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
gone AS (SELECT DISTINCT k.doc_id, unnest(range(k.pos, k.pos + 50)) AS pos FROM k JOIN f USING (h) WHERE f.least < k.doc_id),
g AS (SELECT doc_id, list(pos) AS gone_at, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN g.n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g.gone_at, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@_query("op1_substring_dedup", _OP1_SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[pos:pos + 12], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS pos FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
k AS (SELECT doc_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM p),
m AS (SELECT k.doc_id, k.pos, k.n, g.item_id FROM k JOIN g USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


@_query("op5_decontaminate", _OP5_SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


@_query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int):  # a second parameter of the lambda would be the position
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(secrets.spans_text("base"), 256).alias("base_sha256"), secrets.spans_text("spans").alias("spans"))


@_query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@_query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents")).select("doc_id", "posterior", "score", "kept")


@_query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    separators.write_flat(_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.tiktoken"), SEPARATOR)
    return separators.count_tokens(spark.read.parquet(folder), SEPARATOR).select(F.col("doc").alias("doc_id"), "n_tokens", "closed")


_OP7_SQL = """
WITH r AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM r),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20"""


@_query("op7_top_k", _OP7_SQL)
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


_OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a) USING (doc_id)"""


@_query("op6_jaccard_join", _OP6_SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(_table(spark, sf_dir, "documents")).drop("text_crc")


@_query("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    scored = lm_scores.score_texts(_table(spark, sf_dir, "documents"), part != 2, tokenizer_path("byte_bpe_50k.tiktoken"), SEPARATOR)
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op11_token_codes")
def op11_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = dac.write_ids(_table(spark, sf_dir, "documents"), scratch_path(spark, "dac"), tokenizer_path("word_bpe_49k.json"), END_ID)
    return dac.read_documents(files).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
k AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
s AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS e FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s"""


@_query("op12_fill_in_middle", _OP12_SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def _op13_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Assignment and means of every round, spelled out one after the other."""
    steps = [
        f"""r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"t AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM r, (SELECT unnest(range({parts})) AS p))",
        f"c0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id, v) AS BIGINT) - 1 AS e, v FROM t QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id, v) <= {entries})",
    ]
    near = """SELECT vec_id, label, p, v, min({{d: d, e: e}}).d AS d, min({{d: d, e: e}}).e AS e FROM (SELECT t.vec_id, t.label, t.p, t.v, c.e,
  CAST(list_sum(list_transform(list_zip(t.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM t JOIN {c} c USING (p)) GROUP BY vec_id, label, p, v"""
    for k in range(1, rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(c=f'c{k - 1}')})")
        steps.append(f"m{k} AS (SELECT p, e, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM t) + 1)) AS i) GROUP BY p, e, i)")
        steps.append(f"""c{k} AS MATERIALIZED (SELECT c.p, c.e, coalesce(g.v, c.v) AS v FROM c{k - 1} c LEFT JOIN
  (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM m{k} GROUP BY p, e) g USING (p, e))""")
    steps.append(f"z AS ({near.format(c=f'c{rounds}')})")
    steps.append(f"b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})")
    steps.append("f AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id, label)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM f, b"


@_query("op13_vector_codes", _op13_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    books = codebooks.train(vectors)
    coded = cut_lineage(codebooks.encode(vectors, books, keep=("label",)))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l_label")
    # Either side of the join is split or sent whole by its measured size.
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("l_label")))
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
