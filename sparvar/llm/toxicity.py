"""Toxicity by a hashed linear model with a counterfactual penalty.

Words are hashed into ``2**BITS`` buckets and a document is the set of its buckets.
Labelled documents that hold an identity term get twins in which each term is replaced
by another of its set; training minimises the logistic loss of documents and twins under
the same label plus ``penalty`` times the squared score change between the two, so no
weight can rest on naming a group.  Buckets that too few labelled documents share are
left out, so long texts gather no noise.

The model is fitted on at most about ``max_rows`` labelled rows, chosen by a hash of the
id (documented bound; the sample is broadcast by id and its features are collected).
Every text is scored whole.

Defined results: null and empty texts get the score of a text without known words; rows
without id are scored but never learned from; unlabelled rows and null labels are not
learned from; repeated labels count once, with the larger label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

BITS = 18
MAX_ROWS = 12_000
#: Sets of terms that name a group; a twin replaces a term by the next of its set.
IDENTITY_SETS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "indigenous"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["immigrants", "natives", "refugees"],
    ["old", "young"],
    ["deaf", "blind", "disabled"],
]


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_buckets(words: list[str], bits: int = BITS) -> np.ndarray:
    block = W.Block(pa.array([w.encode() for w in words], pa.binary()), W.ALNUM, True)
    return _bucket(block.word_hashes(), bits)


def _features(bits: int, swap: dict[int, int]):
    """Distinct buckets of each text, and those of its twin where it names a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.ALNUM, True)
                bucket = _bucket(block.word_hashes(), bits)
                own, twin = [], []
                for i in range(len(block)):
                    have = np.unique(bucket[block.first[i] : block.first[i + 1]])
                    named = [b for b in have.tolist() if b in swap]
                    own.append(have.astype(np.int32))
                    twin.append(np.unique(np.concatenate([np.setdiff1d(have, named), [swap[b] for b in named]])).astype(np.int32) if named else None)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(own, pa.list_(pa.int32())), pa.array(twin, pa.list_(pa.int32()))], names=["label", "own", "twin"])

    return run


def fit(rows: list[tuple[int, np.ndarray, np.ndarray | None]], bits: int = BITS, penalty: float = 1.0, rounds: int = 250, least: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient steps with momentum, on shared buckets."""
    size = 1 << bits
    if not rows:
        return np.zeros(size), -1.0
    pairs = [(y, own, twin) for y, own, twin in rows]
    seen = np.bincount(np.concatenate([own for _, own, _ in pairs]), minlength=size)
    label = np.array([y for y, _, _ in pairs], dtype=float)
    toxic = np.bincount(np.concatenate([own for y, own, _ in pairs if y] or [np.zeros(0, np.int64)]), minlength=size)
    base = (label.sum() + 1) / (len(label) + 2)
    # A bucket is worth a weight when its share of label 1 is not what chance gives.
    spread = np.sqrt(np.maximum(seen * base * (1 - base), 1e-9))
    use = (seen >= least) & (np.abs(toxic - seen * base) > 4 * spread)
    column = np.full(size, -1, dtype=np.int64)
    column[use] = np.arange(use.sum())

    def matrix(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        picked = [column[x][column[x] >= 0] for x in lists]
        return np.repeat(np.arange(len(lists)), [len(x) for x in picked]), np.concatenate([*picked, np.zeros(0, np.int64)]).astype(np.int64)

    twins = [(y, own, twin) for y, own, twin in pairs if twin is not None]
    r1, c1 = matrix([own for _, own, _ in pairs])
    r2, c2 = matrix([own for _, own, _ in twins])
    r3, c3 = matrix([twin for _, _, twin in twins])
    y3 = np.array([y for y, _, _ in twins], dtype=float)
    n, m, k = len(pairs), len(twins), int(use.sum())
    w, b, vw, vb = np.zeros(k), float(np.log(base / (1 - base))), np.zeros(k), 0.0
    balance = np.where(label > 0, 0.5 / base, 0.5 / (1 - base)) ** 0.5
    score = lambda r, c, count: b + np.bincount(r, w[c], minlength=count)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rate = np.full(k, 4.0) / np.maximum(np.bincount(c1, minlength=k) / n, 0.02)
    for _ in range(rounds):
        d1 = (sigmoid(score(r1, c1, n)) - label) * balance / n
        gw, gb = np.bincount(c1, d1[r1], minlength=k), d1.sum()
        if m:
            s3 = score(r3, c3, m)
            d3 = (sigmoid(s3) - y3) / n
            gap = penalty * (score(r2, c2, m) - s3) / n
            gw += np.bincount(c3, (d3 - gap)[r3], minlength=k) + np.bincount(c2, gap[r2], minlength=k)
            gb += d3.sum()
        vw, vb = 0.9 * vw - 0.1 * rate * (gw + 1e-4 * w), 0.9 * vb - 0.1 * gb
        w, b = w + vw, b + vb
    weights = np.zeros(size)
    weights[use] = w
    return weights, float(b)


def _score(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.ALNUM, True)
                bucket = _bucket(block.word_hashes(), bits)
                live = np.flatnonzero(weights[bucket])
                keys = np.unique((block.text_of_words()[live] << bits) | bucket[live])
                total = bias + np.bincount(keys >> bits, weights[keys & ((1 << bits) - 1)], minlength=len(block))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=["row", "score"])

    return run


def sampled(labels: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` labelled ids at most, the same ones in every run."""
    total = labels.count()
    if total <= max_rows:
        return labels
    share = int(0.97 * max_rows / total * (1 << 30))
    return labels.where(F.pmod(F.xxhash64(F.col("k_id"), F.lit("sample")), F.lit(1 << 30)) < share)


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", identity_sets: list[list[str]] | None = None, max_rows: int = MAX_ROWS, penalty: float = 1.0, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias; ``held_out`` is a condition on the id column of rows not to learn from."""
    swap: dict[int, int] = {}
    for terms in IDENTITY_SETS if identity_sets is None else identity_sets:
        own = word_buckets(terms, bits).tolist()
        swap |= dict(zip(own, own[1:] + own[:1], strict=True))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy(F.col(id_col).alias("k_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = docs.select(F.col(id_col).alias("t_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(sampled(known, max_rows)), F.col("t_id") == F.col("k_id")).select("label", "text")
    rows = joined.mapInArrow(_features(bits, swap), "label int, own array<int>, twin array<int>").toArrow()
    arrays = [None if not x.is_valid else np.asarray(x.values) for x in rows.column("twin")]
    return fit([(y, np.asarray(x.values), t) for y, x, t in zip(rows.column("label").to_pylist(), rows.column("own"), arrays, strict=True)], bits, penalty)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted``."""
    keep = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = packed.mapInArrow(_score(shared, bits), T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
    return out.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
