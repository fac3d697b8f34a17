"""Quality classifier from weak labels.

Eight overlapping heuristics vote bad, good or nothing on every document.  The votes of
the whole corpus are counted by pattern (at most ``3**8`` patterns, whatever the corpus),
and expectation-maximisation over the counts estimates how often each heuristic votes
each way in either class, and from that the posterior of each pattern.  Posteriors are
then the soft labels of a linear scorer over hashed word features, which decides; its
features are shares of a document's words, so it also judges what no heuristic covers.

The scorer is fitted on about ``max_rows`` documents at most, chosen by a hash of the id
(documented bound); votes, counts and scores cover every document.  No column but the
text is an input.

Defined results: null, empty and wordless texts get no vote and the score of the bias;
they, and any text of fewer than ``MIN_WORDS`` words, are kept, as there is too little to
judge; repeated rows each get the same row; rows without id are scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

LABELLERS = ["symbols", "shouting", "repetition", "variety", "lines", "word_length", "punctuation", "letters"]
BAD, SILENT, GOOD = 0, 1, 2
MIN_WORDS = 8
#: Below this a text is rejected only where scorer and posterior agree.
SHORT_WORDS = 20
BITS = 15
MAX_ROWS = 4_000
#: Added to a text's number of words, so that the few words of a short text decide less.
SHRINK = 12


def _flags(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL = _flags("#$%&*|~^<>{}[]\\=+@_")
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_HEAD = np.ones(256, dtype=bool)
_HEAD[0x80:0xC0] = False  # bytes that begin a character
_STOP = _flags(".,;:?")


def _per_text(block: W.Block, table: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[block.data])])
    return total[block.offsets[1:]] - total[block.offsets[:-1]]


def _per_text_words(block: W.Block, flag: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[block.first[1:]] - total[block.first[:-1]]


def votes(block: W.Block, hashes: np.ndarray) -> np.ndarray:
    """One row of votes for each text."""
    n = block.n_words
    some = np.maximum(n, 1)
    owner = block.text_of_words()
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])
    marked = _per_text_words(block, symbols[block.ends] > symbols[block.starts]) / some
    last = block.data[block.ends - 1]
    stops = _per_text_words(block, _STOP[last]) / some
    exclaim = _per_text_words(block, last == 0x21) / some
    letters = _per_text(block, _LETTER)
    upper = _per_text(block, _UPPER) / np.maximum(letters, 1)
    heads = _per_text(block, _HEAD & W.NOT_SPACE)
    length = heads / some
    solid = _per_text(block, W.NOT_SPACE)
    share = letters / np.maximum(solid, 1)
    repeats = _per_text_words(block, same) / some
    variety, lines = np.ones(len(block)), np.zeros(len(block))
    for i in range(len(block)):
        own = hashes[block.first[i] : block.first[i + 1]]
        if len(own):
            variety[i] = len(np.unique(own)) / len(own)
        text = block.raw[block.offsets[i] : block.offsets[i + 1]].tobytes().split(b"\n")
        full = [x for x in text if x.strip()]
        lines[i] = 1 - len(set(full)) / len(full) if full else 0
    out = np.full((len(block), len(LABELLERS)), SILENT, dtype=np.int64)
    enough = n >= MIN_WORDS

    def cast(k: int, bad: np.ndarray, good: np.ndarray | None = None) -> None:
        out[enough & bad, k] = BAD
        if good is not None:
            out[enough & good & ~bad, k] = GOOD

    cast(0, marked > 0.1, marked == 0)
    cast(1, (exclaim > 0.1) | (upper > 0.3))
    cast(2, repeats > 0.12, repeats < 0.03)
    cast(3, (variety < 0.4) & (n >= 50), (variety > 0.55) & (variety < 0.97))
    cast(4, lines > 0.3)
    cast(5, (length > 6.3) | (length < 3.2), (length > 4.3) & (length < 5.9))
    cast(6, (stops < 0.02) & (n >= 40), (stops > 0.04) & (stops < 0.5))
    cast(7, share < 0.86, share > 0.93)
    return out


def _codes(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def word_features(block: W.Block, hashes: np.ndarray) -> np.ndarray:
    """Four hashed buckets for each word: its shape, shape pair, likeness to the word before, itself."""
    first, last = block.data[block.starts].astype(np.uint64), block.data[block.ends - 1].astype(np.uint64)
    kind = np.where(_UPPER[block.data[block.starts]], 1, np.where(_LETTER[block.data[block.starts]], 2, 3)).astype(np.uint64)
    upper_last = _UPPER[block.data[block.ends - 1]].astype(np.uint64)
    ending = np.where(_LETTER[block.data[block.ends - 1]], upper_last, last)
    size = np.minimum((block.ends - block.starts) // 3, 5).astype(np.uint64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[block.data])])
    shape = ((ending * 4 + kind) * 8 + size) * 2 + (symbols[block.ends] > symbols[block.starts]).astype(np.uint64)
    before = np.zeros_like(shape)
    before[1:] = shape[:-1]
    same = np.zeros(len(hashes), dtype=np.uint64)
    same[1:] = hashes[1:] == hashes[:-1]
    parts = [shape, before * np.uint64(1 << 20) + shape, same, hashes + first * np.uint64(0)]
    return np.stack([W.mix(p + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BITS) for k, p in enumerate(parts)]).astype(np.int64)


def _blocks(batch: pa.RecordBatch):
    for part in W.blocks(batch, "text"):
        block = W.Block(part.column("text"), W.NOT_SPACE, False)
        yield part, block, block.word_hashes()


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, block, hashes in _blocks(batch):
            yield pa.RecordBatch.from_arrays([pa.array(_codes(votes(block, hashes)))], names=["code"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, block, hashes in _blocks(batch):
            features = word_features(block, hashes)
            bucket, share = [], []
            for i in range(len(block)):
                own, count = np.unique(features[:, block.first[i] : block.first[i + 1]], return_counts=True)
                bucket.append(own.astype(np.int32))
                share.append((count / (SHRINK + block.n_words[i])).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(_codes(votes(block, hashes))), pa.array(bucket, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["code", "bucket", "share"])


def expectation_maximisation(counts: dict[int, int], rounds: int = 300) -> tuple[np.ndarray, dict[int, float]]:
    """``theta[class, labeller, vote]`` (class 1 is good) and the posterior of good for each pattern."""
    codes = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[c] for c in codes.tolist()], dtype=float)
    v = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    one_hot = v[:, :, None] == np.arange(3)
    bad, good = (v == BAD).sum(1), (v == GOOD).sum(1)
    post = np.where(bad >= 1, 0.2, np.where(good >= 1, 0.9, 0.5))
    theta = np.zeros((2, len(LABELLERS), 3))
    for _ in range(rounds):
        for y, share in ((0, 1 - post), (1, post)):
            mass = (one_hot * (weight * share)[:, None, None]).sum(0) + 0.5
            theta[y] = mass / mass.sum(1, keepdims=True)
        prior = ((weight * post).sum() + 1) / (weight.sum() + 2)
        ll = [np.log(p) + (np.log(theta[y])[None] * one_hot).sum((1, 2)) for y, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return theta, dict(zip(codes.tolist(), post.tolist(), strict=True))


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]], rounds: int = 200) -> tuple[np.ndarray, float]:
    """Adagrad on the logistic loss of soft labels."""
    size = 1 << BITS
    if not rows:
        return np.zeros(size), 2.0
    y = np.array([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column, value = np.concatenate([r[1] for r in rows]).astype(np.int64), np.concatenate([r[2] for r in rows]).astype(float)
    rate = np.clip(y.mean(), 0.02, 0.98)
    weight = y * 0.5 / rate + (1 - y) * 0.5 / (1 - rate)
    w, b, gw2, gb2 = np.zeros(size), 0.0, np.full(size, 1e-6), 1e-6
    for _ in range(rounds):
        z = b + np.bincount(owner, w[column] * value, minlength=len(rows))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(rows)
        gw, gb = np.bincount(column, d[owner] * value, minlength=size) + 1e-6 * w, d.sum()
        gw2 += gw * gw
        gb2 += gb * gb
        w -= 0.5 * gw / np.sqrt(gw2)
        b -= 0.5 * gb / np.sqrt(gb2)
    return w, float(b)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            for part, block, hashes in _blocks(batch):
                sums = np.bincount(block.text_of_words(), weights[word_features(block, hashes)].sum(0), minlength=len(block))
                z = bias + sums / (SHRINK + block.n_words)
                names = [*part.schema.names[:-1], "n_words", "code", "score"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(block.n_words.astype(np.int64)), pa.array(_codes(votes(block, hashes))), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=names)

    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` with ``quality_votes`` (bad, good), ``posterior``, ``score`` and ``kept``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    spark = docs.sparkSession
    counts = {r["code"]: r["count"] for r in docs.select(text).mapInArrow(_vote, "code long").groupBy("code").count().collect()}
    _, post = expectation_maximisation(counts)
    share = min(1.0, 0.95 * max_rows / max(1, sum(counts.values())))
    picked = F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.where(picked).select(text).mapInArrow(_sample, "code long, bucket array<int>, share array<float>").toArrow()
    model = fit([(post[c.as_py()], np.asarray(b.values), np.asarray(s.values)) for c, b, s in zip(*[rows.column(k) for k in ("code", "bucket", "share")], strict=True)])
    keep = [c for c in docs.columns if c not in ("posterior", "score", "kept")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("code", T.LongType()), T.StructField("score", T.DoubleType())]
    scored = packed.mapInArrow(_score(spark.sparkContext.broadcast(model)), T.StructType([packed.schema["row"], *fields]))
    known = F.create_map(*[F.lit(x) for c, p in sorted(post.items()) for x in (c, float(p))]) if post else None
    posterior = known[F.col("code")] if known is not None else F.lit(None).cast("double")
    short = (F.col("n_words") < MIN_WORDS) | ((F.col("n_words") < SHORT_WORDS) & (F.coalesce(posterior, F.lit(1.0)) >= 0.5))
    kept = (F.col("score") >= threshold) | short
    return scored.select("row.*", posterior.alias("posterior"), "score", kept.alias("kept"))
