"""Corpus counts, base scores and attention scores of texts.

``word_rows`` makes one row per distinct word of a run of texts: its training count and
packed postings (text number and frequency), so a word of a hot text costs a few bytes,
not a row.  Summed, the rows give the count of every word of the corpus; joined back on
the word, they give each text the counts of its words.  Words are keyed by 64-bit hashes.

The text's score is that of an even mixture of the attention model and the smoothed
word counts: ``log10((10**attention + 10**base) / 2)``.

Defined results: a null text is empty and holds one token, its end; rows without id are
scored, never learned from; repeated rows are learned from as often as they stand there
and each get the same row; with no training text every score is that of equal shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention_lm as A
from . import words as W
from .jaccard_join import stored

RUN_WORDS, RUN_TEXTS = 1_500_000, 8192
NO_ID = -(1 << 63)
_ROWS = "h long, word binary, c long, run long, posts binary, ids binary, crcs binary"
_MOST = 255
HELD_TEXTS = 2_000_000
ROUNDS, EPOCHS, TASK_IDS = 4, 6, 3_600_000


class _Run:
    """Words of some texts, until written."""

    def __init__(self):
        self.hashes, self.texts, self.train, self.ids, self.crcs = [], [], [], [], []
        self.words: dict[int, bytes] = {}
        self.n_words = self.n_texts = 0

    def add(self, part: pa.RecordBatch, block: W.Block) -> None:
        hashes = block.word_hashes()
        unique, at = np.unique(hashes, return_index=True)
        for h, i in zip(unique.tolist(), at.tolist(), strict=True):
            if h not in self.words:
                self.words[h] = block.word(i)
        self.hashes.append(hashes)
        self.texts.append(block.text_of_words() + self.n_texts)
        self.train.append(np.asarray(part.column("train")).astype(bool))
        self.ids.append(np.asarray(part.column("id")))
        self.crcs.append(np.asarray(part.column("crc")))
        self.n_words += len(hashes)
        self.n_texts += len(block)

    def rows(self, run: int) -> pa.RecordBatch:
        hashes, texts, train = (np.concatenate(x) for x in (self.hashes, self.texts, self.train))
        order = np.argsort(hashes, kind="stable")
        h, t = hashes[order], texts[order]
        new_word = np.ones(len(h), dtype=bool)
        new_word[1:] = h[1:] != h[:-1]
        new_post = new_word.copy()
        new_post[1:] |= t[1:] != t[:-1]
        at_word, at_post = np.flatnonzero(new_word), np.flatnonzero(new_post)
        times = np.diff(np.append(at_post, len(h)))
        learned = np.add.reduceat(train[t].astype(np.int64), at_word) if len(h) else np.zeros(0, np.int64)
        pieces = -(-times // _MOST)  # a higher frequency takes several postings
        owner = np.repeat(np.arange(len(times)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        part = np.minimum(times[owner] - nth * _MOST, _MOST)
        posts = (t[at_post][owner].astype(np.uint32) << np.uint32(8)) | part.astype(np.uint32)
        edge = np.searchsorted(at_post[owner], at_word)
        offsets = (np.append(edge, len(posts)) * 4).astype(np.int32)
        keys = h[at_word]
        n, none = len(keys), b""
        packed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(posts)])
        columns = [pa.array(W.signed(keys)), pa.array([self.words[k] for k in keys.tolist()], pa.binary()), pa.array(learned), pa.array(np.full(n, run)), packed, pa.array([none] * n, pa.binary()), pa.array([none] * n, pa.binary())]
        names = ["h", "word", "c", "run", "posts", "ids", "crcs"]
        # The last row names the run's texts.
        last = [None, None, None, run, None, np.concatenate(self.ids).tobytes(), np.concatenate(self.crcs).tobytes()]
        tail = [pa.array([v], c.type) for v, c in zip(last, columns, strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(columns, tail, strict=True)], names=names)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, _Run()
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_TEXTS // 4):
            for part in W.blocks(batch.slice(at, RUN_TEXTS // 4), "text"):
                held.add(part, W.Block(part.column("text"), W.NOT_SPACE, True))
                if held.n_words >= RUN_WORDS or held.n_texts >= RUN_TEXTS:
                    yield held.rows(number)
                    number, held = number + 1, _Run()
    if held.n_texts:
        yield held.rows(number)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of log counts, and of known words, of each text of each run, from a partition's words.

    What is held is one entry per text met, written out when ``HELD_TEXTS`` are held.
    """
    width = 2 * RUN_TEXTS
    place: dict[int, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, code = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return keys, np.bincount(code, np.concatenate([h[1] for h in held])), np.bincount(code, np.concatenate([h[2] for h in held]))

    def out() -> pa.RecordBatch:
        keys, logs, known = summed()
        runs = np.array(list(place), dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(runs[keys // width]), pa.array(keys % width), pa.array(logs), pa.array(known.astype(np.int64))], names=["run", "nth", "logs", "known"])

    for batch in batches:
        runs = np.asarray(batch.column("run"))
        for r in np.unique(runs).tolist():
            place.setdefault(r, len(place))
        posts = batch.column("posts")
        sizes = np.asarray(pa.compute.binary_length(posts)).astype(np.int64) // 4
        flat = np.frombuffer(b"".join(posts.to_pylist()), dtype=np.uint32)
        owner = np.array([place[r] for r in runs.tolist()], dtype=np.int64)
        c = np.asarray(batch.column("c"))
        keys, code = np.unique(np.repeat(owner, sizes) * width + (flat >> np.uint32(8)).astype(np.int64), return_inverse=True)
        times = (flat & np.uint32(255)).astype(np.float64)
        held.append((keys, np.bincount(code, np.repeat(np.log10(c + 1.0), sizes) * times), np.bincount(code, np.repeat(c > 0, sizes) * times)))
        size += len(keys)
        if size > HELD_TEXTS:
            held = [summed()]
            size = len(held[0][0])
            if size > HELD_TEXTS // 2:
                yield out()
                place, held, size = {}, [], 0
    if held:
        yield out()


def _id_counts(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, total = A.WordIds(path), np.zeros(size)
        for batch in batches:
            flat, begin = ids_of.encode(batch.column("word").to_pylist())
            np.add.at(total, flat, np.repeat(np.asarray(batch.column("c")).astype(float), np.diff(np.append(begin, len(flat)))))
        yield from _sparse(total)

    return run


def _sparse(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 18):
        own = at[k : k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own].astype(np.float64))], names=["k", "n"])


def _id_runs(path: str, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the texts of a partition, block by block, and the ids before them."""
    ids_of = A.WordIds(path)
    for batch in batches:
        for part in W.blocks(batch, "text"):
            block = W.Block(part.column("text"), W.NOT_SPACE, True)
            ids, _ = ids_of.of_block(block, block.word_hashes(), end)
            yield ids, np.concatenate([[end], ids[:-1]])[: len(ids)]


def _neighbours(path: str, shared, end: int):
    """Counts of (id, spot before it) and (id, spot after it) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = shared.value
        total = np.zeros(len(spot) * 2 * A.NEIGHBOURS, dtype=np.int32)
        for ids, before in _id_runs(path, end, batches):
            np.add.at(total, ids * (2 * A.NEIGHBOURS) + spot[before], 1)
            np.add.at(total, before * (2 * A.NEIGHBOURS) + A.NEIGHBOURS + spot[ids], 1)
        yield from _sparse(total)

    return run


def _learn(path: str, shared, end: int):
    """Gradient steps on all texts of a partition, and counts of their ids by the class before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, class_of = shared.value
        one, size = A.Pass(learner, class_of, end), len(class_of)
        total = np.zeros(A.CLASSES * size, dtype=np.int32)
        for ids, before in _id_runs(path, end, batches):
            np.add.at(total, class_of[before] * size + ids, 1)
            one.add(ids)
        for counts in _sparse(total):
            yield pa.RecordBatch.from_arrays([*counts.columns, pa.nulls(counts.num_rows, pa.list_(pa.float32()))], names=["k", "n", "move"])
        at, n, move = one.moves()
        both = np.hstack([move, one.sums_moves(at, n)]).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * both.shape[1]), pa.array(both.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), lists], names=["k", "n", "move"])

    return run


def _scores(path: str, shared, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids_of = shared.value, A.WordIds(path)
        for batch in batches:
            for part in W.blocks(batch, "text", 1 << 19):
                block = W.Block(part.column("text"), W.NOT_SPACE, True)
                ids, starts = ids_of.of_block(block, block.word_hashes(), end)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("crc"), pa.array(block.n_words.astype(np.int64) + 1), pa.array(model.score(ids, starts, end))], names=["id", "crc", "n_tokens", "attention"])

    return run


def _dense(counts: pa.Table, size: int, dtype=float) -> np.ndarray:
    out = np.zeros(size, dtype)
    out[np.asarray(counts.column("k")).astype(np.int64)] = np.asarray(counts.column("n"))
    return out


def score_texts(docs: DataFrame, learn: Column, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", max_ids: int | None = None) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` per row; ``learn`` is a condition on ``docs``.

    ``max_ids`` has no effect: nothing is sampled.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(text).alias("crc"), text.alias("text"), (F.coalesce(learn, F.lit(False)) & F.col(id_col).isNotNull()).alias("train"))
    words = stored(rows.mapInArrow(_word_rows, _ROWS), "words")
    counts = stored(words.where("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    ends = rows.where("train").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, kinds = total.n + ends, total.v + (ends > 0)

    # The model: all training texts give the classes, then the weights and the counts by class.
    size = end + 1
    texts = rows.where("train").select("text")
    kinds_of = words.where("c > 0").select("word", "c").mapInArrow(_id_counts(tokenizer, size), "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    often = _dense(kinds_of, size)
    often[end] = ends
    spot = spark.sparkContext.broadcast(A.spots(often))
    near = texts.mapInArrow(_neighbours(tokenizer, spot, end), "k long, n double").groupBy("k").agg(F.sum("n").alias("n"))
    near = near.select(F.col("k").cast("int").alias("k"), F.col("n").cast("float").alias("n")).toArrow()
    near = _dense(near, size * 2 * A.NEIGHBOURS, np.float32).reshape(size, -1)
    class_of, first = A.classes(often, near), A.Learner(A.first_weights(often, near))
    del near
    # Many texts are learned from in one epoch, cut into rounds that each take a share of them and
    # average; few in several epochs, each a round.  A task gets enough ids to learn from.
    n_ids = max(1, int(often.sum()))
    shares = ROUNDS if n_ids >= TASK_IDS else 1
    epochs = min(EPOCHS, -(-TASK_IDS // n_ids))
    turn = F.pmod(F.xxhash64("id", "crc", F.lit("lm")), F.lit(shares))
    table = np.zeros(A.CLASSES * size)
    for k in range(shares * epochs):
        shared = spark.sparkContext.broadcast((first, class_of))
        own = rows.where(F.col("train") & (turn == k % shares)).select("text").coalesce(max(1, n_ids // TASK_IDS))
        learned = stored(own.mapInArrow(_learn(tokenizer, shared, end), "k long, n double, move array<float>"), "learned")
        if k < shares:  # later epochs count the same ids
            table += _dense(learned.where("move IS NULL").groupBy("k").agg(F.sum("n").alias("n")).toArrow(), A.CLASSES * size)
        moves = learned.where("move IS NOT NULL").groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("move")[i]).alias(f"m{i}") for i in range(2 * A.WIDTH)]).toArrow()
        at, n = np.asarray(moves.column("k")).astype(np.int64), np.asarray(moves.column("n"))
        total_moves = np.stack([np.asarray(moves.column(f"m{i}")) for i in range(2 * A.WIDTH)], axis=1)
        first = A.Learner(A.moved(first.w, at, n, total_moves[:, : A.WIDTH]), A.moved(A.Weights(*first.sums), at, n, total_moves[:, A.WIDTH :]).all())
        shared.unpersist()
    weights, table = first.w, table.reshape(-1, size)
    model = spark.sparkContext.broadcast(A.Model(weights, class_of, A.within_class(table, class_of)))
    attention = rows.select("id", "crc", "text").mapInArrow(_scores(tokenizer, model, end), "id long, crc long, n_tokens long, attention double")

    # Base: counts go back to the words of each run, and sums to its texts.
    known = words.where("h IS NOT NULL").select("h", "run", "posts").join(counts.select(F.bitwise_not("h").alias("ch"), "c"), F.bitwise_not("h") == F.col("ch"))
    sums = known.select("run", "posts", "c").mapInArrow(_add_up, "run long, nth long, logs double, known long").groupBy("run", "nth").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))
    named = words.where("h IS NULL").select("run", "ids", "crcs").mapInArrow(_texts, "run long, nth long, id long, crc long")
    base = named.join(sums, ["run", "nth"]).groupBy(F.col("id").alias("b_id"), F.col("crc").alias("b_crc")).agg(F.first("logs").alias("logs"), F.first("known").alias("known"))
    out = attention.join(base, (F.col("id") == F.col("b_id")) & (F.col("crc") == F.col("b_crc")), "left")
    logs = F.coalesce("logs", F.lit(0.0)) + float(np.log10(ends + 1.0)) - F.col("n_tokens") * float(np.log10(n_train + kinds + 1.0))
    both = F.greatest("base_score", "attention") + F.log10(F.lit(0.5) + F.lit(0.5) * F.pow(F.lit(10.0), F.least("base_score", "attention") - F.greatest("base_score", "attention")))
    out = out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_tokens", (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), logs.alias("base_score"), "attention")
    return out.withColumn("score", both)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, ids, crcs in zip(batch.column("run").to_pylist(), batch.column("ids").to_pylist(), batch.column("crcs").to_pylist(), strict=True):
            own = np.frombuffer(ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), run)), pa.array(np.arange(len(own))), pa.array(own), pa.array(np.frombuffer(crcs, dtype=np.int64))], names=["run", "nth", "id", "crc"])
