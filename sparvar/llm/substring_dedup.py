"""Substring dedup by level-wise doubling.

Level 0 looks at windows of half the wanted length.  Every wanted window holds a run of
consecutive half windows, and equal wanted windows hold equal runs, so the smallest hash
of the run (its anchor) stands for it: about one anchor per 13 words is shuffled instead
of one window per word.  Only windows whose anchor occurs in two documents are extended
to the full length, and only those are shuffled one by one.  ``longest_repeats`` goes on
doubling until no candidate survives.

Defined results: a null text has no words; a document shorter than the window loses
nothing; a row without id is never a source and loses nothing; rows that share an id
never remove each other's words, and each is judged by its own text.  Windows are
compared by 64-bit hashes of whole word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W

#: Stands for a null id, and is given back as null.
NO_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and checksum, neither of them null, so that every join of the texts reads one exchange."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(text).alias("crc"), text.alias("text"))


def _anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive hashes, by doubling."""
    out, width = hashes, 1
    while width * 2 <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = span - width
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _block_windows(block: W.Block, window: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions with a whole window, their anchors, and the running sum of hashes."""
    sums = W.WORDS.sums(block.word_hashes())
    if len(sums) <= window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), sums
    at = np.flatnonzero(block.whole_windows(window))
    return at, _anchors(W.WORDS.windows(sums, half), window - half + 1)[at], sums


def _emit_anchors(window: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.NOT_SPACE, False)
                at, anchor, _ = _block_windows(block, window, half)
                owner = block.text_of_words()[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                rows = pa.array(owner[new])
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(anchor[new])), part.column("id").take(rows), part.column("crc").take(rows)], names=["h", "id", "crc"])

    return run


def _emit_windows(window: int, half: int):
    """Windows whose anchor is repeated; ``first`` marks those that none can precede."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.NOT_SPACE, False)
                at, anchor, sums = _block_windows(block, window, half)
                owner = block.text_of_words()[at]
                flag = np.zeros(len(at), dtype=np.int8)
                edge = np.searchsorted(owner, np.arange(len(block) + 1))
                for i, pair in enumerate(zip(part.column("repeated"), part.column("later"), strict=True)):
                    for mark, known in enumerate(pair, 1):
                        values = np.asarray(known.values).view(np.uint64)
                        flag[edge[i] : edge[i + 1]][np.isin(anchor[edge[i] : edge[i + 1]], values)] = mark
                live = flag > 0
                at, rows = at[live], pa.array(owner[live])
                h = W.WORDS.spans(sums, at, at + window)
                crc = np.asarray(part.column("crc")).astype(np.int64)[owner[live]]
                key = (crc << np.int64(32)) | (at - block.first[owner[live]])
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(h)), part.column("id").take(rows), pa.array(key), pa.array(flag[live] == 2)], names=["h", "id", "key", "later"])

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """Hashes that occur in two documents, with the smallest; partial sums go first.

    The hash is given as its complement: a join on it then deals both sides out anew,
    which lets adaptive execution split the rows of a hash that very many windows share.
    """
    return rows.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.bitwise_not("h").alias("rh"), "least")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``(id, crc, at)``: word positions where a window starts that also starts in a smaller id."""
    half = (window + 1) // 2
    keyed = _keyed(docs, id_col, text_col)
    anchors = keyed.where(F.col("id") != NO_ID).mapInArrow(_emit_anchors(window, half), "h long, id long, crc long")
    known = (
        anchors.join(_repeated(anchors), F.bitwise_not("h") == F.col("rh"))
        .groupBy(F.col("id").alias("k_id"), F.col("crc").alias("k_crc"))
        .agg(F.collect_set("h").alias("repeated"), F.collect_set(F.when(F.col("id") > F.col("least"), F.col("h"))).alias("later"))
    )
    live = keyed.join(known, (F.col("id") == F.col("k_id")) & (F.col("crc") == F.col("k_crc"))).select("id", "crc", "text", "repeated", "later")
    full = live.mapInArrow(_emit_windows(window, half), "h long, id long, key long, later boolean")
    return full.where("later").join(_repeated(full), (F.bitwise_not("h") == F.col("rh")) & (F.col("id") > F.col("least"))).select(
        "id", F.shiftrightunsigned("key", 32).alias("crc"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")
    )


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.NOT_SPACE, False)
                gone = np.zeros(len(block.starts), dtype=bool)
                for i, at in enumerate(part.column("at")):
                    if at.is_valid:
                        low, high = block.first[i], block.first[i + 1]
                        gone[low:high] = W.covered(int(high - low), np.asarray(at.values).astype(np.int64), window)
                total = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(block.n_words.astype(np.int64)), pa.array((total[block.first[1:]] - total[block.first[:-1]]).astype(np.int64)), W.join_words(block, ~gone)],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` per row of ``docs``; ``kept`` has its words joined by one space."""
    hits = repeated_windows(docs, id_col, text_col, window).groupBy(F.col("id").alias("k_id"), F.col("crc").alias("k_crc")).agg(F.collect_list("at").alias("at"))
    keyed = _keyed(docs, id_col, text_col)
    marked = keyed.join(hits, (F.col("id") == F.col("k_id")) & (F.col("crc") == F.col("k_crc")), "left").select("id", "text", "at")
    out = marked.mapInArrow(_cut(window), "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept")


def _extend(length: int, step: int | None):
    """Windows of ``length`` whose two halves survive (``step`` words apart), or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.NOT_SPACE, False)
                sums = W.WORDS.sums(block.word_hashes())
                ok = block.whole_windows(length)
                if step is not None:
                    alive = np.zeros(len(block.starts), dtype=bool)
                    for i, at in enumerate(part.column("at")):
                        alive[block.first[i] + np.asarray(at.values).astype(np.int64)] = True
                    ok &= alive[: len(ok)] & alive[step : step + len(ok)]
                at = np.flatnonzero(ok)
                owner = block.text_of_words()[at]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(W.WORDS.spans(sums, at, at + length))), part.column("id").take(rows), part.column("crc").take(rows), pa.array(at - block.first[owner])],
                    names=["h", "id", "crc", "at"],
                )

    return run


def longest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", start: int = 25) -> DataFrame:
    """Per document the largest ``start * 2**k`` at which a window of it is repeated in another.

    Each level extends only what the level before found repeated, and is written to the
    shared folder; the loop ends when a level leaves nothing.
    """
    keyed = _keyed(docs, id_col, text_col).where(F.col("id") != NO_ID)
    schema, length, found = "h long, id long, crc long, at long", start, None
    rows = keyed.mapInArrow(_extend(length, None), schema)
    while True:
        alive = cut_lineage(rows.join(_repeated(rows), F.bitwise_not("h") == F.col("rh"), "left_semi").select("id", "crc", "at"))
        level = alive.select("id").distinct().withColumn("longest", F.lit(length))
        if alive.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        spots = alive.groupBy(F.col("id").alias("k_id"), F.col("crc").alias("k_crc")).agg(F.collect_set("at").alias("at"))
        live = keyed.join(spots, (F.col("id") == F.col("k_id")) & (F.col("crc") == F.col("k_crc"))).select("id", "crc", "text", "at")
        rows = live.mapInArrow(_extend(2 * length, length), schema)
        length *= 2
    out = (found if found is not None else level).groupBy("id").agg(F.max("longest").alias("longest"))
    return out.withColumnRenamed("id", id_col)
