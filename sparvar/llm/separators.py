"""Token counts by scanning flat token files for the end-of-document id.

A token file is a run of little-endian token ids without index: document after document,
each closed by the separator id.  It is read in blocks of fixed size whose borders fall
anywhere.  Each block is searched for the separator by one vectorised comparison; the
pieces of documents that cross borders are stitched by a prefix scan over one small row
per block: a running maximum finds the last block with a separator, and a running sum
gives the tokens that hang over from it.  The scan runs first within groups of
``GROUP_BLOCKS`` blocks and then over one row per group, so a file that holds a third of
all tokens is not one task's work.

``write_flat`` makes such a file set from texts, as a table of blocks (file, block,
tokens) in the folder given; ``read_bins`` reads raw files as the same blocks, by byte ranges.

Defined results: a null or empty text is a document of no tokens; a tail without a
separator is an open document, reported with ``closed`` false; an empty file has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .dac import _place

BLOCK_TOKENS = 1 << 16
GROUP_BLOCKS = 256
_BLOCKS = "file long, block long, tokens binary, closes array<long>"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Ids:
    """Ids of texts; pieces of text that recur are looked up and not merged again."""

    def __init__(self, path: str):
        import regex

        import public_tokenizers

        self.encoding = _tokenizer(path)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        known, encode = self.known, self.encoding.encode_ordinary
        out: list[int] = []
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) > 150_000:
                    known.clear()
                ids = known[piece] = encode(piece)
            out += ids
        return out


def _write(tokenizer: str, separator: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, held, size = TaskContext.get().partitionId(), 0, [], 0
        ids, closes = _Ids(tokenizer), []

        def full(data: np.ndarray, names: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data.astype("<u2").tobytes()], pa.binary()), pa.array([names], pa.list_(pa.int64()))],
                names=["file", "block", "tokens", "closes"],
            )

        ends: list[tuple[int, int | None]] = []
        for batch in batches:
            for part in W.blocks(batch, "text"):
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = ids.encode(text)
                    own.append(separator)
                    held.append(np.array(own, dtype=np.uint16))
                    size += len(own)
                    ends.append((block * block_tokens + size - 1, doc))
                    if size >= block_tokens:
                        data = np.concatenate(held)
                        while len(data) >= block_tokens:
                            closes = [d for e, d in ends if e < (block + 1) * block_tokens]
                            ends = ends[len(closes) :]
                            yield full(data[:block_tokens], closes)
                            data, block = data[block_tokens:], block + 1
                        held, size = [data], len(data)
        if size:
            yield full(np.concatenate(held), [d for _, d in ends])

    return run


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """One file per task, cut into blocks.  ``closes`` names, in order, the documents whose
    separator stands in the block; it says nothing of where they begin or end."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows.mapInArrow(_write(tokenizer, separator, block_tokens), _BLOCKS).write.option("compression", "zstd").parquet(folder)


def _cut(item: int, block_tokens: int, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = item * block_tokens
        for batch in batches:
            for path, at, length in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length")), strict=True):
                if length % item:
                    raise ValueError(f"{path}: {length} bytes are no whole number of ids")
                place, name = _place(path)
                with place.open_input_file(name) as f:
                    for k in range(at, min(at + run_bytes, length), step):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k // step], pa.int64()), pa.array([f.read_at(min(step, length - k), k)], pa.binary())], names=["file", "block", "tokens"])

    return run


def read_bins(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, run_blocks: int = 256) -> DataFrame:
    """Blocks of raw token files of any size.

    Files are listed with their lengths only and dealt out in runs of ``run_blocks`` blocks;
    a task reads the bytes of its runs, so one large file spreads over tasks.  An empty file
    has no blocks.
    """
    item = np.dtype(dtype).itemsize
    step = item * block_tokens * run_blocks
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.sum(F.ceil(F.col("length") / step)).alias("n")).first()["n"] or 1
    runs = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    return runs.repartition(min(total, 20_000)).mapInArrow(_cut(item, block_tokens, step), "file string, block long, tokens binary")


def _search(separator: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, tails, sizes = [], [], []
            for value in batch.column("tokens"):
                ids = np.frombuffer(value.as_buffer(), dtype=dtype)
                at = np.flatnonzero(ids == separator)
                counts.append(np.diff(at, prepend=-1) - 1)
                tails.append(len(ids) - 1 - (int(at[-1]) if len(at) else -1))
                sizes.append(len(ids))
            new = [pa.array(counts, pa.list_(pa.int64())), pa.array(tails, pa.int64()), pa.array(sizes, pa.int64())]
            keep = [n for n in batch.schema.names if n != "tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *new], names=[*keep, "counts", "tail", "size"])

    return run


def count_tokens(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """``(file, block, nth, doc, n_tokens, closed)``: a row per document, in the block that closes it.

    ``doc`` is null where the blocks carry no names; open tails have ``closed`` false.
    """
    named = "closes" in blocks.columns
    file = blocks.schema["file"].dataType.simpleString()
    schema = f"file {file}, block long, " + ("closes array<long>, " if named else "") + "counts array<long>, tail long, size long"
    found = blocks.select("file", "block", "tokens", *(["closes"] if named else [])).mapInArrow(_search(separator, dtype), schema)
    found = found.withColumn("part", F.floor(F.col("block") / GROUP_BLOCKS))
    before = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Tokens seen so far less those up to the last separator: what hangs over into a block.
    last = F.max(F.when(F.size("counts") > 0, F.struct(F.col("block"), F.col("reach") - F.col("tail"))))
    within = found.withColumn("reach", F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    within = within.withColumn("cut", last.over(before)["col2"]).withColumn("sum", F.coalesce(F.sum("size").over(before), F.lit(0)))
    groups = within.groupBy("file", "part").agg(F.sum("size").alias("g_size"), last.alias("g_last"), F.sum(F.size("counts")).alias("g_n"))
    order = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("g_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    groups = groups.withColumn("g_cut", F.when(F.col("g_n") > 0, F.struct(F.col("part").alias("p"), (total - F.col("g_size") + F.col("g_last")["col2"]).alias("c"))))
    groups = groups.withColumn("g_sum", F.coalesce(F.sum("g_size").over(order), F.lit(0)))
    groups = groups.withColumn("g_carry", F.col("g_sum") - F.coalesce(F.max("g_cut").over(order)["c"], F.lit(0)))
    joined = within.join(groups.select("file", "part", "g_carry"), ["file", "part"])
    carry = F.when(F.col("cut").isNotNull(), F.col("sum") - F.col("cut")).otherwise(F.col("sum") + F.col("g_carry"))
    named_docs = F.col("closes") if named else F.transform("counts", lambda x: F.lit(None).cast("long"))
    closed = joined.select("file", "block", carry.alias("carry"), F.posexplode(F.arrays_zip(F.col("counts"), named_docs.alias("closes"))).alias("nth", "x"))
    closed = closed.select(
        "file", "block", "nth", F.col("x.closes").alias("doc"), (F.col("x.counts") + F.when(F.col("nth") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed")
    )
    ends = joined.groupBy("file").agg(F.max(F.struct("block", F.when(F.size("counts") > 0, F.col("tail")).otherwise(F.col("size") + carry).alias("open"))).alias("e"))
    opened = ends.where("e.open > 0").select("file", F.col("e.block").alias("block"), F.lit(None).cast("int").alias("nth"), F.lit(None).cast("long").alias("doc"), F.col("e.open").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(opened)
