"""SentencePiece encoding through a table of distinct chunks.

No piece of a vocabulary that splits at white space holds a marker after another
character, so merges never cross the start of a marked word, and none crosses a newline
(a byte token).  A text is therefore cut at those places; each block segments every
distinct chunk once and joins the ids back by the position of its chunks.  A table kept
for the whole task makes a chunk's segmentation shared by all blocks of the task; when
it has ``TABLE_CHUNKS`` entries it starts anew, which changes no result.  A corpus-wide
table would need every (block, chunk) pair in two shuffles and the texts in a third.

``check_model`` refuses a model for which the cut is not exact.  Defined results: a null
or empty text has no ids and decodes to the empty text; repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

TABLE_CHUNKS = 150_000
MARK = "▁"
_CHUNK = re.compile("[ ▁]+[^ ▁\n]*|\n|[^ ▁\n]+")


@lru_cache(maxsize=2)
def _load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless pieces cannot cross a marked word or a newline and text is not normalised."""
    sp = _load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search("[^▁]▁", p) for p in pieces) or any("\n" in p for p in pieces):
        raise ValueError("the model has pieces that cross a white-space marker or a newline")
    for probe in ("a  b", " a ", "ﬁ Ａ　é é", "­​\ttab"):
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError(f"the model changes {probe!r}; whole texts would have to be normalised first")
    if sp.encode("\n") != [sp.piece_to_id(MARK), sp.piece_to_id("<0x0A>")]:
        raise ValueError("the model does not write a newline as one byte token after the marker")


def _segment(sp, chunks: list[str]) -> list[list[int]]:
    """Ids of chunks: the library puts a marker first, which a marked chunk lends from its own."""
    marked = [c[0] in " ▁" for c in chunks]
    ids = sp.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
    lone = [sp.piece_to_id(MARK)]
    return [(x or lone) if m else x[2:] for x, m in zip(ids, marked, strict=True)]


def _encode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _load(model)
        table: dict[str, list[int]] = {}
        for batch in batches:
            for part in W.blocks(batch, "text"):
                texts = part.column("text").to_pylist()
                lists = [_CHUNK.findall(" " + t) if t else [] for t in texts]
                # The block's distinct chunks, numbered in order of appearance.
                place: dict[str, int] = {}
                codes = np.array([place.setdefault(c, len(place)) for own in lists for c in own], dtype=np.int64)
                fresh = [c for c in place if c not in table]
                if len(table) + len(fresh) > TABLE_CHUNKS:
                    table.clear()
                    fresh = list(place)
                table.update(zip(fresh, _segment(sp, fresh) if fresh else [], strict=True))
                known = [table[c] for c in place]
                sizes = np.array([len(x) for x in known], dtype=np.int64)
                flat = np.array([i for x in known for i in x], dtype=np.int32)
                begin = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
                lengths = sizes[codes] if len(codes) else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                ids = flat[np.repeat(begin[codes] - ends[:-1], lengths) + np.arange(ends[-1])] if len(codes) else np.zeros(0, np.int32)
                bounds = ends[np.concatenate([[0], np.cumsum([len(own) for own in lists])]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=["row", "ids"])

    return run


def _decode(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [sp.decode(x) if x else "" for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(texts, pa.string())], names=["row", "ids", "decoded"])

    return run



def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids``; an ``ids`` column of its own is replaced."""
    check_model(model)
    keep = [c for c in docs.columns if c not in (text_col, "ids")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return packed.mapInArrow(_encode(model), schema).select("row.*", "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``."""
    packed = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c not in ("ids", "decoded")]).alias("row"), "ids")
    schema = T.StructType([*packed.schema.fields, T.StructField("decoded", T.StringType())])
    return packed.mapInArrow(_decode(model), schema).select("row.*", "ids", "decoded")
