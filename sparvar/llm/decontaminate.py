"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Benchmark texts are cut into windows of 13 words; an item of fewer words is one window.
The distinct windows are sent to the executors in sets of at most ``set_limit`` windows
(the proven bound of each broadcast); a larger benchmark takes several scans without a
shuffle, each adding its hits to those before.  Between scans the rows are written to the
shared folder and the set is given up, so a task holds one set whatever the benchmark's size.  A scan looks up rolling
hashes of document windows and compares the words of every hash hit, so no hash
collision counts.

Defined results: null and wordless documents have no hits; wordless items have no window;
an item without id still gives hits and is listed as the empty string; repeated items
count once; repeated documents get a row each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import words as W

SET_LIMIT = 100_000
_MASK = np.uint64((1 << 20) - 1)


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.ALNUM, True)
                owner, gram = [], []
                for i in range(len(block)):
                    words = [block.word(j) for j in range(block.first[i], block.first[i + 1])]
                    for at in range(max(1, len(words) - n + 1) if words else 0):
                        owner.append(i)
                        gram.append(b" ".join(words[at : at + n]))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(owner, pa.int64())), pa.array(gram, pa.binary())], names=["item", "gram"])

    return run


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """``(gram, items)``: every distinct window with the ids of its items."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_item_windows(n), "item string, gram binary").groupBy("gram").agg(F.collect_set("item").alias("items"))


class GramSet:
    """One broadcast set: for each window length a bit table, and the windows by hash."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        by_length: dict[int, list[tuple[bytes, list[str]]]] = defaultdict(list)
        for gram, items in rows:
            by_length[gram.count(b" ") + 1].append((gram, list(items)))
        self.lengths = {}
        for length, own in by_length.items():
            block = W.Block(pa.array([g for g, _ in own], pa.binary()), W.ALNUM, False)
            hashes = W.WORDS.spans(W.WORDS.sums(block.word_hashes()), block.first[:-1], block.first[1:])
            table = np.zeros(1 << 20, dtype=bool)
            table[hashes & _MASK] = True
            self.lengths[length] = (table, np.unique(hashes), dict(own))

    def hits(self, block: W.Block) -> tuple[np.ndarray, list[set[str]]]:
        """Words inside an occurring window, and the items found in each text."""
        hit, found = np.zeros(len(block.starts), dtype=bool), [set() for _ in range(len(block))]
        sums = W.WORDS.sums(block.word_hashes())
        owner = block.text_of_words()
        for length, (table, hashes, grams) in self.lengths.items():
            h = W.WORDS.windows(sums, length)
            at = np.flatnonzero(table[h & _MASK])
            at = at[np.isin(h[at], hashes) & block.whole_windows(length)[at]]
            for p in at.tolist():
                items = grams.get(b" ".join([block.word(j) for j in range(p, p + length)]))
                if items is not None:
                    hit[p : p + length] = True
                    found[owner[p]].update(items)
        return hit, found


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            for part in W.blocks(batch, "text"):
                block = W.Block(part.column("text"), W.ALNUM, True)
                hit, found = grams.hits(block)
                at = np.flatnonzero(hit)
                owner = np.searchsorted(at, block.first)
                spots = pa.ListArray.from_arrays(pa.array(owner.astype(np.int32)), pa.array((at - np.repeat(block.first[:-1], np.diff(owner))).astype(np.int32)))
                names = [*part.schema.names, "n_words", "new_at", "new_items"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block.n_words.astype(np.int64)), spots, pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=names)

    return run


def _scanned(df: DataFrame) -> T.StructType:
    new = [T.StructField("n_words", T.LongType()), T.StructField("new_at", T.ArrayType(T.IntegerType())), T.StructField("new_items", T.ArrayType(T.StringType()))]
    return T.StructType([*df.schema.fields, *new])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", n: int = 13, set_limit: int = SET_LIMIT
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (positions), ``items`` and ``contaminated``.

    A document is contaminated when its hit words are at least a twentieth of its words.
    """
    spark = docs.sparkSession
    grams = cut_lineage(benchmark_windows(benchmark, item_col, "text", n))
    sets = max(1, -(-grams.count() // set_limit))
    # Hash buckets may be uneven, so twice as many as needed keep each within the bound.
    sets = sets if sets == 1 else 2 * sets
    keep = [c for c in docs.columns if c not in ("n_words", "hit_words", "items", "contaminated")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    out = docs.select(row.alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items"))
    for k in range(sets):
        own = grams.where(F.pmod(F.xxhash64("gram"), F.lit(sets)) == k) if sets > 1 else grams
        shared = spark.sparkContext.broadcast(GramSet([(bytes(r.gram), r.items) for r in own.toLocalIterator()]))
        step = out.drop("n_words").mapInArrow(_scan(shared), _scanned(out.drop("n_words")))
        out = step.select("row", "text", "n_words", F.array_union("hit_words", "new_at").alias("hit_words"), F.array_union("items", "new_items").alias("items"))
        if k + 1 < sets:
            out = cut_lineage(out)
            shared.destroy()
    contaminated = (F.size("hit_words") > 0) & (F.size("hit_words") * F.lit(20) >= F.col("n_words"))
    return out.select("row.*", "n_words", F.array_sort("hit_words").alias("hit_words"), F.array_sort("items").alias("items"), contaminated.alias("contaminated"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.blocks(batch, "text"):
            block = W.Block(part.column("text"), W.ALNUM, True)
            texts = []
            for i, at in enumerate(part.column("hit_words")):
                raw = part.column("text")[i].as_py()
                spots = np.asarray(at.values).astype(np.int64) if at.is_valid else np.zeros(0, np.int64)
                if len(spots):
                    whole, out, last = raw.encode(), [], 0
                    for run in np.split(spots, np.flatnonzero(np.diff(spots) > 1) + 1):
                        low, high = block.starts[block.first[i] + run[0]] - block.offsets[i], block.ends[block.first[i] + run[-1]] - block.offsets[i]
                        out.append(whole[last:low])
                        last = int(high)
                    raw = b"".join([*out, whole[last:]]).decode()
                texts.append(raw)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "cut_text"])


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the hit words, and what stands between them, out of each text of ``find_contamination``."""
    packed = found.select(F.struct(*[F.col(f"`{c}`") for c in found.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "hit_words")
    out = packed.mapInArrow(_cut, T.StructType([packed.schema["row"], T.StructField("cut_text", T.StringType())]))
    return out.select("row.*", "cut_text")
