"""Exact Jaccard join in the metric space of word-shingle sets.

Distance is one minus Jaccard similarity and ``e = 1 - t``.  A region starts as the
documents that share a prefix shingle: two sets of similarity ``t`` share one of the
first ``n - ceil(t n) + 1`` shingles of each, in any common order, so regions lose no
pair; the order is by the number of sets that hold a shingle, counted over all texts, so
most sets, with too few shingles of other sets, meet none.  Each region has a pivot,
and the distances of its documents to the pivot cut it in two, as in a Voronoi diagram
of the pivot and the rest: by the triangle inequality documents within ``e`` of the
pivot are linked only to such within ``2e``, so the inner cell holds those within ``2e``,
the outer cell those from ``e`` on, and documents between are put into both.  A pivot
has met its whole region and leaves it; cells whose documents are already connected are
done; the others are joined again in the same way until none is left.  No region lists
its pairs: a round compares documents with at most ``PIVOTS`` pivots, of different
components.

A histogram of a set's hashes over ``CELLS`` cells bounds similarity from above (two sets
share at most the smaller count of each cell), so whole sets are fetched only for
pairs that may be linked, and a document whose distance to the pivot stays unknown goes
by its bound.  Documents of equal sets are one node throughout,
so groups of copies cost one row each.  Intermediate tables are written to the shared
folder; collected are only filter words of fixed size.

Defined results: an empty set (null or wordless text) is linked with nothing; a text of
fewer words than the shingle size is one shingle; rows without id take no part
(component null); rows that share an id but not a text are separate nodes with one label;
repeated rows each get the same row.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import words as W

FILTER_BITS = 23
PIVOTS = 256
CELLS = 256
RUN_SHINGLES, RUN_TEXTS = 2_000_000, 1 << 16
PART_SHINGLES = 1 << 22
_FULL = 32767


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: survives lost executors, ends the plan."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    block = W.Block(column, W.NOT_SPACE, True)
    sums = W.WORDS.sums(block.word_hashes())
    windows = W.WORDS.windows(sums, size)
    for low, high in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        if high - low >= size:
            yield np.unique(windows[low : high - size + 1])
        elif high > low:
            yield W.WORDS.spans(sums, np.array([low]), np.array([high]))
        else:
            yield np.zeros(0, np.uint64)


def _print(own: np.ndarray) -> int:
    """Fingerprint of a set."""
    return int(W.mix(W.mix(own).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own))).view(np.int64)[0])


def _rows(size: int):
    """Size and fingerprint of the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "text"):
                sets = list(_sets(part.column("text"), size))
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("crc"), *columns], names=["id", "crc", "n", "fp"])

    return run


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class _Postings:
    """Shingles of some texts, until written: a row a part, its texts by their place in the row."""

    def __init__(self, parts: int):
        self.parts = parts
        self.sets: dict[int, np.ndarray] = {}
        self.n = 0

    def add(self, own: np.ndarray) -> None:
        fp = _print(own)
        if len(own) and fp not in self.sets:
            self.sets[fp] = own
            self.n += len(own)

    def full(self) -> bool:
        return self.n >= RUN_SHINGLES or len(self.sets) >= RUN_TEXTS

    def rows(self) -> pa.RecordBatch:
        prints = np.array(list(self.sets), dtype=np.int64)
        own = np.concatenate(list(self.sets.values()))
        text = np.repeat(np.arange(len(prints)), [len(s) for s in self.sets.values()])
        part = (own >> np.uint64(32)).astype(np.int64) % self.parts
        order = np.argsort(part, kind="stable")
        low, text, edge = own[order].astype(np.uint32), text[order], np.searchsorted(part[order], np.arange(self.parts + 1))
        columns: list[list] = [[], [], [], []]
        for k in np.flatnonzero(np.diff(edge)).tolist():
            at = text[edge[k] : edge[k + 1]]
            new = np.append(True, at[1:] != at[:-1])
            for column, v in zip(columns, (k, prints[at[new]].tobytes(), low[edge[k] : edge[k + 1]].tobytes(), (np.cumsum(new) - 1).astype(np.uint16).tobytes()), strict=True):
                column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(columns)], names=["part", "prints", "lows", "texts"])


def _postings(size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Postings(parts)
        for batch in batches:
            for block in W.blocks(batch, "text"):
                for own in _sets(block.column("text"), size):
                    held.add(own)
                    if held.full():
                        yield held.rows()
                        held = _Postings(parts)
        if held.n:
            yield held.rows()

    return run


def _crowded(table: pa.Table) -> pa.Table:
    """``(fp, m, keys)`` of a part: the keys of each set that others hold too, fewest holders first.

    A key is its count of sets (at most ``_FULL``), the part and 32 bits of the shingle.
    """
    part = table.column("part")[0].as_py()
    prints, lows, texts = ([np.frombuffer(b, dtype) for b in table.column(name).to_pylist()] for name, dtype in (("prints", np.int64), ("lows", np.uint32), ("texts", np.uint16)))
    start = np.cumsum([0] + [len(p) for p in prints[:-1]])
    kinds, first, code = np.unique(np.concatenate(prints), return_index=True, return_inverse=True)
    at = np.concatenate([t + s for t, s in zip(texts, start, strict=True)])
    # Of equal sets only one is counted, but all of its shingles, also those of equal low bits.
    once = np.zeros(len(code), dtype=bool)
    once[first] = True
    keep = once[at]
    both = (np.concatenate(lows)[keep].astype(np.uint64) << np.uint64(32)) | code[at[keep]].astype(np.uint64)
    both.sort()
    low = both >> np.uint64(32)
    new = np.append(True, low[1:] != low[:-1])
    nth = np.cumsum(new) - 1
    df = np.bincount(nth, np.append(True, both[1:] != both[:-1])).astype(np.int64)[nth]
    shared = df > 1
    key = (np.minimum(df[shared], _FULL) << 48) | (part << 32) | low[shared].astype(np.int64)
    own = (both[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.lexsort((key, own))
    own, key = own[order], key[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    edge = np.append(begin, len(own))
    lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(key))
    return pa.table([pa.array(kinds[own[begin]]), pa.array(np.diff(edge)), lists], names=["fp", "m", "keys"])


def _sets_of(size: int, shared):
    """Sets of texts whose fingerprint passes the filter, each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            for part in W.blocks(batch, "text"):
                prints, sets, cells = [], [], []
                for own in _sets(part.column("text"), size):
                    fp = _print(own)
                    spot = fp & ((1 << FILTER_BITS) - 1)
                    if bits[spot >> 6] >> np.uint64(spot & 63) & np.uint64(1) and fp not in seen:
                        seen.add(fp)
                        prints.append(fp)
                        sets.append(W.signed(own))
                        count = np.bincount((own & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                        # A count beyond a short makes all cells full, which bounds nothing.
                        cells.append((count if count.max() < _FULL else np.full(CELLS, _FULL)).astype(np.int16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(cells, pa.binary())], names=["fp", "own", "cells"])

    return run


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, comp)``: the smallest node reachable, by least neighbours and pointer jumps."""
    both = links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
    both = stored(both, "links")
    labels = stored(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        step = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("least", "comp")).alias("new"))
        step = stored(step, "step")
        if step.where("new < comp").isEmpty():
            return labels
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        labels = stored(step.select("node", "new").join(jump, "new").select("node", F.least("new", "far").alias("comp")), "labels")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(x, y, common, n_x, n_y)`` of pairs (x, y)."""
    left = sets.select(F.col("node").alias("x"), F.col("own").alias("own_x"))
    right = sets.select(F.col("node").alias("y"), F.col("own").alias("own_y"))
    both = pairs.join(left, "x").join(right, "y")
    return both.select("x", "y", F.size(F.array_intersect("own_x", "own_y")).cast("long").alias("common"), F.size("own_x").cast("long").alias("n_x"), F.size("own_y").cast("long").alias("n_y"))


def _reaches(common, n_x, n_y, percent: int):
    return common * 100 >= (n_x + n_y - common) * percent


def _bounds(percent: int):
    """Whether ``2e`` (near) and ``e`` (open) are within reach, by histograms.

    Only pairs with a main pivot are kept when no link is within reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.int16).reshape(-1, CELLS) for c in ("cells_x", "cells_y")]
            most = np.minimum(*cells).sum(1, dtype=np.int64)
            both = np.asarray(batch.column("n_x")) + np.asarray(batch.column("n_y")) - most
            near, linked = most * 100 >= both * (2 * percent - 100), most * 100 >= both * percent
            keep = np.asarray(batch.column("is_main")).astype(bool) | linked
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(pa.array(keep)), batch.column("y").filter(pa.array(keep)), pa.array(near[keep]), pa.array(linked[keep])], names=["x", "y", "near", "open"])

    return run


def _bounded(pairs: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Distinct ``(x, y, near, open)`` of ``(x, y, is_main)``: pairs met in many regions are compared once."""
    once = pairs.groupBy("x", "y").agg(F.max("is_main").alias("is_main"))
    whole = once.join(shape.toDF("x", "n_x", "cells_x"), "x").join(shape.toDF("y", "n_y", "cells_y"), "y")
    return whole.select("x", "y", "is_main", "n_x", "n_y", "cells_x", "cells_y").mapInArrow(_bounds(percent), "x long, y long, near boolean, open boolean")


def _single(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members with their component, of regions that still hold two; equal regions once.

    Of equal ones that of the least key stays: the first common key of two sets is never dropped.
    """
    placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    state = placed.groupBy("region").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.bit_xor(F.xxhash64("node")).alias("sign"), F.sum(F.hash("node").cast("long")).alias("sum"), F.count("*").alias("size"), F.first("key").alias("key"))
    live = state.where("c0 < c1").groupBy("sign", "sum", "size").agg(F.min_by("region", F.struct("key", "region")).alias("region"))
    return placed.join(live.select("region"), "region")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id, text_crc)`` per row of ``docs``."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(whole).alias("crc"), whole.alias("text"))
    rows = stored(texts.mapInArrow(_rows(size), "id long, crc long, n long, fp long"), "rows")
    has = F.col("id").isNotNull() & (F.col("n") > 0)
    distinct = stored(rows.where(has).groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "prints")
    # Ids that repeat with other texts get a node number of their own.
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("fp"))
    node = F.when(nth == 1, F.col("rep")).otherwise(F.col("fp").bitwiseOR(F.lit(-(1 << 63))))
    names = stored(distinct.select("fp", "rep", node.alias("node"), "n"), "nodes")

    # Shingles that no other set holds come first in the order, so a set whose other shingles
    # do not reach into its prefix has no region.
    text = texts.where("id IS NOT NULL").select("text")
    parts = min(1 << 15, -(-(names.agg(F.sum("n")).first()[0] or 1) // PART_SHINGLES) + 5)
    posts = text.mapInArrow(_postings(size, parts), "part long, prints binary, lows binary, texts binary")
    held = stored(posts.groupBy("part").applyInArrow(_crowded, "fp long, m long, keys array<long>"), "crowded")
    # The prefix is n - least + 1 long and begins with n - m shingles of no other set.
    least = F.ceil(F.col("n") * percent / 100)
    into = held.groupBy("fp").agg(F.sum("m").alias("m")).join(names.select("fp", "node", "n"), "fp").select("fp", "node", "n", (F.col("n") - F.col("m")).alias("alone"), (F.col("m") - least + 1).cast("int").alias("k")).where("k > 0")
    keys = held.join(into, "fp").groupBy("node").agg(F.first("k").alias("k"), F.first("n").alias("n"), F.first("alone").alias("alone"), F.flatten(F.collect_list("keys")).alias("keys"))
    # Sets whose shingles many others hold stand in the middle of near copies: they make good pivots.
    held_by = F.aggregate("keys", F.lit(0).cast("long"), lambda s, key: s + F.shiftright(key, 48))
    keys = keys.withColumn("rank", -F.floor(held_by / F.col("n")))
    # ``left`` counts a set's shingles from a key on in the order: no two sets share more than
    # the smaller left of their first common key.
    keys = keys.withColumn("keys", F.slice(F.array_sort("keys"), F.lit(1), F.col("k")))
    placed = F.transform("keys", lambda key, i: F.struct(key.alias("region"), (F.col("n") - F.col("alone") - i).alias("left")))
    placed = F.filter(placed, lambda e, i: (i == 0) | (e.region != F.get(F.col("keys"), i - 1)))
    keyed = stored(keys.select("node", "rank", F.explode(placed).alias("e")).select("node", "rank", "e.region", "e.left"), "keyed")
    shared = keyed.groupBy("region").agg(F.min_by("node", F.struct("rank", "node")).alias("y"), F.count("*").alias("size")).where("size > 1").select(F.bitwise_not("region").alias("r"), "y")
    members = stored(keyed.join(shared, F.bitwise_not("region") == F.col("r")).select("region", "node", "rank", "left", "y"), "shared")
    # Near copies share most of their prefixes: regions of the same documents are kept once, the
    # first in the order.
    one = members.groupBy("region").agg(F.bit_xor(F.xxhash64("node")).alias("sign"), F.sum(F.hash("node").cast("long")).alias("sum"), F.count("*").alias("size"))
    one = one.groupBy("sign", "sum", "size").agg(F.min("region").alias("region")).select("region")
    members = stored(members.join(one, "region"), "regions")

    # Sets of the nodes met, picked from the texts by a filter of fixed size and then exactly.
    prints = stored(members.select("node", "rank").distinct().join(names, "node").select("node", "fp", "n", "rank"), "used")
    spot = prints.select(F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("spot"))
    filled = spot.select(F.shiftright("spot", 6).alias("w"), F.expr("shiftleft(1L, CAST(spot & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[np.asarray(filled.column("w"))] = np.asarray(filled.column("b"))
    picked = text.mapInArrow(_sets_of(size, spark.sparkContext.broadcast(bits.view(np.uint64))), "fp long, own array<long>, cells binary")
    sets = stored(prints.join(picked, "fp").groupBy("node").agg(F.first("n").alias("n"), F.first("own").alias("own"), F.first("cells").alias("cells")), "sets")

    linked = _reaches(F.col("common"), F.col("n_x"), F.col("n_y"), percent)
    width = (100 - percent) / 100
    distance = 1 - F.col("common") / (F.col("n_x") + F.col("n_y") - F.col("common"))
    shape = sets.select("node", "n", "cells")
    first = members.where("node != y").select(F.col("node").alias("x"), "y", F.lit(True).alias("is_main"))
    pairs = stored(_bounded(first, shape, percent), "pairs")
    members = members.where("node != y").select("region", F.col("region").alias("key"), "node", "left", F.col("y").alias("main"))
    links, comp = None, None
    while True:
        asked = pairs.where("open").select("x", "y")
        found = stored(_measured(asked, sets), "distances")
        new = found.where(linked).select("x", "y")
        if links is None or not new.isEmpty():
            links = stored(new if links is None else links.unionByName(new).distinct(), "linked")
            ends = links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).distinct()
            comp = components(ends, links)
        # Known distances place a document; of others the bound tells which are far, and the
        # rest goes to both cells.  1e-9 guards the borders against rounding.
        far = found.select(F.col("x").alias("node"), F.col("y").alias("main"), distance.alias("d"))
        bound = pairs.select(F.col("x").alias("node"), F.col("y").alias("main"), "near")
        placed = members.join(bound, ["node", "main"], "left").join(far, ["node", "main"], "left")
        inner = F.coalesce(F.col("d") < 2 * width + 1e-9, F.col("near"), F.lit(False))
        outer = F.coalesce(F.col("d") > width - 1e-9, F.lit(True))
        cells = F.array_compact(F.array(F.when(inner, 0), F.when(outer, 1)))
        split = placed.select("region", "key", "node", "left", F.explode(cells).alias("cell")).select(F.xxhash64("region", "cell").alias("region"), "key", "node", "left")
        live = stored(_single(split, comp), "live")
        if live.isEmpty():
            break
        ranked = live.join(prints.select("node", "n", "rank"), "node")
        heads = ranked.groupBy("region", "comp").agg(F.min(F.struct("rank", "node", "n", "left")).alias("y"))
        heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy("y"))).where(F.col("k") <= PIVOTS)
        heads = stored(heads.select("region", F.col("comp").alias("p_comp"), F.col("y.node").alias("y"), F.col("y.n").alias("n_y"), F.col("y.left").alias("left_y"), (F.col("k") == 1).alias("is_main")), "pivots")
        # One row a region and document carries the pivots, and each document lists them once.
        # What both have left after the region's key, if it is their first common one, bounds
        # similarity too, and costs least to compare.
        offered = heads.groupBy(F.col("region").alias("r")).agg(F.collect_list(F.struct("y", "n_y", "left_y", "p_comp", "is_main")).alias("offered"))

        def meets(h):
            return (h.y != F.col("node")) & (h.is_main | ((h.p_comp != F.col("comp")) & _reaches(F.least(F.col("left"), h.left_y), F.col("n"), h.n_y, percent)))

        met = ranked.join(offered, F.col("region") == F.col("r")).withColumn("offered", F.filter("offered", meets))
        met = met.select("node", F.transform("offered", lambda h: h.y).alias("ys"), F.transform(F.filter("offered", lambda h: h.is_main), lambda h: h.y).alias("own"))
        met = met.groupBy(F.col("node").alias("x")).agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
        met = met.select("x", F.explode("ys").alias("y"), "own").select("x", "y", F.array_contains("own", F.col("y")).alias("is_main"))
        pairs = stored(_bounded(met, shape, percent), "pairs")
        mains = heads.where("is_main").select("region", F.col("y").alias("main"))
        rest = live.join(heads.select("region", F.col("y").alias("node")), ["region", "node"], "left_anti")
        members = stored(rest.select("region", "key", "node", "left").join(mains, "region"), "members")

    labels = names.join(comp, "node", "left").select("fp", F.coalesce("comp", "node").alias("comp"), "rep")
    least = labels.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = labels.join(least, "comp").select("fp", "component_id")
    out = rows.join(final, "fp", "left").select("id", F.col("n").alias("n_shingles"), F.when(has, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("crc").alias("text_crc"))
    return out.withColumnRenamed("id", id_col)
