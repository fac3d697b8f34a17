"""Product codes of vectors, with entries found by a GNAT over each codebook.

Vectors become integers, floor(scale * x), and are cut into equal parts.  The codebook of
a part position starts as that part of the first rows by id; a round assigns every part to
the nearest entry and moves the entries to floored means.  A round is one job: tasks add
up sums and counts for each entry, Spark adds those, and only a codebook (parts x entries
rows, whatever the number of vectors) comes to the driver.

A GNAT holds a codebook's entries: split points, the other entries under the nearest of
them, and for each pair of child and split point the range of distances from the split
point to the child's entries.  A query's distances to split points eliminate whole children
that lie outside its best distance so far.  Ranges are widened by ``SLACK`` against rounded
roots and only strictly farther children go, so ties are never lost; what is compared is
exact integer squares, ties to the lower index.  Rows of an Arrow batch walk the tree
together, each child with those rows that still need it.

Defined results: rows without id, and vectors that are null or hold a null or non-finite
component, take no part.  So do those whose size is not that of the first row kept or no
multiple of ``parts``, and those with a component beyond ``LIMIT`` after scaling, as squares
are summed in 64 bits.  Among repeated ids the smaller vector comes first.  With fewer rows
than entries a codebook is as short as the rows are; with none it is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 27
SLACK = 1e-9
#: Children of a node, and entries up to which a child is searched one by one.
FAN, LEAF = 4, 3


class Gnat:
    """Geometric near-neighbour access tree over integer points."""

    def __init__(self, points: np.ndarray, names: np.ndarray | None = None):
        self.names = np.arange(len(points)) if names is None else names
        self.points = points
        self.children: list[Gnat] = []
        if len(points) <= LEAF:
            return
        # Split points far from each other: each next one has the largest least distance.
        split, near = [0], squares(points, points[:1])[:, 0]
        while len(split) < min(FAN, len(points)) and near.max() > 0:
            split.append(int(np.argmax(near)))
            near = np.minimum(near, squares(points, points[split[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(points)), split)
        dist = squares(points, points[split])
        owner = np.argmin(dist[rest], axis=1)
        self.split = points[split]
        self.split_names = self.names[split]
        self.low, self.high = np.zeros((len(split), len(split))), np.zeros((len(split), len(split)))
        for child in range(len(split)):
            under = rest[owner == child]
            if len(under):
                d = np.sqrt(dist[under].astype(np.float64))
                self.low[child], self.high[child] = d.min(0) * (1 - SLACK), d.max(0) * (1 + SLACK)
            # Equal points that no split tells apart are searched one by one.
            self.children.append(Gnat(points[under], self.names[under]) if len(under) < len(points) - 1 or len(split) > 1 else _leaf(points[under], self.names[under]))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Name of the nearest point of each row and the exact squared distance; ties to the lower name."""
        best = np.full(len(rows), np.iinfo(np.int64).max)
        name = np.full(len(rows), np.iinfo(np.int64).max)
        self._search(rows, np.arange(len(rows)), best, name)
        return name, best

    @staticmethod
    def _take(d: np.ndarray, names: np.ndarray, at: np.ndarray, best: np.ndarray, name: np.ndarray) -> None:
        for k in range(len(names)):
            won = (d[:, k] < best[at]) | ((d[:, k] == best[at]) & (names[k] < name[at]))
            best[at[won]] = d[won, k]
            name[at[won]] = names[k]

    def _search(self, rows: np.ndarray, at: np.ndarray, best: np.ndarray, name: np.ndarray) -> None:
        if not len(at) or not len(self.points):
            return
        if not self.children:
            self._take(squares(rows[at], self.points), self.names, at, best, name)
            return
        d = squares(rows[at], self.split)
        self._take(d, self.split_names, at, best, name)
        root = np.sqrt(d.astype(np.float64))
        for child, node in enumerate(self.children):
            if not len(node.points):
                continue
            reach = np.sqrt(best[at].astype(np.float64)) * (1 + SLACK)
            near = (root * (1 - SLACK) - reach[:, None] <= self.high[child]) & (root * (1 + SLACK) + reach[:, None] >= self.low[child])
            node._search(rows, at[near.all(1)], best, name)


def _leaf(points: np.ndarray, names: np.ndarray) -> Gnat:
    out = Gnat(points[:0], names[:0])
    out.points, out.names = points, names
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    d = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def _usable(batch: pa.RecordBatch, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable rows of a batch and their integer vectors."""
    vectors = batch.column("_vec")
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    flat = vectors.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * x)
        good = (np.abs(x) <= LIMIT).all(1)
    return rows[good], x[good].astype(np.int64)


def _sums(books: np.ndarray, dim: int, scale: float):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, x = _usable(batch, dim, scale)
            for p, tree in enumerate(trees):
                own = x[:, p * width : (p + 1) * width]
                name, _ = tree.nearest(own)
                np.add.at(total[p], name, own)
                count[p] += np.bincount(name, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray, dim: int, scale: float):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            rows, x = _usable(batch, dim, scale)
            names, errors = zip(*(t.nearest(x[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)), strict=True)
            codes = np.stack(names, axis=1).astype(np.uint8)
            keep = [c for c in batch.schema.names if c != "_vec"]
            picked = [batch.column(c).take(pa.array(rows)) for c in keep]
            yield pa.RecordBatch.from_arrays([*picked, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sum(errors, axis=0), pa.int64())], names=[*keep, "code", "error"])

    return run


def _rows(vectors: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    return vectors.where(F.col(id_col).isNotNull()).select(*keep, F.col(vec_col).cast("array<double>").alias("_vec"))


def first_books(vectors: DataFrame, parts: int, entries: int, scale: float, id_col: str, vec_col: str) -> np.ndarray:
    """(parts, entries, width) integers of the usable rows with the smallest ids."""
    rows = _rows(vectors, id_col, vec_col, F.col(id_col).cast("long").alias("_id")).where(F.col("_vec").isNotNull())
    fine = rows.where(F.forall("_vec", lambda e: e.isNotNull() & ~F.isnan(e) & (e * scale >= -LIMIT) & (e * scale < LIMIT + 1)))
    # The dimension is that of the first row; a limit keeps what comes to the driver at a codebook's size.
    head = fine.orderBy("_id", "_vec").select(F.size("_vec").alias("dim")).first()
    if head is None or head.dim % parts or head.dim == 0:
        return np.zeros((parts, 0, 0), np.int64)
    least = fine.where(F.size("_vec") == head.dim).orderBy("_id", "_vec").limit(entries).orderBy("_id", "_vec").collect()
    x = np.floor(scale * np.array([r["_vec"] for r in least])).astype(np.int64)
    return x.reshape(len(least), parts, -1).transpose(1, 0, 2).copy()


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds``; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    books = first_books(vectors, parts, entries, scale, id_col, vec_col)
    dim = parts * books.shape[2]
    for _ in range(rounds if books.shape[1] else 0):
        found = _rows(vectors, id_col, vec_col).mapInArrow(_sums(books, dim, scale), "part int, entry int, n long, sums array<long>")
        at = found.select("part", "entry", "n", F.posexplode("sums").alias("k", "s"))
        new = at.groupBy("part", "entry", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in new:
            books[r.part, r.entry, r.k] = int(r.s) // r.n
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: float = 4096.0, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, code, error)``: a byte a part, and the squared distances summed over parts."""
    types = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "code binary, error long"])
    if not books.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    return _rows(vectors, id_col, vec_col, id_col, *keep).mapInArrow(_codes(books, books.shape[0] * books.shape[2], scale), schema)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """Adds ``approx``, the integers that a code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    byte = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("approx", F.flatten(F.array(*[F.get(F.get(table, F.lit(p)), byte(p)) for p in range(len(books))])))
