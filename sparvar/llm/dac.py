"""Token ids in directly addressable codes: files that give any token without decoding a block.

An id is split into chunks of eight bits, lowest first.  Level 0 holds the first chunk of
every id; a bitmap says which ids go on, and level 1 holds the second chunk of those
alone, and so on.  The place of an id on the next level is the number of set bits before
it, which a rank directory (a running count every 512 bits) and one popcount give.

A file, all numbers little-endian unsigned 64-bit words unless said otherwise:

    magic (8 bytes), documents, ids, levels
    of each level: chunks, then byte offsets of its chunks, bitmap and directory
    byte offsets of document ids, of their null flags (a byte each) and of starts
    sections, each padded to 64 bytes; starts has one entry more than there are documents

``write_ids`` deals the texts by ranges of the document id, so partition after partition
and file after file hold them in ascending order; a file is closed by the document with
which it reaches ``file_ids`` ids.  A task names its files by its attempt, and only
those of attempts that ended well are in the manifest, a small Parquet table beside them:
lost executors leave files that nothing refers to.  The ids before a file are a running
sum over the manifest.

Defined results: a null or empty text is the end id alone; rows without id come first;
repeated ids stand side by side, in any order; an empty table has no files.  Columns
besides id and text are not read.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W

MAGIC = b"DACIDS1\0"
RANK_BITS = 512
FILE_IDS = 1 << 22
#: Entries and characters of a worker's table of encoded chunks; it starts anew beyond them.
TABLE_CHUNKS, TABLE_CHARS = 600_000, 16_000_000
_MANIFEST = "part int, nth int, path string, n_docs long, n_ids long"


# ------------------------------------------------------------------------ codes


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64)


def pack(ids: np.ndarray, docs: np.ndarray, absent: np.ndarray, starts: np.ndarray) -> bytes:
    """One file: ``ids`` of all documents, document ids, their null flags, and where each starts."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += bytes(-len(bits) % (RANK_BITS // 8))
        ones = np.bitwise_count(np.frombuffer(bits, dtype="<u8")).reshape(-1, RANK_BITS // 64).sum(1, dtype=np.uint64)
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits, before.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    sections = [x for _, *three in levels for x in three]
    sections += [docs.astype("<i8").tobytes(), absent.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    head = len(MAGIC) + 8 * (3 + 4 * len(levels) + 3)
    at, places = head + -head % 64, []
    for s in sections:
        places.append(at)
        at += len(s) + -len(s) % 64
    words = [len(docs), len(ids), len(levels)]
    for k, (n, *_) in enumerate(levels):
        words += [n, *places[3 * k : 3 * k + 3]]
    header = MAGIC + struct.pack(f"<{len(words) + 3}Q", *words, *places[-3:])
    return b"".join([_padded(header), *map(_padded, sections)])


class Codes:
    """A file behind ``read(offset, size)``; every call reads only the bytes it needs."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = bytes(read(0, 32))
        if head[:8] != MAGIC:
            raise ValueError("no file of directly addressable codes")
        self.n_docs, self.n_ids, n = struct.unpack("<3Q", head[8:])
        rest = struct.unpack(f"<{4 * n + 3}Q", bytes(read(32, 8 * (4 * n + 3))))
        self.levels = [rest[4 * k : 4 * k + 4] for k in range(n)]
        self.places = rest[-3:]

    @classmethod
    def of(cls, data) -> Codes:
        view = memoryview(data)
        return cls(lambda at, size: view[at : at + size])

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n_docs
        ids, absent, starts = self.places
        return np.frombuffer(self.read(ids, 8 * n), "<i8"), np.frombuffer(self.read(absent, n), np.uint8).astype(bool), np.frombuffer(self.read(starts, 8 * (n + 1)), "<u8").astype(np.int64)

    def _rank(self, level: int, at: int) -> int:
        """Set bits before position ``at`` of a level's bitmap: a directory entry and one popcount."""
        _, _, bits, directory = self.levels[level]
        block, inside = divmod(at, RANK_BITS)
        before = int.from_bytes(self.read(directory + 8 * block, 8), "little")
        if not inside:
            return before
        word = int.from_bytes(self.read(bits + block * (RANK_BITS // 8), -(-inside // 8)), "little")
        return before + (word & ((1 << inside) - 1)).bit_count()

    def token(self, at: int) -> int:
        """The id at a position, from one chunk, one bit and one rank a level."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value = 0
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value |= self.read(chunks + at, 1)[0] << (8 * level)
            if not self.read(bits + at // 8, 1)[0] >> (at % 8) & 1:
                break
            at = self._rank(level, at)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids of a run of positions: of each level one run of chunks, found by one rank."""
        if end <= start:
            return np.zeros(0, np.uint32)
        parts, low, high = [], start, end
        for level, (_, chunks, bits, _) in enumerate(self.levels):
            value = np.frombuffer(self.read(chunks + low, high - low), np.uint8).astype(np.uint32)
            first = low // 8
            more = np.unpackbits(np.frombuffer(self.read(bits + first, -(-high // 8) - first), np.uint8), bitorder="little")
            more = more[low - 8 * first : high - 8 * first].astype(bool)
            parts.append((value, more))
            n = int(more.sum())
            if not n:
                break
            low = self._rank(level, low)
            high = low + n
        out = parts[-1][0]
        for value, more in reversed(parts[:-1]):
            value[more] |= out << np.uint32(8)
            out = value
        return out


# ------------------------------------------------------------------------ texts

_OTHER, _DIGIT, _LETTER, _SPACE, _HIGH = 3, 4, 1, 2, 0
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x80:] = _HIGH


class ChunkIds:
    """Ids of whole texts by a table of distinct chunks.

    The tokenizer's pieces never cross white space, nor begin in front of a letter-to-other
    step and end behind it, as its pattern takes letters in whole runs, digits singly, and
    reads from the left.  Texts are therefore cut behind white space, between an ASCII
    letter and an ASCII character that is none, and on both sides of an ASCII digit, and
    each distinct chunk is encoded once.  A text that
    may name a special token is one chunk.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.begin = np.zeros(1 << 14, dtype=np.int64)

    def _add(self, chunks: list[str]) -> None:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        n, m = len(self.known), int(self.begin[len(self.known)])
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        ends = m + np.cumsum(sizes)
        while len(self.begin) < n + len(chunks) + 1:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begin[n + 1 : n + len(chunks) + 1] = ends
        self.flat[m : ends[-1]] = np.fromiter((x for e in encoded for x in e), dtype=np.uint32, count=int(sizes.sum()))
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        texts = texts.fill_null("").cast(pa.string())
        n = len(texts)
        _, off, buf = texts.buffers()
        offsets = np.frombuffer(off, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        kind = _CLASS[data]
        cut = np.zeros(len(data), dtype=bool)
        left, right = kind[:-1], kind[1:]
        cut[1:] = ((left == _LETTER) & (right >= _SPACE)) | ((left == _SPACE) & (right != _SPACE)) | ((left == _DIGIT) & (right > _HIGH)) | ((right == _DIGIT) & (left > _HIGH))
        for mark in self.marks:
            for i in np.flatnonzero(np.asarray(pa.compute.match_substring(texts, mark))):
                cut[offsets[i] : offsets[i + 1]] = False
        full = offsets[1:] > offsets[:-1]
        cut[offsets[:-1][full]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        if len(self.known) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.clear()
        names = pieces.dictionary.to_pylist()
        new = len(self.known)
        found = np.array([self.known.get(x, -1) for x in names], dtype=np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self._add([names[i] for i in missing])
            found[missing] = np.arange(new, new + len(missing))
        row = found[np.asarray(pieces.indices)]
        sizes = self.begin[row + 1] - self.begin[row]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[row] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])


@lru_cache(maxsize=2)
def _chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


# ------------------------------------------------------------------------ files


def _place(folder: str):
    from pyarrow import fs

    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return fs.FileSystem.from_uri(uri)


def _write(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, table, place = TaskContext.get(), _chunk_ids(tokenizer), None
        held, docs, absent, sizes, size, nth = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, docs, absent, sizes, size, nth, place
            if place is None:
                place = _place(folder)
                place[0].create_dir(place[1], recursive=True)
            name = f"{task.partitionId():06d}-{nth:06d}-{task.taskAttemptId()}.dac"
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            with place[0].open_output_stream(f"{place[1]}/{name}") as out:
                out.write(pack(np.concatenate(held), np.concatenate(docs), np.concatenate(absent), starts))
            row = {"part": task.partitionId(), "nth": nth, "path": f"{folder}/{name}", "n_docs": len(starts) - 1, "n_ids": int(starts[-1])}
            held, docs, absent, sizes, size, nth = [], [], [], [], 0, nth + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for rows in W.blocks(batch, "text", 8 << 20):
                ids, counts = table.encode(rows.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                names = rows.column("doc")
                held.append(ids)
                docs.append(np.asarray(names.fill_null(0)))
                absent.append(np.asarray(names.is_null()))
                sizes.append(counts)
                size += len(ids)
                if size >= file_ids:
                    yield close()
        if sizes:
            yield close()

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Files of ids in ascending order of the document id; returns ``manifest(spark, folder)``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # The second key spreads an id that many rows share.
    dealt = rows.repartitionByRange("doc", F.rand(11)).sortWithinPartitions("doc")
    dealt.mapInArrow(_write(folder, tokenizer, end_id, file_ids), _MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(part, nth, path, n_docs, n_ids, base)``: a row per file, ``base`` the ids of all files before it."""
    files = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per writing task reaches this window.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p_base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    own = files.withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return own.join(parts, "part").select("part", "nth", "path", "n_docs", "n_ids", (F.col("p_base") + F.col("before")).alias("base"))


def _opened(path: str) -> Codes:
    place, name = _place(path)
    f = place.open_input_file(name)
    return Codes(lambda at, size: f.read_at(size, at))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            place, name = _place(path)
            with place.open_input_file(name) as f:
                codes = Codes.of(f.read_buffer())
            docs, absent, starts = codes.documents()
            room = np.searchsorted(starts, np.arange(0, int(starts[-1]) + 1, 1 << 20))
            edges = np.unique(np.concatenate([room, [0, len(docs)]]).clip(0, len(docs)))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                ids = [codes.slice(int(starts[i]), int(starts[i + 1])).astype("<u4").tobytes() for i in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[a:b], pa.int64(), mask=absent[a:b]), pa.array(base + starts[a:b], pa.int64()), pa.array(np.diff(starts[a : b + 1]), pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc", "start", "n_tokens", "ids"],
                )


def read_documents(files: DataFrame) -> DataFrame:
    """``(doc, start, n_tokens, ids)`` of all files of a manifest; ``ids`` are little-endian unsigned
    32-bit integers, the end id included."""
    spread = files.select("path", "base").repartition(min(max(1, files.count()), 20_000))
    return spread.mapInArrow(_documents, "doc long, start long, n_tokens long, ids binary")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Codes] = {}
    for batch in batches:
        ids = []
        for path, base, at in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "position")), strict=True):
            if path not in known:
                known = {path: _opened(path)}
            ids.append(known[path].token(at - base))
        yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(ids, pa.int64())], names=["position", "token"])


def tokens_at(files: DataFrame, wanted: DataFrame, position: str = "position", cell: int = FILE_IDS) -> DataFrame:
    """``(position, token)`` of positions counted over all files; those outside are left out.

    Positions meet files by cells of ``cell`` positions; a task then reads a few bytes of a
    file for each position and decodes nothing else.
    """
    cells = F.sequence(F.floor(F.col("base") / cell), F.floor((F.col("base") + F.col("n_ids") - 1) / cell))
    spans = files.where("n_ids > 0").select("path", "base", (F.col("base") + F.col("n_ids")).alias("end"), F.explode(cells).alias("cell"))
    asked = wanted.select(F.col(position).cast("long").alias("position")).withColumn("cell", F.floor(F.col("position") / cell))
    met = asked.join(spans, "cell").where((F.col("position") >= F.col("base")) & (F.col("position") < F.col("end")))
    return met.select("path", "base", "position").sortWithinPartitions("path", "position").mapInArrow(_tokens, "position long, token long")
