"""Words of a block of texts and rolling hashes over them, as whole-array numpy work.

An Arrow string column already is one byte buffer with offsets, so words are found by
one table look-up per byte and hashed by differences of a running polynomial sum modulo
2**64; no Python object is made per word.  Every word class in use holds all or none of
the bytes from 0x80 up, so working on UTF-8 bytes gives the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK_BYTES = 1 << 20


def _byte_class(*keep: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in keep:
        table[low : high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~_byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (applied after lower-casing A-Z)
ALNUM = _byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of spans of a sequence from one running sum; ``base`` must be odd."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Of every window of ``length`` items; empty where there are fewer."""
        n = max(0, len(sums) - length)
        return mix((sums[length : length + n] - sums[:n]) * self.down[:n])


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES = Rolling(0xD1342543DE82EF95)
WORDS = Rolling(0xAF251AF3B0F025B5)
#: An independent second hash, for 128-bit keys.
WORDS2 = Rolling(0xDA942042E4DD58B5)


class Block:
    """Texts of some rows: ``data``, byte ``offsets`` of texts, words and their hashes.

    ``starts`` and ``ends`` are byte positions of words; ``first[i]:first[i + 1]`` are
    the words of text ``i``.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool):
        texts = texts.fill_null("")
        n = len(texts)
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, off, buf = texts.buffers()
        offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        low, high = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        data = np.frombuffer(buf, dtype=np.uint8)[low:high] if buf is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        self.raw = data
        self.data = LOWER[data] if lower else data
        inside = table[self.data]
        full = self.offsets[1:] > self.offsets[:-1]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[self.offsets[:-1][full]] = False
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[self.offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        sums = _BYTES.sums(_BYTE_VALUES[self.data])
        return _BYTES.spans(sums, self.starts, self.ends)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def whole_windows(self, length: int) -> np.ndarray:
        """For each word position with ``length`` words after it in the block: whether they are of one text."""
        n = max(0, len(self.starts) - length + 1)
        ends = np.repeat(self.first[1:], self.n_words)[:n]
        return np.arange(n) + length <= ends

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; one long text is a slice of its own."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Positions of ``range(n)`` inside any window."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def join_words(block: Block, keep: np.ndarray) -> pa.StringArray:
    """Of each text its kept words, unchanged, joined by one space."""
    starts, sizes = block.starts[keep], (block.ends - block.starts)[keep]
    owner = block.text_of_words()[keep]
    last = np.ones(len(owner), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    room = sizes + ~last
    at = np.zeros(len(room) + 1, dtype=np.int64)
    np.cumsum(room, out=at[1:])
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    shift = np.repeat(starts - at[:-1], sizes)
    target = np.arange(int(sizes.sum())) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes)
    out[target] = block.raw[target + shift]
    offsets = at[np.searchsorted(owner, np.arange(len(block) + 1))].astype(np.int32)
    return pa.StringArray.from_buffers(len(block), pa.py_buffer(offsets), pa.py_buffer(out))
