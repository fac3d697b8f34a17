"""Fill-in-middle transformation with cuts found by a Fenwick tree.

A text's units are runs of ASCII letters and single other characters.  Its UTF-8 bytes are
cut into blocks of ``BLOCK`` bytes; of each block the tree holds how many units and how
many code points begin in it.  A cut after so many units is found by binary-lifting
descent: it adds the widest strides of blocks that stay within the count, so it ends in
the block where the next unit begins; only that block is then searched, and its code
points up to the place are added to the tree's sum.  All texts of an Arrow slice share
one array of blocks, each with a tree of its own, so building and descending are a few
array operations for each stride and no work for each character in Python.

Defined results: a null text is an empty one; a row without id draws its numbers from
``seed:`` alone; repeated rows give repeated results; ``n``, ``form``, ``prefix_chars``,
``middle_chars`` and ``output`` replace columns of these names, others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

BLOCK = 256
#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ["plain", "psm", "spm"]
_LETTER = W._byte_class((0x41, 0x5A), (0x61, 0x7A))
_NEW = ["n", "form", "prefix_chars", "middle_chars", "output"]


class Texts:
    """Bytes of some texts, where units and code points begin, and a Fenwick tree for each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: int = BLOCK):
        self.data, self.offsets, self.block = data, offsets, block
        self.char = (data & 0xC0) != 0x80
        letter = _LETTER[data]
        inside = np.zeros(len(data), dtype=bool)
        inside[1:] = letter[1:] & letter[:-1]
        full = offsets[1:] > offsets[:-1]
        inside[offsets[:-1][full]] = False
        self.unit = self.char & ~inside
        self.n_blocks = -(-np.diff(offsets) // block)
        self.first = np.concatenate([[0], np.cumsum(self.n_blocks)])
        owner = np.repeat(np.arange(len(self.n_blocks)), self.n_blocks)
        self.local = np.arange(len(owner)) - self.first[owner] + 1
        edges = offsets[owner] + (self.local - 1) * block
        count = lambda flags: np.add.reduceat(flags, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64)
        self.tree = np.stack([count(self.unit), count(self.char)])
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(self.tree, axis=1)], axis=1)
        self.n_units, self.n_chars = sums[:, self.first[1:]] - sums[:, self.first[:-1]]
        step = 1
        while step <= self.n_blocks.max(initial=0):
            # An entry of twice the stride takes in the entry one stride below it.
            at = np.flatnonzero(self.local % (2 * step) == 0)
            self.tree[:, at] += self.tree[:, at - step]
            step *= 2
        self.step = step

    def cut(self, text: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte position and number of code points in front of unit ``after`` (0-based) of each text."""
        done = np.zeros(len(text), np.int64)
        units, chars = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        step = self.step
        while step:
            to = done + step
            may = np.flatnonzero(to <= self.n_blocks[text])
            node = self.first[text[may]] + to[may] - 1
            may, node = (x[units[may] + self.tree[0, node] <= after[may]] for x in (may, node))
            done[may] += step
            units[may] += self.tree[0, node]
            chars[may] += self.tree[1, node]
            step //= 2
        place = self.offsets[text] + done * self.block
        end = self.offsets[text + 1]
        place = np.minimum(place, end)
        # The cut lies in one block: its place is that of the unit still wanted there.
        here = np.flatnonzero(place < end)
        for some in np.array_split(here, max(1, len(here) // 4096)):
            at = place[some][:, None] + np.arange(self.block)
            open_ = at < end[some][:, None]
            at = np.minimum(at, len(self.data) - 1)
            seen = np.cumsum(self.unit[at] & open_, axis=1)
            want = (after - units)[some]
            shift = np.argmax(seen > want[:, None], axis=1)
            chars[some] += np.take_along_axis(np.cumsum(self.char[at] & open_, axis=1), shift[:, None], axis=1)[:, 0] - 1
            place[some] += shift
        return place, chars


def _draws(seed: str, ids: list) -> np.ndarray:
    hashes = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(hashes), ">u4").reshape(-1, 4).astype(np.int64)


def _transform(seed: str, plain_from: int, spm_below: int, block: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p_mark, s_mark, m_mark = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.blocks(batch, "_text", 4 << 20):
                texts = rows.column("_text").fill_null("").cast(pa.string())
                _, off, buf = texts.buffers()
                offsets = np.frombuffer(off, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                raw = buf.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if offsets[-1] > offsets[0] else b""
                offsets -= offsets[0]
                at = Texts(np.frombuffer(raw, np.uint8), offsets, block)
                h = _draws(seed, rows.column("_id").to_pylist())
                marked = np.zeros(len(texts), dtype=bool)
                for m in (PREFIX, SUFFIX, MIDDLE):
                    marked |= np.asarray(pa.compute.match_substring(texts, m))
                form = np.where((h[:, 2] % 100 >= plain_from) | marked | (np.diff(offsets) == 0), 0, np.where(h[:, 3] % 100 < spm_below, 2, 1))
                cuts = np.sort(h[:, :2] % (at.n_units + 1)[:, None], axis=1)
                some = np.flatnonzero(form > 0)
                b1, c1 = at.cut(some, cuts[some, 0])
                b2, c2 = at.cut(some, cuts[some, 1])
                out = [raw[offsets[i] : offsets[i + 1]] if not form[i] else b"" for i in range(len(texts))]
                for i, x, y in zip(some.tolist(), b1.tolist(), b2.tolist(), strict=True):
                    pre, mid, end = raw[offsets[i] : x], raw[x:y], raw[y : offsets[i + 1]]
                    out[i] = b"".join([p_mark, pre, s_mark, end, m_mark, mid] if form[i] == 1 else [s_mark, end, p_mark, pre, m_mark, mid])
                sizes = np.zeros((2, len(texts)), np.int64)
                sizes[:, some] = c1, c2 - c1
                new = [
                    pa.array(at.n_units, pa.int64()), pa.array(np.array(FORMS, dtype=object)[form], pa.string()),
                    *[pa.array(x, pa.int64(), mask=form == 0) for x in sizes], pa.array(out, pa.binary()).cast(pa.string()),
                ]
                keep = [c for c in rows.schema.names if c not in ("_id", "_text")]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *new], names=[*keep, *_NEW])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20, block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` without their text, and of it units ``n``, ``form``, the sizes of prefix and middle in code points, and ``output``.

    Of a hundred documents those with a third draw of ``plain_from`` or more stay plain, and
    of the others those with a fourth draw below ``spm_below`` take the form with the suffix first.
    """
    kept = [c for c in docs.columns if c not in (text_col, *_NEW)]
    rows = docs.select(*kept, F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n long, form string, prefix_chars long, middle_chars long, output string"])
    return rows.mapInArrow(_transform(seed, plain_from, spm_below, block), schema)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that a form was made of; its marks stand once each, as a text that holds one stays plain."""
    out = F.col(output)
    head, middle = F.substring_index(out, MIDDLE, 1), F.substring_index(out, MIDDLE, -1)
    # Both marks in front have the size of PREFIX; the first is cut off.
    head = F.substr(head, F.lit(len(PREFIX) + 1))
    first, second = (lambda m: F.substring_index(head, m, 1)), (lambda m: F.substring_index(head, m, -1))
    psm, spm = F.concat(first(SUFFIX), middle, second(SUFFIX)), F.concat(second(PREFIX), middle, first(PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
