"""Language-model scores from a small causal self-attention model in numpy.

Words become subword ids of a public vocabulary.  Attention over the last ids predicts
the class of the next one; within a class, counts of the whole training corpus give the
id, depending on the class of the id before it.  So

    P(next) = P(class | attention over the context) * P(next | class, class before)

All training texts are learned from, in tasks.  Classes come from what stands before and
after each id in the whole corpus, and so does each id's first row of weights.  Then tasks
take gradient steps, in rounds that each have a share of the training texts, and the moves
of the tasks are averaged after a round, each row of weights by the ids that moved it.
Every training text is in one round; nothing is sampled.

Scoring cuts each text into windows of ``CONTEXT + STEP`` ids that overlap by
``CONTEXT``: a window scores its last ``STEP`` ids, so each id is scored once, with at
least ``CONTEXT`` ids of its text before it where the text has them.  Windows are padded
and masked, and many run as one batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import words as W

CONTEXT, STEP = 8, 24
WIDTH, HEAD, HIDDEN, CLASSES = 24, 16, 32, 64
NEIGHBOURS = 192


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def begins_with_space(path: str) -> np.ndarray:
    encoding = tokenizer(path)
    return np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(encoding.n_vocab)])


class WordIds:
    """Ids of the words of blocks; each distinct word of a task is encoded once."""

    def __init__(self, path: str, limit: int = 300_000):
        self.encoding, self.limit, self.spaced = tokenizer(path), limit, begins_with_space(path)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int64), 0
        self.begin, self.size = np.zeros(1 << 15, dtype=np.int64), np.zeros(1 << 15, dtype=np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a space, and where each word's begin.

        Words go through the library as one text; its ids that begin with a space begin
        the words, and should their number differ, each word goes through alone.
        """
        ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(words)).decode()) if words else [], dtype=np.int64)
        begin = np.flatnonzero(self.spaced[ids])
        if len(begin) != len(words) or (len(begin) and begin[0]):
            lists = [self.encoding.encode_ordinary(" " + w.decode()) for w in words]
            ids, sizes = np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64)
            begin = np.cumsum(sizes) - sizes
        return ids, begin

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        ids, begin = self.encode(words)
        old = len(self.place)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while old + len(keys) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, np.zeros_like(self.begin)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[old : old + len(keys)] = begin + self.used
        self.size[old : old + len(keys)] = np.diff(np.append(begin, len(ids)))
        self.used += len(ids)
        self.place.update(zip(keys, range(old, old + len(keys)), strict=True))

    def of_block(self, block: W.Block, hashes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, and where each text starts."""
        unique, at, code = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > self.limit:
            self._clear()
        keys, get = unique.tolist(), self.place.get
        spot = np.array([get(h, -1) for h in keys], dtype=np.int64)
        fresh = np.flatnonzero(spot < 0)
        if len(fresh):
            spot[fresh] = len(self.place) + np.arange(len(fresh))
            self._learn([keys[i] for i in fresh.tolist()], [block.word(i) for i in at[fresh].tolist()])
        spot = spot[code] if len(code) else np.zeros(0, np.int64)
        lengths = self.size[spot]
        total = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        starts = total[block.first] + np.arange(len(block) + 1)
        out = np.full(int(starts[-1]), end, dtype=np.int64)
        place = np.arange(int(total[-1]))
        out[place + np.repeat(block.text_of_words(), lengths)] = self.flat[place + np.repeat(self.begin[spot] - total[:-1], lengths)]
        return out, starts


@dataclass
class Weights:
    embed: np.ndarray  # ids x WIDTH
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    residual: np.ndarray
    out: np.ndarray
    top: np.ndarray  # HIDDEN x CLASSES
    bias: np.ndarray
    lag: np.ndarray  # by distance

    def all(self) -> list[np.ndarray]:
        return [self.embed, self.query, self.key, self.value, self.residual, self.out, self.top, self.bias, self.lag]


def initial(size: int, seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    embed = (rng.standard_normal((size, WIDTH)) * 0.3).astype(np.float32)
    return Weights(embed, normal(WIDTH, HEAD), normal(WIDTH, HEAD), normal(WIDTH, HEAD), normal(WIDTH, HIDDEN), normal(HEAD, HIDDEN), normal(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32), np.zeros(CONTEXT + STEP, np.float32))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _step(w: Weights, ids: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients on full windows ``ids`` (batch x length), ``target`` classes."""
    n, length = ids.shape
    x = w.embed[ids]
    q, k, v, r = x @ w.query, x @ w.key, x @ w.value, x @ w.residual
    scale = np.float32(1 / np.sqrt(HEAD))
    apart = np.arange(length)[:, None] - np.arange(length)[None]
    mask = np.where(apart >= 0, w.lag[np.maximum(apart, 0)], -np.inf).astype(np.float32)
    a = _softmax(q @ k.transpose(0, 2, 1) * scale + mask)
    c = a @ v
    pre = r + c @ w.out
    h = np.maximum(pre, 0)
    p = _softmax(h @ w.top + w.bias)
    flat = p.reshape(-1, CLASSES)
    rows = np.arange(len(flat))
    loss = -np.log(flat[rows, target.ravel()] + 1e-12).mean()
    dz = flat.copy()
    dz[rows, target.ravel()] -= 1
    dz /= len(flat)
    d_top, d_bias = h.reshape(-1, HIDDEN).T @ dz, dz.sum(0)
    dp = (dz @ w.top.T).reshape(pre.shape) * (pre > 0)
    d_out = c.reshape(-1, HEAD).T @ dp.reshape(-1, HIDDEN)
    dc = dp @ w.out.T
    da, dv = dc @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dc
    ds = a * (da - (da * a).sum(-1, keepdims=True))
    d_lag = np.bincount(np.maximum(apart, 0).ravel(), np.where(apart >= 0, ds.sum(0), 0).ravel(), minlength=len(w.lag)).astype(np.float32)
    dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q * scale
    flat_x = x.reshape(-1, WIDTH)
    grads = [flat_x.T @ g.reshape(len(flat_x), -1) for g in (dq, dk, dv, dp)]
    dx = dq @ w.query.T + dk @ w.key.T + dv @ w.value.T + dp @ w.residual.T
    order = np.argsort(ids.ravel(), kind="stable")
    own, first = np.unique(ids.ravel()[order], return_index=True)
    return loss, [(own, np.add.reduceat(dx.reshape(-1, WIDTH)[order], first)), *grads, d_out, d_top, d_bias, d_lag]


class Learner:
    """Adagrad on one set of weights."""

    def __init__(self, w: Weights, sums: list[np.ndarray] | None = None):
        self.w = w
        self.sums = sums or [np.full(p.shape, 1e-6, np.float32) for p in w.all()]

    def copy(self) -> Learner:
        return Learner(Weights(*[p.copy() for p in self.w.all()]), [s.copy() for s in self.sums])

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        _, grads = _step(self.w, x, y)
        own, g = grads[0]
        self.sums[0][own] += g * g
        self.w.embed[own] -= rate * g / np.sqrt(self.sums[0][own])
        for p, s, g in zip(self.w.all()[1:], self.sums[1:], grads[1:], strict=True):
            s += g * g
            p -= 0.25 * rate * g / np.sqrt(s)


def first_weights(count: np.ndarray, features: np.ndarray) -> Weights:
    """Weights whose row of each id are the main directions of what stands before and after it.

    ``features`` is as in ``classes``; ids that do not occur keep a random row.
    """
    w = initial(len(count))
    met = np.flatnonzero(count > 0)
    if len(met) > WIDTH:
        own = features[met]
        own = np.sqrt(own / np.maximum(own.sum(1, keepdims=True), 1))
        mass = (count[met] / count[met].sum()).astype(np.float32)[:, None]
        own -= (own * mass).sum(0)
        _, directions = np.linalg.eigh((own * mass).T @ own)
        own = own @ directions[:, ::-1][:, :WIDTH]
        w.embed[met] = own * (np.float32(0.3) / np.maximum(np.sqrt((own * own).mean()), 1e-6))
    return w


class Pass:
    """One pass of a learner over runs of ids, all of which are learned from."""

    def __init__(self, learner: Learner, class_of: np.ndarray, end: int, batch: int = 64, rate: float = 0.08):
        self.start, self.learner = as_rows(learner.w), learner.copy()
        self.start_sums = as_rows(Weights(*learner.sums))
        self.class_of, self.batch, self.rate = class_of, batch, rate
        self.size = len(class_of)
        self.seen = np.zeros(self.size)
        self.held = np.array([end], dtype=np.int64)

    def add(self, ids: np.ndarray) -> None:
        """``ids`` go on where the last ones ended; what fills no batch is held."""
        self.held = np.concatenate([self.held, ids])
        length = CONTEXT + STEP
        each = self.batch * length
        n = (len(self.held) - 1) // each
        for k in range(n):
            self._learn(k * each, each, length)
        self.held = self.held[n * each :]

    def _learn(self, at: int, n: int, length: int) -> None:
        x = self.held[at : at + n]
        self.seen += np.bincount(x, minlength=self.size)
        self.learner.step(x.reshape(-1, length), self.class_of[self.held[at + 1 : at + n + 1]].reshape(-1, length), self.rate)

    def moves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of weights that moved, the ids that moved each, and their product with the move."""
        length = CONTEXT + STEP
        left = len(self.held) - 1
        whole = left // length * length
        if whole:
            self._learn(0, whole, length)
        if left > whole:
            self._learn(whole, left - whole, left - whole)
        self.held = self.held[-1:]
        move = as_rows(self.learner.w) - self.start
        n = np.concatenate([self.seen, np.full(len(move) - self.size, self.seen.sum())])
        at = np.flatnonzero(n)
        return at, n[at], move[at] * n[at, None]

    def sums_moves(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """As ``moves``, of the learner's sums of squares, for the rows ``at``."""
        return (as_rows(Weights(*self.learner.sums)) - self.start_sums)[at] * n[:, None]


def as_rows(w: Weights) -> np.ndarray:
    """All weights as rows of ``WIDTH``: one for each id, then the others in order."""
    rest = np.concatenate([p.ravel() for p in w.all()[1:]])
    return np.vstack([w.embed, np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)]).astype(np.float64)


def moved(w: Weights, at: np.ndarray, n: np.ndarray, moves: np.ndarray) -> Weights:
    """Weights after the summed ``moves`` of all tasks."""
    rows = as_rows(w)
    rows[at] += moves / n[:, None]
    out, rest, used = [rows[: len(w.embed)]], rows[len(w.embed) :].ravel(), 0
    for p in w.all()[1:]:
        out.append(rest[used : used + p.size].reshape(p.shape))
        used += p.size
    return Weights(*[p.astype(np.float32) for p in out])


def spots(count: np.ndarray) -> np.ndarray:
    """Place of each id as a neighbour: its own for the most frequent, else a shared one."""
    spot = (W.mix(np.arange(len(count), dtype=np.uint64)) % np.uint64(NEIGHBOURS)).astype(np.int64)
    top = np.argsort(-count, kind="stable")[: NEIGHBOURS // 2]
    spot[top] = np.arange(len(top))
    return spot


def classes(count: np.ndarray, features: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Class of each id: k-means over what stands before and after it in the corpus.

    ``features`` (ids x 2 ``NEIGHBOURS``) counts the spots before each id, then those after.
    """
    size = len(count)
    often = np.flatnonzero(count >= 4)
    out = np.arange(size) % 4  # what the corpus hardly knows shares four classes
    if len(often) < CLASSES:
        return np.arange(size) % CLASSES
    features = features[often]
    features /= np.maximum(features.sum(1, keepdims=True), 1)
    np.sqrt(features, out=features)
    mass = count[often].astype(np.float64)
    centre = features[np.argsort(-mass, kind="stable")[: CLASSES - 4]].copy()
    for _ in range(rounds):
        near = (features @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        for c in range(len(centre)):
            own = near == c
            if own.any():
                centre[c] = np.average(features[own], axis=0, weights=mass[own])
    out[often] = 4 + near
    return out


def within_class(counts: np.ndarray, class_of: np.ndarray, keep: float = 2.0) -> np.ndarray:
    """log10 P(id | class, class before): ``counts`` has a row of ids for each class before.

    Counts given the class before are backed off to those of the class, and these to equal
    shares, so every id keeps some probability.
    """
    size = len(class_of)
    total = counts.sum(0) + 0.05
    plain = total / np.bincount(class_of, total, minlength=CLASSES)[class_of]
    out = np.empty((len(counts), size), np.float32)
    for before, row in enumerate(counts):
        mass = np.bincount(class_of, row, minlength=CLASSES)[class_of]
        kinds = np.bincount(class_of, row > 0, minlength=CLASSES)[class_of]
        back = keep + 0.5 * kinds
        out[before] = np.log10((row + back * plain) / (mass + back))
    return out


class Model:
    """Tables for scoring: everything that depends on one id alone is looked up.

    The row of ``inner`` is that of the class before, so over all next ids the probabilities
    sum to one.  Ids named by ``starts_word`` take the row ``CLASSES`` instead, whatever stands
    before; the sum stays one only if no class holds both kinds.
    """

    def __init__(self, w: Weights, class_of: np.ndarray, inner: np.ndarray, starts_word: np.ndarray | None = None):
        # Side by side, what is looked up together: key and value, query and residual.
        self.kv = np.hstack([w.embed @ w.key, w.embed @ w.value])
        self.qr = np.hstack([w.embed @ w.query / np.float32(np.sqrt(HEAD)), w.embed @ w.residual]).astype(np.float32)
        self.out, self.top = w.out, w.top
        # A class without ids is never next.
        self.bias = np.where(np.bincount(class_of, minlength=CLASSES) > 0, w.bias, -np.inf).astype(np.float32)
        self.class_of, self.inner, self.starts_word = class_of, inner, starts_word
        apart = CONTEXT + np.arange(STEP)[:, None] - np.arange(CONTEXT + STEP)[None]
        self.mask = np.where(apart >= 0, np.exp(w.lag[np.clip(apart, 0, len(w.lag) - 1)]), 0).astype(np.float32)

    def _windows(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> np.ndarray:
        """log10 P of the live ones of ``y`` (windows x STEP), given inputs ``x`` that end below them."""
        kv, qr = self.kv.take(x, axis=0), self.qr.take(x[:, -STEP:], axis=0)
        a = np.matmul(qr[:, :, :HEAD], kv[:, :, :HEAD].transpose(0, 2, 1))
        np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        a *= self.mask[:, -x.shape[1] :]
        c = np.matmul(a, kv[:, :, HEAD:])
        c /= a.sum(-1, keepdims=True) + np.float32(1e-20)
        last, c, r = x[:, -STEP:].ravel(), c.reshape(-1, HEAD), qr.reshape(-1, HEAD + self.top.shape[0])[:, HEAD:]
        if not live.all():
            keep = np.flatnonzero(live.ravel())
            last, c, y, r = last[keep], c[keep], y.ravel()[keep], r[keep]
        y = y.ravel()
        h = c @ self.out
        h += r
        np.maximum(h, 0, out=h)
        z = h @ self.top
        z += self.bias
        np.minimum(z, 60, out=z)
        picked = z[np.arange(len(y)), self.class_of[y]]
        np.exp(z, out=z)
        before = self.class_of[last]
        if self.starts_word is not None:
            before = np.where(self.starts_word[y], CLASSES, before)
        return (picked - np.log(z.sum(1))) / np.float32(np.log(10)) + self.inner[before, y]

    def score(self, ids: np.ndarray, starts: np.ndarray, end: int, chunk: int = 256) -> np.ndarray:
        """log10 probability of each text; a text's ids end with ``end``, which also stands before it."""
        n, lengths = len(starts) - 1, np.diff(starts)
        per = -(-lengths // STEP)
        owner = np.repeat(np.arange(n), per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        offset = (np.arange(len(owner)) - first[owner]) * STEP
        out = np.zeros(n)
        before = np.concatenate([[end], ids[:-1]])
        before[starts[:-1]] = end
        # A text's first window has nothing before it; later ones have a whole context.
        for rows, context in ((np.flatnonzero(offset == 0), 0), (np.flatnonzero(offset > 0), CONTEXT)):
            for at in range(0, len(rows), chunk):
                o, s = owner[rows[at : at + chunk]], offset[rows[at : at + chunk]]
                place = s[:, None] + np.arange(-context, STEP)
                live = place[:, context:] < lengths[o][:, None]
                spot = np.minimum(starts[o][:, None] + place, len(ids) - 1)
                value = self._windows(before[spot], ids[spot[:, context:]], live)
                out += np.bincount(np.broadcast_to(o[:, None], live.shape)[live], value, minlength=n)
        return out
