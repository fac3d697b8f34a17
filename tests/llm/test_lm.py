import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvar.llm import attention_lm as A
from sparvar.llm import lm_scores, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def test_base_counts_and_scores(spark, make, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "x " * 3000), (-3, "other text"), (-4, "same"), (-4, "same"), (None, "the unknownword")]
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    got = lm_scores.score_texts(make(rows), part != 2, path, queries.SEPARATOR, max_ids=40_000).collect()
    words = [WORD.findall((t or "").translate(LOW)) for _, t in rows]
    c = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        if learned(i):
            c.update(w)
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        own = [*w, "\n"]
        want[str((i, len(own), sum(c[x] > 0 for x in own), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own), 6)))] += 1
    assert Counter(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 and r.score >= r.base_score - 0.302 for r in got)
    none = lm_scores.score_texts(make([(1, "a b"), (2, None)]), F.lit(False), path, queries.SEPARATOR).collect()
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)} and len(none) == 2
    assert lm_scores.score_texts(make([]), F.lit(True), path, queries.SEPARATOR).count() == 0


def small_model(rng, size=90):
    w = A.initial(size)
    w.lag[:] = rng.standard_normal(len(w.lag)) * 0.1
    class_of = np.arange(size) % A.CLASSES
    inner = A.within_class(rng.random((A.CLASSES + 1, size)), class_of)
    return w, class_of, A.Model(w, class_of, inner, np.arange(size) % 3 == 0)


def test_windows_score_each_id_once_like_a_loop():
    rng = np.random.default_rng(2)
    w, class_of, model = small_model(rng)
    end = 89
    texts = [np.append(rng.integers(0, 89, n), end) for n in (0, 1, 31, 32, 33, 100)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.score(np.concatenate(texts), starts, end, chunk=3)
    for t, s in zip(texts, got, strict=True):
        x, total = np.append([end], t[:-1]), 0.0
        for i in range(len(t)):
            low = max(0, i // A.STEP * A.STEP - A.CONTEXT)
            past = x[low : i + 1]
            e = np.exp((w.embed[past] @ w.key) @ (w.embed[x[i]] @ w.query) / np.sqrt(A.HEAD) + w.lag[i - np.arange(low, i + 1)])
            h = np.maximum(w.embed[x[i]] @ w.residual + (e / e.sum()) @ (w.embed[past] @ w.value) @ w.out, 0)
            z = h @ w.top + w.bias
            before = A.CLASSES if model.starts_word[t[i]] else class_of[x[i]]
            total += (z[class_of[t[i]]] - np.log(np.exp(z).sum())) / np.log(10) + model.inner[before, t[i]]
        assert abs(total - s) < 1e-3 * (1 + abs(total))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    w = A.initial(30)
    ids, target = rng.integers(0, 30, (3, 12)), rng.integers(0, A.CLASSES, (3, 12))
    _, grads = A._step(w, ids, target)
    for p, g in zip(w.all()[1:], grads[1:], strict=True):
        spot = tuple(0 for _ in p.shape)
        keep = p[spot]
        p[spot] = keep + 1e-2
        up = A._step(w, ids, target)[0]
        p[spot] = keep - 1e-2
        down = A._step(w, ids, target)[0]
        p[spot] = keep
        assert abs((up - down) / 2e-2 - g[spot]) < 2e-3 + 0.05 * abs(g[spot])


def test_within_class_is_a_distribution():
    rng = np.random.default_rng(4)
    class_of = rng.integers(0, A.CLASSES, 500)
    p = 10.0 ** A.within_class(rng.integers(0, 4, (A.CLASSES + 1, 500)), class_of).astype(float)
    for row in p:
        sums = np.bincount(class_of, row, minlength=A.CLASSES)
        assert np.allclose(sums[np.unique(class_of)], 1, atol=1e-3)


def test_a_pass_learns_from_every_id_and_moves_add_up():
    rng = np.random.default_rng(6)
    size, ids = 80, rng.integers(0, 79, 1000)
    class_of = np.arange(size) % A.CLASSES
    first = A.Learner(A.initial(size))
    kept = A.as_rows(first.w)
    one = A.Pass(first, class_of, 79, batch=4)
    for at in range(0, 1000, 77):
        one.add(ids[at : at + 77])
    at, n, moves = one.moves()
    assert np.array_equal(A.as_rows(first.w), kept)  # what tasks share stays as it was
    inputs = np.append([79], ids[:-1])
    assert np.array_equal(one.seen, np.bincount(inputs, minlength=size)) and set(at[at < size]) == set(inputs)
    after = A.moved(first.w, at, n, moves)
    assert np.allclose(A.as_rows(after), A.as_rows(one.learner.w), atol=1e-5)
    twice = A.moved(first.w, at, 2 * n, 2 * moves)  # a second task that moved alike
    assert np.allclose(A.as_rows(twice), A.as_rows(after), atol=1e-6)


def test_learns_from_texts_beyond_the_sample(spark, make, monkeypatch):
    """With next to no sample, weights and counts still come from all training texts."""
    seen = {}
    moved, within = A.moved, A.within_class
    monkeypatch.setattr(A, "moved", lambda w, at, n, m: seen.update(n=n.max()) or moved(w, at, n, m))
    monkeypatch.setattr(A, "within_class", lambda t, c: seen.update(counts=t.sum()) or within(t, c))
    rows = [(i, f"alpha beta {'gamma' if i % 2 else 'delta'} word{i} again") for i in range(300)] + [(None, "never learned")]
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    lm_scores.score_texts(make(rows), F.col("doc_id") % 3 != 0, path, queries.SEPARATOR, max_ids=1)
    enc = A.tokenizer(path)
    want = sum(1 + len(enc.encode_ordinary(" " + t)) for i, t in rows if i is not None and i % 3)
    assert (seen["n"], seen["counts"]) == (want, want)


def test_probabilities_of_all_next_ids_sum_to_one(spark, make, monkeypatch):
    """For the model as trained: classes mix word starts and inner ids, and some may be empty."""
    made, build = [], A.Model.__init__
    monkeypatch.setattr(A.Model, "__init__", lambda self, *a: made.append(self) or build(self, *a))
    rows = [(i, f"unbelievable tokenization {'xylophones' if i % 2 else 'disestablish'} qzx{i} again") for i in range(300)]
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    lm_scores.score_texts(make(rows), F.lit(True), path, queries.SEPARATOR, max_ids=20_000)
    model, size = made[0], queries.SEPARATOR + 1
    starts = np.zeros(size, dtype=bool)
    starts[: len(A.begins_with_space(path))] = A.begins_with_space(path)[:size]
    assert any(0 < starts[model.class_of == c].mean() < 1 for c in np.unique(model.class_of))
    ids = A.tokenizer(path).encode_ordinary(" unbelievable tokenization qzx7")
    for n in (0, 1, len(ids)):
        x = np.tile(np.array([queries.SEPARATOR, *ids[:n]]), (size, 1))
        y = np.zeros((size, x.shape[1]), np.int64)
        y[:, -1] = np.arange(size)
        live = np.zeros(y.shape, dtype=bool)
        live[:, -1] = True
        full = np.pad(x, ((0, 0), (A.STEP - x.shape[1], 0)), constant_values=queries.SEPARATOR)
        pad = ((0, 0), (A.STEP - x.shape[1], 0))
        p = 10.0 ** model._windows(full, np.pad(y, pad), np.pad(live, pad)).astype(float)
        assert abs(p.sum() - 1) < 2e-3


def test_an_empty_class_takes_no_probability():
    w = A.initial(40)
    class_of = np.arange(40) % 5
    inner = A.within_class(np.random.default_rng(8).integers(0, 9, (A.CLASSES, 40)), class_of)
    model = A.Model(w, class_of, inner)
    x, y = np.tile(np.arange(A.STEP), (40, 1)), np.tile(np.arange(40)[:, None], (1, A.STEP))
    live = np.zeros(y.shape, dtype=bool)
    live[:, -1] = True
    assert abs((10.0 ** model._windows(x, y, live).astype(float)).sum() - 1) < 1e-3


@pytest.mark.parametrize("task_ids", [500, 1])
def test_weights_come_from_every_training_text(spark, make, monkeypatch, task_ids):
    """Rounds by shares of the texts, or epochs over all: no text is left out, none is sampled."""
    rows = [(i, f"alpha beta {'gamma' if i % 2 else 'delta'} word{i} again") for i in range(200)]
    seen, counts = [], []
    moved, within = A.moved, A.within_class
    monkeypatch.setattr(A, "moved", lambda w, at, n, m: seen.append(n.max()) or moved(w, at, n, m))
    monkeypatch.setattr(A, "within_class", lambda t, c: counts.append(t.sum()) or within(t, c))
    monkeypatch.setattr(lm_scores, "TASK_IDS", task_ids * 10)
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    first = lm_scores.score_texts(make(rows), F.lit(True), path, queries.SEPARATOR).orderBy("doc_id").collect()
    enc = A.tokenizer(path)
    want = sum(1 + len(enc.encode_ordinary(" " + t)) for _, t in rows)
    epochs = max(1, -(-task_ids * 10 // want))
    assert sum(seen) == 2 * want * epochs and counts == [want]  # weights and their sums of squares
    assert first == lm_scores.score_texts(make(rows), F.lit(True), path, queries.SEPARATOR, max_ids=1).orderBy("doc_id").collect()
