import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparvar.llm import codebooks, dac, fim, queries

# ------------------------------------------------------------------- token codes


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=1500), st.data())
@settings(max_examples=40, deadline=None)
def test_any_token_and_any_run(ids, data):
    ids = np.array(ids, dtype=np.uint32)
    file = dac.pack(ids, np.array([5]), np.array([False]), np.array([0, len(ids)]))
    codes = dac.Codes.of(file)
    assert [codes.token(i) for i in range(len(ids))] == ids.tolist()
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert codes.slice(a, b).tolist() == ids[a:b].tolist()


def test_one_token_reads_few_bytes():
    ids = np.random.default_rng(1).integers(0, 60000, 200_000).astype(np.uint32)
    file, read = dac.pack(ids, np.array([1]), np.array([False]), np.array([0, len(ids)])), []
    codes = dac.Codes(lambda at, size: read.append(size) or file[at : at + size])
    read.clear()
    assert codes.token(123_456) == ids[123_456]
    assert sum(read) < 200


HARD = ["", " ", "it's  DON'T\tx'sy'LL 12a3 a1b's", "a..'s ..'sam", "<|endoftext|> b<|startoftext|>c", "<|endoftex|>", "é̂ Áb e≠ İ ΑΣ x\x85y z \U0001f642!", "'" * 50, "x" * 5000, "long text, " * 3000, "\x1c\x1d a\x00b"]


@pytest.mark.parametrize("text", HARD)
def test_chunks_give_the_ids_of_whole_texts(text):
    import pyarrow as pa

    table = dac.ChunkIds(queries.tokenizer_path("word_bpe_49k.json"))
    ids, counts = table.encode(pa.array([text, "and", text]))
    want = table.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist()[: len(want)] == want and counts[0] == counts[2] == len(want)


@given(st.lists(st.text(st.sampled_from("abSst'rel.,-9 \ńé|<>Σ"), max_size=30), max_size=5))
@settings(max_examples=80, deadline=None)
def test_chunks_of_any_text(texts):
    import pyarrow as pa

    table = dac._chunk_ids(queries.tokenizer_path("word_bpe_49k.json"))
    ids, counts = table.encode(pa.array(texts, pa.string()))
    want = [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def brute_files(rows, path):
    from tokenizers import Tokenizer

    tk, start, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [40, 1 << 22])
def test_files_hold_documents_in_order(spark, make, tmp_path, file_ids):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = [(k, t) for k, t in enumerate(HARD)] + [(None, "no id"), (-3, None), (40, "same"), (40, "same"), (99, "last one's here")]
    files = dac.write_ids(make(rows, 4), str(tmp_path / "f"), path, 2, file_ids=file_ids)
    got = dac.read_documents(files).selectExpr("doc", "start", "n_tokens", "crc32(ids)").collect()
    want = brute_files(rows, path)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    # Any position over all files, and some beyond them.
    total = want[-1][1] + want[-1][2]
    ids = {r["start"] + k: int(x) for r in dac.read_documents(files).collect() for k, x in enumerate(np.frombuffer(r["ids"], "<u4"))}
    asked = spark.range(-5, total + 5, 7).withColumnRenamed("id", "position")
    found = {r.position: r.token for r in dac.tokens_at(files, asked, cell=64).collect()}
    assert found == {p: ids[p] for p in range(-5, total + 5, 7) if p in ids} and len(found) > 100


def test_empty_table_has_no_files(spark, make, tmp_path):
    files = dac.write_ids(make([]), str(tmp_path / "e"), queries.tokenizer_path("word_bpe_49k.json"), 2)
    assert files.count() == 0 and dac.read_documents(files).count() == 0


def test_op11_against_the_library(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_token_codes(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == brute_files(rows, queries.tokenizer_path("word_bpe_49k.json"))


# ---------------------------------------------------------------- fill in middle


def brute_fim(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, hx = len(units), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hx[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("block", [1, 7, 256])
def test_fill_in_middle(spark, make, block):
    texts = [None, "", "a", "<", "ab cd", "é́\U0001f642x " * 40, "letters" * 400, "a <P> b", "x<S>", "<M", "> <P S> <", "1 2\n3\r\n" * 300, "word " * 20_000, "中" * 999]
    rows = [(100 * i + k, t) for k, t in enumerate(texts) for i in range(6)] + [(None, "no id at all"), (7, "twice"), (7, "twice")]
    got = fim.fill_in_middle(make(rows), block=block).withColumn("back", fim.restored())
    assert {"lang", "source", "n_words", "h", "id"} <= set(got.columns)
    found = got.collect()
    key = lambda r: str(r[:5])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted((brute_fim(*r) for r in rows), key=key)
    assert sorted(((r.doc_id, r.back) for r in found), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(make):
    assert fim.fill_in_middle(make([])).count() == 0


@given(st.lists(st.text(st.sampled_from("ab 1é中\U0001f642\n"), max_size=60), min_size=1, max_size=6), st.sampled_from([1, 2, 3, 16]), st.data())
@settings(max_examples=150, deadline=None)
def test_tree_cuts_anywhere(texts, block, data):
    raw = [t.encode() for t in texts]
    at = fim.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), block)
    for i, t in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert at.n_units[i] == len(units) and at.n_chars[i] == len(t)
        k = data.draw(st.integers(0, len(units)))
        place, chars = at.cut(np.array([i]), np.array([k]))
        head = "".join(units[:k])
        assert (place[0] - at.offsets[i], chars[0]) == (len(head.encode()), len(head))


# ----------------------------------------------------------------- vector codes


@given(st.integers(1, 40), st.integers(1, 4), st.integers(0, 3), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_tree_finds_the_nearest(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-(3**spread), 3**spread + 1, (n, dim)) * (1 if spread < 3 else 10**6)
    rows = rng.integers(-(4**spread), 4**spread + 1, (60, dim)) * (1 if spread < 3 else 10**6)
    name, d = codebooks.Gnat(points).nearest(rows)
    want = codebooks.squares(rows, points)
    assert name.tolist() == want.argmin(1).tolist() and d.tolist() == want.min(1).tolist()


def test_tree_leaves_out_subtrees(monkeypatch):
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(256, 2)) * 10000).astype(np.int64)
    rows = (rng.normal(size=(500, 2)) * 10000).astype(np.int64)
    tree, seen = codebooks.Gnat(points), []
    plain = codebooks.squares
    monkeypatch.setattr(codebooks, "squares", lambda a, b: seen.append(len(a) * len(b)) or plain(a, b))
    name, _ = tree.nearest(rows)
    assert sum(seen) < 0.5 * 500 * 256 and name.tolist() == plain(rows, points).argmin(1).tolist()


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])]
    out, by = [], {}
    for i, v, lab in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        by[lab] = by.get(lab, 0) + out[-1][2]
    return [(i, c, e, by[lab]) for i, c, e, lab in out], books


@pytest.mark.parametrize("n", [0, 5, 120])
def test_vector_codes(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(size=16).round(2)], int(rng.integers(3)) if i % 4 else None) for i in rng.permutation(n) - 3]
    rows += [(1000, None, 1), (1001, [float("nan")] * 16, 1), (1002, [1.0] * 15 + [None], 1), (1003, [float("inf")] + [0.0] * 15, 2), (None, [0.5] * 16, 0)]
    if n > 50:
        rows += [(7, [0.25] * 16, 1), (7, [0.25] * 16, 1), (8, [-100.0] * 16, 2)] + [(2000 + k, [3.0] * 16, 2) for k in range(60)]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).selectExpr("*", "'c' AS code", "1 AS error", "2 AS part", "'i' AS _id").write.parquet(str(tmp_path / "t/embeddings.parquet"))
    got = queries.op13_vector_codes(spark, str(tmp_path / "t"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = got.collect()
    if not n:
        assert found == []
        return
    want, books = brute_codes(rows)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found) == sorted(want)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_codes_stand_for_entries(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(80)] + [(500, [1e30] * 8), (501, [1.0] * 7)], "vec_id long, embedding array<double>")
    books = codebooks.train(frame, parts=2, entries=8, rounds=3)
    rows = codebooks.decode(codebooks.encode(frame, books), books).join(frame, "vec_id").collect()
    assert len(rows) == 80
    for r in rows:
        x = np.floor(4096 * np.array(r.embedding)).astype(np.int64)
        assert ((x - np.array(r.approx)) ** 2).sum() == r.error
