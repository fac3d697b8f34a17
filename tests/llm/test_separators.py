import numpy as np
import pytest

from sparvar.llm import queries, separators


def brute(ids, sep):
    out, run = [], 0
    for x in ids:
        if x == sep:
            out.append((run, True))
            run = 0
        else:
            run += 1
    return out + ([(run, False)] if run else [])


@pytest.mark.parametrize("block", [1, 3, 64])
def test_stitches_raw_files(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(separators, "GROUP_BLOCKS", 4)
    rng = np.random.default_rng(7)
    want = []
    for k, (n, p) in enumerate([(500, 0.02), (333, 0.5), (200, 0.0), (64, 1.0), (0, 0)]):
        ids = np.where(rng.random(n) < p, 9, rng.integers(10, 60000, n)).astype("<u2")
        ids.tofile(tmp_path / f"{k}.bin")
        want += [(k, *x) for x in brute(ids.tolist(), 9)]
    got = separators.count_tokens(separators.read_bins(spark, str(tmp_path), block_tokens=block, run_blocks=5), 9).collect()
    rows = sorted(got, key=lambda r: (r.file, r.block, 1 << 30 if r.nth is None else r.nth))
    assert [(int(r.file[-5]), r.n_tokens, r.closed) for r in rows] == want


def test_texts_to_counts(spark, make, tmp_path, sf):
    path = queries.tokenizer_path("byte_bpe_50k.tiktoken")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (-3, "<|endoftext|> x"), (-4, "long " * 4000), (-4, "again"), (None, "no id"), (-5, "é\r\n\t 12345 \U0001f642")]
    enc = separators._tokenizer(path)
    want = sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in rows), key=str)
    for k, block in enumerate((50, 1 << 16)):
        folder = str(tmp_path / f"t{k}")
        separators.write_flat(make(rows), folder, path, queries.SEPARATOR, block_tokens=block)
        got = separators.count_tokens(spark.read.parquet(folder), queries.SEPARATOR).collect()
        assert sorted(((r.doc, r.n_tokens) for r in got), key=str) == want and all(r.closed for r in got)
    separators.write_flat(make([]), str(tmp_path / "e"), path, queries.SEPARATOR)
    assert separators.count_tokens(spark.read.parquet(str(tmp_path / "e")), queries.SEPARATOR).count() == 0


def test_half_an_id_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        separators.read_bins(spark, str(tmp_path)).collect()
