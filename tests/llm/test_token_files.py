import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citescope.llm import token_files as T
from citescope.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_round_trip_of_odd_rows(spark, make_docs, odd_rows, tokenizer):
    folder = scratch_path(spark, "tokens")
    files = T.write_token_files(make_docs(odd_rows).repartition(3), folder, PATH, end_id=2)
    assert files == T.open_token_files(folder)
    rows = T.read_token_files(spark, files, with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    at = 0
    for r, (_, text) in zip(rows, order):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert r.ids == want and (r.start, r.n_tokens) == (at, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_files_are_flat_ids_and_64_bit_offsets(spark, make_docs, tokenizer):
    folder = scratch_path(spark, "tokens")
    files = T.write_token_files(make_docs([(2, "b c"), (1, "a")]).coalesce(1), folder, PATH, 2)
    ids = np.concatenate([np.fromfile(f"{folder}/{name}.tokens", files.dtype)
                          for _, name, *_ in files.shards])
    want = [x for t in ("a", "b c")
            for x in tokenizer.encode(t, add_special_tokens=False).ids + [2]]
    assert ids.tolist() == want and files.dtype == "<u2"
    for _, name, n_docs, n_tokens, base in files.shards:
        offsets = np.fromfile(f"{folder}/{name}.offsets", "<i8")
        assert len(offsets) == n_docs + 1 and offsets[0] == 0 and offsets[-1] == n_tokens


def test_empty_table(spark, make_docs):
    files = T.write_token_files(make_docs([]), scratch_path(spark, "tokens"), PATH, 2)
    assert T.read_token_files(spark, files).collect() == []


def test_wide_vocabulary_uses_four_bytes(spark, make_docs, monkeypatch):
    monkeypatch.setattr(T, "vocabulary_dtype", lambda path: "<u4")
    folder = scratch_path(spark, "tokens")
    files = T.write_token_files(make_docs([(1, "a b")]), folder, PATH, 2)
    assert T.read_token_files(spark, files).first().n_tokens == 3
