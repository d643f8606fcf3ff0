import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from citescope.llm import pieces as P
from citescope.llm import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return P.Pieces(PATH)


def check(own, library, texts):
    ids, decimals = own.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "") for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == want
    assert decimals == [",".join(map(str, x)).encode() for x in want]
    assert own.decode(pa.array(ids, pa.binary())) == [library.decode(x) for x in want]


ALPHABET = ["a", "b", " ", "  ", "▁", "the", "in", "\n", "\t", "é", "日", "本", "😀", "\x00",
            "<0x41>", "<s>", "ing", "tion", "aaaa", "    ", "ا", " ⁇ ", "=", "​"]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), min_size=1, max_size=8))
def test_same_ids_and_text_as_the_library(own, library, texts):
    check(own, library, texts)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_characters(own, library, texts):
    check(own, library, texts)


def test_pieces_of_the_vocabulary_side_by_side(own, library):
    rng = random.Random(2)
    check(own, library, ["".join(library.id_to_piece(rng.randrange(259, 32_000))
                                 for _ in range(rng.randint(1, 40))) for _ in range(500)])


def test_long_runs_and_long_words(own, library):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghi") for _ in range(20_000))
    check(own, library, [" " * 5_001, "ab" * 10_000, word, "日本語" * 5_000, "a" * 9_999,
                         "- " * 3_000, None, ""])


def test_ids_that_no_text_has(own, library):
    rng = random.Random(6)
    rows = [[rng.choice([rng.randrange(259), rng.randrange(32_000), rng.randrange(195, 259)])
             for _ in range(rng.randint(0, 12))] for _ in range(2_000)]
    packed = pa.array([np.array(x, "<u4").tobytes() for x in rows], pa.binary())
    assert own.decode(packed) == [library.decode(x) for x in rows]


def test_memo_generations(library, monkeypatch):
    monkeypatch.setattr(P, "MEMO_WORDS", 3)
    small = P.Pieces(PATH)
    for text in ["one two three four five", "one two", "six seven eight nine", "one nine", "two"]:
        check(small, library, [text, text])
    assert small.older


def test_rows_keep_their_columns(spark, make_docs, odd_rows, library):
    docs = make_docs(odd_rows).withColumnRenamed("words", "decimals")
    rows = P.decode(P.encode(docs, PATH), PATH).collect()
    assert len(rows) == len(odd_rows) and rows[0].kind == "x"
    want = sorted((str(i), t or "", library.encode(t or "")) for i, t in odd_rows)
    got = sorted((str(r.doc_id), r.text or "", np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    assert all(r.decoded.decode() == library.decode(np.frombuffer(r.ids, "<u4").tolist())
               for r in rows)
    assert P.encode(make_docs([]), PATH).collect() == []


def test_query_over_a_whole_table(spark, library):
    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    rows = queries.op12_sentencepiece(spark, folder).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode(text[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
