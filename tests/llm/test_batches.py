import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citescope.llm.batches import WordTokens, chunks, utf8, word_ids, words_of

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def memo():
    return WordTokens(PATH, bound=50)


TEXT = st.text(st.one_of(st.sampled_from(list(" \t\n.,;!é'’ΣσİßǅA1a½́日<|>-")), st.characters(
    exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_memoised_tokens_equal_whole_texts(tokenizer, memo, texts):
    got = memo.encode(pa.array(texts, pa.string()))
    want = [np.array(e.ids, "<u4").tobytes()
            for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_special_strings_and_nulls(tokenizer, memo):
    texts = ["<|endoftext|>", "x<|endoftext|>y.", "<|ENDOFTEXT|>.", "don't, WE'LL.", None, ""]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode(pa.array(texts))] == want


def test_long_words_forgotten_and_repeated(tokenizer):
    memo = WordTokens(PATH, bound=3)
    for texts in (["a" * 100 + "!! b c", "d e f g b."], ["b", "a" * 100, None], ["g b c d. " * 3]):
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in memo.encode(pa.array(texts))] == want


def test_memo_takes_few_bytes_a_word():
    bound, draw = 10_000, random.Random(1)
    memo = WordTokens(PATH, bound=bound)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnop", k=9)) + "." for _ in range(5000))
             for _ in range(10)]
    memo.encode(pa.array(["warm up"]))
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for text in texts:
        memo.encode(pa.array([text]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 80 * bound


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_runs_without_ascii_white_space(texts):
    vocabulary, ids, bounds = word_ids(pa.array(texts, pa.string()))
    words = [[vocabulary[i].decode() for i in ids[a:b]] for a, b in zip(bounds, bounds[1:])]
    assert words == [WORD.findall(t or "") for t in texts]


def test_words_of_a_slice():
    column = pa.array(["a b", " c ", None, "b  d"]).slice(1, 3)
    vocabulary, ids, bounds = words_of(column)
    assert vocabulary.to_pylist() == ["c", "b", "d"]
    assert ids.tolist() == [0, 1, 2] and bounds.tolist() == [0, 1, 1, 3]


def test_chunks_cut_by_bytes_and_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aaaa", None, "b" * 50, "", "cc"])})
    parts = list(chunks(iter([batch, batch.slice(0, 0)]), limit=6))
    assert [utf8(p.column(0)) for p in parts] == [[b"aaaa", b""], [b"b" * 50, b""], [b"cc"]] or (
        sum((utf8(p.column(0)) for p in parts), []) == utf8(batch.column(0)))
