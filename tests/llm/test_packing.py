import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citescope.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=80))
def test_plan_uses_every_piece_once_within_capacity(lengths):
    counts = np.bincount(lengths, minlength=17)
    patterns = P.plan(counts, 16)
    used = Counter()
    for pattern, n in patterns:
        assert 0 < sum(pattern) <= 16 and n > 0
        for x in pattern:
            used[x] += n
    assert used == Counter(lengths)
    assert sum(n for _, n in patterns) <= 2 * -(-sum(lengths) // 16) + 1


def test_exact_complements_fill_gaps():
    # singles, pairs and triples that fill 16 exactly
    lengths = [10, 6] * 3 + [9, 4, 3] * 2 + [7, 5, 2, 2] + [16]
    patterns = P.plan(np.bincount(lengths, minlength=17), 16)
    assert sum(n for _, n in patterns) == sum(lengths) // 16
    assert all(sum(p) == 16 for p, _ in patterns)


def check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_odd_rows(make_docs, odd_rows):
    rows = P.pack(make_docs(odd_rows).repartition(3), PATH, end_id=0, capacity=2048).collect()
    check(rows, odd_rows, 2048)


def test_many_equal_lengths_over_many_tasks(make_docs):
    docs = [(i, "the " * (i % 5)) for i in range(200)]
    rows = P.pack(make_docs(docs).repartition(5), PATH, end_id=0, capacity=10).collect()
    assert check(rows, docs, 10) == -(-sum(i % 5 + 1 for i in range(200)) // 10)


def test_empty_table(make_docs):
    assert P.pack(make_docs([]), PATH, end_id=0).collect() == []
