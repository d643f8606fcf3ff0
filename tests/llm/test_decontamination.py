import random
from itertools import combinations

import numpy as np
import pytest

from citescope.llm import decontamination as D


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows],
                                 "item_id long, text string, words string, key string")


def brute(docs, rows, min_words=D.MIN_WORDS, identity=D.IDENTITY):
    """All diagonals of all pairs, without seeds."""
    def cores(text):
        found = [w.strip(D.SIGNS.decode()).lower() for w in (text or "").split()]
        return [w for w in found if w]

    out = set()
    for i, text in docs:
        own = cores(text)
        for item, t in rows:
            words = cores(t)
            if i is None or item is None or len(words) < D.MIN_ITEM_WORDS:
                continue
            least = min(min_words, len(words))
            for diagonal in range(-len(words), len(own)):
                equal = [0 <= diagonal + k < len(own) and words[k] == own[diagonal + k]
                         for k in range(max(0, -diagonal), min(len(words), len(own) - diagonal))]
                if any(sum(equal[a:b]) >= identity * (b - a) for a in range(len(equal))
                       for b in range(a + least, len(equal) + 1)):
                    out.add((i, item))
                    break
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    tests = [(i, " ".join(text(n))) for i, n in enumerate((15, 20, 40, 60, 6, 9, 3))]
    docs = []
    for i, (_, t) in enumerate(tests):
        words = t.split()
        around = text(30), text(30)
        docs.append((10 * i, " ".join(around[0] + words + around[1])))            # verbatim
        changed = list(words)
        for k in range(4, len(words), 6):                                          # one in six
            changed[k] = "other"
        docs.append((10 * i + 1, " ".join(around[0] + changed + around[1])))
        docs.append((10 * i + 2, " | ".join(w.upper() + "***" for w in words)))    # signs, case
        docs.append((10 * i + 3, " ".join(around[0] + words[:5] + around[1])))     # too little
    docs += [(500 + i, " ".join(text(200))) for i in range(10)]
    return docs, tests


def test_planted_overlaps_against_brute_force(spark, make_docs, case):
    docs, tests = case
    got = D.leaks(make_docs(docs), items(spark, tests)).collect()
    want = brute(docs, tests)
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(10 * i, i) for i in range(6)} <= want and (60, 6) not in want
    assert {(10 * i + 1, i) for i in range(4)} <= want and {(10 * i + 2, i) for i in range(6)} <= want
    for r in got:
        assert D.IDENTITY * r.n_words <= r.n_equal <= r.n_words
        if r.doc_id == 10 * r.item_id:
            assert (r.doc_start, r.item_start) == (30, 0) or r.n_words > len(
                tests[r.item_id][1].split()) - 1


def test_odd_rows_repeats_and_nulls(spark, make_docs, odd_rows):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    tests = items(spark, [(1, line), (1, line), (2, line), (None, line), (3, None), (4, ""),
                          (5, "..."), (6, "the")])
    docs = make_docs(odd_rows + [(50, line), (50, line), (None, line)])
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(docs, tests).collect())
    assert sorted(set(got)) == [(50, 1), (50, 2)]
    kept = D.keep_clean(docs, tests)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        [str(i) for i, _ in odd_rows])


def test_rows_are_judged_by_their_own_text(spark, make_docs):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [(1, line), (1, "a clean text"), (None, line), (None, "another clean text"), (2, line)]
    kept = D.keep_clean(make_docs(rows), items(spark, [(1, line)])).collect()
    assert sorted(r.text for r in kept) == ["a clean text", "another clean text"]


def test_masks_reach_every_pattern_of_substitutions():
    """A window of an overlap agrees under some mask, whichever words of 12 to 25 differ; longer
    overlaps hold one of these."""
    for n in range(12, 26):
        windows = [sum(1 << i + at for i, use in enumerate(m) if use == "1")
                   for m in D.MASKS for at in range(n - len(m) + 1)]
        for changed in combinations(range(n), n - -(-8 * n // 10)):
            bits = sum(1 << i for i in changed)
            assert any(w & bits == 0 for w in windows), (n, changed)


def test_overlap_with_three_neighbours_substituted(spark, make_docs):
    words = [f"word{i}" for i in range(15)]
    changed = words[:6] + ["x", "y", "z"] + words[9:]
    got = D.leaks(make_docs([(1, " ".join(changed))]), items(spark, [(1, " ".join(words))])).collect()
    assert [(r.doc_id, r.n_words, r.n_equal) for r in got] == [(1, 15, 12)]


def test_empty_tables(spark, make_docs):
    some = make_docs([(1, "a b c d e f g h i j k l m")])
    assert D.leaks(make_docs([]), items(spark, [(1, "a b c d e f")])).collect() == []
    assert D.leaks(some, items(spark, [])).collect() == []
    assert D.keep_clean(some, items(spark, [])).count() == 1


def test_longest_run_equals_all_runs():
    rng = random.Random(9)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randint(0, 30))], bool)
        got = D.longest_run(equal, 5, 0.8)
        runs = [(a, b) for a in range(len(equal)) for b in range(a + 5, len(equal) + 1)
                if 1000 * equal[a:b].sum() >= 800 * (b - a)]
        best = max(runs, key=lambda r: (r[1] - r[0], -r[1]), default=None)
        assert got == best


def test_full_bitmap_changes_nothing(spark, make_docs, case, monkeypatch):
    docs, tests = case
    monkeypatch.setattr(D, "FILTER_BITS", 12)
    monkeypatch.setattr(D, "_bitmap", lambda keys: np.ones(1 << 12, bool))
    got = D.leaks(make_docs(docs), items(spark, tests)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, tests)
