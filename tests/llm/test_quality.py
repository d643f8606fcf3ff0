import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from citescope.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    n = len(words)
    times = Counter(tuple(words[i:i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if times[tuple(words[i:i + 3])] > 1
               for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def found(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts_of_odd_rows(spark, make_docs, odd_rows):
    rows = odd_rows + [(30, "a b c a b c d\na b c a b c d\nx"), (31, "1 2 3 4 " * 30),
                       (32, "a\x1cb c d <<&&")]
    docs = make_docs(rows)
    got = Q.judge(docs, Q.fit(docs, labels(spark, []))).collect()
    assert sorted((str(r.doc_id), found(r)) for r in got) == sorted(
        (str(i), brute(t)) for i, t in rows)
    assert all(r.kept != r.base_failed for r in got)  # without labels the base rule decides


@pytest.mark.parametrize("many", [1, 1 << 21])
def test_repeat_words_with_small_and_large_vocabularies(many):
    ids = np.array([5, 6, 7, 5, 6, 7, 8, 5, 6, 7, 1, 2, 1, 2, 1]) % max(9, many)
    bounds = np.array([0, 7, 10, 10, 15])
    assert Q.repeat_words(ids, bounds, max(9, many)).tolist() == [6, 0, 0, 5]


def test_blocks_of_words_list_all_grams_in_order():
    words = [b"a", b"x" * (2 * Q.BLOCK), b"", *(b"w%d" % i for i in range(30_000)), b"end"]
    word, bucket = Q.word_grams(words)
    ratio = np.random.default_rng(1).normal(size=Q.BUCKETS)
    at, found = 0, np.zeros(len(words))
    for a, b, own, of in Q.gram_blocks(words):
        assert a == at and b > a
        at = b
        found[a:b] = np.bincount(own, weights=ratio[of], minlength=b - a)
    assert at == len(words)
    assert np.array_equal(found, np.bincount(word, weights=ratio[bucket], minlength=len(words)))
    assert list(Q.gram_blocks([])) == []


def test_memory_of_scores_does_not_follow_the_grams():
    texts = pa.array([" ".join(f"word{i:07d}" for i in range(k, k + 500))
                      for k in range(0, 100_000, 500)])  # 1.2 MB, all words distinct
    tracemalloc.start()
    Q.counts_and_scores(texts, np.zeros(Q.BUCKETS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * texts.nbytes


def corpus():
    good = [(i, " ".join(f"plain{(i * 7 + j) % 61} words" for j in range(60))) for i in range(60)]
    bad = [(100 + i, " ".join(f"plain{(i * 5 + j) % 61}### words%%%" for j in range(60)))
           for i in range(20)]
    return good, bad


def test_ratio_tells_trusted_from_junk_and_labels_are_not_needed_to_be_judged(spark, make_docs):
    good, bad = corpus()
    rows = [(i, 1, 0) for i, _ in good[:30]] + [(i, 0, 0) for i, _ in bad[:10]]
    rows += [(100, None, 0), (None, 1, 0), (0, 0, 0), (0, 1, 0), (99_999, 1, 1)]
    docs = make_docs(good + bad)
    model = Q.fit(docs, labels(spark, rows))
    got = {r.doc_id: r for r in Q.judge(docs, model).collect()}
    assert all(got[i].kept for i, _ in good) and not any(got[i].kept for i, _ in bad)
    kept = Q.keep(docs, model)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in good]


def test_counts_do_not_depend_on_partitions_or_join_strategy(spark, make_docs, monkeypatch):
    good, bad = corpus()
    known = labels(spark, [(i, 1, 0) for i, _ in good[:30]] + [(i, 0, 0) for i, _ in bad[:10]])
    one = Q.fit(make_docs(good + bad).coalesce(1), known)
    monkeypatch.setattr("citescope.llm.joins.broadcast_if_small", lambda side, n: side)
    monkeypatch.setattr(Q, "broadcast_if_small", lambda side, n: side)
    many = Q.fit(make_docs(good + bad).repartition(7), known)
    assert np.array_equal(one.ratio, many.ratio) and one.threshold == many.threshold


def test_target_and_raw_multinomials_equal_a_direct_count(spark, make_docs):
    docs = [(1, "ab ab c"), (2, "ab d")]
    model = Q.fit(make_docs(docs), labels(spark, [(1, 1, 0), (2, 0, 0)]))
    raw, target = np.full(Q.BUCKETS, Q.SMOOTHING), np.full(Q.BUCKETS, Q.SMOOTHING)
    for _, text in docs:
        for word in text.split():
            for b in Q.word_grams([word.encode()])[1]:
                raw[b] += 1
                target[b] += text == "ab ab c"
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(model.ratio, want)


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    model = Q.fit(docs, labels(spark, [(1, 1, 0)]))
    assert Q.judge(docs, model).collect() == [] and Q.keep(docs, model).collect() == []
