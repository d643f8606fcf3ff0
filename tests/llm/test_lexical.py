import math
import random
import re
from collections import Counter

import pytest

from citescope.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items):
    """item_id, rank, doc_id, score rows, items by position."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, bag in bags:
            m = 100 - 25 + (25 * bag.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:20], 1)]
    return sorted(map(str, out))


def search(spark, docs, items):
    table = spark.createDataFrame(
        [(*d, "x", 1, "x") for d in docs], "doc_id long, text string, item string, n long, bag string")
    wanted = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, h string")
    return L.search(table.repartition(3), wanted)


def check(spark, docs, items):
    got = search(spark, docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"),
                          ("score", "bigint")]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(docs, items)


def test_terms_of_odd_texts():
    import pyarrow as pa

    texts = ["A-Z ÀÉ x\x00y", None, "", "ÄbC'd 日本 9.9", "  ", "\x7f~"]
    for column in (pa.array(texts), pa.array(["skip", *texts, "skip"]).slice(1, len(texts))):
        vocabulary, ids, bounds = L.terms(column)
        words = vocabulary.take(pa.array(ids)).to_pylist()
        assert [words[a:b] for a, b in zip(bounds, bounds[1:])] == [terms(t) for t in texts]


def test_random_corpus_with_copies_and_ties(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÉTÉ", "Main"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)]
    docs = [(i, rng.choice(texts)) for i in range(400)]
    docs += [(rng.randrange(400), "w1 main hot") for _ in range(100)]  # one large group of copies
    docs += [(None, "w1 main hot"), (None, "w2, only w2"), (5, None), (6, ""), (7, "...")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 8)))) for i in range(30)]
    items += [(3, "w1 w1 hot"), (3, "w1 w1 hot"), (None, "only"), (90, "nowhere to be found"), (91, None)]
    check(spark, docs, items)


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(80)]
    items = [(i, " ".join(rng.choices(words, k=4))) for i in range(6)]
    monkeypatch.setattr(L, "ITEM_BYTES", 30)
    assert len(list(L._blocks(spark.createDataFrame(items, "item_id long, text string")))) > 1
    check(spark, docs, items)


def test_small_steps_give_the_same(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(120)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(9)]
    monkeypatch.setattr(L, "CELLS", 40)
    check(spark, docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([], []),
                                         ([(1, None), (2, "!")], [(1, "a")]),
                                         ([(1, "a b")], [(1, "?"), (2, None)])])
def test_empty_tables(spark, docs, items):
    assert search(spark, docs, items).collect() == []


def test_equal_hashes_are_verified(spark, monkeypatch):
    """With one hash for all, classes are still told apart by bag and m."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(L.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    rng = random.Random(13)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(90)]
    check(spark, docs, [(i, " ".join(rng.choices(words, k=3))) for i in range(8)])
