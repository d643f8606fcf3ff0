import random
import re

import numpy as np
import xxhash

from citescope.llm import simhash as S
from citescope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance=3):
    """smallest index reachable from each index"""
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_of_odd_rows(make_docs, odd_rows):
    got = S.fingerprints(make_docs(odd_rows)).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted(
        (str(i), brute_fingerprint(t)) for i, t in odd_rows)


def test_links_connect_all_pairs_within_three_bits(spark):
    rng = random.Random(5)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        value = rng.getrandbits(64)
        values.add(value)
        for _ in range(4):  # chains of neighbours at distance 1 to 4
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values, key=lambda v: v - (1 << 64) if v >> 63 else v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r.node: r.component for r in components(edges).collect()}
    want = brute_components(values)
    assert [got.get(v, v) for v in signed] == [signed[i] for i in want]
    for r in edges.collect():
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3


def test_no_side_of_the_links_is_broadcast(spark):
    """All of them are made by explode, 65 rows and more a fingerprint; the planner takes them
    for as few as the fingerprints are."""
    edges = S.links(spark.range(60).selectExpr("shiftleft(1L, cast(id as int)) AS fp"))
    plan = edges._jdf.queryExecution().executedPlan()
    assert "Broadcast" not in plan.toString()
    assert len(edges.collect()) == 60 * 59 // 2  # any two single bits meet in their own variant
    assert "Broadcast" not in plan.toString()  # as it ran


def test_components_of_chains_stars_and_loops(spark):
    edges = ([(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
             + [(5, 5), (3, 4), (4, 3)])
    got = {r.node: r.component
           for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(200, 260)} == {7} and got[4] == 3 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_and_kept_rows(make_docs, odd_rows):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    rows = odd_rows + [(20, " ".join(base)), (21, " ".join(near)), (22, " ".join(base).upper())]
    docs = make_docs(rows)
    got = S.near_duplicates(docs).collect()
    ids = [i for i, _ in rows]
    label = brute_components([brute_fingerprint(t) for _, t in rows])
    smallest = {}
    for i, c in zip(ids, label):
        if i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    want = sorted((str(i), smallest.get(c)) for i, c in zip(ids, label))
    assert sorted((str(r.doc_id), r.component_id) for r in got) == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        {str(smallest.get(c)) for c in label})


def test_one_row_of_every_group_stays(make_docs):
    """Ids that are null, repeated, or stand for several texts."""
    a, b, c, d = ("alpha one two three", "beta four five six", "gamma seven eight", "delta nine ten")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, c), (None, d), (None, d), (4, None),
            (None, "")]
    kept = sorted(((r.doc_id, r.text) for r in S.keep_one(make_docs(rows)).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (3, c), (None, d), (4, None)], key=str)
    rng = random.Random(17)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 4))) for _ in range(20)]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(texts)) for _ in range(60)]
    label = brute_components([brute_fingerprint(t) for _, t in rows])
    kept = S.keep_one(make_docs(rows)).collect()
    of_text = {t: k for (_, t), k in zip(rows, label)}
    assert sorted(of_text[r.text] for r in kept) == sorted(set(label))
    for r in kept:
        ids = [i for (i, _), k in zip(rows, label) if k == of_text[r.text] and i is not None]
        assert r.doc_id == min(ids, default=None)


def test_empty_table(make_docs):
    assert S.near_duplicates(make_docs([])).collect() == []
    assert S.keep_one(make_docs([])).collect() == []


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"a{i}" for i in range(1000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text.encode()) == whole == brute_fingerprint(text)
    assert np.uint64(whole) >= 0
