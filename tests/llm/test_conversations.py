import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from citescope.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, block string, codes string, c0 string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """(gaps, blank, repeated, truncated, illegal, cost), audit, transcript of (turn, role, text)
    rows, by least (cost, audit) over all edits."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        faults.append("blank" if not solid else "repeat" if (role, text) in seen
                      else "cut" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    delta = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    put = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserted):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        if inserted < 3:
            c, a, m = best(i, put[state], inserted + 1) or (10**9, "", ())
            out.append((c + 3, "I" + a, (f"{name[put[state]]}:", *m)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, m = best(i + 1, state, 0)
            out.append((c + 4, "D" + a, m))
            if faults[i] not in ("blank", "repeat"):
                stay = 3 * (faults[i] == "cut")
                to = delta.get((state, role[:1]))
                if to:
                    c, a, m = best(i + 1, to, 0)
                    out.append((c + stay, "K" + a, (f"{role}:{text}", *m)))
                c, a, m = best(i + 1, put[state], 0)
                out.append((c + stay + 3, "R" + a, (f"{name[put[state]]}:{text}", *m)))
        return min(out, default=None)

    import sys
    sys.setrecursionlimit(20_000)
    cost, audit, said = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    return ((max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
             faults.count("blank"), faults.count("repeat"), faults.count("cut"),
             sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost), audit, "\n".join(said))


def random_rows(rng, n):
    rows = []
    for _ in range(n):
        turn = rng.choice([None, rng.randrange(n + 1), rng.randrange(n + 1)])
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
        text = rng.choice(["Yes.", "No!", "Well", "  ", "", None, "Why? \n", f"Line {rng.random()}.",
                           f"Ünd {rng.random()}", "a" * 40 + rng.choice("bc") + "."])
        rows += [(turn, role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


def check(spark, talks):
    rows = [(i, *r, "x", "x", "x") for i, talk in talks.items() for r in talk]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: r for r in C.digests(C.repair(df)).collect()}
    assert len(got) == len(talks)
    for i, talk in talks.items():
        counts, audit, transcript = brute(talk)
        r = got[i]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) == counts, talk
        assert r.audit == audit, talk
        assert r.repaired_sha256 == hashlib.sha256(transcript.encode()).hexdigest()


def test_random_conversations(spark):
    rng = random.Random(3)
    talks = {i: random_rows(rng, rng.randint(1, 12)) for i in range(300)}
    talks[None] = random_rows(rng, 9)
    check(spark, talks)


@pytest.mark.parametrize("seed", range(3))
def test_conversations_over_many_blocks(spark, seed):
    rng = random.Random(seed)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        talks = {0: random_rows(rng, 400), 1: random_rows(rng, 30), 2: [(0, "user", "Hm.")] * 50,
                 3: [(None, "assistant", f"{i}.") for i in range(60)], 4: random_rows(rng, 3)}
        check(spark, talks)
        rows = spark.createDataFrame([(0, t, r, x) for t, r, x in talks[0]],
                                     "conv_id long, turn long, role string, text string")
        assert C.repair(rows).count() > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_walk_is_the_least_of_all_edits():
    rng = random.Random(8)
    for _ in range(400):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(1, 40)))
        vector = C.FINAL
        for code in reversed(codes):
            vector = C._before(code, vector)
        matrix = C._matrix(codes)
        assert list(vector) == [min(matrix[4 * s + t] + C.FINAL[t] for t in range(4))
                                for s in range(4)]
        *edits, _ = C._walk(codes, C.FINAL, 0)
        cost = sum({"D": 4, "I": 3, "K": 0, "R": 3}[a] for e in edits for a, _ in e)
        cost += sum(3 * (c >> 2 == C.CUT and e[-1][0] != "D") for c, e in zip(codes, edits))
        assert cost <= vector[0] <= cost + 6


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, 0, 1, 2) for t in (None, *range(40))]
    got = C.damage(spark.createDataFrame(rows, SCHEMA.split(", block")[0]))
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fault == 0:
            continue
        row = (c, t, "user" if fault == 4 else role,
               "" if fault == 1 else "One Two" if fault == 2 else text)
        want += [row] * (2 if fault == 3 else 1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.repair(empty)).collect() == []
    assert C.damage(empty).collect() == []


def test_query_gives_every_conversation(spark, tmp_path):
    from citescope.llm import queries

    # Conversation 7 loses its only row, conversation 8 has a null row.
    lost = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    left = next(t for t in range(100) if zlib.crc32(f"8:{t}".encode()) % 20 > 4)
    rows = [(7, lost, "user", "Hi."), (8, left, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_conversations(spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(got[7]) == (7, 0, 0, 0, 0, 0, 0, "", nothing)
    assert tuple(got[8]) == (8, 0, 1, 0, 0, 0, 4, "D", nothing)


def test_whole_table_against_brute_force(spark):
    from citescope.llm import queries

    folder = "/root/testdata/sf0.001"
    talks = {}
    for r in C.damage(queries.table(spark, folder, "conversations")).collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    for r in queries.op11_conversations(spark, folder).collect():
        counts, audit, transcript = brute(talks.get(r.conv_id, []))
        assert tuple(r)[1:7] == counts and r.audit == audit
        assert r.repaired_sha256 == hashlib.sha256(transcript.encode()).hexdigest()
    assert queries.op11_conversations(spark, folder).where(F.col("audit") != "").count()
