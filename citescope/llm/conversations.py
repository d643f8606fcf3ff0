"""Conversation structure repair: cheapest edits by a square-root checkpointed dynamic program.

The rows of a conversation in order of turn (nulls first, then role and text) are kept (K,
cost 0), given the role user or assistant (R, 3) or deleted (D, 4; required for blank texts and
for repeats of a role and text seen earlier); rows with an empty text and one of these roles may
be inserted anywhere (I, 3); a truncated row that stays costs 3. The roles' initials must then
read ``(s?(ua)+)?``. Of the cheapest edits those with the ASCII-least initials are taken.

A state is where a sequence of roles stands in that pattern; the cost of finishing from each of
the four states is a backward vector. Rows are cut into blocks at the bounds of a range
partitioning, so that a conversation of any length is spread over tasks:

1. every block yields its costs from state to state, a 4 x 4 matrix, and its counts;
2. per conversation the matrices give the backward vector behind every block, the checkpoints;
3. every block yields the state in which the least walk leaves it, by the state it starts in,
   and these give the state in which each block is entered;
4. every block is walked forward: backward vectors are kept only at every sqrt(rows)-th row, the
   rows between two of them are recomputed when the walk reaches them, and the first edit in
   ASCII order that is tight (its cost plus the cost behind it is the cost here) is emitted.

What is held is one byte a row and the texts of the one block. Which rows are repeats is found by
hashed groups, not in order: a row is the first of its role and text, or not.

Defined cases: a null role or text is one space; a null turn comes first and takes no part in
gaps; rows of a null ``conv_id`` are one conversation; rows of one turn stand by role, then the
first 32 characters of the text, then its SHA-256; equal rows are repeats of the first; an empty
table gives no rows; other columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from citescope.llm.batches import BATCH_BYTES, in_arrow
from citescope.session import scratch_path

# Fixed values of the edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BIG = 1 << 60
# States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a. Where a kept initial (s, u, a,
# other) leads, and where an inserted or new role leads: its name follows from the state.
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
PUT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
FINAL = (0, 2 * INSERT, INSERT, 0)
BLANK, REPEAT, CUT = 1, 2, 3  # faults; a row's code is its initial + 4 x its fault
LEGAL = {(0, 1), (1, 2), (2, 1)}
SPACES = "\t\n\x0b\x0c\r "
CONV = ["c1", "c0"]
ORDER = ["t1", "t0", "role", "start", "digest"]


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with known faults: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped
    (0), loses its text (1) or the signs ``.!?`` in it (2), comes twice (3) or gets the role
    user (4). Nulls are written as one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return (rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(
            F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"), fault.alias("fault"))
        .where("fault <> 0")
        .withColumn("fault", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2)))
                                       .otherwise(F.array(F.lit(1)))))
        .drop("fault"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their place: conversation, turn, role, start and digest of the text; no nulls."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    return rows.select(
        F.col("conv_id").isNotNull().cast("int").alias("c1"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c0"),
        F.col("turn").isNotNull().cast("int").alias("t1"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t0"),
        filled("role").alias("role"), filled("text").alias("text")).select(
        *CONV, "t1", "t0", "role", F.substring("text", 1, 32).alias("start"),
        F.unhex(F.sha2("text", 256)).alias("digest"), "text")


def _judged(rows: DataFrame) -> DataFrame:
    """One row per different row: its code, the code of its repeats, and how many there are."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    own = (F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(CUT))
    same = _keyed(rows).groupBy(*CONV, *ORDER, own.alias("own")).agg(F.count("*").alias("n"))
    first = (same.groupBy(*CONV, "role", "digest")
             .agg(F.min("t1").alias("t1"),
                  F.min(F.expr("if(t1 = 1, t0, null)")).alias("t0"))
             .withColumn("t0", F.expr("if(t1 = 0, 0L, t0)"))
             .withColumn("is_first", F.lit(1)))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = (F.when(F.col("own") == BLANK, BLANK).when(F.col("is_first").isNull(), REPEAT)
             .otherwise(F.col("own")))
    again = F.when(F.col("own") == BLANK, BLANK).otherwise(REPEAT)
    # A row is met by the first of its text only where it is that row: no key is hot.
    return same.join(first, [*CONV, "t1", "t0", "role", "digest"], "left").select(
        *CONV, *ORDER, "n", (kind + 4 * fault).alias("code"), (kind + 4 * again).alias("again"))


def _bounds(judged: DataFrame) -> DataFrame | None:
    """Places inside conversations at which rows are cut into blocks, per conversation: the first
    places of range partitions, so at most as many as there are shuffle partitions."""
    firsts = (judged.select(*CONV, *ORDER).repartitionByRange(*CONV, *ORDER)
              .groupBy(F.spark_partition_id().alias("part"))
              .agg(F.min(F.struct(*CONV, *ORDER)).alias("at")).select("at.*").collect())
    if len(firsts) < 2:
        return None
    spark = judged.sparkSession
    schema = judged.select(*CONV, *ORDER).schema
    return (spark.createDataFrame(firsts, schema).groupBy(*CONV)
            .agg(F.collect_list(F.struct(*ORDER)).alias("cuts")))


def _in_blocks(rows: DataFrame, bounds: DataFrame | None) -> DataFrame:
    if bounds is None:
        return rows.withColumn("block", F.lit(0))
    here = F.struct(*ORDER)
    return (rows.join(F.broadcast(bounds), CONV, "left")
            .withColumn("block", F.coalesce(
                F.size(F.filter("cuts", lambda cut: cut <= here)), F.lit(0))).drop("cuts"))


def _before(code: int, behind: tuple) -> tuple:
    """The costs before a row from those behind it; inserted rows before it included."""
    kind, fault = code & 3, code >> 2
    cost = [DELETE + x for x in behind]
    if fault not in (BLANK, REPEAT):
        stay = TRUNCATED if fault == CUT else 0
        for s in range(4):
            to = KEPT.get((s, kind))
            if to is not None:
                cost[s] = min(cost[s], stay + behind[to])
            cost[s] = min(cost[s], stay + REROLE + behind[PUT[s]])
    return tuple(min(cost[s], INSERT + cost[PUT[s]], 2 * INSERT + cost[PUT[PUT[s]]])
                 for s in range(4))


def _walk(codes: bytes, behind: tuple, state: int) -> Iterator[list]:
    """Per row its edits in order as (letter, role of an inserted or renamed row); at last the
    state in which the rows leave. Costs are kept at every sqrt-th row and recomputed between."""
    step = isqrt(len(codes)) + 1
    kept = {}
    vector = behind
    for i in range(len(codes) - 1, -1, -1):
        vector = _before(codes[i], vector)
        if i % step == 0:
            kept[i] = vector
    for start in range(0, len(codes), step):
        end = min(len(codes), start + step)
        vectors = [kept.get(end, behind)]
        for i in range(end - 1, start - 1, -1):
            vectors.append(_before(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(start, end):
            here, after = vectors[i - start], vectors[i - start + 1]
            kind, fault = codes[i] & 3, codes[i] >> 2
            stay = TRUNCATED if fault == CUT else 0
            edits = []
            while True:
                if here[state] == DELETE + after[state]:
                    edits.append(("D", None))
                    break
                if here[state] == INSERT + here[PUT[state]]:
                    edits.append(("I", ROLE[state]))
                    state = PUT[state]
                    continue
                to = KEPT.get((state, kind))
                if to is not None and here[state] == stay + after[to]:
                    edits.append(("K", None))
                    state = to
                    break
                edits.append(("R", ROLE[state]))
                state = PUT[state]
                break
            yield edits
    yield state


def _matrix(codes: bytes) -> list[int]:
    """Costs from each state before the rows to each behind them, row by row."""
    columns = []
    for to in range(4):
        vector = tuple(0 if s == to else BIG for s in range(4))
        for code in reversed(codes):
            vector = _before(code, vector)
        columns.append(vector)
    return [columns[to][s] for s in range(4) for to in range(4)]


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows with equal keys, streamed."""
    rows = (r for batch in batches for r in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[k] for k in keys))


def _batched(arrow: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)],
                                             schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), arrow)],
                                         schema=arrow)


def _map_runs(rows: DataFrame, schema: str, function) -> DataFrame:
    """``function`` over batches, giving tuples of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(arrow, function(batches))

    return rows.transform(in_arrow, work, schema)


SUMMARY = ("c1 int, c0 long, block int, codes binary, matrix array<long>, turns array<long>, "
           "counts array<long>, first int, last int")


def _summaries(judged: DataFrame, bounds: DataFrame | None) -> DataFrame:
    """One row per block: the codes of its rows, its matrix and its counts (blank, repeated,
    truncated, illegal neighbours); ``turns`` has least, greatest and number of its turns."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (c1, c0, block), rows in _runs(batches, "c1", "c0", "block"):
            codes, turns = bytearray(), []
            for r in rows:
                codes.append(r["code"])
                codes += bytes([r["again"]]) * (r["n"] - 1)
                if r["t1"]:
                    if not turns:
                        turns = [r["t0"], r["t0"], 1]
                    elif turns[1] != r["t0"]:
                        turns[1:] = [r["t0"], turns[2] + 1]
            code = np.frombuffer(bytes(codes), np.uint8)
            kind, fault = code & 3, np.bincount(code >> 2, minlength=4)
            legal = np.zeros((4, 4), bool)
            legal[tuple(zip(*LEGAL))] = True
            illegal = int((~legal[kind[:-1], kind[1:]]).sum())
            yield (c1, c0, block, bytes(codes), _matrix(bytes(codes)), turns,
                   [*fault[1:].tolist(), illegal], int(kind[0]), int(kind[-1]))

    return (_in_blocks(judged, bounds).repartition(*CONV, "block")
            .sortWithinPartitions(*CONV, "block", *ORDER)
            .select(*CONV, "block", "t1", "t0", "n", "code", "again")
            .transform(_map_runs, SUMMARY, summarise))


CHECKPOINT = "c1 int, c0 long, block int, n_blocks int, behind array<long>, found array<long>"


def _checkpoints(summaries: DataFrame) -> DataFrame:
    """The backward vector behind every block; with a conversation's first block ``found``:
    gaps, blank, repeated, truncated, illegal, cost."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (c1, c0), rows in _runs(batches, "c1", "c0"):
            blocks = list(rows)  # at most one a shuffle partition
            behind, vectors = FINAL, []
            for b in reversed(blocks):
                vectors.append(list(behind))
                m = b["matrix"]
                behind = [min(m[4 * s + t] + behind[t] for t in range(4)) for s in range(4)]
            counts = [sum(x) for x in zip(*(b["counts"] for b in blocks))]
            for a, b in zip(blocks, blocks[1:]):
                counts[3] += (a["last"], b["first"]) not in LEGAL
            turns = [b["turns"] for b in blocks if b["turns"]]
            gaps = 0
            if turns:
                different = sum(t[2] for t in turns) - sum(
                    a[1] == b[0] for a, b in zip(turns, turns[1:]))
                gaps = turns[-1][1] - turns[0][0] + 1 - different
            found = [gaps, *counts, behind[0]]
            for b, vector in zip(blocks, reversed(vectors)):
                yield c1, c0, b["block"], len(blocks), vector, found
                found = None

    return (summaries.drop("codes").repartition(*CONV).sortWithinPartitions(*CONV, "block")
            .transform(_map_runs, CHECKPOINT, chain))


def _entries(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the state in which the least walk enters each."""

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                leaves = []
                for state in range(4):
                    for state in _walk(r["codes"], tuple(r["behind"]), state):
                        pass
                    leaves.append(state)
                yield r["c1"], r["c0"], r["block"], leaves

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (c1, c0), rows in _runs(batches, "c1", "c0"):
            state = 0
            for r in rows:
                yield c1, c0, r["block"], state
                state = r["leaves"][state]

    # Conversations of one block start in state 0.
    entered = (blocks.where("n_blocks > 1")
               .transform(_map_runs, "c1 int, c0 long, block int, leaves array<long>", leave)
               .repartition(*CONV).sortWithinPartitions(*CONV, "block")
               .transform(_map_runs, "c1 int, c0 long, block int, entry int", enter))
    return blocks.join(entered, [*CONV, "block"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(0)))


REPAIRED = ("c1 int, c0 long, block int, n_blocks int, audit string, messages long, "
            "transcript string, found array<long>")


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per block its head (codes, checkpoint, entry), then its rows in order."""
    for (c1, c0, block), rows in _runs(batches, "c1", "c0", "block"):
        head = next(rows)
        walk = _walk(head["codes"], tuple(head["behind"]), head["entry"])
        audit, said = [], []
        for r, edits in zip(rows, walk):
            for letter, role in edits:
                audit.append(letter)
                if letter == "I":
                    said.append(f"{role}:")
                elif letter == "R":
                    said.append(f"{role}:{r['text']}")
                elif letter == "K":
                    said.append(f"{r['role']}:{r['text']}")
        state = next(walk)
        if head["is_last"]:
            while FINAL[state]:
                audit.append("I")
                said.append(f"{ROLE[state]}:")
                state = PUT[state]
        yield (c1, c0, block, head["n_blocks"], "".join(audit), len(said), "\n".join(said),
               head["found"])


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text) in blocks: c1 (whether
    there is a conv_id), c0 (it), block, n_blocks, audit (the edits' initials), messages (rows
    left), transcript (their ``role:text``, joined by newlines) and, with the first block of a
    conversation, found (gaps, blank, repeated, truncated, illegal, cost)."""
    spark = rows.sparkSession
    folder = scratch_path(rows.sparkSession, "conversations")
    _judged(rows).write.parquet(f"{folder}/judged")
    judged = spark.read.parquet(f"{folder}/judged")
    bounds = _bounds(judged)
    _summaries(judged, bounds).write.parquet(f"{folder}/blocks")
    summaries = spark.read.parquet(f"{folder}/blocks")
    blocks = _entries(summaries.select(*CONV, "block", "codes")
                      .join(_checkpoints(summaries), [*CONV, "block"]))
    # The last block of a conversation has the final costs behind it, and it alone walks on.
    last = summaries.groupBy(*CONV).agg(F.max("block").alias("last_block"))
    heads = blocks.join(last, CONV).select(
        *CONV, "block", F.lit(0).alias("part"), "codes", "behind", "entry", "n_blocks", "found",
        (F.col("block") == F.col("last_block")).alias("is_last"))
    bodies = _in_blocks(_keyed(rows), bounds).withColumn("part", F.lit(1))
    return (heads.unionByName(bodies, allowMissingColumns=True)
            .repartition(*CONV, "block").sortWithinPartitions(*CONV, "block", "part", *ORDER)
            .select(*CONV, "block", "codes", "behind", "entry", "n_blocks", "found", "is_last",
                    "role", "text")
            .transform(_map_runs, REPAIRED, _emit))


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, the counts, cost, audit and ``repaired_sha256`` of the
    whole transcript. Blocks of one conversation are hashed as a stream, one at a time."""
    whole = F.sha2("transcript", 256)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (c1, c0), rows in _runs(batches, "c1", "c0"):
            state, audit, found, some, done = hashlib.sha256(), [], None, False, None
            for r in rows:
                audit.append(r["audit"])
                found = found or r["found"]
                done = r["done"]
                if r["messages"] and r["transcript"] is not None:
                    state.update(("\n" * some + r["transcript"]).encode())
                    some = True
            yield c1, c0, found, "".join(audit), done or state.hexdigest()

    one = F.col("n_blocks") == 1
    rows = (repaired.select(*CONV, "block", "audit", "messages", "found",
                            F.when(one, whole).alias("done"),
                            F.when(~one, F.col("transcript")).alias("transcript"))
            .repartition(*CONV).sortWithinPartitions(*CONV, "block")
            .transform(_map_runs, "c1 int, c0 long, found array<long>, audit string, sha string",
                       hashed))
    return rows.select(
        F.when(F.col("c1") == 1, F.col("c0")).alias("conv_id"),
        *(F.col("found")[i].alias(name) for i, name in enumerate(
            ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"])),
        "audit", F.col("sha").alias("repaired_sha256"))
