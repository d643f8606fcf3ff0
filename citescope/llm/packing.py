"""Best-fit packing by exact-complement hashing.

Lengths are at most ``capacity``, so the whole corpus is planned on its length histogram
(``capacity`` counts, whatever the number of documents):

1. From the longest length down, the gap that a piece leaves is looked up among single lengths,
   sums of two and sums of three; a combination that fills the gap exactly is consumed as
   often as the counts of all its lengths allow. Sums of two are indexed by a count per sum
   that is kept up to date as lengths run out. Where no such sum exists the gap is narrowed by
   the longest piece that fits, and looked up again.
2. What is left goes best-fit decreasing into open sequences, again by whole groups.

Which combinations go first decides what is left, so the plan is made with a few orders, on
copies of the histogram, and the one with the fewest sequences is taken. The plan is a list of
patterns; pieces get their places from their rank among the pieces of
their length. Ranks need no global sort: a task numbers its pieces of each length, and prefix
sums over (length, task) counts give the bases.

Defined cases: null text is the empty text (its end id alone); a null ``doc_id`` is kept;
repeated rows are packed as rows of their own; an empty table gives no rows; other columns
are ignored; texts longer than the capacity are cut into pieces of exactly the capacity, the
last may be shorter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citescope.llm.batches import BATCH_BYTES, chunks, in_arrow, word_tokens
from citescope.session import scratch_path

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, task int, "
          "local_rank long")
STRATEGIES = [(False, 1.0), (True, 1.0), (False, 0.5), (True, 0.5), (True, 0.1)]
RANK_BITS = 50  # of a 64-bit search key; the rest holds the length


def exact_patterns(counts: np.ndarray, capacity: int, long_first: bool = True, share: float = 1.0
                   ) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that fill ``capacity`` exactly, consumed from ``counts`` in place. Of the
    combinations that fill a gap those with the longest (or shortest) parts come first; each is
    consumed up to ``share`` of what the counts allow, again and again until none is left."""
    patterns = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    have = counts > 0
    pair_sums = np.convolve(have.astype(np.int64), have.astype(np.int64))[:capacity + 1]

    def take(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        n = -int(-min(int(counts[x]) // m for x, m in need.items()) * share // 1)
        if not n:
            return False
        patterns.append((lengths, n))
        for x, m in need.items():
            counts[x] -= n * m
            if not counts[x]:
                have[x] = False
                ways = have[:capacity + 1 - x]
                pair_sums[x:] -= 2 * ways
                if 2 * x <= capacity:
                    pair_sums[2 * x] -= 1
        return True

    def pairs(total: int) -> Iterator[tuple[int, int]]:
        """Longer part first."""
        if total >= 2 and pair_sums[total] > 0:
            longer = np.arange(total - 1, (total - 1) // 2, -1)[::1 if long_first else -1]
            for j in longer[have[longer] & have[total - longer]].tolist():
                yield j, total - j

    def fillers(gap: int) -> Iterator[tuple[int, ...]]:
        if have[gap]:
            yield (gap,)
        yield from pairs(gap)
        if gap >= 3:
            third = np.arange(gap - 2, 0, -1)[::1 if long_first else -1]
            for k in third[have[third] & (pair_sums[gap - third] > 0)].tolist():
                for pair in pairs(gap - k):
                    if pair[0] <= k:
                        yield (k, *pair)

    def stacks(length: int) -> Iterator[tuple[int, ...]]:
        """The piece alone, then with more and more of the longest pieces that fit: where three
        parts are too short for the gap, it is narrowed first."""
        stack, gap = (length,), capacity - length
        while gap > 0:
            yield stack
            fitting = np.flatnonzero(have[:min(length, gap) + 1])[::-1].tolist()
            longest = next((x for x in fitting if counts[x] > stack.count(x)), None)
            if longest is None:
                return
            stack, gap = (*stack, longest), gap - longest

    for length in range(capacity - 1, 0, -1):
        taken = True
        while taken and counts[length]:
            taken = False
            for stack in stacks(length):
                for filler in fillers(capacity - sum(stack)):
                    taken |= take((*stack, *filler))
                    if not counts[length]:
                        break
                if taken or not counts[length]:
                    break
    return patterns


def best_fit_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over whole groups of equal sequences."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g in open_by_gap if g >= length), default=None)
            if gap is None:
                each = capacity // length
                whole, rest = divmod(left, each)
                for times, n in ((each, whole), (rest, 1)):
                    if times and n:
                        open_by_gap.setdefault(capacity - times * length, []).append(
                            ((length,) * times, n))
                left = 0
            else:
                pattern, n = open_by_gap[gap].pop()
                used = min(left, n)
                if used < n:
                    open_by_gap[gap].append((pattern, n - used))
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                open_by_gap.setdefault(gap - length, []).append(((*pattern, length), used))
                left -= used
    return [x for group in open_by_gap.values() for x in group]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) for a histogram indexed by length."""
    best: list[tuple[tuple[int, ...], int]] | None = None
    least = -(-int(np.arange(capacity + 1) @ np.asarray(counts, np.int64)) // capacity)
    for long_first, share in STRATEGIES:
        left = np.asarray(counts, np.int64).copy()
        found = exact_patterns(left, capacity, long_first, share)
        found += best_fit_patterns(left, capacity)
        size = sum(n for _, n in found)
        if best is None or size < sum(n for _, n in best):
            best = found
        if size == least:
            break
    return best or []


@dataclass
class Places:
    """Rank ranges of each length and the sequences and offsets they map to. A pattern is a
    run per distinct length, so there are at most (patterns) x (distinct lengths in one)."""

    key: np.ndarray       # length << RANK_BITS | first rank
    sequence: np.ndarray  # of the first rank
    offset: np.ndarray    # of the first piece of the run
    times: np.ndarray     # pieces of that length in one sequence

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]]) -> Places:
        used: Counter = Counter()
        rows, sequence = [], 0
        for lengths, n in patterns:
            offset = 0
            for length, times in sorted(Counter(lengths).items(), reverse=True):
                rows.append((length << RANK_BITS | used[length], sequence, offset, times))
                used[length] += n * times
                offset += length * times
            sequence += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*(np.ascontiguousarray(table[:, i]) for i in range(4)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << RANK_BITS) | rank
        i = np.searchsorted(self.key, key, side="right") - 1
        within = key - self.key[i]
        return (self.sequence[i] + within // self.times[i],
                self.offset[i] + within % self.times[i] * length)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, numbered within its task and length."""
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        tokens = word_tokens(tokenizer)
        for batch in chunks(batches, limit=BATCH_BYTES, tokens=True):
            encoded = [x + end for x in tokens.encode(batch.column(1))]
            n = np.array([-(-len(x) // step) for x in encoded])
            parts = [x[a:a + step] for x in encoded for a in range(0, len(x), step)]
            number = np.concatenate([np.arange(k) for k in n])
            length = np.array([len(x) // 4 for x in parts], np.int64)
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], np.arange(capacity + 2))
            rank = np.empty(len(parts), np.int64)
            rank[order] = np.arange(len(parts)) - first[length[order]] + seen[length[order]]
            seen += np.diff(first)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))),
                "piece": pa.array(number, pa.int32()), "start": pa.array(number * capacity),
                "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                "task": pa.array(np.full(len(parts), task, np.int32)),
                "local_rank": pa.array(rank)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).transform(in_arrow, cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces(docs, tokenizer, end_id, capacity).write.parquet(path)  # fixes tasks and ranks
    table = spark.read.parquet(path)
    per_task = table.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n  # at most `capacity` rows
    places = Places.of(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
                sequence, offset = places.find(length, rank)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                    names=[*columns, "sequence_id", "offset"])

    return (table.join(bases, ["length", "task"])
            .select(*columns, (F.col("base") + F.col("local_rank")).alias("rank"))
            .transform(in_arrow, place, "doc_id long, piece int, start long, length long, "
                               "ids_crc32 long, sequence_id long, offset long"))
