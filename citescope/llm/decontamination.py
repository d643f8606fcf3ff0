"""Benchmark decontamination by spaced-seed hashing.

Words are compared without case and without the signs at their ends; a word of signs alone is
no word. A mask selects some positions of a window of words; windows of a benchmark item and a
document that agree there have the same hash, whatever stands at the ignored positions. Items
too short for the widest mask have masks of their whole length too, contiguous and with each one
position left out, which finds every overlap at 0.8 of fewer than ten words.

1. Every window of every item is hashed under every mask, and so is every window of every
   document. A bitmap of fixed size over the item hashes lets a document's task drop windows
   whose hash no item has; it never drops a true hit, and the join that follows is exact.
2. The join gives candidates (document, item, diagonal).
3. Candidates are verified on whole texts: along the diagonal, the longest run of at least
   ``min_words`` words (the whole item, if shorter) that begins and ends anywhere and agrees in
   at least ``identity`` of its words. Substituted words are tolerated at any position.

Defined cases: null texts have no words; items of fewer than ``MIN_ITEM_WORDS`` words are no
evidence and never match; repeated items and repeated rows are found each; rows with a null
doc_id or item_id never match in ``leaks``; ``keep_clean`` judges every row by its text, so ids
may be null or repeated; of several overlaps of a document with an item the longest is
reported, then the one with most agreeing words, then the first; empty tables give no rows;
other columns are ignored (``leaks``) or pass through untouched (``keep_clean``); texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm.batches import chunks, in_arrow, word_ids
from citescope.llm.joins import broadcast_if_small
from citescope.session import scratch_path

# Weight 5, spans 6 to 10: every overlap of 12 words and more at 0.8 has a window that agrees
# under one of them, whichever words are substituted.
MASKS = ("111011", "1101011", "11100101", "110010011", "1010011001")
MIN_ITEM_WORDS = 5
MIN_WORDS = 12
IDENTITY = 0.8
FILTER_BITS = 24  # the bitmap has 2 ** FILTER_BITS bits, two megabytes
SIGNS = b".,;:!?#*$%&|<>()[]{}\"'`~^=+-_/\\@"
MULTIPLIER = 0x9E3779B97F4A7C15
LEAKS = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, bounds of each text)."""
    vocabulary, ids, bounds = word_ids(column)
    cores = [w.strip(SIGNS) for w in vocabulary]
    value = np.array([xxhash.xxh64_intdigest(c.decode().lower().encode()) if c else 0
                      for c in cores], np.uint64)
    real = np.array([bool(c) for c in cores], bool)[ids]
    kept = np.concatenate([[0], np.cumsum(real)])
    return value[ids[real]], kept[bounds]


def whole_masks(n: int) -> list[str]:
    """Masks over all ``n`` words of a short item: contiguous, and with one position ignored."""
    return ["1" * n, *("1" * i + "0" + "1" * (n - i - 1) for i in range(n))]


def seeds(hashes: np.ndarray, bounds: np.ndarray, masks: list[str], short: frozenset[str] = frozenset()
          ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask: (text, position in it, key) of every window. Masks in ``short`` take only
    windows that are a whole text."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for mask in masks:
        m = len(hashes) - len(mask) + 1
        if m <= 0:
            continue
        start = np.flatnonzero(doc[:m] == doc[len(mask) - 1:])
        if mask in short:
            start = start[np.diff(bounds)[doc[start]] == len(mask)]
        key = np.full(m, xxhash.xxh64_intdigest(mask), np.uint64)
        for i, use in enumerate(mask):
            if use == "1":
                key = (key ^ hashes[i:i + m]) * np.uint64(MULTIPLIER)
                key ^= key >> np.uint64(29)
        yield doc[start], start - bounds[doc[start]], key[start]


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def _item_seeds(items: DataFrame, masks: list[str], short: frozenset[str]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            for text, at, key in seeds(*word_hashes(batch.column(1)), masks, short):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text)), pa.array(at),
                     pa.array(key.view(np.int64))], names=["item_id", "item_at", "key"])

    return items.transform(in_arrow, rows, "item_id long, item_at long, key long").distinct()


def _item_words(items: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, bounds = word_hashes(batch.column(1))
            words = [hashes[a:b].view(np.int64).tolist() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.int64()))],
                names=["item_id", "words"])

    return (items.transform(in_arrow, rows, "item_id long, words array<long>")
            .where(F.size("words") >= MIN_ITEM_WORDS))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which values the top bits of the keys take, gathered as one fixed-size set."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            seen[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        packed = np.packbits(seen).tobytes()
        step = 1 << 12
        parts = [(i, packed[i:i + step]) for i in range(0, len(packed), step)]
        parts = [(i, x) for i, x in parts if x.strip(b"\0")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in parts], pa.int64()),
             pa.array([x for _, x in parts], pa.binary())], names=["at", "bits"])

    packed = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in keys.select("key").transform(in_arrow, rows, "at long, bits binary").toLocalIterator():
        packed[r["at"]:r["at"] + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return np.unpackbits(packed).astype(bool)


def longest_run(equal: np.ndarray, least: int, identity: float) -> tuple[int, int] | None:
    """(first, last + 1) of the longest run of at least ``least`` positions of which at least
    ``identity`` are equal; among the longest the first."""
    if len(equal) < least:
        return None
    # a run is good when the sum of (equal - identity) over it is not negative
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1000, 0) - round(1000 * identity))])
    lowest = np.minimum.accumulate(total)  # falls; its first value <= total[e] is the best start
    starts = np.searchsorted(-lowest, -total, side="left")
    size = np.arange(len(total)) - starts
    end = int(np.argmax(size))
    return (int(starts[end]), end) if size[end] >= least else None


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS,
          identity: float = IDENTITY) -> DataFrame:
    """One row per document and item that overlap: word positions of the longest overlap, its
    words, and how many of them are equal."""
    spark = docs.sparkSession
    docs, items = _texts(docs, "doc_id"), _texts(items, "item_id").where("item_id IS NOT NULL")
    path = scratch_path(spark, "items")
    _item_words(items).write.parquet(path)
    words = spark.read.schema("item_id long, words array<long>").parquet(path)
    widest = max(map(len, MASKS))
    short = [r.n for r in words.select(F.size("words").alias("n")).where(f"n < {widest}")
             .distinct().collect()]  # fewer than `widest` values
    whole = frozenset(mask for n in short for mask in whole_masks(n))
    masks = [*MASKS, *sorted(whole.difference(MASKS))]
    seed_path = scratch_path(spark, "seeds")
    _item_seeds(items.join(words.select("item_id").distinct(), "item_id"), masks,
                whole.difference(MASKS)).write.parquet(seed_path)
    item_seeds = spark.read.schema("item_id long, item_at long, key long").parquet(seed_path)
    bitmap = _bitmap(item_seeds)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            for text, at, key in seeds(*word_hashes(batch.column(1)), masks):
                on = bitmap[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                if on.any():
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text[on])), pa.array(at[on]),
                         pa.array(key[on].view(np.int64))], names=["doc_id", "doc_at", "key"])

    candidates = (docs.where("doc_id IS NOT NULL")
                  .transform(in_arrow, hits, "doc_id long, doc_at long, key long")
                  .join(item_seeds, "key")
                  .select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
                  .distinct())
    candidate_path = scratch_path(spark, "candidates")
    candidates.write.parquet(candidate_path)
    candidates = spark.read.schema("doc_id long, item_id long, diagonal long").parquet(
        candidate_path)
    # item words travel once per (document, item); a document's list follows its own length
    per_doc = (candidates.groupBy("doc_id", "item_id")
               .agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
               .join(words, "item_id").groupBy("doc_id")
               .agg(F.collect_list(F.struct("item_id", "diagonals", "words")).alias("found")))
    suspects = docs.join(broadcast_if_small(candidates.select("doc_id").distinct(), 8),
                         "doc_id", "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, bounds = word_hashes(batch.column(1))
            out = []
            for i, (doc, found) in enumerate(zip(batch.column(0).to_pylist(),
                                                 batch.column(2).to_pylist())):
                own = hashes[bounds[i]:bounds[i + 1]]
                best: dict[int, tuple] = {}
                for f in found:
                    item = np.array(f["words"], np.int64).view(np.uint64)
                    for diagonal in f["diagonals"]:
                        first, last = max(0, -diagonal), min(len(item), len(own) - diagonal)
                        if last <= first:
                            continue
                        equal = item[first:last] == own[first + diagonal:last + diagonal]
                        run = longest_run(equal, min(min_words, len(item)), identity)
                        if run:
                            a, b = run
                            rank = (b - a, int(equal[a:b].sum()), -(first + diagonal + a))
                            if f["item_id"] not in best or rank > best[f["item_id"]][0]:
                                best[f["item_id"]] = (rank, first + a)
                out += [(doc, item_id, -r[2], at, r[0], r[1]) for item_id, (r, at) in best.items()]
            names = [x.split()[0] for x in LEAKS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[k] for row in out], pa.int64()) for k in range(len(names))],
                names=names)

    return suspects.join(per_doc, "doc_id").transform(in_arrow, verify, LEAKS)


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text has no verified overlap, all columns as they are. Texts
    are told apart by a 64-bit hash, so that rows of one id are judged each."""
    spark = docs.sparkSession
    path = scratch_path(spark, "leaks")
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    leaks(docs.select(mark.alias("doc_id"), "text"), items, **options).write.parquet(path)
    leaked = spark.read.schema(LEAKS).parquet(path).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(broadcast_if_small(leaked, 8), mark == F.col("leaked"), "left_anti")
