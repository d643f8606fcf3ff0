"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

The n-grams are runs of 1 to 4 bytes inside a word (its ends count as signs), hashed into a
fixed number of buckets. Two multinomials over the buckets are counted over the whole corpus:
the raw one from every document, the target one from every trusted document. A document's
score is the mean over its n-grams of log target - log raw, so length cancels out. The
threshold is the score that separates trusted from untrusted labelled documents best (largest
sum of both hit rates, ties to the lower score; in the middle of the gap between the scores on
its sides), read from a fixed-size histogram; every document is then judged by comparing its
score with it.

Words are counted once per distinct word of a chunk, so a repeated word costs one lookup.

Defined cases: null text has no words, so it fails the base rule; a null label is no label; a
document labelled twice is trusted if any label says so; with no trusted or no untrusted label
the base rule alone decides; empty tables give no rows; repeated rows are judged alike, one by
one; extra columns never reach the operator (``judge``) or pass through untouched (``keep``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm.batches import chunks, in_arrow, utf8, word_ids
from citescope.llm.joins import broadcast_if_small

SYMBOLS = b"#*$%&|<>"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
SMOOTHING = 0.5
BLOCK = 1 << 16      # bytes of words whose n-grams are listed at a time
BINS = 4096          # of the calibration histogram
SPAN = 8.0           # scores outside [-SPAN, SPAN] count in the outermost bins
MIN_WORDS = 50

VERDICTS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, base_failed boolean, kept boolean, score double")


@dataclass
class QualityModel:
    ratio: np.ndarray   # log target - log raw of each bucket
    threshold: float


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def word_grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of every word, in no special order."""
    padded = b"".join(b"\x01" + w + b"\x02" for w in vocabulary)
    data = np.frombuffer(padded, np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in vocabulary], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    words, buckets = [], []
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(257) + data[n - 1:]  # exact: 4 bytes fit
        if n in ORDERS:
            whole = owner[:m] == owner[n - 1:]
            mixed = (code[whole] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            words.append(owner[:m][whole])
            buckets.append((mixed >> np.uint64(64 - 14)).astype(np.int64))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(buckets)


def gram_blocks(vocabulary: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, word, bucket): ``word_grams`` of the words first <= i < last, block by block:
    the list of all n-grams takes over a hundred times the words' bytes. A longer word is a block
    of its own."""
    ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
    first = 0
    while first < len(vocabulary):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        yield first, last, *word_grams(vocabulary[first:last])
        first = last


def repeat_words(ids: np.ndarray, bounds: np.ndarray, n_vocabulary: int) -> np.ndarray:
    """Per text, the words covered by three-word windows found twice or more in it."""
    covered = np.zeros(len(ids) + 2, bool)
    if len(ids) >= 3:
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        starts = np.flatnonzero(doc[:-2] == doc[2:])
        first = ids[starts] * n_vocabulary + ids[starts + 1]
        if n_vocabulary >= 1 << 21:  # keep the combined key exact
            first = np.unique(first, return_inverse=True)[1]
        key = first * n_vocabulary + ids[starts + 2]
        order = np.argsort(key, kind="stable")  # equal keys stay in document order
        near = (key[order][1:] == key[order][:-1]) & (
            doc[starts[order]][1:] == doc[starts[order]][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= near
        again[:-1] |= near
        at = starts[order[again]]
        covered[at] = covered[at + 1] = covered[at + 2] = True
    return _sums(covered[:len(ids)].astype(np.int64), bounds)


def dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def counts_and_scores(column: pa.Array, ratio: np.ndarray) -> dict[str, np.ndarray]:
    vocabulary, ids, bounds = word_ids(column)
    length = np.array([len(w.decode()) for w in vocabulary], np.int64)
    symbols = np.array([len(w) - len(w.translate(None, SYMBOLS)) for w in vocabulary], np.int64)
    grams, value = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary))
    for a, b, word, bucket in gram_blocks(vocabulary):
        grams[a:b] = np.bincount(word, minlength=b - a)
        value[a:b] = np.bincount(word, weights=ratio[bucket], minlength=b - a)
    n_words = np.diff(bounds)
    repeated = repeat_words(ids, bounds, len(vocabulary))
    score = _sums(value[ids], bounds) / np.maximum(1, _sums(grams[ids], bounds))
    return {
        "n_words": n_words, "word_chars": _sums(length[ids], bounds),
        "n_symbols": _sums(symbols[ids], bounds),
        "n_dup_lines": np.array([dup_lines(t) if b"\n" in t else 0 for t in utf8(column)],
                                np.int64),
        "n_repeat_words": repeated,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeated > 50 * n_words),
        "score": np.round(score, 9),
    }


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, trusted (null without a label). The labels are broadcast only when they
    are measured to be small; else both sides are shuffled by doc_id."""
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy("doc_id").agg((F.max("quality") > 0).alias("trusted")))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        broadcast_if_small(known, 9), "doc_id", "left")


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Multinomials over the whole corpus, then the threshold over all labelled documents."""
    labelled = _labelled(docs, labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in chunks(batches):
            trusted = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            vocabulary, ids, bounds = word_ids(batch.column(1))
            times = [np.bincount(own, minlength=len(vocabulary))
                     for own in (ids, ids[np.repeat(trusted, np.diff(bounds))])]
            for a, b, word, bucket in gram_blocks(vocabulary):
                for i in range(2):
                    total[i] += np.bincount(bucket, weights=times[i][a:b][word],
                                            minlength=BUCKETS).astype(np.int64)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "raw": pa.array(total[0][used]),
                                          "target": pa.array(total[1][used])})

    counted = (labelled.transform(in_arrow, count, "bucket long, raw long, target long")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # at most BUCKETS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return QualityModel(np.zeros(BUCKETS), -np.inf)
    raw, target = raw + SMOOTHING, target + SMOOTHING
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in chunks(batches):
            found = counts_and_scores(batch.column(1), ratio)
            trusted = batch.column(2).to_numpy(zero_copy_only=False).astype(int)
            at = np.clip(((found["score"] + SPAN) * (BINS / (2 * SPAN))).astype(int), 0, BINS - 1)
            np.add.at(total, (trusted, at), ~found["base_failed"])
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bin": pa.array(used), "bad": pa.array(total[0][used]),
                                          "good": pa.array(total[1][used])})

    histogram = np.zeros((2, BINS))
    for r in (labelled.where("trusted IS NOT NULL")
              .transform(in_arrow, place, "bin long, bad long, good long")
              .groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
              .collect()):  # at most BINS rows
        histogram[:, r.bin] = r.bad, r.good
    bad, good = histogram.sum(axis=1)
    if not bad or not good:
        return QualityModel(ratio, -np.inf)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(histogram, axis=1)], axis=1)
    gain = below[0] / bad - below[1] / good  # of rejecting all bins before the edge
    first = last = int(np.argmax(gain))
    while last < BINS and gain[last + 1] == gain[first]:  # bins without a labelled document
        last += 1
    return QualityModel(ratio, (first + last) / 2 * 2 * SPAN / BINS - SPAN)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per document: the base counts, base_failed, kept and the score."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = counts_and_scores(batch.column(1), model.ratio)
            kept = ~found["base_failed"] & (found["score"] >= model.threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[k]) for k in (
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed")), pa.array(kept), pa.array(found["score"])],
                names=[x.split()[0] for x in VERDICTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).transform(in_arrow, rows, VERDICTS)


def keep(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            found = counts_and_scores(texts, model.ratio)
            kept = ~found["base_failed"] & (found["score"] >= model.threshold)
            yield batch.filter(pa.array(kept))

    return docs.transform(in_arrow, rows, docs.schema)
