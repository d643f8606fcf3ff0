"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) for k = 1 .. K, with one weight vector for all
thresholds and theta_1 < theta_2 < ... Features, hashed to 32 bits, are the presence of a word
(lower-cased, signs at its ends stripped) and of two, and of four, words with the same first 3
to 7 letters. Shared prefixes catch inflected forms that were not in the labelled texts; their
number tells a chance occurrence from a habit.

Fitting uses a bounded sample of labelled documents (``max_labelled``, the smallest hashes of
doc_id; all of them when there are fewer). Feature counts of the sample are gathered in Spark,
the features that tell toxic from clean texts (by G-squared, which must be significant; seen in
at least ``min_docs`` texts) are kept, and the small design matrix they leave is fitted by
accelerated gradient descent. Scoring is one pass over all documents without a shuffle.

Defined cases: null and word-less texts have no features and get the prior's severity; a null
label or grade is no label; a document labelled twice has its highest grade; without labels of
two different grades every severity is 0; repeated rows are scored alike, one by one; an empty
table gives no rows; other columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm.batches import chunks, in_arrow, utf8
from citescope.session import scratch_path

MAX_LABELLED = 10_000
MIN_DOCS = 3
PREFIXES = (3, 4, 5, 6, 7)
MIN_GAIN = 8.0  # least G-squared / 2 of a feature: fewer weak features, less noise
DECIDE = 0.2  # P(grade >= 1) from which a text counts as toxic: best F1 on labels held out
SIGNS = b".,;:!?#*$%&|<>()\"'"
SCORES = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def features_of_word(word: bytes) -> list[int]:
    """Codes of a word: hash x 4 for itself, hash x 4 + 1 for each prefix."""
    core = word.strip(SIGNS).decode().lower()
    if not core:
        return []
    return [4 * zlib.crc32(b"w" + core.encode())] + [
        4 * zlib.crc32(b"p" + core[:n].encode()) + 1 for n in PREFIXES if len(core) >= n]


def present(text: bytes, memo: dict[bytes, tuple[int, ...]], used=None) -> list[int]:
    """The features of a text, ascending: codes of words, codes of prefixes seen twice, and
    those + 1 of prefixes seen four times. ``memo`` holds words' codes (in ``used``, if given)."""
    times: dict[int, int] = {}
    for word, n in Counter(text.split()).items():
        own = memo.get(word)
        if own is None:
            own = memo[word] = tuple(f for f in features_of_word(word)
                                     if used is None or f in used or f + 1 in used)
        for f in own:
            times[f] = times.get(f, 0) + n
    found = [f for f, n in times.items() if n >= 2 or not f & 3]
    found += [f + 1 for f, n in times.items() if n >= 4 and f & 3]
    return sorted(found)


@dataclass
class SeverityModel:
    features: np.ndarray    # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; empty when there is nothing to tell apart

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, one row per score."""
        return 1 / (1 + np.exp(-(z[:, None] - self.thresholds[None, :])))


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, n_features: int,
                        l2: float = 0.5, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the penalised likelihood; ``rows`` hold the indices of
    the features present. Nesterov's method with a fixed number of steps, so the result is the
    same on every run."""
    k = int(grades.max())
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    share = np.array([(grades >= j).mean() for j in range(1, k + 1)])
    theta = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
    # thresholds as a first value and logs of gaps keep their order at every step
    p = np.concatenate([np.zeros(n_features), theta[:1],
                        np.log(np.maximum(np.diff(theta), 1e-2))])

    def gradient(p: np.ndarray) -> np.ndarray:
        w, first, gaps = p[:n_features], p[n_features], np.exp(p[n_features + 1:])
        theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(owner, weights=w[column], minlength=len(rows))
        upper = np.where(grades < k, theta[np.minimum(grades, k - 1)], np.inf)
        lower = np.where(grades > 0, theta[np.maximum(grades - 1, 0)], -np.inf)
        cu, cl = (1 / (1 + np.exp(-np.clip(t - z, -40, 40))) for t in (upper, lower))
        cu, cl = np.where(grades < k, cu, 1.0), np.where(grades > 0, cl, 0.0)
        mass = np.maximum(cu - cl, 1e-12)
        du, dl = cu * (1 - cu) / mass, cl * (1 - cl) / mass
        g = np.empty_like(p)
        g[:n_features] = np.bincount(column, weights=(du - dl)[owner],
                                     minlength=n_features) + l2 * w
        g_theta = np.bincount(np.maximum(grades - 1, 0), weights=dl, minlength=k)[:k]
        g_theta -= np.bincount(np.minimum(grades, k - 1), weights=du, minlength=k)[:k]
        tail = np.cumsum(g_theta[::-1])[::-1]
        g[n_features] = tail[0]
        g[n_features + 1:] = tail[1:] * gaps
        return g

    # Lipschitz bound of the gradient: a quarter of the largest column and row counts
    widest = max([len(r) for r in rows], default=0) + 1
    rate = 1 / (0.25 * widest * max(1, np.bincount(column, minlength=1).max(initial=1)) ** 0.5
                * 4 + l2)
    ahead, last = p.copy(), p.copy()
    for i in range(steps):
        now = ahead - rate * gradient(ahead)
        ahead = now + i / (i + 3) * (now - last)
        last = now
    gaps = np.exp(last[n_features + 1:])
    return last[:n_features], last[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit(docs: DataFrame, grades: DataFrame, max_labelled: int = MAX_LABELLED,
        min_docs: int = MIN_DOCS) -> SeverityModel:
    """``grades``: doc_id, grade (0 and up). Every feature that is significant in the labelled
    sample is kept."""
    sample = (grades.where("doc_id IS NOT NULL AND grade IS NOT NULL AND grade >= 0")
              .groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    texts = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
             .join(F.broadcast(sample), "doc_id"))  # at most max_labelled rows
    path = scratch_path(docs.sparkSession, "labelled")
    texts.write.parquet(path)  # all documents are read once for the sample
    texts = docs.sparkSession.read.schema(texts.schema).parquet(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            memo: dict = {}
            toxic = batch.column(2).to_numpy(zero_copy_only=False) > 0
            sets = [np.array(present(t, memo), np.int64) for t in utf8(batch.column(1))]
            empty = [np.zeros(0, np.int64)]
            a, b = (np.concatenate(empty + [s for s, y in zip(sets, toxic) if y == want])
                    for want in (True, False))
            feature, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            n_toxic = np.bincount(at[:len(a)], minlength=len(feature))
            n_all = np.bincount(at, minlength=len(feature))
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(feature), "n_toxic": pa.array(n_toxic),
                "n_all": pa.array(n_all)})

    counted = (texts.transform(in_arrow, count, "feature long, n_toxic long, n_all long")
               .groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"),
                                       F.sum("n_all").alias("n_all"))
               .where(F.col("n_all") >= min_docs))
    totals = texts.agg(F.count("*").alias("n"),
                       F.sum((F.col("grade") > 0).cast("long")).alias("toxic"),
                       F.countDistinct("grade").alias("kinds")).first()
    if not totals.n or totals.kinds < 2 or not totals.toxic:
        return SeverityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    n, toxic = float(totals.n), float(totals.toxic)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    k, m = F.col("n_toxic").cast("double"), F.col("n_all").cast("double")
    gain = (part(k, m * toxic / n) + part(m - k, m * (n - toxic) / n)
            + part(toxic - k, (n - m) * toxic / n) + part(n - toxic - m + k, (n - m) * (n - toxic) / n))
    best = (counted.where(m < n).withColumn("gain", F.round(gain, 6))
            .where(F.col("gain") >= MIN_GAIN).select("feature").collect())
    features = np.sort(np.array([r.feature for r in best], np.int64))

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            memo: dict = {}
            kept = []
            for text in utf8(batch.column(1)):
                found = np.intersect1d(present(text, memo), features)
                kept.append(np.searchsorted(features, found).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(kept, pa.list_(pa.int32()))],
                names=["doc_id", "grade", "x"])

    rows = (texts.transform(in_arrow, design, "doc_id long, grade int, x array<int>")
            .orderBy("doc_id", "x").collect())  # at most max_labelled documents
    levels = np.unique([r.grade for r in rows])  # grades present, so that no level is empty
    y = np.searchsorted(levels, [r.grade for r in rows])
    weights, theta = fit_cumulative_link([np.array(r.x, np.int64) for r in rows], y, len(features))
    return SeverityModel(features, weights, theta)


def score(docs: DataFrame, model: SeverityModel, decide: float = DECIDE) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic = P(grade >= 1), grade (the most likely one),
    toxic = p_toxic >= decide."""
    weight_of = dict(zip(model.features.tolist(), model.weights.tolist()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple] = {}
        for batch in chunks(batches):
            if len(memo) > 300_000:
                memo.clear()
            z = np.zeros(batch.num_rows)
            for i, text in enumerate(utf8(batch.column(1))):
                z[i] = sum(weight_of.get(f, 0.0) for f in present(text, memo, weight_of))
            over = model.at_least(z)
            if over.shape[1]:
                mass = -np.diff(np.hstack([np.ones((len(z), 1)), over, np.zeros((len(z), 1))]))
                severity, p, grade = over.sum(axis=1), over[:, 0], mass.argmax(axis=1)
            else:
                severity = p = np.zeros(len(z))
                grade = np.zeros(len(z), int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.round(severity, 9)), pa.array(np.round(p, 9)),
                 pa.array(grade, pa.int32()), pa.array(p >= decide)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).transform(in_arrow, rows, SCORES)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Severity grades from the label table: 0 clean, 1 toxic, 2 toxic in a text that is also of
    low quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(
        F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))
