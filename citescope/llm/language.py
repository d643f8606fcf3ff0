"""Language ID by multilingual mixture inference.

Each language is a smoothed multinomial over hashed character trigrams (lower-cased letters,
anything else is one blank), counted over all training documents. A document is a mixture of
languages: expectation-maximisation on its trigram counts gives the language proportions.
The language set is chosen by penalised likelihood: the languages are ordered by proportion,
the mixture of the first k is fitted for every k (up to ``max_languages``, if given), and the k with the largest
log-likelihood - k/2 log(number of trigrams) wins. The prediction is the language with the
largest share in the chosen set; the score is that share.

Documents are taken together in groups, as one sparse matrix of counts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text
when no training document has a language; a null ``lang`` teaches nothing; ties go to the
language that sorts first; repeated rows are predicted alike, one by one; an empty table gives
no rows; other columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm.batches import chunks, in_arrow, utf8, worker_store

BUCKETS = 1 << 13
SMOOTHING = 0.1
GROUP = 256      # documents in one sparse matrix
STEPS = 8        # of expectation-maximisation
UNKNOWN = "und"
PREDICTIONS = "doc_id long, lang_pred string, score double, languages string"


def _letters() -> np.ndarray:
    """Which code points are letters."""
    store = worker_store()
    if "letters" not in store:
        store["letters"] = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return store["letters"]


def trigram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count, has letters): the non-zero trigram counts of every text, by
    document. Runs of non-letters are one blank, and a blank stands at either end; a trigram
    has a letter in its middle, or at both ends."""
    whole = "\0".join(t.decode().lower().replace("\0", " ") for t in texts)
    code = np.frombuffer(f"\0{whole}\0".encode("utf-32-le", "surrogatepass"), np.uint32)
    cut = code == 0
    doc = np.cumsum(cut) - 1
    letter = _letters()[code]
    keep = letter | cut
    keep[1:] |= letter[:-1]  # the first sign behind a letter stands for the run
    code = np.where(letter, code, 0).astype(np.uint64)[keep]
    doc, letter = doc[keep], letter[keep]
    has = np.bincount(doc[letter], minlength=len(texts))[:len(texts)] > 0
    if len(code) < 3:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, has
    # what lies in another text is a blank
    before, after = doc[:-2] == doc[1:-1], doc[2:] == doc[1:-1]
    mixed = ((np.where(before, code[:-2], 0) << np.uint64(42)) ^ (code[1:-1] << np.uint64(21))
             ^ np.where(after, code[2:], 0))
    bucket = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)
    ok = letter[1:-1] | (before & after & letter[:-2] & letter[2:])
    table = np.bincount(doc[1:-1][ok] * BUCKETS + bucket[ok], minlength=len(texts) * BUCKETS)
    at = np.flatnonzero(table)
    return at // BUCKETS, at % BUCKETS, table[at], has


@dataclass
class LanguageModel:
    languages: list[str]  # sorted
    probability: np.ndarray  # language x bucket

    def predict(self, texts: list[bytes], max_languages: int | None = None
                ) -> tuple[list[str], np.ndarray, list[str]]:
        names = self.languages
        pred, share, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [""] * len(texts)
        if not names or not texts:
            return pred, share, sets
        doc, bucket, count, has = trigram_counts(texts)
        if not len(doc):
            return pred, share, sets
        known = np.unique(doc)
        starts = np.searchsorted(doc, known)
        row = np.repeat(np.arange(len(known)), np.diff(np.append(starts, len(doc))))
        p = self.probability[:, bucket]
        count = count.astype(np.float64)
        n = np.add.reduceat(count, starts)

        def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions (document x language, 0 where not allowed) and log-likelihoods."""
            pi = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(STEPS if allowed.sum(axis=1).max() > 1 else 0):
                joint = pi.T[:, row] * p
                joint *= count / joint.sum(axis=0)
                pi = np.add.reduceat(joint, starts, axis=1).T / n[:, None]
            mass = np.log((pi.T[:, row] * p).sum(axis=0))
            return pi, np.add.reduceat(count * mass, starts)

        full = np.ones((len(known), len(names)))
        order = np.argsort(-np.round(fit(full)[0], 6), axis=1, kind="stable")
        best = np.full(len(known), -np.inf)
        chosen = np.zeros_like(full)
        for k in range(1, min(max_languages or len(names), len(names)) + 1):
            allowed = np.zeros_like(full)
            np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
            pi, fitted = fit(allowed)
            value = fitted - 0.5 * k * np.log(np.maximum(n, 2))
            better = value > best
            best[better], chosen[better] = value[better], pi[better]
        for i, d in enumerate(known):
            if has[d]:
                by = sorted((-round(float(x), 6), name) for x, name in zip(chosen[i], names) if x)
                pred[d], share[d] = by[0][1], min(1.0, max(0.0, -by[0][0]))
                sets[d] = ",".join(f"{name}:{-x:.3f}" for x, name in by)
        return pred, share, sets


def fit(docs: DataFrame) -> LanguageModel:
    """``docs``: text and lang of the training documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in chunks(batches):
            texts, langs = utf8(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for start in range(0, len(texts), GROUP):
                doc, bucket, n, _ = trigram_counts(texts[start:start + GROUP])
                own = langs[start:start + GROUP][doc]
                for lang in set(own):
                    at = own == lang
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    totals[lang] += np.bincount(bucket[at], weights=n[at],
                                                minlength=BUCKETS).astype(np.int64)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()),
                                              "bucket": pa.array(used), "n": pa.array(total[used])})

    summed = (docs.where("lang IS NOT NULL AND text IS NOT NULL")
              .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string"))
              .transform(in_arrow, count, "lang string, bucket long, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    rows = summed.collect()  # at most languages x BUCKETS
    languages = sorted({r.lang for r in rows})
    index = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for r in rows:
        counts[index[r.lang], r.bucket] = r.n
    # smoothed towards the corpus, so that no language is helped by rare buckets
    shared = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS) if len(languages) else counts
    own = counts.sum(axis=1, keepdims=True)
    weight = SMOOTHING * BUCKETS
    return LanguageModel(languages, (counts + weight * shared) / (own + weight))


def predict(docs: DataFrame, model: LanguageModel, max_languages: int | None = None) -> DataFrame:
    """doc_id, lang_pred, score, languages (the chosen set with its shares)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = utf8(batch.column(1))
            found = [model.predict(texts[i:i + GROUP], max_languages)
                     for i in range(0, len(texts), GROUP)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for f in found for x in f[0]], pa.string()),
                 pa.array(np.concatenate([f[1] for f in found])),
                 pa.array([x for f in found for x in f[2]], pa.string())],
                names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).transform(in_arrow, rows, PREDICTIONS)
