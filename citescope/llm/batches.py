"""Helpers shared by the operators: Arrow batches to byte texts, word ids, memoised tokens."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

import citescope

# Functions bring the package's code along: executors need no installed copy of it.
cloudpickle.register_pickle_by_value(citescope)

# Text bytes that one task works on at a time: bounds a Python worker's memory at any row size
# (a single longer text is a chunk of its own).
CHUNK_BYTES = 2 << 20
BATCH_BYTES = 4 << 20  # of an Arrow batch between the JVM and Python


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with Arrow batches bounded by bytes: texts differ in length by orders of
    magnitude, so a number of rows bounds neither side's memory. Use with ``transform``."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null becomes the empty text."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text_column: str = "text",
           limit: int = CHUNK_BYTES, tokens: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row ranges of at most ``limit`` text bytes (one row at least). A
    task that does not encode ``tokens`` gives a kept token memo's memory back first."""
    if not tokens:
        for key in [k for k in worker_store() if k.startswith("tokens ")]:
            del worker_store()[key]
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text_column))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker is kept, its peak need not be


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, ids, bounds): the distinct words of a string column, all its words as ids
    into the vocabulary, and the bounds of each text: text i has ``ids[bounds[i]:bounds[i + 1]]``.
    A word is a run without space or U+0009 to U+000D; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    bounds = offsets - offsets[0]
    vocabulary = coded.dictionary
    empty = pc.index(vocabulary, "").as_py()  # left by white space at an end of a text
    if empty >= 0:
        real = ids != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        ids = ids[real]
        ids -= ids > empty
        vocabulary = pa.concat_arrays([vocabulary[:empty], vocabulary[empty + 1:]])
    return vocabulary, ids, bounds


def word_ids(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``words_of`` with the vocabulary as UTF-8 bytes."""
    vocabulary, ids, bounds = words_of(column)
    return vocabulary.cast(pa.binary()).to_pylist(), ids, bounds


class WordTokens:
    """Token ids of texts as bytes of ``dtype``, from the tokenizers library.

    Encoding is memoised by word: the tokenizer drops white space and never merges across it,
    so a text's ids are those of its words in order. It lower-cases too, so A-Z are lower-cased
    first (not around ``<|``, which starts a special token). A word is cut into a stem and
    the ASCII signs behind it where a letter or digit precedes them, which the tokenizer never
    merges either. New stems made of letters are encoded many in one call: the vocabulary marks
    the last token of a run of letters, which tells them apart. The memo holds stems and signs
    in two Arrow arrays, the last asked for first: at most ``bound``, none longer than ``LONGEST``
    bytes. An entry takes some 30 bytes there, and several times that as Python objects.
    """

    SIGNS = ".,;:!?#*$%&|<>()"
    GROUP = 1000
    LONGEST = 64

    def __init__(self, path: str, dtype: str = "<u4", bound: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.bound = np.dtype(dtype), bound
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.known = pa.array([], pa.string())
        self.ids = pa.array([], pa.large_binary())  # of ``known``

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _learned(self, stems: list[str]) -> pa.Array:
        runs = [x for x in stems if x.isalpha()]
        found: dict[str, bytes] = {}
        for group in (runs[i:i + self.GROUP] for i in range(0, len(runs), self.GROUP)):
            encoding, = self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)
            ids = np.array(encoding.ids, self.dtype)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(ends) == len(group):
                data = ids.tobytes()
                found.update(zip(group, map(data.__getitem__, map(slice, [0, *ends], ends))))
            else:  # a letter that normalises to more than letters
                found.update((x, self._ids(x)) for x in group)
        return pa.array([found[x] if x in found else self._ids(x) for x in stems],
                        pa.large_binary())

    def _of_stems(self, stems: pa.Array) -> pa.Array:
        """Ids of distinct stems, which move to the front of the memo."""
        at = pc.index_in(stems, value_set=self.known)
        new = pc.is_null(at)
        ids = pa.concat_arrays([self.ids, self._learned(stems.filter(new).to_pylist())])
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        fresh = new.to_numpy(zero_copy_only=False)
        place[fresh] = len(self.ids) + np.arange(np.count_nonzero(fresh))
        found = ids.take(pa.array(place))
        older = np.ones(len(self.known), bool)
        older[place[~fresh]] = False
        short = pc.less_equal(pc.binary_length(stems), self.LONGEST)
        self.known, self.ids = (
            pa.concat_arrays([a := asked.filter(short).slice(0, self.bound),
                              kept.filter(pa.array(older)).slice(0, self.bound - len(a))])
            for asked, kept in ((stems, self.known), (found, self.ids)))
        return found

    def _of_words(self, words: pa.Array) -> pa.Array:
        stems = pc.ascii_rtrim(words, self.SIGNS)
        cut = np.flatnonzero(pc.not_equal(stems, words).to_numpy(zero_copy_only=False))
        tails, whole = [], np.zeros(len(words), bool)
        for i, word, stem in zip(cut, words.take(pa.array(cut)).to_pylist(),
                                 stems.take(pa.array(cut)).to_pylist()):
            end = stem[-1:]
            whole[i] = stem and ("<|" in word or not (
                end.isalnum() if end.isascii() else end.isalpha()))
            # the signs may belong to the last token of the stem
            tails.append("" if whole[i] else word[len(stem):])
        stems = pc.if_else(pa.array(whole), words, stems)
        tail = np.full(len(words), len(tails))
        tail[cut] = np.arange(len(tails))
        parts = pa.concat_arrays([stems, pa.array([*tails, ""], pa.string()).take(
            pa.array(tail))]).dictionary_encode()
        ids = self._of_stems(parts.dictionary).take(parts.indices)
        return pc.binary_join_element_wise(ids.slice(0, len(words)), ids.slice(len(words)),
                                           pa.scalar(b"", pa.large_binary()))

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string column as bytes."""
        text = pc.fill_null(column.cast(pa.string()), "")
        text = pc.if_else(pc.match_substring(text, "<|"), text, pc.ascii_lower(text))
        vocabulary, ids, bounds = words_of(text)
        encoded = self._of_words(vocabulary).take(pa.array(ids))
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(pc.binary_length(encoded).to_numpy(), out=ends[1:])
        data = encoded.buffers()[2]
        whole = data.to_pybytes() if data else b""
        cuts = ends[bounds].tolist()
        return list(map(whole.__getitem__, map(slice, cuts, cuts[1:])))


def worker_store() -> dict:
    """A dict that outlives a task in a reused Python worker (functions shipped by value get
    fresh globals in every task)."""
    return sys.modules.setdefault("citescope_worker_store",
                                  types.ModuleType("citescope_worker_store")).__dict__


def word_tokens(path: str, dtype: str = "<u4") -> WordTokens:
    """The worker's memo for a tokenizer file, kept from task to task."""
    store, key = worker_store(), f"tokens {path} {dtype}"
    if key not in store:
        store[key] = WordTokens(path, dtype)
    return store[key]
