"""Ranked lexical search: items against all documents, by bag deduplication.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased. With N documents that have a term, L terms in all of them, n terms in a document
and df documents with a term, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), a document
has m = 75 + (25 n N) div L, and its score for an item sums w ((10^9 tf) div (1000 tf + 12 m))
over the item's terms, repeats included.

Documents are restricted to the items' vocabulary. What is left is a bag (term, tf); documents
with the same bag and the same m have the same scores. They are hashed, equal hashes are
verified by comparing bag and m, and each class is scored once, as one member stands for all:
an item's best ``TOP`` documents lie in its best ``TOP`` classes by (score, least doc_id). Only
those classes are expanded, by ascending doc_id, to ``TOP`` members at most.

Items are a query set: they are taken in blocks of ``ITEM_BYTES`` of text, so that the
vocabulary that tasks hold is bounded; a block reads the documents once and its bags thrice.

Defined cases: a null text has no term; documents without a term do not count in N; repeated
rows and ids are documents of their own; a null ``doc_id`` comes behind equal scores; repeated
items are answered each, null ids and all; items without a term and empty tables give no rows;
other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citescope.llm.batches import chunks, in_arrow, words_of
from citescope.llm.joins import broadcast_if_small
from citescope.session import scratch_path

TOP = 20
ITEM_BYTES = 4 << 20   # of item text in a block
CELLS = 4 << 20        # scores and products that a task holds at a time
MERGE = 32             # partial top lists of an item are merged in so many groups first
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b
                   if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                   for b in range(256))
RESULT = "item_id long, rank int, doc_id long, score long"


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, ids, bounds) of the terms of a string column, as ``words_of`` gives words."""
    text = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    # One byte becomes one byte, and bytes of other characters stay: the offsets hold.
    plain = (data.to_pybytes() if data else b"")[offsets[0]:offsets[-1]].translate(TERM_BYTES)
    return words_of(pa.Array.from_buffers(pa.large_string(), len(text), [
        None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(plain)]))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, its terms with repeats) in blocks of bounded text."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for r in rows.toLocalIterator():
        text = r.text or ""
        if block and size + len(text) > ITEM_BYTES:
            yield block
            block, size = [], 0
        vocabulary, ids, _ = terms(pa.array([text]))
        block.append((r.item_id, Counter(vocabulary.take(pa.array(ids)).to_pylist())))
        size += len(text)
    if block:
        yield block


def bags(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n and the bag (pairs of 32-bit term number and tf by ascending term) of every
    document with a term."""

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        width = len(vocabulary) + 1
        for batch in chunks(batches):
            words, ids, bounds = terms(batch.column(1))
            number = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
            number = number.astype(np.int64)[ids]
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            held = number >= 0
            key, tf = np.unique(row[held] * width + number[held], return_counts=True)
            cuts = np.searchsorted(key, np.arange(batch.num_rows + 1) * width) * 8
            data = np.stack([key % width, tf], axis=1).astype("<u4").tobytes()
            n = np.diff(bounds)
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(some), pa.array(n).filter(some),
                 pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()).filter(some)],
                ["doc_id", "n", "bag"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .transform(in_arrow, restrict, "doc_id long, n long, bag binary"))


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of the entries of a column of bags."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), "<u4").astype(np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(rows)), [len(x) // 8 for x in rows])
    return row, flat[:, 0], flat[:, 1]


def _document_counts(bag_table: DataFrame, size: int) -> np.ndarray:
    """df of every term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_pairs(batch.column(0))[1], minlength=size)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for r in (bag_table.select("bag").transform(in_arrow, count, "term long, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):  # one row per term
        df[r.term] = r.df
    return df


def _score(items: list[Counter], number: dict[str, int], weight: np.ndarray):
    """A function over batches of classes (h, m, bag, no_id, first) to the best classes of each
    item in the task. Sums are exact: they are taken in two halves of 26 bits and more."""
    wanted = sorted((number[t], i, q) for i, item in enumerate(items) for t, q in item.items())
    term, item_of, repeats = (np.array(x, np.int64) for x in zip(*wanted))
    start = np.searchsorted(term, np.arange(len(number) + 1))
    n_items = len(items)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # item, -score, no_id, first, h of the task's best classes so far
        top = np.zeros((5, 0), np.int64)
        least = np.ones(n_items, np.int64)  # a score below it is not among the item's best

        def scores(part: pa.RecordBatch) -> np.ndarray:
            row, t, tf = _pairs(part.column(2))
            m = part.column(1).to_numpy()[row]
            value = weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            many = start[t + 1] - start[t]
            ends = np.cumsum(many)
            total = np.zeros(part.num_rows * n_items, np.int64)
            a = 0
            while a < len(t):
                before = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
                k = many[a:b]
                at = (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                      + np.repeat(start[t[a:b]], k))
                cell = np.repeat(row[a:b], k) * n_items + item_of[at]
                product = np.repeat(value[a:b], k) * repeats[at]
                for shift, half in ((26, product >> 26), (0, product & ((1 << 26) - 1))):
                    total += np.bincount(cell, half, len(total)).astype(np.int64) << shift
                a = b
            return total.reshape(part.num_rows, n_items)

        step = max(1, CELLS // n_items)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                total = scores(part)
                row, i = np.nonzero(total >= least)
                column = [part.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                          for k in (3, 4, 0)]
                top = np.concatenate([top, [i, -total[row, i], *column]], axis=1)
                top = top[:, np.lexsort(top[::-1])]
                place = np.arange(top.shape[1]) - np.searchsorted(top[0], top[0])
                top = top[:, place < TOP]
                place = place[place < TOP]
                full = top[:, place == TOP - 1]
                least[full[0]] = -full[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(top[0]), pa.array(-top[1]), pa.array(top[2]), pa.array(top[3]),
             pa.array(top[4])], ["item", "score", "no_id", "first", "h"])

    return best


def _search_block(docs: DataFrame, block: list[tuple[int | None, Counter]]) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, item in block for t in item})
    if not vocabulary:
        return None
    folder = scratch_path(spark, "bags")
    bags(docs, vocabulary).write.parquet(f"{folder}/all")
    written = spark.read.parquet(f"{folder}/all")
    n_docs, n_terms = written.agg(F.count("*"), F.sum("n")).head()
    if not n_docs:
        return None
    df = _document_counts(written, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
                       for d in df.tolist()], np.int64)
    no_id = F.col("doc_id").isNull()
    members = (written.where(F.length("bag") > 0)
               .withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L"))
               .withColumn("h", F.xxhash64("m", "bag"))
               .withColumn("no_id", no_id.cast("int"))
               .withColumn("id", F.coalesce("doc_id", F.lit(0))))
    # The least id of a class: rows with a null id count only where there is no other.
    classes = (members.groupBy("h", "m", "bag")
               .agg(F.min("no_id").alias("no_id"), F.min("doc_id").alias("first"))
               .select("h", "m", "bag", "no_id", F.coalesce("first", F.lit(0)).alias("first")))
    number = {t: i for i, t in enumerate(vocabulary)}
    order = [F.desc("score"), "no_id", "first"]
    best = (classes.transform(in_arrow, _score([x for _, x in block], number, weight),
                              "item long, score long, no_id long, first long, h long")
            .withColumn("group", F.spark_partition_id() % MERGE))
    for keys in (["item", "group"], ["item"]):
        best = (best.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
                .where(F.col("place") <= TOP))
    best.drop("group", "place").write.parquet(f"{folder}/best")
    best = spark.read.parquet(f"{folder}/best")  # TOP rows an item at most

    hashes = best.select("h").distinct()
    same = Window.partitionBy("h", "m", "bag")
    ordered = same.orderBy("no_id", "id")
    expanded = (members.join(broadcast_if_small(hashes, 16), "h", "left_semi")
                .withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= TOP)
                .withColumn("no_first", F.min("no_id").over(same))
                .withColumn("first", F.coalesce(F.min("doc_id").over(same), F.lit(0)))
                .select("h", F.col("no_first").cast("long").alias("no_id"), "first", "doc_id",
                        F.col("no_id").alias("doc_no_id")))
    ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)],
                                "item long, item_id long")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), "doc_no_id", "doc_id")
    return (best.join(expanded, ["h", "no_id", "first"])
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP)
            .join(broadcast_if_small(ids, 16), "item")
            .select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ``TOP`` best documents (doc_id, text) of each item (item_id, text) with a score above
    0: item_id, rank, doc_id, score; equal scores by ascending doc_id."""
    found = docs.sparkSession.createDataFrame([], RESULT)
    for block in _blocks(items):
        part = _search_block(docs, block)
        if part is not None:
            found = found.unionByName(part)
    return found
