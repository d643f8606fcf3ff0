"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Equal
fingerprints are one node from there on, so any group of copies costs one row. Two
fingerprints are linked when at most three bits differ, and are found by shuffling variants
that both sides emit, half the radius each:

* distance 1 or 2: both emit the 65 variants within one bit; they meet in the middle.
* distance 3: the number of set bits differs in parity, so let the odd side flip two bits and
  the even side one. Of any three bits two lie in the same half of the fingerprint, so the
  odd side needs pairs within a half only (992 in place of 2016). It emits them only when
  some even fingerprint agrees with one of its halves up to one bit - every pair at distance
  3 does - which a shuffle on half fingerprints tells first.

A variant is shared by at most 65 fingerprints within one bit of it (2,081 within two), so no
group grows with the data. Members of a variant's group are verified by bit distance and
linked to its smallest member, which keeps the links linear. Components follow from the links.

Defined cases: null and word-less texts have fingerprint zero and are linked like any other;
repeated rows are rows of their own in one group; a null ``doc_id`` gets the component of the
others of its group, or null; an empty table gives no rows; other columns are ignored; very
long texts are hashed whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citescope.llm.batches import chunks, in_arrow, utf8
from citescope.llm.components import components
from citescope.llm.joins import broadcast_if_small
from citescope.session import scratch_path

SEED = 42
MAX_DISTANCE = 3
BLOCK = 1 << 15  # hashes whose bits are counted at a time


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit majority fingerprint of a whole text."""
    words = text.lower().split()  # bytes: lower-cases A-Z, cuts at the six white-space signs
    if not words:
        return 0
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64,
                         len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i:i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes))))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))],
                                             names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).transform(
        in_arrow, rows, "doc_id long, fp long")


def _flips(column: Column, masks: list[int]) -> Column:
    """The variants of a fingerprint, one row each."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in signed]),
                                 lambda m: column.bitwiseXOR(m)))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` with the same components as all
    pairs within three bits; every link is verified."""
    fp = F.col("fp")
    one = [1 << i for i in range(64)]
    near = (fps.select("fp", _flips(fp, [0, *one]).alias("variant"))
            .withColumn("a", F.min("fp").over(Window.partitionBy("variant")))
            .where((F.col("a") != fp) & (_distance("a", "fp") <= 2))
            .select("a", F.col("fp").alias("b")))
    odd = fps.where(F.bit_count(fp) % 2 == 1)
    even = fps.where(F.bit_count(fp) % 2 == 0)
    low = F.lit((1 << 32) - 1)

    def halves(flips: list[int]) -> Column:
        def variants(side: int, half: Column) -> Column:
            return F.transform(F.array(*[F.lit(m).cast("long") for m in flips]),
                               lambda m: F.struct(F.lit(side).alias("side"),
                                                  half.bitwiseXOR(m).alias("half")))

        return F.inline(F.concat(variants(0, fp.bitwiseAND(low)),
                                 variants(1, F.shiftrightunsigned(fp, 32))))

    # The planner takes rows made by explode for as few as their source has and would broadcast
    # them; they must not be, as they grow with the data.
    agreeing = even.select(halves([0, *(1 << i for i in range(32))])).distinct().hint("merge")
    active = (odd.select("fp", halves([0]))
              .join(agreeing, ["side", "half"], "left_semi").select("fp").distinct())
    pairs = [1 << i | 1 << j for h in (0, 32) for i in range(h, h + 32) for j in range(h, i)]
    met = (active.select(F.col("fp").alias("b"), _flips(fp, pairs).alias("variant")).hint("merge")
           .join(even.select(F.col("fp").alias("a"), _flips(fp, one).alias("variant")), "variant")
           .where(_distance("a", "b") <= MAX_DISTANCE).select("a", "b"))
    return near.union(met).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: one row per row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    fingerprints(docs, shingle).write.parquet(path)
    table = spark.read.schema("doc_id long, fp long").parquet(path)
    nodes_path = scratch_path(spark, "nodes")
    table.groupBy("fp").agg(F.min("doc_id").alias("first_doc")).write.parquet(nodes_path)
    nodes = spark.read.schema("fp long, first_doc long").parquet(nodes_path)
    group = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    members = nodes.join(group, "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = members.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_fp = members.join(least, "component").select("fp", "component_id")
    return table.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with exactly one row of every group, all columns as they are: that of the smallest
    doc_id, a null one last; of several texts with that id the one of the smallest hash; of rows
    that repeat it one. Rows are told apart by id and a 64-bit hash of the text, so an id that
    stands for several texts loses none of them but to its own group."""
    spark = docs.sparkSession
    key = [F.col("doc_id").cast("long").alias("doc_id"),
           F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark")]
    names = ["row_id", "row_mark"]
    path, lost_path = scratch_path(spark, "groups"), scratch_path(spark, "lost")
    # The fingerprint follows from the text, so one row per text hash is enough.
    fingerprints(docs.select(key[1].alias("doc_id"), "text"), shingle).distinct().write.parquet(path)
    fps = spark.read.schema("doc_id long, fp long").parquet(path).withColumnRenamed("doc_id", "mark")
    group = components(links(fps.select("fp").distinct())).withColumnRenamed("node", "fp")
    grouped = (fps.join(group, "fp", "left")
               .select("mark", F.coalesce("component", "fp").alias("component")))
    rows = docs.select(*key).groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    no_id = F.col("doc_id").isNull().alias("no_id")
    texts = (rows.groupBy("mark").agg(F.min(F.struct(no_id, "doc_id")).alias("least"))
             .join(grouped, "mark"))
    first = texts.groupBy("component").agg(F.min(F.struct("least", "mark")).alias("first"))
    rows = rows.join(texts.join(first, "component").select(
        "mark", F.col("first.least.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark")),
        "mark")
    kept = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    (rows.where(~kept | (F.col("n") > 1))
     .select(F.col("doc_id").alias(names[0]), F.col("mark").alias(names[1]), kept.alias("kept"))
     .write.parquet(lost_path))
    lost = spark.read.schema("row_id long, row_mark long, kept boolean").parquet(lost_path)
    same = (F.col("row_id").eqNullSafe(F.col("doc_id").cast("long"))
            & (F.col("row_mark") == F.xxhash64(
                F.coalesce(F.col("text").cast("string"), F.lit("")))))
    alone = docs.join(broadcast_if_small(lost.drop("kept"), 17), same, "left_anti")
    repeated = lost.where("kept").drop("kept")
    if not repeated.limit(1).count():
        return alone
    again = (docs.join(broadcast_if_small(repeated, 17), same)
             .dropDuplicates(names).select(*docs.columns))
    return alone.unionByName(again)
