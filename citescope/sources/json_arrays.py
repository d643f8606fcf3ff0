"""JSON arrays of any length as tables: a splittable reader and a parallel writer.

Reading. The text source cuts a file at commas and splits it among tasks; a row is the text
between two commas, and its split is known by file and first byte. Whether a comma ends an
element depends on what came before: on being inside a string, and on the depth.

1. Every split is read under both assumptions (it starts inside a string, or outside) and says
   for each how it ends, by how much the depth changes, and how many commas it has by depth (a
   file's last piece has none, which the next step takes off).
2. These are chained per file, one row a split: now every split knows its state, its depth and
   the number of the element it starts in.
3. Every split is cut into elements. Those that lie in several splits are put together by their
   number; no other element leaves its task.

Writing. Elements are range-partitioned in order, between a row for the opening and one for the
closing bracket, and sorted; every element but the first, which a minimum over the order finds,
is preceded by a comma. The part files in the order of their names are one array, an element a
line. No task holds more than its own part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citescope.operators.joins import BROADCAST_BYTES
from citescope.session import scratch_path

_STRING_ENDS = re.compile(r'\\.|"', re.S)
_PLAIN = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_SPLIT = ["source", "file", "start"]
_STATE = "in_string boolean, ends_in_string boolean, delta int, commas map<int,long>"
BUCKET = 4096  # positions numbered together


def _after(piece: str, in_string: bool) -> tuple[bool, int]:
    """(inside a string?, change of depth) behind a piece that holds no comma."""
    if in_string:
        end = next((m for m in _STRING_ENDS.finditer(piece) if m[0] == '"'), None)
        if end is None:
            return True, 0
        piece = piece[end.end():]
    plain = _PLAIN.sub("", piece)
    inside = '"' in plain
    if inside:
        plain = plain[:plain.index('"')]
    return inside, sum(map(plain.count, "[{")) - sum(map(plain.count, "]}"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """source, file, start, value: the texts between commas in order within their split.
    Part files of one folder are one source."""
    file = F.col("_metadata.file_path")
    part = F.regexp_extract(file, r"^(.*)/part-[0-9]{5,}[^/]*$", 1)
    return (spark.read.option("lineSep", ",").text(path)
            .select(F.when(part != "", part).otherwise(file).alias("source"), file.alias("file"),
                    F.col("_metadata.file_block_start").alias("start"), "value"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    rows = (r for batch in batches for r in batch.to_pylist())
    return groupby(rows, key=lambda r: tuple(r[c] for c in _SPLIT))


def _states(pieces: DataFrame) -> DataFrame:
    """Per split and assumption its end, its change of depth and its commas by depth."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _by_split(batches):
            now = {False: (False, 0), True: (True, 0)}
            commas = {False: Counter(), True: Counter()}
            for r in rows:
                for start, (inside, depth) in now.items():
                    inside, change = _after(r["value"], inside)
                    now[start] = inside, depth + change
                    if not inside:
                        commas[start][depth + change] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * 2), pa.array([key[1]] * 2), pa.array([key[2]] * 2, pa.int64()),
                 pa.array([False, True]), pa.array([now[s][0] for s in (False, True)]),
                 pa.array([now[s][1] for s in (False, True)], pa.int32()),
                 pa.array([list(commas[s].items()) for s in (False, True)],
                          pa.map_(pa.int32(), pa.int64()))],
                [*_SPLIT, "in_string", "ends_in_string", "delta", "commas"])

    return pieces.select(*_SPLIT, "value").mapInArrow(
        read, "source string, file string, start long, " + _STATE)


_CHAINED = ("source string, file string, start long, in_string boolean, depth int, element long, "
            "file_end boolean, last long")


def _chained(states: DataFrame) -> DataFrame:
    """The state, depth and element in which every split starts, and its array's last element
    (-1 where the array does not end)."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for source, mine in groupby(rows, key=lambda r: r["source"]):
            inside, depth, element, out = False, 0, 0, []
            for (_, file, start), both in groupby(mine, key=lambda r: tuple(r[c] for c in _SPLIT)):
                if out and out[-1][1] != file:  # the split before was the last of its file
                    out[-1] = (*out[-1][:6], True)
                    element -= not inside and depth == 1
                out.append((source, file, start, inside, depth, element, False))
                taken = next(r for r in list(both) if r["in_string"] == inside)
                element += dict(taken["commas"]).get(1 - depth, 0)
                inside, depth = taken["ends_in_string"], depth + taken["delta"]
            out[-1] = (*out[-1][:6], True)
            last = -1 if inside or depth else element
            yield pa.RecordBatch.from_pylist(
                [dict(zip(_NAMES, (*x, last))) for x in out], schema=_ARROW)

    return (states.repartition("source").sortWithinPartitions(*_SPLIT, "in_string")
            .mapInArrow(chain, _CHAINED))


_NAMES = [x.split()[0] for x in _CHAINED.split(", ")]
_ARROW = pa.schema(list(zip(_NAMES, [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int32(),
                                     pa.int64(), pa.bool_(), pa.int64()])))
_FRAGMENTS = "source string, file string, start long, last long, element long, whole boolean, text string"


def _fragments(pieces: DataFrame) -> DataFrame:
    """Elements, or the parts of them that a split holds (``whole`` is false). Every piece had a
    comma behind it, but for the last of a file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, file, start), rows in _by_split(batches):
            held: list[str] = []
            out: list[tuple[int, bool, str]] = []
            r = next(rows)
            inside, depth, element, file_end, last = (r[c] for c in _NAMES[3:])
            while r is not None:
                piece, r = r["value"], next(rows, None)
                inside, change = _after(piece, inside)
                depth += change
                held.append(piece)
                if not inside and depth == 1 and not (file_end and r is None):
                    # the first may have begun in an earlier split
                    out.append((element, bool(out), ",".join(held)))
                    held, element = [], element + 1
            if held:
                out.append((element, False, ",".join(held) + "," * (not file_end)))
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([source] * n), pa.array([file] * n), pa.array([start] * n, pa.int64()),
                 pa.array([last] * n, pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.string())],
                [x.split()[0] for x in _FRAGMENTS.split(", ")])

    return pieces.select(*_NAMES, "value").mapInArrow(cut, _FRAGMENTS)


def _measured(side: DataFrame, name: str, row_bytes: int) -> DataFrame:
    """A narrow side, written, and broadcast if its rows are few enough."""
    path = scratch_path(side.sparkSession, name)
    side.write.parquet(path)
    side = side.sparkSession.read.schema(side.schema).parquet(path)
    return F.broadcast(side) if side.count() * row_bytes <= BROADCAST_BYTES else side


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """source, element (from 0), value (a variant) of the elements of JSON arrays, one array a
    file, or one a folder of part files. A file that is no array, or that does not parse, gives
    no rows. An element, not an array, has to fit into a task."""
    pieces = _pieces(spark, path)
    starts = _measured(_chained(_states(pieces)), "splits", 256)  # a row a split of the files
    found = _fragments(pieces.join(starts, _SPLIT))
    # A split's first element may have begun before it, and its last goes on behind it.
    parts = (found.where("NOT whole").groupBy("source", "last", "element")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
                 "file", "start", "text"))), lambda x: x["text"]), "").alias("text")))
    each = found.where("whole").select("source", "last", "element", "text").unionByName(parts)
    text = F.col("text")
    opened = F.when(F.col("element") > 0, text).when(
        text.rlike(r"^\s*\["), F.regexp_replace(text, r"^\s*\[", ""))
    closed = F.when(F.col("element") < F.col("last"), opened).when(
        (F.col("last") >= 0) & opened.rlike(r"\]\s*\z"), F.regexp_replace(opened, r"\]\s*\z", ""))
    each = (each.select("source", "last", "element", closed.alias("text"))
            .where(~((F.col("last") == 0) & F.coalesce(F.col("text").rlike(r"^\s*\z"), F.lit(False))))
            # The parser ignores what follows a value: within both brackets nothing can.
            .select("source", "element", *(
                F.try_variant_get(F.try_parse_json(F.concat(F.lit(a), "text", F.lit(b))), at, "variant")
                .alias(name) for a, b, at, name in (("[", "]", "$[0]", "value"),
                                                    ('{"v":', "}", "$.v", "again"))))
            .select("source", "element", F.when(F.col("again").isNotNull(), F.col("value")).alias("value")))
    bad = _measured(each.where("value IS NULL").select("source").distinct(), "no-arrays", 256)
    return each.join(bad, "source", "left_anti")


def numbered(rows: DataFrame, key: str, order: str, position: str) -> DataFrame:
    """``rows`` with their place among those of ``key`` in order of the whole number ``order``,
    from 0: by prefix sums over buckets of it, so that no task sees more than a bucket."""
    bucket = F.expr(f"{order} div {BUCKET}")
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(key, "_bucket").orderBy(order)
    return (rows.join(sums, [key, "_bucket"])
            .withColumn(position, F.col("_before") + F.row_number().over(here) - 1)
            .drop("_bucket", "_before"))


def write_array(elements: DataFrame, path: str, order: list[str], json: str = "json") -> None:
    """One JSON array of the column ``json`` in order of ``order``, then of the text."""
    row = elements.select(F.struct(*order).alias("at"), F.col(json).alias("raw"))
    first = row.agg(F.min(F.struct("at", "raw"))).scalar()
    # Equal rows are told apart, so that one row alone is the first.
    row = (row.groupBy("at", "raw").agg(F.count("*").alias("n"))
           .select(F.lit(1).alias("part"), "at", "raw",
                   F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")))
    is_first = (F.struct("at", "raw") == first) & (F.col("copy") == 1)
    row = row.withColumn("text", F.when(is_first, F.col("raw")).otherwise(F.concat(F.lit(","), "raw")))
    brackets = elements.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, text string")
    (row.unionByName(brackets, allowMissingColumns=True)
     .repartitionByRange("part", "at", "raw", "copy")
     .sortWithinPartitions("part", "at", "raw", "copy")
     .select("text").write.mode("errorifexists").text(path))
