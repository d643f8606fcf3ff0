"""Report sinks and read-back.

The report is a directory of CSV part files with a header (one logical table), written once per
run or appended per batch, each batch in a folder of its run and number.
``''`` and NULL stay distinct: NULL is written as an empty field, ``''`` as ``""``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.schemas import REPORT_COLUMNS, REPORT_SCHEMA

CSV_OPTIONS = {"header": "true"}   # defaults: NULL <-> empty field, "" <-> quoted empty


def write_header_only(spark: SparkSession, path: str) -> None:
    """An empty report with the header row."""
    (spark.createDataFrame([], REPORT_SCHEMA).coalesce(1).write.mode("errorifexists")
     .options(**CSV_OPTIONS).csv(path))


def append_report(report: DataFrame, path: str, stamp: str, batch: int | str) -> None:
    """A8 + H3: append the rows of one batch of a run (union all with what is there). They go to
    the folder of that run and batch, which a repeated attempt replaces, so that a batch counts
    once however often it is written; no other rows are touched."""
    (report.select(*REPORT_COLUMNS).write.mode("overwrite").options(**CSV_OPTIONS)
     .csv(f"{path.rstrip('/')}/run={stamp}/batch={batch}"))


def report_path(output_dir: str, stamp: str, batch: int | None = None) -> str:
    """I12 naming: ``all_references[_batch_NNN]_<stamp>.csv`` (a folder of CSV parts)."""
    name = f"all_references_batch_{batch:03d}_{stamp}.csv" if batch is not None else f"all_references_{stamp}.csv"
    return f"{output_dir.rstrip('/')}/{name}"


def write_full_report(report: DataFrame, output_dir: str, stamp: str, batch: int | None = None) -> str:
    """The whole-run report under its run-stamped name; fails if the target exists."""
    path = report_path(output_dir, stamp, batch)
    report.select(*REPORT_COLUMNS).write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)
    return path


_EMPTY_MARK = "\u0001"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A10: read back with the declared schema (no inference).

    The reader folds a quoted empty field into NULL by default; a marker keeps it apart and
    is mapped back to ``''``.
    """
    df = (spark.read.schema(REPORT_SCHEMA).options(**CSV_OPTIONS).option("emptyValue", _EMPTY_MARK)
          .option("recursiveFileLookup", "true").csv(path))
    return df.select(*[
        (F.when(F.col(f.name) == _EMPTY_MARK, F.lit("")).otherwise(F.col(f.name)).alias(f.name)
         if f.dataType.typeName() == "string" else F.col(f.name)) for f in REPORT_SCHEMA.fields])
