"""Incremental audit on Structured Streaming.

Page files arrive in a directory. The stream takes their paths (``maxFilesPerTrigger`` a batch;
contents are no part of it), and ``foreachBatch`` audits the files of a batch as a batch audit
does: content is read once, at the addresses of the pages that count, and of the evidence only that on
URLs the batch cites leaves its scan.

Output folders, each below ``out_dir``; a batch that is run again overwrites its own folders only:

* ``report/batch_id=<n>/attempt=<k>``: the report rows of the batch;
* ``index/...``: which article copies it holds (article, place, batch), narrow;
* ``quarantine/batch_id=<n>``: its files that could not be read, with size, time and reason.

A file that fails does not end the stream: the files of a failed batch are tried one by one, those
that fail go to quarantine and the rest are audited. If they fail together though each can be
read, all are put there. ``replay`` audits quarantined files again, as a further attempt of their
batch, once they are mended. An article that arrives again, in the same batch or a later one, is
reported by its last copy alone (A5: by ``ingest_pos``, then by arrival): the index says which batch
holds it, and ``read_report`` joins report rows with that, so nothing written is ever rewritten and
a restart changes nothing. ``trigger(availableNow=True)`` drains what is there and stops.
"""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.functions.text import clean_title
from citescope.plans.audit import audit_pages
from citescope.session import scratch_path
from citescope.sources.pages import unique_pages

PAGES = "article_pos long, title string, html string, ingest_pos long"
ARTICLE = ["article_pos", "article_title"]
QUARANTINE = "path string, bytes long, modified timestamp, reason string"
FILES = "path string, modificationTime timestamp, length long, content binary"
REASON_CHARS = 500


def stage_pages(pages: DataFrame, path: str, rows_per_file: int = 100_000) -> str:
    """Writes ``pages`` as parquet files, standing in for pages landing over time: as many as
    the input has partitions, and more where one holds over ``rows_per_file`` rows."""
    (pages.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path))
    return path


class IncrementalAudit:
    """The audit of arriving files against given evidence, written below ``out_dir``."""

    def __init__(self, spark: SparkSession, out_dir: str, probes: DataFrame,
                 browser_obs: DataFrame | None, stamp: str = "19700101_000000",
                 mode: str = "structure", schema: str = PAGES):
        self.spark, self.out_dir, self.schema = spark, out_dir, schema
        self.probes, self.browser_obs = probes, browser_obs
        self.stamp, self.mode = stamp, mode

    def _folder(self, kind: str, batch_id: int, attempt: int | None = None) -> str:
        parts = [self.out_dir, kind, f"batch_id={batch_id}"]
        return os.path.join(*parts, *([f"attempt={attempt}"] if attempt is not None else []))

    def _pages(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _audit(self, paths: list[str], batch_id: int, attempt: int) -> None:
        """Report and index of some files; the index, which makes the rows visible, comes last."""
        article = [F.col("article_pos"), clean_title(F.col("title")).alias("article_title")]
        pages = unique_pages(self._pages(paths), key=("article_pos", "title"), enough=True)
        result = audit_pages(pages.select("article_pos", "title", "html"), self.probes,
                             self.browser_obs, mode=self.mode, stamp=self.stamp, prune=True)
        result.report.write.mode("overwrite").parquet(self._folder("report", batch_id, attempt))
        (pages.select(*article, "ingest_pos").write.mode("overwrite")
         .parquet(self._folder("index", batch_id, attempt)))

    def _reason(self, paths: list[str]) -> str | None:
        """Why files cannot be read whole; None if they can."""
        try:
            self._pages(paths).write.format("noop").mode("overwrite").save()
        except (PySparkException, Py4JJavaError) as e:
            return str(e)[:REASON_CHARS]
        return None

    def process(self, batch: DataFrame, batch_id: int) -> None:
        files = batch.select("path", "length", "modificationTime").collect()  # maxFilesPerTrigger
        good, bad = files, []
        try:
            self._audit([f.path for f in files], batch_id, 0)
        except (PySparkException, Py4JJavaError):
            reasons = {f.path: self._reason([f.path]) for f in files}
            good = [f for f in files if reasons[f.path] is None]
            bad = [(f, reasons[f.path]) for f in files if reasons[f.path] is not None]
            try:
                if good:
                    self._audit([f.path for f in good], batch_id, 0)
            except (PySparkException, Py4JJavaError) as e:
                bad += [(f, str(e)[:REASON_CHARS]) for f in good]
        self._write_quarantine(batch_id, [(f.path, f.length, f.modificationTime, reason)
                                          for f, reason in bad])

    def _write_quarantine(self, batch_id: int, rows: list[tuple]) -> None:
        (self.spark.createDataFrame(rows, QUARANTINE).coalesce(1).write.mode("overwrite")
         .parquet(self._folder("quarantine", batch_id)))

    def quarantine(self) -> DataFrame:
        """path, bytes, modified, reason, batch_id of the files that wait to be mended."""
        return self.spark.read.schema(f"{QUARANTINE}, batch_id long").parquet(
            os.path.join(self.out_dir, "quarantine"))

    def replay(self, mended: dict[str, str] | None = None) -> int:
        """Audits quarantined files again, from ``mended`` paths where those differ; returns how
        many files are left in quarantine."""
        mended, left = mended or {}, 0
        waiting: dict[int, list] = {}
        for r in self.quarantine().collect():
            waiting.setdefault(r.batch_id, []).append(r)
        for batch_id, rows in waiting.items():
            still = [(r.path, r.bytes, r.modified, reason) for r in rows
                     if (reason := self._reason([mended.get(r.path, r.path)])) is not None]
            ready = [mended.get(r.path, r.path) for r in rows if r.path not in {x[0] for x in still}]
            if ready:
                attempts = (self._index().where(F.col("batch_id") == batch_id)
                            .agg(F.max("attempt")).head()[0])
                self._audit(ready, batch_id, (attempts or 0) + 1)
            self._write_quarantine(batch_id, still)
            left += len(still)
        return left

    def _index(self) -> DataFrame:
        return self.spark.read.schema("article_pos long, article_title string, ingest_pos long, "
                                      "batch_id long, attempt int").parquet(
            os.path.join(self.out_dir, "index"))

    def read_report(self) -> DataFrame:
        """The report: of every article the rows of its last copy."""
        last = (self._index().groupBy(*ARTICLE)
                .agg(F.max(F.struct("ingest_pos", "batch_id", "attempt")).alias("last"))
                .select(*(F.col(c).alias(f"_{c}") for c in ARTICLE), "last.batch_id", "last.attempt"))
        rows = self.spark.read.parquet(os.path.join(self.out_dir, "report"))
        rows = rows.withColumn("batch_id", F.col("batch_id").cast("long"))
        same = [rows[c].eqNullSafe(last[f"_{c}"]) for c in ARTICLE]
        return (rows.join(last, [*same, rows.batch_id == last.batch_id, rows.attempt == last.attempt],
                          "left_semi").drop("attempt"))

    def run(self, pages_dir: str, checkpoint: str, max_files_per_trigger: int = 64) -> DataFrame:
        """Runs the stream over ``pages_dir`` (folders below it too) until nothing is left."""
        arriving = (self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
                    .option("maxFilesPerTrigger", max_files_per_trigger).load(pages_dir))
        query = (arriving.select("path", "length", "modificationTime")
                 .writeStream.foreachBatch(self.process)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        return self.read_report()


def run_incremental_audit(spark: SparkSession, pages_dir: str, out_dir: str, probes: DataFrame,
                          browser_obs: DataFrame | None, checkpoint: str | None = None,
                          max_files_per_trigger: int = 64, stamp: str = "19700101_000000",
                          mode: str = "structure") -> DataFrame:
    """Runs the stream to completion and returns the report (see the module).

    ``pages_dir`` holds parquet files of ``(article_pos, title, html[, ingest_pos])``.
    """
    audit = IncrementalAudit(spark, out_dir, probes, browser_obs, stamp, mode)
    return audit.run(pages_dir, checkpoint or out_dir + "-checkpoint", max_files_per_trigger)


def incremental_audit_from(spark: SparkSession, pages: DataFrame, probes: DataFrame,
                           browser_obs: DataFrame | None, max_files_per_trigger: int = 4,
                           stamp: str = "19700101_000000") -> DataFrame:
    """Stages ``pages`` into a fresh folder under the checkpoint folder and streams them."""
    base = scratch_path(spark, "incremental-audit")
    pages_dir = stage_pages(pages, os.path.join(base, "pages"))
    return run_incremental_audit(spark, pages_dir, os.path.join(base, "out"), probes, browser_obs,
                                 checkpoint=os.path.join(base, "checkpoint"), stamp=stamp,
                                 max_files_per_trigger=max_files_per_trigger)
