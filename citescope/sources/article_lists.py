"""Saved article lists (A3, A6, C6, G3) and popular-article records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.schemas import POPULAR_RECORD_SCHEMA
from citescope.sources.json_arrays import numbered, read_arrays, write_array


def _title(item: Column) -> Column:
    """The title of an element: an object's ``title`` or a bare string; else null."""
    return F.when(F.schema_of_variant(item).startswith("OBJECT"),
                  F.try_variant_get(item, "$.title", "string")).when(
        F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))


def read_article_list(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """A3 + C6: ``(source, article_pos, title)`` from JSON files whose top level is an array of
    objects with ``title`` or of bare strings (other elements ignored; no filter, no dedup), or
    from folders of part files that make up one array (``write_popular_records``).

    A file whose top level is not an array, or that does not parse, gives no rows. A ``null``
    title is dropped. ``limit > 0`` keeps the first ``limit`` entries per list (G3). A list may be
    of any length: it is read by many tasks.
    """
    titles = (read_arrays(spark, path).select("source", "element", _title(F.col("value")).alias("title"))
              .where("title IS NOT NULL"))
    rows = numbered(titles, "source", "element", "article_pos")
    return (rows.where(F.col("article_pos") < limit) if limit > 0 else rows).select(
        "source", "article_pos", "title")


def write_lists(lists: DataFrame, path: str, key: str) -> None:
    """Many saved lists, one a line: ``lists`` has ``key`` and ``value``, the JSON array."""
    (lists.select(F.to_json(F.struct(F.col(key).alias("key"), F.col("value").alias("list"))))
     .write.mode("errorifexists").text(path))


def read_lists(spark: SparkSession, path: str, key: str, key_type: str = "string",
               limit: int = 0) -> DataFrame:
    """``(key, article_pos, title)`` of lists written by ``write_lists``."""
    lines = spark.read.schema("key string, list string").json(path)
    arrays = lines.select(F.col("key").cast(key_type).alias(key), F.try_parse_json("list").alias("v")
                          ).where(F.schema_of_variant("v").startswith("ARRAY"))
    titles = F.filter(F.transform(F.try_variant_get("v", "$", "array<variant>"), _title),
                      lambda t: t.isNotNull())
    titles = F.slice(titles, 1, limit) if limit > 0 else titles
    return (arrays.select(key, F.posexplode(titles).alias("pos", "title"))
            .select(key, F.col("pos").cast("long").alias("article_pos"), "title"))


def write_popular_records(records: DataFrame, path: str, order=()) -> None:
    """One JSON array (UTF-8, non-ASCII kept) of ``title, display_text, url`` in order of
    ``order``, as part files that ``read_article_list`` reads as one list."""
    fields = [f.name for f in POPULAR_RECORD_SCHEMA.fields]
    write_array(records.select(*order, F.to_json(F.struct(*fields)).alias("_json")), path,
                list(order) or ["_json"], "_json")


def read_popular_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of saved lists (any order)."""
    value = F.col("value")
    return read_arrays(spark, path).where(F.schema_of_variant(value).startswith("OBJECT")).select(
        *[F.try_variant_get(value, f"$.{f.name}", "string").alias(f.name)
          for f in POPULAR_RECORD_SCHEMA.fields])
