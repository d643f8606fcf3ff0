"""Page-view document sources.

Daily documents have the shape ``{"items": [{"articles": [{"article", "rank", "views"}]}]}``.
Stored one file per day under ``.../view_day=YYYY-MM-DD/``, the day is a partition column, so a
filter on sampled days prunes whole directories before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.schemas import PAGEVIEW_DOC_SCHEMA


ARTICLES_PER_DOC = 1000  # fixed value: the length of a daily document


def write_pageview_docs(views: DataFrame, path: str) -> None:
    """``views`` (view_day, rank, article, views) as documents, in rank order; a day with more
    articles than a document holds has several, numbered by the folder ``part=``."""
    entry = F.struct("rank", "article", "views")
    part = F.expr(f"cast((rank - 1) div {ARTICLES_PER_DOC} as int)")
    (views.groupBy("view_day", part.alias("part")).agg(F.sort_array(F.collect_list(entry)).alias("articles"))
     .select("view_day", "part", F.to_json(F.struct(F.array(F.struct("articles")).alias("items"))))
     .write.partitionBy("view_day", "part").text(path))


def read_pageview_docs(spark: SparkSession, path: str) -> DataFrame:
    """A1/A2 + C7: one row per article entry, ``pos`` = 1-based position in the day's document,
    or over its documents where they have a ``part``.

    Only ``items[0]`` is read. Malformed documents yield no rows (PERMISSIVE mode).
    Absent fields are defaulted later (``popularity.with_defaults``).
    """
    docs = (spark.read.schema(PAGEVIEW_DOC_SCHEMA).option("mode", "PERMISSIVE")
            .option("multiLine", True).json(path))
    cols = [c for c in docs.columns if c not in ("items", "part")]
    before = F.col("part") * ARTICLES_PER_DOC if "part" in docs.columns else F.lit(0)
    first = F.try_element_at(F.col("items"), F.lit(1))["articles"]
    return (docs.select(*cols, before.alias("before"), F.posexplode(first).alias("pos", "a"))
            .select(*cols, (F.col("before") + F.col("pos") + 1).cast("int").alias("pos"),
                    "a.article", "a.rank", "a.views"))
