"""Article ranking from page-view facts.

Input: ``pageviews(view_day DATE, pos, article, rank, views)``, one row per article and day,
``pos`` being the position in that day's document (the documents list articles by rank).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citescope.functions.text import (DEFAULT_RANK, DEFAULT_VIEWS, SCORE_APPEARANCE_WEIGHT,
                                      non_article_title, rank_weighted_score)

# ---- fixed values ------------------------------------------------------------------------------
# The ten representative days of the long-run ranking, in the order they are sampled.
SAMPLE_DAYS = [
    dt.date(2024, 1, 1),
    dt.date(2023, 12, 25),
    dt.date(2023, 7, 4),
    dt.date(2023, 3, 15),
    dt.date(2022, 12, 31),
    dt.date(2022, 6, 15),
    dt.date(2022, 1, 15),
    dt.date(2021, 12, 25),
    dt.date(2021, 7, 4),
    dt.date(2021, 3, 15),
]
DEFAULT_LIMIT = 25
# -------------------------------------------------------------------------------------------------


def with_defaults(pageviews: DataFrame) -> DataFrame:
    """Absent title -> '', rank -> 1000, views -> 0 (a missing title is kept, not dropped)."""
    return (pageviews
            .withColumn("article", F.coalesce(F.col("article"), F.lit("")))
            .withColumn("rank", F.coalesce(F.col("rank"), F.lit(DEFAULT_RANK).cast("bigint")))
            .withColumn("views", F.coalesce(F.col("views"), F.lit(DEFAULT_VIEWS).cast("bigint"))))


def article_rows(pageviews: DataFrame) -> DataFrame:
    """B1: drop special pages and the main page."""
    return pageviews.where(~non_article_title(F.col("article")))


def sampled_days(pageviews: DataFrame, days=None) -> DataFrame:
    """A2: rows of the sampled days only (a partition filter when the data is laid out by day),
    with ``day_order`` = the day's place in the sampling order."""
    days = list(SAMPLE_DAYS if days is None else days)
    order = F.lit(None).cast("int")
    for i, d in reversed(list(enumerate(days))):
        order = F.when(F.col("view_day") == F.lit(d), F.lit(i)).otherwise(order)
    return with_defaults(pageviews.where(F.col("view_day").isin(days))).withColumn("day_order", order)


def daily_top(pageviews: DataFrame, day, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A1 + G1: the first ``limit`` article titles of one day's document, after B1.

    ``orderBy(pos).limit(n)`` plans to a per-partition top-n (TakeOrderedAndProject); the
    numbering window then runs over at most ``limit`` rows.
    """
    if limit <= 0:
        return pageviews.sparkSession.createDataFrame([], "top_pos int, article string, views bigint")
    rows = article_rows(with_defaults(pageviews.where(F.col("view_day") == F.lit(day))))
    top = rows.orderBy("pos", "article").limit(limit).select("pos", "article", "views")
    return top.select(F.row_number().over(Window.orderBy("pos", "article")).cast("int").alias("top_pos"),
                      "article", "views")


def daily_tops(pageviews: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A1 + G1 for every day at once: the first ``limit`` titles of each daily document.

    ``row_number() <= k`` is planned as a WindowGroupLimit: before the shuffle each partition
    keeps at most k rows per day, so a day holding a large share of all rows costs no more
    than any other.
    """
    rows = article_rows(with_defaults(pageviews))
    w = Window.partitionBy("view_day").orderBy("pos", "article")
    return (rows.withColumn("top_pos", F.row_number().over(w).cast("int"))
            .where(F.col("top_pos") <= max(int(limit), 0))
            .select("view_day", "top_pos", "article", "views"))


def popular_scored(pageviews: DataFrame, limit: int = DEFAULT_LIMIT, days=None,
                   all_days: bool = True) -> DataFrame:
    """E1 + G2: rank-weighted long-run ranking.

    Per row ``views / sqrt(rank)``; per title the sum, the number of appearances and the sum of
    views; final score ``sum * (1 + 0.1 * appearances)``; descending, ties by first appearance
    (day order, then position). ``all_days`` ranks over every day present (ascending dates),
    otherwise over ``days`` (default: the ten sample days). A zero rank drops only that row.
    Non-positive limits give no rows.
    """
    if all_days:
        pv = with_defaults(pageviews).withColumn("day_order", F.datediff("view_day", F.lit("1970-01-01")))
    else:
        pv = sampled_days(pageviews, days)
    rows = (article_rows(pv)
            .withColumn("score", rank_weighted_score(F.col("views"), F.col("rank")))
            .where(F.col("score").isNotNull() & (F.col("rank") > 0)))
    agg = (rows.groupBy("article")
           .agg(F.sum("score").alias("total_score"),
                F.count("*").alias("appearances"),
                F.sum("views").alias("total_views"),
                # (day order, position) packed into one long keeps the aggregate hash-based.
                F.min(F.col("day_order").cast("long") * F.lit(1 << 32) + F.col("pos").cast("long"))
                .alias("first_seen")))
    scored = agg.withColumn(
        "score", F.col("total_score") * (F.lit(1.0) + F.col("appearances") * F.lit(SCORE_APPEARANCE_WEIGHT)))
    n = max(int(limit), 0)
    top = scored.orderBy(F.desc("score"), F.asc("first_seen")).limit(n)
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("score"), F.asc("first_seen"))).cast("int").alias("top_pos"),
        F.col("article").alias("title"),
        F.round("score", 6).alias("score"),
        F.col("appearances").cast("bigint").alias("appearances"),
        F.col("total_views").cast("bigint").alias("total_views"))
