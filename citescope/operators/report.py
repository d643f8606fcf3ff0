"""Report rows and summaries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citescope.functions import urls
from citescope.operators.browser import browser_detail
from citescope.schemas import REPORT_COLUMNS

# ---- fixed values ------------------------------------------------------------------------------
NO_ERROR = "None"                    # the string, not a NULL
NOT_CHECKED = "Not checked"
ARCHIVED_BROWSER_TEXT = "Browser validation not performed."
DEAD_WITHOUT_CODE = "CONNECTION_ERROR"
BLOCKED_WITHOUT_CODE = "BLOCKED"
OTHER_WITHOUT_CODE = "ERROR"
TOP_DEAD_ARTICLES = 5
# -------------------------------------------------------------------------------------------------


def error_code(has_archive: Column, status: Column, code: Column) -> Column:
    """I14."""
    c = code.cast("string")
    return (F.when(has_archive, F.lit(NO_ERROR))
            .when(status.isNull(), F.lit(NOT_CHECKED))
            .when(status == "dead", F.coalesce(c, F.lit(DEAD_WITHOUT_CODE)))
            .when(status == "blocked", F.coalesce(c, F.lit(BLOCKED_WITHOUT_CODE)))
            .when(status == "alive", F.lit(NO_ERROR))
            .otherwise(F.coalesce(c, F.lit(OTHER_WITHOUT_CODE))))


def browser_check(has_archive: Column, status: Column, browser: Column) -> Column:
    """I15."""
    return (F.when(has_archive, F.lit(ARCHIVED_BROWSER_TEXT))
            .when(browser.isNotNull(), browser["status"])
            .when(status.isNotNull(), status)
            .otherwise(F.lit(NOT_CHECKED)))


def browser_check_detail(has_archive: Column, browser: Column, original_url: Column) -> Column:
    """I16 (only for rows re-checked in the browser)."""
    return (F.when(has_archive | browser.isNull(), F.lit(""))
            .otherwise(browser_detail(browser, original_url)))


def report_rows(links: DataFrame, stamp: str | Column) -> DataFrame:
    """K1: one report row per original link occurrence.

    ``links`` carries ``article_title, original_url, first_archive`` (NULL when none),
    ``status, status_code`` (NULL when not checked) and ``browser`` (NULL when not re-checked).
    B8 drops archive URLs; B12 fixes the column order.
    """
    cond, cols = _report_exprs(stamp) if isinstance(stamp, str) else _report_exprs_uncached(stamp)
    return links.where(cond).select(
        *cols, *[c for c in links.columns if c in ("article_pos", "ref_pos", "pair_pos", "link_pos")])


def _report_exprs_uncached(stamp):
    has_archive = F.coalesce(F.col("first_archive"), F.lit("")) != ""
    st = stamp if isinstance(stamp, Column) else F.lit(stamp)
    cols = [
        F.col("article_title"),
        F.col("original_url"),
        F.when(has_archive, F.col("first_archive")).alias("archive_url"),
        has_archive.alias("has_archive"),
        error_code(has_archive, F.col("status"), F.col("status_code")).alias("error_code"),
        st.alias("timestamp"),
        browser_check(has_archive, F.col("status"), F.col("browser")).alias("browser_validation_check"),
        browser_check_detail(has_archive, F.col("browser"), F.col("original_url"))
        .alias("browser_validation_check_detail"),
    ]
    return ~urls.is_archive(F.col("original_url")), cols


_report_exprs = functools.lru_cache(maxsize=64)(_report_exprs_uncached)


def select_report(df: DataFrame) -> DataFrame:
    """B12."""
    return df.select(*REPORT_COLUMNS)


def top_dead_articles(results: DataFrame, n: int = TOP_DEAD_ARTICLES) -> DataFrame:
    """E4 + G4: articles ranked by dead-link count, with the totals and the "and N more" count.

    Dead links are kept per title: a repeated title takes the count of its last occurrence and
    keeps the place of its first one (stable descending sort). Totals are scalar subqueries.
    """
    dead = results.where(F.col("status") == "dead")
    per_occ = dead.groupBy("article_title", "article_pos").agg(F.count("*").alias("dead_links"))
    per_title = per_occ.groupBy("article_title").agg(
        F.max_by("dead_links", "article_pos").alias("dead_links"),
        F.min("article_pos").alias("first_pos"))
    # The ranking and the totals read the same exchange, which the planner reuses.
    n_articles = per_title.select(F.count("*")).scalar()
    n_dead = per_title.select(F.sum("dead_links").cast("bigint")).scalar()
    order = [F.desc("dead_links"), F.asc("first_pos")]
    top = per_title.orderBy(*order).limit(n)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("int").alias("top_pos"),
        "article_title", F.col("dead_links").cast("bigint").alias("dead_links"),
        n_articles.alias("articles_with_dead"), n_dead.alias("total_dead"),
        F.greatest(n_articles - F.lit(n), F.lit(0)).cast("bigint").alias("more_articles"))


def run_totals(results: DataFrame, articles: DataFrame) -> DataFrame:
    """E5: links considered, dead and archived (duplicates counted), and the articles of the
    list, with or without HTML."""
    n_articles = articles.select(F.count("*")).scalar()
    return (results.agg(F.count("*").alias("links_checked"),
                        F.count_if(F.col("status") == "dead").alias("dead_links"),
                        F.count_if(F.col("status") == "archived").alias("archived_links"))
            .select("*", n_articles.alias("articles_processed")))


def links_with_archives(articles: DataFrame) -> DataFrame:
    """Per article row with its ``pairs``, links (occurrences) and distinct originals that
    have archives."""
    links = F.filter("pairs", lambda p: p["original_url"] != "")
    archived = F.filter(links, lambda p: p["archive_url"] != "")
    rows = articles.select("article_pos", F.size(links).cast("long").alias("n_links"), F.size(
        F.array_distinct(F.transform(archived, lambda p: p["original_url"]))).cast("long")
        .alias("n_with_archives"))
    return rows.where("n_links > 0")
