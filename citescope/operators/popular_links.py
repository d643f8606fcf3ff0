"""Popular-list link extraction.

A regex over raw HTML, evaluated in the JVM. Each page is one row; its matches are handled as
arrays inside that row (namespace filter, decoding, first occurrence per title, text cleaning),
so the operator needs no shuffle and scales with the number of pages.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.functions.text import ARTICLE_URL_BASE, clean_link_text, percent_decode
from citescope.operators.staging import stage

# ---- fixed values ------------------------------------------------------------------------------
# Title prefixes of non-article namespaces (tested on the undecoded href, case-sensitive).
NAMESPACE_PREFIXES = [
    "Special:", "User:", "Talk:", "Wikipedia:", "File:", "Category:", "Template:", "Help:",
    "Portal:", "MediaWiki:", "Module:", "Project:", "Media:",
    "User_talk:", "Wikipedia_talk:", "File_talk:", "Category_talk:", "Template_talk:",
    "Help_talk:", "Portal_talk:", "MediaWiki_talk:", "Module_talk:", "Project_talk:", "Media_talk:",
]
MAIN_PAGE = "Main_Page"
# Relative article links as served by the page API: ./Title (fragment dropped) and link text.
LINK_PATTERN = '<a[^>]*href="{prefix}([^"#]+)(?:#[^"]*)?"[^>]*>([^<]+)</a>'
DEFAULT_PREFIX = "./"
# -------------------------------------------------------------------------------------------------

_NS_RE = "^(?:" + "|".join(re.escape(p) for p in NAMESPACE_PREFIXES) + ")"


def link_pattern(prefix: str = DEFAULT_PREFIX) -> str:
    return LINK_PATTERN.format(prefix=re.escape(prefix))


def is_namespace_link(href) -> Column:
    """B2: namespace page or the main page."""
    h = F.col(href) if isinstance(href, str) else href
    return h.rlike(_NS_RE) | (h == MAIN_PAGE)


def raw_links(html: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """All (href, text) matches of one page, in document order."""
    p = F.lit(link_pattern(prefix))
    return F.arrays_zip(F.regexp_extract_all(html, p, 1).alias("href"),
                        F.regexp_extract_all(html, p, 2).alias("text"))


def _decoded_links(html: Column, prefix: str) -> Column:
    """B2 on the raw href, then I8: ``array<struct<title, text>>`` in document order."""
    links = F.filter(raw_links(html, prefix), lambda x: ~is_namespace_link(x["href"]))
    return F.transform(links, lambda x: F.struct(percent_decode(x["href"]).alias("title"),
                                                 x["text"].alias("text")))


def first_occurrences(pages: DataFrame, html: str = "html", keys=("page_id",),
                      prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """E8 for C1: per page, the first (title, raw text) of every decoded title, in order.

    Sort-based, O(n log n) per page: (title, position) pairs are sorted, the first element of
    each title run is kept, and the survivors are put back in document order. The sorted
    array is staged once per row so the run test reads it instead of re-sorting.
    """
    k = list(keys)
    dec = stage(pages, k, _dec=_decoded_links(F.col(html), prefix))
    by_title = F.array_sort(F.transform("_dec", lambda x, i: F.struct(
        x["title"].alias("title"), i.alias("pos"), x["text"].alias("text"))))
    srt = stage(dec, k, _srt=by_title)
    starts = F.filter("_srt", lambda x, j: (j == 0) | (
        F.element_at(F.col("_srt"), F.greatest(j, F.lit(1))).getField("title") != x["title"]))
    in_order = F.array_sort(F.transform(starts, lambda x: F.struct(
        x["pos"].alias("pos"), x["title"].alias("title"), x["text"].alias("text"))))
    firsts = F.transform(in_order, lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    return srt.select(*k, firsts.alias("firsts"))


def _kept_links(firsts: Column, base: str, limit: int) -> Column:
    cleaned = F.transform(firsts, lambda x: F.struct(
        x["title"].alias("title"), clean_link_text(x["text"]).alias("display_text"),
        F.concat(F.lit(base), x["title"]).alias("url")))
    kept = F.filter(cleaned, lambda x: F.length(x["display_text"]) > 1)
    return F.slice(kept, 1, limit) if limit > 0 else kept


def article_links_json(pages: DataFrame, html: str = "html", keys=("page_id",),
                       prefix: str = DEFAULT_PREFIX, base: str = ARTICLE_URL_BASE,
                       limit: int = 0) -> DataFrame:
    """C1 + A6: per page, the JSON array of ``{title, display_text, url}`` records (the saved
    popular-list form, readable by ``article_lists.read_article_list``), built from the page's
    own link array: no regrouping of exploded rows."""
    k = list(keys)
    firsts = first_occurrences(pages, html, k, prefix)
    return firsts.select(*k, F.to_json(_kept_links(F.col("firsts"), base, limit)).alias("json"))


def article_links_df(pages: DataFrame, html: str = "html", keys=("page_id",),
                     prefix: str = DEFAULT_PREFIX, base: str = ARTICLE_URL_BASE,
                     limit: int = 0) -> DataFrame:
    """C1 for every page: one row per kept link, ``link_pos`` 0-based among kept links.

    Namespace filter on the raw href, percent-decoding, first occurrence per decoded title,
    then the text test (a bad first occurrence hides a later good one), then the optional
    limit (only when ``limit > 0``). No shuffle: every step is inside the page's row.
    """
    k = list(keys)
    firsts = first_occurrences(pages, html, k, prefix)
    kept = _kept_links(F.col("firsts"), base, limit)
    return (firsts.select(*k, F.posexplode(kept).alias("link_pos", "l"))
            .select(*k, F.col("link_pos").cast("int").alias("link_pos"),
                    "l.title", "l.display_text", "l.url"))
