"""Query catalog: every operator of the blueprint as a (Spark plan, DuckDB oracle SQL) pair.

Each Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver
tables (or fixtures derived from them). Each oracle is an independent DuckDB statement over the
same tables. Column names and types are aligned between the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope import fixtures as FX
from citescope.functions import text as TX
from citescope.functions import urls as U
from citescope.operators import browser as B
from citescope.operators import extraction as X
from citescope.operators import pairing as P
from citescope.operators import popular_links as PL
from citescope.operators import popularity as POP
from citescope.operators import probes as J
from citescope.operators import report as R
from citescope.operators.staging import stage
from citescope.plans import audit as A
from citescope.plans import oracle as O
from citescope.sources import pages as PG

RUN_STAMP = "20240131_235959"   # run parameter recorded in every report row
DRIVER_PAGE_PREFIX = "/"        # driver pages link as "/Title" instead of "./Title"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return FX.table(spark, sf_dir, name)


def _raw_pages(spark, sf_dir) -> DataFrame:
    """Driver pages for per-document parsing."""
    return PG.read_pages(spark, f"{sf_dir}/pages.parquet")


def _pageviews(spark, sf_dir) -> DataFrame:
    # Documents list articles by rank, so the document position is the rank.
    return _t(spark, sf_dir, "fx_pageviews").withColumn("pos", F.col("rank").cast("int"))


DUCK_FX_HTML = """fx_html AS (
  SELECT title, article_pos,
         concat('<html><body><h2>References</h2><ol class="mw-references references">',
                string_agg(concat('<li><cite><a href="', replace(original_url, '&', '&amp;'), '">o</a>',
                                  CASE WHEN archive_url IS NULL THEN ''
                                       ELSE concat(' <a href="', replace(archive_url, '&', '&amp;'), '">a</a>') END,
                                  '</cite><a href="#back">^</a></li>'), '' ORDER BY ref_pos),
                '</ol></body></html>') AS html
  FROM fx_refs GROUP BY title, article_pos)"""

# Links of every fx_refs article in document order: original, then its archive.
DUCK_LINKS = """lk AS (
  SELECT article_pos, title, ref_pos * 2 AS pos, original_url AS url FROM fx_refs
  UNION ALL
  SELECT article_pos, title, ref_pos * 2 + 1 AS pos, archive_url AS url FROM fx_refs WHERE archive_url IS NOT NULL),
dl AS (SELECT article_pos, url, min(pos) AS pos FROM lk GROUP BY article_pos, url)"""


def _with(*names: str, extra: list[str] | None = None) -> str:
    head = FX.cte(*names)
    if extra:
        head = head.rstrip("\n") + ",\n" + ",\n".join(extra) + "\n"
    return head


# ================================ ranking (A1, A2, B1, E1, G1, G2, I10-I13) ================

@query("popular_scored", _with("fx_pageviews") + """,
r AS (SELECT article, views, rank, datediff('day', DATE '1970-01-01', view_day) AS day_order,
             CAST(views AS DOUBLE) / sqrt(CAST(rank AS DOUBLE)) AS score
      FROM fx_pageviews
      WHERE NOT (starts_with(article, 'Special:') OR article = 'Main_Page') AND rank > 0),
g AS (SELECT article, sum(score) AS total_score, count(*) AS appearances,
             CAST(sum(views) AS BIGINT) AS total_views, min(day_order * 100000000 + rank) AS first_seen
      FROM r GROUP BY article),
s AS (SELECT article, total_score * (1.0::DOUBLE + appearances * 0.1::DOUBLE) AS score,
             appearances, total_views, first_seen FROM g)
SELECT CAST(row_number() OVER (ORDER BY score DESC, first_seen) AS INTEGER) AS top_pos,
       article AS title, round(score, 6) AS score, CAST(appearances AS BIGINT) AS appearances, total_views
FROM s ORDER BY score DESC, first_seen LIMIT 25""")
def popular_scored(spark, sf_dir):
    """E1 flagship of the ranking: rank-weighted long-run top 25 over every day."""
    return POP.popular_scored(_pageviews(spark, sf_dir), limit=25)


@query("pageview_documents", _with("fx_pageviews") + """
SELECT view_day, CAST(rank AS INTEGER) AS pos, article, rank, CAST(views AS BIGINT) AS views
FROM fx_pageviews""")
def pageview_documents(spark, sf_dir):
    """C7 + A1: the articles of every day written as JSON documents of at most 1,000 articles (a
    day's form and length), in folders of the day and the part of it, and read back."""
    from citescope.session import scratch_path
    from citescope.sources import pageviews as PV

    path = scratch_path(spark, "pageview-documents")
    PV.write_pageview_docs(_t(spark, sf_dir, "fx_pageviews"), path)
    return PV.read_pageview_docs(spark, path).select("view_day", "pos", "article", "rank", "views")


_DAYS_LIST = ", ".join(f"DATE '{d.isoformat()}'" for d in POP.SAMPLE_DAYS)


@query("popular_scored_sampled", _with("fx_pageviews") + f""",
pv AS (SELECT list_extract([{_DAYS_LIST}], 1 + datediff('day', DATE '1970-01-01', view_day) % 10) AS view_day,
              article, views, rank, datediff('day', DATE '1970-01-01', view_day) % 10 AS day_order FROM fx_pageviews),
r AS (SELECT article, views, rank, day_order, CAST(views AS DOUBLE) / sqrt(CAST(rank AS DOUBLE)) AS score
      FROM pv WHERE NOT (starts_with(article, 'Special:') OR article = 'Main_Page') AND rank > 0),
g AS (SELECT article, sum(score) AS total_score, count(*) AS appearances,
             CAST(sum(views) AS BIGINT) AS total_views, min(day_order * 100000000 + rank) AS first_seen
      FROM r GROUP BY article),
s AS (SELECT article, total_score * (1.0::DOUBLE + appearances * 0.1::DOUBLE) AS score,
             appearances, total_views, first_seen FROM g)
SELECT CAST(row_number() OVER (ORDER BY score DESC, first_seen) AS INTEGER) AS top_pos,
       article AS title, round(score, 6) AS score, CAST(appearances AS BIGINT) AS appearances, total_views
FROM s ORDER BY score DESC, first_seen LIMIT 25""")
def popular_scored_sampled(spark, sf_dir):
    """E1 + A2 as a run ranks by default: over the ten sample days. The driver's days are dealt
    onto them; a day outside them must not count."""
    days = F.array(*[F.lit(d) for d in POP.SAMPLE_DAYS])
    pv = _pageviews(spark, sf_dir)
    dealt = pv.withColumn("view_day", F.element_at(
        days, (F.datediff("view_day", F.lit("1970-01-01")) % 10 + 1).cast("int")))
    other = pv.withColumn("view_day", F.lit("1999-01-01").cast("date"))
    return POP.popular_scored(dealt.unionByName(other), limit=25, all_days=False)


@query("daily_top", _with("fx_pageviews") + """
SELECT view_day, CAST(row_number() OVER (PARTITION BY view_day ORDER BY rank, article) AS INTEGER) AS top_pos,
       article, views
FROM fx_pageviews WHERE NOT (starts_with(article, 'Special:') OR article = 'Main_Page')
QUALIFY top_pos <= 25""")
def daily_top(spark, sf_dir):
    """A1 + G1 for every day: the first 25 titles of each daily document."""
    return POP.daily_tops(_pageviews(spark, sf_dir), limit=25)


@query("title_filter", _with("fx_pageviews") + """
SELECT view_day, article, rank FROM fx_pageviews
WHERE NOT (starts_with(article, 'Special:') OR article = 'Main_Page')""")
def title_filter(spark, sf_dir):
    """B1."""
    return POP.article_rows(_pageviews(spark, sf_dir)).select("view_day", "article", "rank")


_SAMPLE_SQL = ", ".join(f"DATE '{d.isoformat()}'" for d in POP.SAMPLE_DAYS)
_SAMPLE_ORDER = " ".join(f"WHEN DATE '{d.isoformat()}' THEN {i}" for i, d in enumerate(POP.SAMPLE_DAYS))


@query("sampled_days", _with("fx_pageviews") + f"""
SELECT view_day, CAST(CASE view_day {_SAMPLE_ORDER} END AS INTEGER) AS day_order, article,
       coalesce(rank, 1000) AS rank, coalesce(views, 0) AS views
FROM fx_pageviews WHERE view_day IN ({_SAMPLE_SQL})""")
def sampled_days(spark, sf_dir):
    """A2: rows of the ten sample days (with defaults)."""
    return POP.sampled_days(_pageviews(spark, sf_dir)).select(
        "view_day", F.col("day_order").cast("int").alias("day_order"), "article", "rank", "views")


@query("day_urls", _with("fx_pageviews") + f"""
SELECT view_day, concat({O.q(TX.PAGEVIEW_API_BASE)}, strftime(view_day, '%Y/%m/%d')) AS api_url,
       CAST(view_day - INTERVAL 1 DAY AS DATE) AS previous_day
FROM (SELECT DISTINCT view_day FROM fx_pageviews) d""")
def day_urls(spark, sf_dir):
    """I10 + I11: page-view API URL of each day and the day before it."""
    days = _t(spark, sf_dir, "fx_pageviews").select("view_day").distinct()
    return days.select("view_day", TX.pageview_day_url("view_day").alias("api_url"),
                       TX.yesterday("view_day").alias("previous_day"))


# ================================ popular-list links (C1, B2, B11, I8-I10) ==================

_P = PL.link_pattern(DRIVER_PAGE_PREFIX)
_NS = "^(?:" + "|".join(PL.NAMESPACE_PREFIXES) + ")"
_DUCK_MATCHES = f"""m AS (SELECT page_id, regexp_extract_all(html, {O.q(_P)}, 1) AS h,
                         regexp_extract_all(html, {O.q(_P)}, 2) AS t FROM pages),
u AS (SELECT page_id, unnest(h) AS href, unnest(t) AS txt, unnest(range(len(h))) AS pos FROM m),
f AS (SELECT page_id, pos, href, url_decode(href) AS title, txt FROM u
      WHERE NOT (regexp_matches(href, {O.q(_NS)}) OR href = 'Main_Page')),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, title ORDER BY pos) AS rn FROM f),
c AS (SELECT page_id, pos, title,
             {O.collapse_ws("regexp_replace(txt, '&[^;]+;', '', 'g')")} AS display_text
      FROM d WHERE rn = 1)"""


@query("page_links_regex", f"""WITH {_DUCK_MATCHES}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS link_pos,
       title, display_text, concat({O.q(TX.ARTICLE_URL_BASE)}, title) AS url
FROM c WHERE length(display_text) > 1""")
def page_links_regex(spark, sf_dir):
    """C1 on the driver pages (links written ``/Title``)."""
    return PL.article_links_df(_raw_pages(spark, sf_dir), prefix=DRIVER_PAGE_PREFIX)


@query("namespace_filter", f"""WITH {_DUCK_MATCHES}
SELECT page_id, CAST(pos AS INTEGER) AS match_pos, href FROM f""")
def namespace_filter(spark, sf_dir):
    """B2: raw matches that are not namespace pages."""
    pages = _t(spark, sf_dir, "pages")
    ex = pages.select("page_id", F.posexplode(PL.raw_links(F.col("html"), DRIVER_PAGE_PREFIX)).alias("match_pos", "m"))
    return (ex.where(~PL.is_namespace_link(F.col("m.href")))
            .select("page_id", F.col("match_pos").cast("int").alias("match_pos"), F.col("m.href").alias("href")))


@query("link_text_filter", f"""WITH {_DUCK_MATCHES}
SELECT page_id, title, display_text, length(display_text) > 1 AS kept FROM c""")
def link_text_filter(spark, sf_dir):
    """I9 + B11 on first occurrences: cleaned text and whether it passes (length > 1)."""
    firsts = PL.first_occurrences(_raw_pages(spark, sf_dir), prefix=DRIVER_PAGE_PREFIX)
    ex = firsts.select("page_id", F.explode("firsts").alias("x"))
    cleaned = TX.clean_link_text(F.col("x.text"))
    return ex.select("page_id", F.col("x.title").alias("title"), cleaned.alias("display_text"),
                     (F.length(cleaned) > 1).alias("kept"))


@query("saved_list_round_trip", f"""WITH {_DUCK_MATCHES}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS article_pos, title
FROM c WHERE length(display_text) > 1""")
def saved_list_round_trip(spark, sf_dir):
    """A6 + A3 + C6: every page's extracted links saved as a JSON array, one list a line, and
    read back by the saved-list reader."""
    from citescope.session import scratch_path
    from citescope.sources import article_lists as AL

    path = scratch_path(spark, "saved-lists")
    lists = PL.article_links_json(_raw_pages(spark, sf_dir), prefix=DRIVER_PAGE_PREFIX)
    AL.write_lists(lists.withColumnRenamed("json", "value"), path, key="page_id")
    return AL.read_lists(spark, path, key="page_id", key_type="long").select(
        "page_id", "article_pos", "title")


@query("popular_records", f"""WITH {_DUCK_MATCHES}
SELECT CAST(row_number() OVER (ORDER BY page_id, pos) - 1 AS BIGINT) AS article_pos, title
FROM c WHERE length(display_text) > 1""")
def popular_records(spark, sf_dir):
    """A6 + A3 + C6: all extracted links written as one saved list, the list of one run without
    a limit, and read back by the saved-list reader."""
    from citescope.session import scratch_path
    from citescope.sources import article_lists as AL

    path = scratch_path(spark, "popular-records")
    links = PL.article_links_df(_raw_pages(spark, sf_dir), prefix=DRIVER_PAGE_PREFIX)
    AL.write_popular_records(links, path, order=["page_id", "link_pos"])
    return AL.read_article_list(spark, path).select("article_pos", "title")


@query("popular_records_limited", f"""WITH {_DUCK_MATCHES}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS link_pos, title
FROM c WHERE length(display_text) > 1 QUALIFY link_pos < 3""")
def popular_records_limited(spark, sf_dir):
    """The optional limit of a list, here three links a page (0, the default, is all: the
    queries above)."""
    return PL.article_links_df(_raw_pages(spark, sf_dir), prefix=DRIVER_PAGE_PREFIX, limit=3).select(
        "page_id", "link_pos", "title")


# ================================ pages (A4, A5, B3, D1, B7, E9) =============================

@query("pages_min_content", """
SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages
WHERE html IS NOT NULL AND length(html) > 100""")
def pages_min_content(spark, sf_dir):
    """B3 + A5."""
    return PG.min_content(_t(spark, sf_dir, "pages")).select("page_id", "url", F.length("html").alias("n_chars"))


@query("html_preview", """
SELECT page_id, CAST(length(html) AS INTEGER) AS n_chars, left(html, 200) AS preview FROM pages""")
def html_preview(spark, sf_dir):
    """Length and first 200 characters of every page."""
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", F.length("html").alias("n_chars"), TX.preview(F.col("html")).alias("preview"))


@query("articles_with_html", _with("fx_refs", extra=[DUCK_FX_HTML]) + """
SELECT a.article_pos, a.title, CAST(length(h.html) AS INTEGER) AS html_chars
FROM (SELECT article_pos, title FROM fx_refs) a JOIN fx_html h ON a.title = h.title""")
def articles_with_html(spark, sf_dir):
    """D1 + B7: every article occurrence (one per reference row, titles repeat) with its HTML."""
    arts = _t(spark, sf_dir, "fx_refs").select("article_pos", "title")
    return PG.articles_with_html_chars(arts, _t(spark, sf_dir, "fx_html")).select(
        "article_pos", "title", "html_chars")


@query("article_counts", _with("fx_refs", extra=[DUCK_FX_HTML]) + """
SELECT CAST(count(*) AS BIGINT) AS articles_found, CAST(count(DISTINCT a.title) AS BIGINT) AS unique_titles,
       CAST((SELECT count(*) FROM fx_refs r JOIN fx_html h ON r.title = h.title AND length(h.html) > 100) AS BIGINT)
         AS articles_processed
FROM fx_refs a""")
def article_counts(spark, sf_dir):
    """E9."""
    arts = _t(spark, sf_dir, "fx_refs").select("article_pos", "title")
    processed = PG.articles_with_html_chars(arts, _t(spark, sf_dir, "fx_html"))
    return PG.article_counts(arts, processed)


# ================================ URL algebra (B4, B5, I1-I5, B10) ===========================

def _url_query(name: str, spark_cols: Callable, duck_cols: str):
    @query(name, _with("fx_refs") + f"""
SELECT page_id, {duck_cols} FROM (SELECT page_id, original_url AS o, coalesce(archive_url, '') AS a FROM fx_refs) t""")
    def fn(spark, sf_dir):
        t = _t(spark, sf_dir, "fx_refs").select(
            "page_id", F.col("original_url").alias("o"), F.coalesce("archive_url", F.lit("")).alias("a"))
        return t.select("page_id", *spark_cols(F.col("o"), F.col("a")))
    fn.__name__ = name
    return fn


_url_query("url_external", lambda o, a: [U.is_external(o).alias("o_external"), U.is_external(a).alias("a_external")],
           f"{O.is_external('o')} AS o_external, {O.is_external('a')} AS a_external")
_url_query("url_archive", lambda o, a: [U.is_archive(o).alias("o_archive"), U.is_archive(a).alias("a_archive")],
           f"{O.is_archive('o')} AS o_archive, {O.is_archive('a')} AS a_archive")
_url_query("url_normalized", lambda o, a: [U.normalize(o).alias("o_norm"), U.normalize(a).alias("a_norm"),
                                           U.normalize(U.archive_original(a)).alias("x_norm")],
           f"{O.normalize('o')} AS o_norm, {O.normalize('a')} AS a_norm, "
           f"{O.normalize(O.archive_original('a'))} AS x_norm")
_url_query("url_domain", lambda o, a: [U.domain(o).alias("o_domain"),
                                       U.domain(U.archive_original(a)).alias("x_domain"),
                                       U.same_domain(o, U.archive_original(a)).alias("same_domain")],
           f"{O.domain('o')} AS o_domain, {O.domain(O.archive_original('a'))} AS x_domain, "
           f"{O.domain('o')} = {O.domain(O.archive_original('a'))} AS same_domain")
_url_query("url_basic", lambda o, a: [U.basic_normalize(o).alias("o_basic"), U.basic_normalize(a).alias("a_basic"),
                                      U.url_path(o).alias("o_path")],
           f"{O.basic('o')} AS o_basic, {O.basic('a')} AS a_basic, {O.path('o')} AS o_path")
_url_query("url_equivalent", lambda o, a: [U.equivalent(o, U.archive_original(a)).alias("equiv_extracted"),
                                           U.equivalent(o, a).alias("equiv_archive"),
                                           U.equivalent(o, o).alias("equiv_self")],
           f"{O.equivalent('o', O.archive_original('a'))} AS equiv_extracted, "
           f"{O.equivalent('o', 'a')} AS equiv_archive, {O.equivalent('o', 'o')} AS equiv_self")
_url_query("archive_original", lambda o, a: [U.archive_original(a).alias("extracted")],
           f"{O.archive_original('a')} AS extracted")
_url_query("archive_valid_match", lambda o, a: [U.valid_archive_match(o, a).alias("valid_match")],
           f"{O.valid_match('o', 'a')} AS valid_match")


# ================================ reference extraction (C2-C5, P1, H1, H2, E8) ===============

def _html(spark, sf_dir) -> DataFrame:
    """A5: the last copy of every article page."""
    key = ("html", id(spark), spark.sparkContext.applicationId, sf_dir)
    return _memo(key, lambda: PG.unique_pages(_t(spark, sf_dir, "fx_html")))


@query("reference_rows", _with("fx_refs") + """
SELECT article_pos, title, CAST(ref_pos AS INTEGER) AS ref_pos, 'list' AS ref_kind, 0 AS pair_pos,
       original_url, coalesce(archive_url, '') AS archive_url
FROM fx_refs""")
def reference_rows(spark, sf_dir):
    """C2 + P1 + H2: one row per (reference, original/archive pair)."""
    return A.reference_rows(_html(spark, sf_dir))


_REFERENCE_LINKS_SQL = _with("fx_refs") + f"""
SELECT article_pos, CAST(ref_pos AS INTEGER) AS ref_pos, link_pos, href,
       {O.is_external('href')} AS is_external, {O.is_archive('href')} AS is_archive
FROM (SELECT article_pos, ref_pos, 0 AS link_pos, original_url AS href FROM fx_refs
      UNION ALL SELECT article_pos, ref_pos, 1, archive_url FROM fx_refs WHERE archive_url IS NOT NULL
      UNION ALL SELECT article_pos, ref_pos, CASE WHEN archive_url IS NULL THEN 1 ELSE 2 END, '#back' FROM fx_refs) l"""


@query("reference_links", _REFERENCE_LINKS_SQL)
def reference_links(spark, sf_dir):
    """Every link of every reference with its external/archive flags."""
    df = X.with_reference_tree(_html(spark, sf_dir).select("article_pos", "html"))
    return (df.select("article_pos", F.explode(X.reference_links_flat(F.col("refs"))).alias("l"))
            .select("article_pos", "l.ref_pos", "l.link_pos", "l.href", "l.is_external", "l.is_archive"))


@query("sql_reference_links", _REFERENCE_LINKS_SQL)
def sql_reference_links(spark, sf_dir):
    """C3 from SQL: the table function over the pages' HTML column, the flags as SQL functions."""
    from citescope.plans.sql_surface import register_sql

    register_sql(spark)
    _html(spark, sf_dir).select("article_pos", "html").createOrReplaceTempView("cs_article_pages")
    return spark.sql("""SELECT p.article_pos, t.ref_pos, t.link_pos, t.href,
                               cs_is_external(t.href) AS is_external, cs_is_archive(t.href) AS is_archive
                        FROM cs_article_pages p, LATERAL reference_links(p.html) t""")


@query("close_links", _with("fx_refs") + """,
l AS (SELECT article_pos, ref_pos, archive_url IS NOT NULL AS archived FROM fx_refs)
SELECT article_pos, CAST(ref_pos AS INTEGER) AS ref_pos, 0 AS first_link, 1 AS later_link, archived AS close FROM l
UNION ALL
SELECT article_pos, CAST(ref_pos AS INTEGER), x, 2, false FROM l, (VALUES (0), (1)) v(x) WHERE archived""")
def close_links(spark, sf_dir):
    """Of every two links of a reference whether the later is a sibling close behind the first,
    by their parents and places among siblings."""
    df = X.with_link_places(_html(spark, sf_dir).select("article_pos", "html"))
    first, later = df.alias("a"), df.alias("b")
    pairs = first.join(later, (F.col("a.article_pos") == F.col("b.article_pos"))
                       & (F.col("a.ref_pos") == F.col("b.ref_pos")) & (F.col("a.link_pos") < F.col("b.link_pos")))
    return pairs.select("a.article_pos", "a.ref_pos", F.col("a.link_pos").alias("first_link"),
                        F.col("b.link_pos").alias("later_link"), P.elements_close(
                            F.col("a.parent"), F.col("a.place"), F.col("b.parent"), F.col("b.place")).alias("close"))


_DISTINCT_LINKS_SQL = _with("fx_refs", extra=[DUCK_LINKS]) + """
SELECT article_pos, CAST(row_number() OVER (PARTITION BY article_pos ORDER BY pos) - 1 AS INTEGER) AS link_pos, url
FROM dl"""


@query("comprehensive_links", _DISTINCT_LINKS_SQL)
def comprehensive_links(spark, sf_dir):
    """C4 + B6 + H1: distinct external links of the whole page (set union of the three rules)."""
    df = X.with_anchor_tree(_html(spark, sf_dir).select("article_pos", "html"), external_only=True)
    return (df.select("article_pos", F.posexplode(X.comprehensive_links(F.col("anchors"))).alias("link_pos", "url"))
            .select("article_pos", F.col("link_pos").cast("int").alias("link_pos"), "url"))


@query("distinct_reference_urls", _DISTINCT_LINKS_SQL)
def distinct_reference_urls(spark, sf_dir):
    """C5 + E8: distinct originals and archives of the paired references."""
    df = X.with_reference_tree(_html(spark, sf_dir).select("article_pos", "html"), external_only=True)
    urls_ = X.distinct_reference_urls(P.pair_references(F.col("refs")))
    return (df.select("article_pos", F.posexplode(urls_).alias("link_pos", "url"))
            .select("article_pos", F.col("link_pos").cast("int").alias("link_pos"), "url"))


# One document per page: its URL as a link with a class and an id, every fifth one in a ref.
_CLASSED_PAGES = """SELECT page_id, page_id % 5 = 0 AS in_ref, url,
       CASE page_id % 4 WHEN 0 THEN 'external text' WHEN 1 THEN 'mw-redirect' WHEN 2 THEN 'x mw-editsection'
            ELSE '' END AS class,
       CASE page_id % 3 WHEN 0 THEN 'cite-1' WHEN 1 THEN 'a-mw-content-text-1' ELSE '' END AS id FROM pages"""


@query("reference_like_links", f"""WITH c AS ({_CLASSED_PAGES})
SELECT page_id, url FROM c
WHERE in_ref OR (class NOT IN ('mw-redirect', 'x mw-editsection') AND NOT contains(id, 'mw-content-text'))""")
def reference_like_links(spark, sf_dir):
    """B6 + C4: links kept by class, by id, or for standing in a ref element."""
    _t(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    c = spark.sql(_CLASSED_PAGES)
    link = F.concat(F.lit('<a class="'), F.col("class"), F.lit('" id="'), F.col("id"), F.lit('" href="'),
                    F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit('">x</a>'))
    html = F.when(F.col("in_ref"), F.concat(F.lit("<ref>"), link, F.lit("</ref>"))).otherwise(
        F.concat(F.lit("<p>"), link, F.lit("</p>")))
    df = X.with_anchor_tree(c.select("page_id", html.alias("html")), external_only=True)
    return df.select("page_id", F.explode(X.comprehensive_links(F.col("anchors"))).alias("url"))


@query("no_external_links", """
SELECT page_id, CAST(len(regexp_extract_all(html, '<a[^>]*href="(https?://[^"]*)"', 1)) AS INTEGER) AS n_external,
       CAST(len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS INTEGER) AS n_anchors
FROM pages""")
def no_external_links(spark, sf_dir):
    """C4 on the raw driver pages: anchors per page and external ones among them (none)."""
    df = X.with_anchor_tree(_raw_pages(spark, sf_dir).select("page_id", "html"))
    ext = F.filter("anchors", lambda a: U.is_external(a["href"]))
    return df.select("page_id", F.size(ext).alias("n_external"), F.size("anchors").alias("n_anchors"))


# ================================ pairing lookups and flat modes (E2, D3, D2, O1, H4, E7) ====

@query("archive_groups", _with("fx_refs") + """
SELECT article_pos, original_url, string_agg(archive_url, ' ' ORDER BY ref_pos) AS archives_text,
       CAST(count(*) AS INTEGER) AS n_archives
FROM fx_refs WHERE archive_url IS NOT NULL GROUP BY article_pos, original_url""")
def archive_groups(spark, sf_dir):
    """Archives of each original in reference order."""
    refs = X.with_reference_tree(_html(spark, sf_dir).select("article_pos", "html"), external_only=True)
    g = refs.select("article_pos", F.explode(P.archive_groups_in_row(P.pair_references(F.col("refs")))).alias("g"))
    return g.select("article_pos", "g.original_url", F.array_join("g.archives", " ").alias("archives_text"),
                    F.size("g.archives").alias("n_archives"))


@query("first_archive", _with("fx_refs") + """,
fa AS (SELECT article_pos, original_url, arg_min(archive_url, ref_pos) AS first_archive
       FROM fx_refs WHERE archive_url IS NOT NULL GROUP BY article_pos, original_url)
SELECT r.article_pos, CAST(r.ref_pos AS INTEGER) AS ref_pos, 0 AS pair_pos, r.original_url, fa.first_archive
FROM fx_refs r LEFT JOIN fa ON fa.article_pos = r.article_pos AND fa.original_url = r.original_url""")
def first_archive(spark, sf_dir):
    """D3: the article-wide first archive of every original occurrence (sort + map inside the
    article's row; no shuffle, one parser pass)."""
    occ = A._occurrences_structure(_html(spark, sf_dir))
    return occ.select("article_pos", "ref_pos", "pair_pos", "original_url", "first_archive")


_DUCK_D2 = [DUCK_LINKS, f"""o AS (SELECT * FROM dl WHERE NOT {O.is_archive('url')}),
a AS (SELECT *, {O.archive_original('url')} AS ex FROM dl WHERE {O.is_archive('url')}),
m AS (SELECT a.article_pos, a.url AS archive_url, arg_min(o.url, o.pos) AS original_url
      FROM a JOIN o ON a.article_pos = o.article_pos AND a.ex <> '' AND {O.equivalent('o.url', 'a.ex')}
      GROUP BY a.article_pos, a.url)"""]


def _flat(spark, sf_dir) -> DataFrame:
    key = ("flat_links", id(spark), spark.sparkContext.applicationId, sf_dir)
    return _memo(key, lambda: A.flat_links(_html(spark, sf_dir), "references"))


@query("links_to_check", _with("fx_refs", extra=_DUCK_D2) + """
SELECT o.article_pos, o.url FROM o
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.article_pos = o.article_pos AND m.original_url = o.url)""")
def links_to_check(spark, sf_dir):
    """H4 + D2 (flat mode): originals that received no archive."""
    f = _flat(spark, sf_dir)
    return f.select("article_pos", F.explode(P.links_to_check(F.col("links"), F.col("matches"))).alias("url"))


@query("equivalence_match", _with("fx_refs", extra=_DUCK_D2) + """
SELECT a.article_pos, CAST(row_number() OVER (PARTITION BY a.article_pos ORDER BY a.pos) - 1 AS INTEGER) AS archive_pos,
       a.url AS archive_url, m.original_url
FROM a LEFT JOIN m ON m.article_pos = a.article_pos AND m.archive_url = a.url""")
def equivalence_match(spark, sf_dir):
    """Each archive's first equivalent original (NULL when none)."""
    f = _flat(spark, sf_dir)
    return (f.select("article_pos", F.explode("matches").alias("m"))
            .select("article_pos", F.col("m.archive_pos").cast("int").alias("archive_pos"),
                    "m.archive_url", "m.original_url"))


@query("flat_archive_groups", _with("fx_refs", extra=_DUCK_D2) + """
SELECT m.article_pos, m.original_url, string_agg(m.archive_url, ' ' ORDER BY a.pos) AS archives_text,
       CAST(count(*) AS INTEGER) AS n_archives
FROM m JOIN a ON a.article_pos = m.article_pos AND a.url = m.archive_url
GROUP BY m.article_pos, m.original_url""")
def flat_archive_groups(spark, sf_dir):
    """E2 + H4 in the flat mode: archives grouped under their first equivalent original."""
    f = _flat(spark, sf_dir)
    g = f.select("article_pos", F.explode(P.archives_by_original(F.col("links"), F.col("matches"))).alias("g"))
    return g.select("article_pos", "g.original_url", F.array_join("g.archives", " ").alias("archives_text"),
                    F.size("g.archives").alias("n_archives"))


@query("links_with_archives", _with("fx_refs") + """
SELECT article_pos, CAST(count(*) AS BIGINT) AS n_links,
       CAST(count(DISTINCT CASE WHEN archive_url IS NOT NULL THEN original_url END) AS BIGINT) AS n_with_archives
FROM fx_refs GROUP BY article_pos""")
def links_with_archives(spark, sf_dir):
    """E7."""
    refs = X.with_reference_tree(_html(spark, sf_dir).select("article_pos", "html"), external_only=True)
    return R.links_with_archives(stage(refs, "article_pos", pairs=P.pair_references(F.col("refs"))))


# ================================ HTTP evidence (J1, J2, J3, D6, E3) =========================

_J1_STATUS, _J1_CODE = O.http_status_case("p.url", "p")


@query("probe_status", _with("fx_probe") + f"""
SELECT p.url, p.observed_at, {_J1_STATUS} AS status, {_J1_CODE} AS status_code FROM fx_probe p""")
def probe_status(spark, sf_dir):
    """J1 over every recorded probe."""
    p = _t(spark, sf_dir, "fx_probe")
    r = J.http_status(F.col("url"), F.struct(*[F.col(c) for c in p.columns]))
    return p.select("url", "observed_at", r["status"].alias("status"), r["status_code"].alias("status_code"))


@query("bot_blocked", _with("fx_probe") + f"""
SELECT url, {O.bot('head_headers')} AS head_bot, {O.bot('get_headers')} AS get_bot FROM fx_probe""")
def bot_blocked(spark, sf_dir):
    """J2 on HEAD and GET headers."""
    p = _t(spark, sf_dir, "fx_probe")
    return p.select("url", J.bot_blocked("head_headers").alias("head_bot"), J.bot_blocked("get_headers").alias("get_bot"))


_U_STATUS, _U_CODE = O.http_status_case("r.original_url", "p")
_DUCK_CHECKED = f"""fa AS (SELECT article_pos, original_url, arg_min(archive_url, ref_pos) AS first_archive
       FROM fx_refs WHERE archive_url IS NOT NULL GROUP BY article_pos, original_url),
chk AS (
  SELECT r.article_pos, r.title, CAST(r.ref_pos AS INTEGER) AS ref_pos, 0 AS pair_pos, r.original_url,
         fa.first_archive, fa.first_archive IS NOT NULL AS has_archive,
         CASE WHEN fa.first_archive IS NOT NULL OR {O.is_archive('r.original_url')} THEN 'archived'
              ELSE {_U_STATUS} END AS status,
         CASE WHEN fa.first_archive IS NOT NULL OR {O.is_archive('r.original_url')} THEN NULL
              ELSE {_U_CODE} END AS status_code
  FROM fx_refs r
  LEFT JOIN fa ON fa.article_pos = r.article_pos AND fa.original_url = r.original_url
  LEFT JOIN fx_probe_last p ON p.url = r.original_url)"""


_BUILT: dict = {}


def _memo(key, build):
    """Reuses a built (lazy, immutable) DataFrame plan for the same session and folder: only
    driver-side plan construction is saved; every query still executes in full."""
    if key not in _BUILT:
        if len(_BUILT) > 32:
            _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def forget_plans() -> None:
    """Drops the plans kept by ``_memo`` (for timing a query alone)."""
    _BUILT.clear()


def _audit(spark, sf_dir, browser: bool = True, full: bool = False) -> A.AuditResult:
    key = ("audit", id(spark), spark.sparkContext.applicationId, sf_dir, browser, full)
    return _memo(key, lambda: _build_audit(spark, sf_dir, browser, full))


def _build_audit(spark, sf_dir, browser: bool, full: bool) -> A.AuditResult:
    """The structure-mode audit of every fixture article. ``full``: K2 from the article list,
    including the D1 title join; otherwise from the article pages themselves (each fixture
    page is one article occurrence, so the D1 join would return the same rows)."""
    probes = _t(spark, sf_dir, "fx_probe")
    obs = _t(spark, sf_dir, "fx_browser") if browser else None
    if full:
        arts = _t(spark, sf_dir, "fx_refs").select("article_pos", "title").distinct()
        return A.audit(arts, _t(spark, sf_dir, "fx_html"), probes, obs, stamp=RUN_STAMP)
    pages = PG.min_content(_html(spark, sf_dir)).select("article_pos", "title", "html")
    return A.audit_pages(pages, probes, obs, stamp=RUN_STAMP)


_CHECKED_SQL = _with("fx_probe", extra=[_DUCK_CHECKED]) + """
SELECT article_pos, ref_pos, pair_pos, original_url, status, status_code FROM chk"""


@query("checked_links_pruned", _CHECKED_SQL)
def checked_links_pruned(spark, sf_dir):
    """J3 + D4 + D6 where most evidence is on URLs that no article cites: it is dropped in its scan."""
    pages = PG.min_content(_html(spark, sf_dir)).select("article_pos", "title", "html")
    probes, obs = (_t(spark, sf_dir, n) for n in ("fx_probe", "fx_browser"))
    noise = F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.concat(
        F.col("url"), F.when(i > 0, F.concat(F.lit("#uncited-"), i.cast("string"))).otherwise(""))))
    much = [e.withColumn("url", noise) for e in (probes, obs)]
    res = A.audit_pages(pages, *much, stamp=RUN_STAMP, prune=True).results
    return res.select("article_pos", "ref_pos", "pair_pos", "original_url", "status", "status_code")


@query("checked_links", _CHECKED_SQL)
def checked_links(spark, sf_dir):
    """J3 + D6: status of every original occurrence (archived ones skip the probe join)."""
    return _audit(spark, sf_dir).results.select("article_pos", "ref_pos", "pair_pos", "original_url",
                                                 "status", "status_code")


@query("status_summary", _with("fx_probe", extra=[_DUCK_CHECKED]) + """
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE status = 'alive') AS BIGINT) AS alive,
       CAST(count(*) FILTER (WHERE status = 'dead') AS BIGINT) AS dead,
       CAST(count(*) FILTER (WHERE status = 'blocked') AS BIGINT) AS blocked,
       CAST(count(*) FILTER (WHERE status = 'archived') AS BIGINT) AS archived,
       CAST(count(*) FILTER (WHERE status = 'connection_error') AS BIGINT) AS connection_error
FROM chk""")
def status_summary(spark, sf_dir):
    """E3."""
    return J.status_summary(_audit(spark, sf_dir).results)


@query("status_lists", _with("fx_probe", extra=[_DUCK_CHECKED]) + """
SELECT article_pos, ref_pos, original_url, status, status_code FROM chk
WHERE status IN ('dead', 'blocked', 'archived')""")
def status_lists(spark, sf_dir):
    """B9 + E3 detail lists: the dead, blocked and archived links with their codes."""
    res = _audit(spark, sf_dir, browser=False).results
    return (res.where(F.col("status").isin("dead", "blocked", "archived"))
            .select("article_pos", "ref_pos", "original_url", "status", "status_code"))


# ================================ browser evidence (J4, J5, J6, D7, E6) =====================

_BC = O.browser_case("b.url", "b")


@query("browser_status", _with("fx_browser") + f"""
SELECT b.url, {_BC['status']} AS status, {_BC['code']} AS code, {_BC['error_indicator']} AS error_indicator,
       {_BC['blocking_indicator']} AS blocking_indicator, {_BC['redirected']} AS redirected
FROM fx_browser b""")
def browser_status(spark, sf_dir):
    """J4 (+ J5) over every observation."""
    b = _t(spark, sf_dir, "fx_browser")
    d = B.browser_decision(F.col("url"), F.struct(*[F.col(c) for c in b.columns]))
    return b.select("url", d["status"].alias("status"), d["code"].alias("code"),
                    d["error_indicator"].alias("error_indicator"),
                    d["blocking_indicator"].alias("blocking_indicator"), d["redirected"].alias("redirected"))


@query("browser_failure", _with("fx_browser") + f"""
SELECT b.url, {_BC['status']} AS status, {_BC['error']} AS error FROM fx_browser b WHERE b.failure_kind IS NOT NULL""")
def browser_failure(spark, sf_dir):
    """Failed page loads (timeout, driver error, other)."""
    b = _t(spark, sf_dir, "fx_browser").where(F.col("failure_kind").isNotNull())
    d = B.browser_decision(F.col("url"), F.struct(*[F.col(c) for c in b.columns]))
    return b.select("url", d["status"].alias("status"), d["error"].alias("error"))


_BD = O.browser_case("c.original_url", "b", in_status="c.status", in_code="c.status_code")
_DUCK_VALIDATED = f"""val AS (
  SELECT c.article_pos, c.ref_pos, c.original_url, c.status_code AS http_code,
         {_BD['status']} AS browser_status, {_BD['detail']} AS browser_detail
  FROM chk c LEFT JOIN fx_browser_last b ON b.url = c.original_url WHERE c.status = 'dead')"""


@query("validated_dead", _with("fx_probe", "fx_browser", extra=[_DUCK_CHECKED, _DUCK_VALIDATED]) + """
SELECT article_pos, ref_pos, original_url, http_code, browser_status, browser_detail FROM val""")
def validated_dead(spark, sf_dir):
    """D7 + J6: dead links re-checked with browser evidence."""
    v = _audit(spark, sf_dir).validated
    return v.select("article_pos", "ref_pos", "original_url", F.col("status_code").alias("http_code"),
                    F.col("browser.status").alias("browser_status"),
                    B.browser_detail(F.col("browser"), F.col("original_url")).alias("browser_detail"))


@query("browser_totals", _with("fx_probe", "fx_browser", extra=[_DUCK_CHECKED, _DUCK_VALIDATED]) + """
SELECT CAST(count(*) FILTER (WHERE browser_status = 'alive') AS BIGINT) AS false_positives,
       CAST(count(*) FILTER (WHERE browser_status = 'dead') AS BIGINT) AS confirmed_dead,
       CAST(count(*) FILTER (WHERE browser_status = 'blocked') AS BIGINT) AS blocked,
       CAST(count(*) FILTER (WHERE browser_status = 'timeout') AS BIGINT) AS timeout,
       CAST(count(*) FILTER (WHERE browser_status = 'error') AS BIGINT) AS error
FROM val""")
def browser_totals(spark, sf_dir):
    """E6."""
    return B.browser_totals(_audit(spark, sf_dir).validated)


# ================================ report (K1, K2, I14-I17, E4, E5, B8, B12) =================

_DUCK_REPORT = f"""rep AS (
  SELECT {O.clean_title('c.title')} AS article_title, c.original_url, c.first_archive AS archive_url,
         c.has_archive,
         CASE WHEN c.has_archive THEN 'None'
              WHEN c.status = 'dead' THEN coalesce(CAST(c.status_code AS VARCHAR), 'CONNECTION_ERROR')
              WHEN c.status = 'blocked' THEN coalesce(CAST(c.status_code AS VARCHAR), 'BLOCKED')
              WHEN c.status = 'alive' THEN 'None'
              ELSE coalesce(CAST(c.status_code AS VARCHAR), 'ERROR') END AS error_code,
         {O.q(RUN_STAMP)} AS "timestamp",
         CASE WHEN c.has_archive THEN 'Browser validation not performed.'
              WHEN c.status = 'dead' THEN v.browser_status ELSE c.status END AS browser_validation_check,
         CASE WHEN c.has_archive THEN '' WHEN c.status = 'dead' THEN v.browser_detail ELSE '' END
           AS browser_validation_check_detail,
         c.article_pos, c.ref_pos, c.pair_pos
  FROM chk c LEFT JOIN val v ON v.article_pos = c.article_pos AND v.ref_pos = c.ref_pos
  WHERE NOT {O.is_archive('c.original_url')})"""
_REPORT_HEAD = _with("fx_probe", "fx_browser", extra=[_DUCK_CHECKED, _DUCK_VALIDATED, _DUCK_REPORT])


@query("report_rows", _REPORT_HEAD + "SELECT * FROM rep")
def report_rows(spark, sf_dir):
    """K1 + K2 (structure mode, from the article list through D1), B8, B12: the full report."""
    return _audit(spark, sf_dir, full=True).report


@query("report_csv_round_trip", _REPORT_HEAD + """
SELECT article_title, original_url, archive_url, has_archive, error_code, "timestamp",
       browser_validation_check, browser_validation_check_detail FROM rep""")
def report_csv_round_trip(spark, sf_dir):
    """A9 + A10 (+ A7 header, H3 append): the report written as CSV under its run-stamped
    name, read back with the declared schema; NULL and '' survive the round trip."""
    from citescope.session import scratch_path
    from citescope.sources import report_io as RIO

    out = scratch_path(spark, "report-csv")
    path = RIO.write_full_report(_audit(spark, sf_dir).report, out, RUN_STAMP)
    return RIO.read_report(spark, path)


@query("report_append", _REPORT_HEAD + """
SELECT article_title, original_url, archive_url, has_archive, error_code, "timestamp",
       browser_validation_check, browser_validation_check_detail FROM rep""")
def report_append(spark, sf_dir):
    """A7 + A8 + H3: a header-only report, appended to in two batches, the second of which is
    written twice, read back as one."""
    from citescope.session import scratch_path
    from citescope.sources import report_io as RIO

    path = scratch_path(spark, "report-append")
    report = _audit(spark, sf_dir).report
    RIO.write_header_only(spark, path)
    for part in (0, 1, 1):
        RIO.append_report(report.where(F.col("ref_pos") % 2 == part), path, RUN_STAMP, part)
    return RIO.read_report(spark, path)


@query("report_error_code", _REPORT_HEAD + "SELECT article_pos, ref_pos, original_url, has_archive, error_code FROM rep")
def report_error_code(spark, sf_dir):
    """I14 + I17."""
    return _audit(spark, sf_dir).report.select("article_pos", "ref_pos", "original_url", "has_archive", "error_code")


@query("report_browser", _REPORT_HEAD + """
SELECT article_pos, ref_pos, original_url, browser_validation_check, browser_validation_check_detail FROM rep""")
def report_browser(spark, sf_dir):
    """I15 + I16."""
    return _audit(spark, sf_dir).report.select("article_pos", "ref_pos", "original_url", "browser_validation_check",
                                               "browser_validation_check_detail")


@query("report_top_dead", _with("fx_probe", extra=[_DUCK_CHECKED]) + f""",
pt AS (SELECT {O.clean_title('title')} AS article_title, article_pos, count(*) AS dead_links
       FROM chk WHERE status = 'dead' GROUP BY 1, 2),
t AS (SELECT article_title, arg_max(dead_links, article_pos) AS dead_links, min(article_pos) AS first_pos
      FROM pt GROUP BY article_title)
SELECT CAST(row_number() OVER (ORDER BY dead_links DESC, first_pos) AS INTEGER) AS top_pos, article_title,
       CAST(dead_links AS BIGINT) AS dead_links,
       (SELECT count(*) FROM t) AS articles_with_dead,
       CAST((SELECT sum(dead_links) FROM t) AS BIGINT) AS total_dead,
       CAST(greatest((SELECT count(*) FROM t) - 5, 0) AS BIGINT) AS more_articles
FROM t ORDER BY dead_links DESC, first_pos LIMIT 5""")
def report_top_dead(spark, sf_dir):
    """E4 + G4: five articles with most dead links, stable order."""
    res = _audit(spark, sf_dir).results
    return R.top_dead_articles(res)


@query("run_totals", _with("fx_probe", extra=[_DUCK_CHECKED]) + """
SELECT CAST(count(*) AS BIGINT) AS links_checked,
       CAST(count(*) FILTER (WHERE status = 'dead') AS BIGINT) AS dead_links,
       CAST(count(*) FILTER (WHERE status = 'archived') AS BIGINT) AS archived_links,
       CAST((SELECT count(DISTINCT article_pos) FROM fx_refs) AS BIGINT) AS articles_processed
FROM chk""")
def run_totals(spark, sf_dir):
    """E5: the articles are those of the list, with or without HTML."""
    res = _audit(spark, sf_dir)
    return R.run_totals(res.results, res.articles)


_F_STATUS, _F_CODE = O.http_status_case("o.url", "p")
_DUCK_FLAT = _DUCK_D2 + [f"""fo AS (
  SELECT o.article_pos, o.url AS original_url, o.pos,
         CAST(row_number() OVER (PARTITION BY o.article_pos ORDER BY o.pos) - 1 AS INTEGER) AS link_pos,
         (SELECT arg_min(m.archive_url, a2.pos) FROM m JOIN a a2 ON a2.article_pos = m.article_pos
            AND a2.url = m.archive_url WHERE m.article_pos = o.article_pos AND m.original_url = o.url) AS first_archive,
         {_F_STATUS} AS probe_status, {_F_CODE} AS probe_code
  FROM o LEFT JOIN fx_probe_last p ON p.url = o.url),
fchk AS (
  SELECT f.article_pos, t.title, f.link_pos, f.original_url, f.first_archive,
         f.first_archive IS NOT NULL AS has_archive,
         CASE WHEN f.first_archive IS NOT NULL THEN 'archived' ELSE f.probe_status END AS status,
         CASE WHEN f.first_archive IS NOT NULL THEN NULL ELSE f.probe_code END AS status_code
  FROM fo f JOIN (SELECT DISTINCT article_pos, title FROM fx_refs) t ON t.article_pos = f.article_pos)""",
    f"""fval AS (
  SELECT c.article_pos, c.link_pos, {_BD['status']} AS browser_status,
         {_BD['detail']} AS browser_detail
  FROM fchk c LEFT JOIN fx_browser_last b ON b.url = c.original_url WHERE c.status = 'dead' AND NOT c.has_archive)""",
    f"""frep AS (
  SELECT {O.clean_title('c.title')} AS article_title, c.original_url, c.first_archive AS archive_url,
         c.has_archive,
         CASE WHEN c.has_archive THEN 'None'
              WHEN c.status = 'dead' THEN coalesce(CAST(c.status_code AS VARCHAR), 'CONNECTION_ERROR')
              WHEN c.status = 'blocked' THEN coalesce(CAST(c.status_code AS VARCHAR), 'BLOCKED')
              WHEN c.status = 'alive' THEN 'None'
              ELSE coalesce(CAST(c.status_code AS VARCHAR), 'ERROR') END AS error_code,
         {O.q(RUN_STAMP)} AS "timestamp",
         CASE WHEN c.has_archive THEN 'Browser validation not performed.'
              WHEN c.status = 'dead' THEN v.browser_status ELSE c.status END AS browser_validation_check,
         CASE WHEN c.has_archive THEN '' WHEN c.status = 'dead' THEN v.browser_detail ELSE '' END
           AS browser_validation_check_detail,
         c.article_pos, c.link_pos
  FROM fchk c LEFT JOIN fval v ON v.article_pos = c.article_pos AND v.link_pos = c.link_pos)"""]


def _flat_audit(spark, sf_dir, mode: str) -> A.AuditResult:
    key = ("flat", id(spark), spark.sparkContext.applicationId, sf_dir, mode)
    return _memo(key, lambda: _build_flat_audit(spark, sf_dir, mode))


def _build_flat_audit(spark, sf_dir, mode: str) -> A.AuditResult:
    pages = PG.min_content(_html(spark, sf_dir)).select("article_pos", "title", "html")
    return A.audit_pages(pages, _t(spark, sf_dir, "fx_probe"), _t(spark, sf_dir, "fx_browser"),
                         mode=mode, stamp=RUN_STAMP)


_FLAT_REPORT_SQL = _with("fx_probe", "fx_browser", extra=_DUCK_FLAT) + "SELECT * FROM frep"


@query("flat_report_references", _FLAT_REPORT_SQL)
def flat_report_references(spark, sf_dir):
    """K2 in the references-only flat mode: C5 links, D2 grouping, one row per distinct original."""
    return _flat_audit(spark, sf_dir, "references").report


@query("flat_report_all", _FLAT_REPORT_SQL)
def flat_report_all(spark, sf_dir):
    """K2 in the all-links flat mode: C4 links (same links on these pages), D2 grouping."""
    return _flat_audit(spark, sf_dir, "all").report


@query("flat_run_totals", _with("fx_probe", "fx_browser", extra=_DUCK_FLAT) + """
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE status = 'alive') AS BIGINT) AS alive,
       CAST(count(*) FILTER (WHERE status = 'dead') AS BIGINT) AS dead,
       CAST(count(*) FILTER (WHERE status = 'blocked') AS BIGINT) AS blocked,
       CAST(count(*) FILTER (WHERE status = 'archived') AS BIGINT) AS archived,
       CAST(count(*) FILTER (WHERE status = 'connection_error') AS BIGINT) AS connection_error
FROM fchk WHERE NOT has_archive""")
def flat_run_totals(spark, sf_dir):
    """E3 in a flat mode: only links without archives are checked (no archived results)."""
    return J.status_summary(_flat_audit(spark, sf_dir, "references").results)


@query("incremental_audit", _REPORT_HEAD + "SELECT * FROM rep")
def incremental_audit(spark, sf_dir):
    """The structure-mode audit as a file stream of pages (availableNow), one file a batch, in
    which articles arrive again, newer or older; must equal the batch report."""
    from citescope.streaming.incremental import incremental_audit_from
    pages = _t(spark, sf_dir, "fx_html").select("article_pos", "title", "html", "ingest_pos")
    arriving = pages.repartition(2, (F.col("ingest_pos") + F.col("article_pos")) % 2)
    out = incremental_audit_from(spark, arriving, _t(spark, sf_dir, "fx_probe"),
                                 _t(spark, sf_dir, "fx_browser"), max_files_per_trigger=1, stamp=RUN_STAMP)
    return out.drop("batch_id")


@query("incremental_quarantine", _REPORT_HEAD + "SELECT rep.*, article_pos % 7 = 3 AS replayed FROM rep")
def incremental_quarantine(spark, sf_dir):
    """S1 with a file that cannot be read (text in place of Parquet): the stream goes on without its
    articles and puts it in quarantine, and a replay from the mended file reports them."""
    import os

    from citescope.session import scratch_path
    from citescope.streaming.incremental import IncrementalAudit, stage_pages

    base = scratch_path(spark, "incremental-quarantine")
    pages = _html(spark, sf_dir).select("article_pos", "title", "html").withColumn(
        "ingest_pos", F.lit(0).cast("long"))
    poisoned = F.col("article_pos") % 7 == 3
    stage_pages(pages.where(~poisoned), os.path.join(base, "pages", "good"))
    pages.where(poisoned).select(F.to_json(F.struct("*"))).coalesce(1).write.text(
        os.path.join(base, "pages", "bad"))
    mended = stage_pages(pages.where(poisoned).coalesce(1), os.path.join(base, "mended"))
    audit = IncrementalAudit(spark, os.path.join(base, "out"), _t(spark, sf_dir, "fx_probe"),
                             _t(spark, sf_dir, "fx_browser"), stamp=RUN_STAMP)
    audit.run(os.path.join(base, "pages"), os.path.join(base, "checkpoint"))
    waiting = [r.path for r in audit.quarantine().collect()]
    before = audit.read_report().select("article_pos").distinct().withColumnRenamed("article_pos", "seen")
    before.write.parquet(os.path.join(base, "before"))
    before = spark.read.schema("seen long").parquet(os.path.join(base, "before"))
    audit.replay({path: mended for path in waiting})
    report = audit.read_report().drop("batch_id")
    return report.join(before, report.article_pos == before.seen, "left").select(
        *report.columns, F.col("seen").isNull().alias("replayed"))


# ================================ scalar text functions (I6, I7, I12) =======================

@query("clean_title", _with("fx_refs") + f"""
SELECT 'article' AS kind, title AS raw, {O.clean_title('title')} AS cleaned FROM (SELECT DISTINCT title FROM fx_refs) t
UNION ALL
SELECT 'page' AS kind, raw, {O.clean_title('raw')} AS cleaned
FROM (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw FROM pages) p""")
def clean_title(spark, sf_dir):
    """I6 on article titles and on page titles."""
    arts = _t(spark, sf_dir, "fx_refs").select("title").distinct().select(
        F.lit("article").alias("kind"), F.col("title").alias("raw"))
    pages = _t(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("raw"))
    both = arts.unionByName(pages)
    return both.select("kind", "raw", TX.clean_title(F.col("raw")).alias("cleaned"))


@query("duration_text", f"""
SELECT event_id, {O.format_duration('value')} AS as_seconds, {O.format_duration('value * 60')} AS as_minutes,
       {O.format_duration('value * 3600')} AS as_hours
FROM events
UNION ALL
SELECT -event_id - 1, {O.format_duration('-value')}, {O.format_duration('-value * 60')},
       {O.format_duration('-value * 3600')} FROM events""")
def duration_text(spark, sf_dir):
    """I7 on all event values and their negatives read as seconds, minutes and hours (exact
    '%.1f' rounding)."""
    ev = _t(spark, sf_dir, "events").select("event_id", "value")
    ev = ev.union(ev.select(-F.col("event_id") - 1, -F.col("value")))
    return ev.select("event_id", TX.format_duration(F.col("value")).alias("as_seconds"),
                     TX.format_duration(F.col("value") * 60).alias("as_minutes"),
                     TX.format_duration(F.col("value") * 3600).alias("as_hours"))


@query("progress_text", """
SELECT event_id, printf('%.1f', CAST(event_id + 1 AS DOUBLE) / CAST((SELECT count(*) FROM events) AS DOUBLE)
                                * CAST(100 AS DOUBLE)) AS progress
FROM events""")
def progress_text(spark, sf_dir):
    """Progress of every event's place among all events."""
    ev = _t(spark, sf_dir, "events")
    total = ev.select(F.count("*")).scalar()
    return ev.select("event_id", TX.progress_percent(F.col("event_id") + 1, total).alias("progress"))


@query("run_stamp", """
SELECT CAST(ts AS DATE) AS run_day, strftime(min(ts), '%Y%m%d_%H%M%S') AS stamp,
       concat('all_references_batch_', lpad(CAST(day(CAST(ts AS DATE)) AS VARCHAR), 3, '0'), '_',
              strftime(min(ts), '%Y%m%d_%H%M%S'), '.csv') AS file_name
FROM events GROUP BY CAST(ts AS DATE)""")
def run_stamp(spark, sf_dir):
    """Run stamp of each day's first event and the batch report file name."""
    ev = _t(spark, sf_dir, "events")
    g = ev.groupBy(F.to_date("ts").alias("run_day")).agg(F.min("ts").alias("first_ts"))
    st = TX.run_stamp(F.col("first_ts"))
    return g.select("run_day", st.alias("stamp"),
                    TX.report_file_name(st, F.dayofmonth("run_day")).alias("file_name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
