"""SQL surface: the engine's functions as session SQL functions and table functions (2.13).

``register_sql(spark)`` makes these callable from ``spark.sql``:

  scalar (SQL functions built from the same column expressions the DataFrame API uses)
    cs_is_external(u), cs_is_archive(u), cs_normalize_url(u), cs_url_domain(u),
    cs_same_domain(a, b), cs_basic_normalize(u), cs_url_path(u), cs_url_equivalent(a, b),
    cs_archive_original(u), cs_valid_archive_match(o, a), cs_clean_title(t),
    cs_clean_link_text(t), cs_percent_decode(h), cs_format_duration(seconds)
  per-page scan (Arrow UDF): cs_scan(html) -> the flat facts of ``schemas.MARKUP``
  table functions over any HTML column, used with LATERAL; a page's rows are made where the page
  is read, without a join or an exchange:
    reference_links(html)  ref_pos, ref_kind, link_pos, href (C3)
    page_links(html)       link_pos, href, in_ref, classes, id (C4's input)

``register_pages(spark, pages, key)`` makes temporary views over a page table:

    reference_links  key, ref_pos, ref_kind, link_pos, href, elem_key, parent_key,
                     grandparent_key, next_href, prev_href
    page_links       key, link_pos, href, in_ref, in_section, classes, id

Archive pairing and flat-mode matching are higher-order expressions over those arrays and are
used through the DataFrame API (``citescope.operators.pairing``); lambda expressions do not
round-trip into SQL function bodies.

Example::

    SELECT title, count(*) FROM reference_links GROUP BY title
    SELECT p.title, t.href, cs_is_archive(t.href) FROM pages p, LATERAL reference_links(p.html) t
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.functions import markup
from citescope.functions import text as TX
from citescope.functions import urls as U
from citescope.operators import extraction as X
from citescope.session import bound_arrow_batches


class ReferenceLinks:
    """C3 of one page: the links of its reference elements."""

    def eval(self, html: str):
        m = markup.scan(html)
        for pos, (element, kind, _, _) in enumerate(m["refs"] if m else []):
            first, last = m["seen"][element], m["seen"][m["last"][element]]
            for i, link in enumerate(m["links"][first:last]):
                yield pos, kind, i, link[1]


class PageLinks:
    """Every link of one page in document order."""

    def eval(self, html: str):
        m = markup.scan(html)
        for pos, (_, href, classes, ident, in_ref) in enumerate(m["links"] if m else []):
            yield pos, href, in_ref, classes, ident


TABLE_FUNCTIONS = {
    "reference_links": (ReferenceLinks, "ref_pos int, ref_kind string, link_pos int, href string"),
    "page_links": (PageLinks, "link_pos int, href string, in_ref boolean, classes array<string>, id string"),
}


def _sql_text(spark: SparkSession, expr: Column, params: dict[str, str]) -> str:
    """SQL text of ``expr`` over typed parameters (via the analyzed plan)."""
    schema = ", ".join(f"{n} {t}" for n, t in params.items())
    df = spark.createDataFrame([], schema)
    plan = df.select(expr.alias("r"))._jdf.queryExecution().analyzed()
    return plan.projectList().apply(0).child().sql()


def _fn(spark, name, params: dict[str, str], returns: str, expr: Column) -> None:
    body = _sql_text(spark, expr, params)
    args = ", ".join(f"{n} {t}" for n, t in params.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")


def register_sql(spark: SparkSession) -> None:
    u, a, b = F.col("u"), F.col("a"), F.col("b")
    s1 = {"u": "string"}
    s2 = {"a": "string", "b": "string"}
    _fn(spark, "cs_is_external", s1, "boolean", U.is_external(u))
    _fn(spark, "cs_is_archive", s1, "boolean", U.is_archive(u))
    _fn(spark, "cs_normalize_url", s1, "string", U.normalize(u))
    _fn(spark, "cs_url_domain", s1, "string", U.domain(u))
    _fn(spark, "cs_same_domain", s2, "boolean", U.same_domain(a, b))
    _fn(spark, "cs_basic_normalize", s1, "string", U.basic_normalize(u))
    _fn(spark, "cs_url_path", s1, "string", U.url_path(u))
    _fn(spark, "cs_url_equivalent", s2, "boolean", U.equivalent(a, b))
    _fn(spark, "cs_archive_original", s1, "string", U.archive_original(u))
    _fn(spark, "cs_valid_archive_match", s2, "boolean", U.valid_archive_match(a, b))
    _fn(spark, "cs_clean_title", s1, "string", TX.clean_title(u))
    _fn(spark, "cs_clean_link_text", s1, "string", TX.clean_link_text(u))
    _fn(spark, "cs_percent_decode", s1, "string", TX.percent_decode(u))
    _fn(spark, "cs_format_duration", {"s": "double"}, "string", TX.format_duration(F.col("s")))
    bound_arrow_batches(spark)
    spark.udf.register("cs_scan", X.scan_udf())
    for name, (function, returns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(function, returnType=returns, useArrow=True))


def register_pages(spark: SparkSession, pages: DataFrame, key: str = "title",
                   html: str = "html") -> None:
    """Temporary views ``reference_links`` (C2) and ``page_links`` (C4 input) over ``pages``."""
    own = pages.select(key, F.col(html).alias("html"))
    (X.with_reference_tree(own).select(key, F.explode("refs").alias("r"))
     .select(key, "r.ref_pos", "r.ref_kind", F.explode("r.links").alias("l"))
     .select(key, "ref_pos", "ref_kind", "l.link_pos", "l.href", "l.elem_key", "l.parent_key",
             "l.grandparent_key", "l.next_href", "l.prev_href")
     .createOrReplaceTempView("reference_links"))
    (X.with_anchor_tree(own, markup_guard=True).select(key, F.inline("anchors"))
     .createOrReplaceTempView("page_links"))
