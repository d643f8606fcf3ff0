"""The full audit (K2): articles -> HTML -> links -> archive pairing -> HTTP evidence ->
browser evidence -> report rows.

Plan shape (structure mode):
  pages cut to the listed titles (semi-join; the list is broadcast while measured small)
  -> flat markup scan, once per page (Python, Arrow batches; the only Python step)
  -> per-reference pairing (JVM higher-order functions, no shuffle)
  -> explode to one row per link occurrence; attach the article occurrences (D1)
  -> first archive per (article, original): sort + map inside the article's row (no shuffle)
  -> one left join with the evidence, reduced to one narrow row per URL (D4-D7)
  -> CASE projection into the fixed report layout.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.functions import urls
from citescope.functions.text import clean_title
from citescope.operators import browser as B
from citescope.operators import extraction as X
from citescope.operators import pairing as P
from citescope.operators import report as R
from citescope.operators.staging import stage
from citescope.session import checkpoint_dir, scratch_path
from citescope.sources.evidence import prune_evidence, wanted_urls
from citescope.sources.pages import listed_pages

MODES = ("structure", "references", "all")


@dataclass
class AuditResult:
    report: DataFrame        # K1 rows (report columns + article_pos and positions)
    results: DataFrame       # link results (J3): one row per checked link occurrence
    validated: DataFrame     # browser re-check of dead links (J6)
    links: DataFrame         # exploded links with first archive
    articles: DataFrame      # the article list (E5 counts it, with or without HTML)


def reference_rows(pages: DataFrame, keys=("article_pos", "title")) -> DataFrame:
    """C2 + P1 + H2: one row per (reference, pair) of every page, in document order."""
    k = list(keys)
    with_refs = X.with_reference_tree(pages.select(*k, "html"), external_only=True)
    return P.pair_reference_rows(with_refs, k)


@functools.lru_cache(maxsize=None)
def _flat_exprs(mode: str):
    """Flat-mode expressions over fixed column names, built once per process."""
    if mode == "references":
        links = X.distinct_reference_urls(P.pair_references(F.col("refs")))
    else:
        links = X.comprehensive_links(F.col("anchors"))
    origs = P.original_parts(F.col("links"))
    archs = P.archive_parts(F.col("links"))
    srt = P.first_archive_by_original(F.col("matches"))
    fmap = P.first_archive_map_flat(F.col("_ms"))
    first = F.transform(F.filter("links", lambda u: ~urls.is_archive(u)), lambda o: F.struct(
        o.alias("original_url"), F.try_element_at(F.col("_fm"), o).alias("first_archive")))
    return links, origs, archs, (srt, fmap, first)


def flat_links(pages: DataFrame, mode: str, keys=("article_pos", "title")) -> DataFrame:
    """Per page: ``links`` (C5 for 'references', C4 for 'all') and the D2 ``matches``."""
    k = list(keys)
    links, origs, archs, _ = _flat_exprs(mode)
    if mode == "references":
        src = X.with_reference_tree(pages.select(*k, "html"), external_only=True)
    else:
        src = X.with_anchor_tree(pages.select(*k, "html"), markup_guard=True, external_only=True)
    # Each array is staged once per article so later lambdas read it instead of re-deriving it.
    staged = stage(src, k, links=links)
    staged = stage(staged, k + ["links"], _origs=origs, _archs=archs)
    return P.match_archives(staged, k + ["links"])


@functools.lru_cache(maxsize=None)
def _structure_exprs():
    pairs = P.pair_references(F.col("refs"))
    return pairs, P.first_archive_sorted(F.col("_pairs")), P.first_archive_map(F.col("_sorted"))


def _occurrences_structure(pages: DataFrame, keys=("article_pos", "title")) -> DataFrame:
    """Original occurrences with the article-wide first archive (D3).

    All pairs of an article are in its row: they are sorted once, the first archive of every
    original goes into a map with unique keys, and each occurrence looks it up while the row
    is exploded. No shuffle; the first exchange of link rows is the URL-keyed probe join.
    """
    k = list(keys)
    pairs, srt, firsts = _structure_exprs()
    with_refs = X.with_reference_tree(pages.select(*k, "html"), external_only=True)
    staged = stage(with_refs, k, _pairs=pairs)
    staged = stage(staged, k + ["_pairs"], _sorted=srt)
    staged = stage(staged, k + ["_pairs"], _firsts=firsts)
    rows = staged.select(*k, "_firsts", F.explode("_pairs").alias("p"))
    return (rows.where(F.col("p.original_url") != "")
            .select(*k, "p.ref_pos", "p.ref_kind", F.col("p.pair_pos").cast("int").alias("pair_pos"),
                    "p.original_url", "p.archive_url",
                    F.try_element_at(F.col("_firsts"), F.col("p.original_url")).alias("first_archive")))


def _occurrences_flat(pages: DataFrame, mode: str, keys=("article_pos", "title")) -> DataFrame:
    """Distinct originals of each article with the first archive matched to them (D2 groups),
    via a sorted array and a unique-key map inside the row."""
    k = list(keys)
    srt, fmap, with_first = _flat_exprs(mode)[3]
    flat = stage(flat_links(pages, mode, keys=k), k + ["links"], _ms=srt)
    flat = stage(flat, k + ["links"], _fm=fmap)
    return (flat.select(*k, F.posexplode(with_first).alias("link_pos", "l"))
            .select(*k, F.col("link_pos").cast("int").alias("link_pos"),
                    "l.original_url", "l.first_archive"))


def audit(articles: DataFrame, pages: DataFrame, probes: DataFrame, browser_obs: DataFrame | None,
          mode: str = "structure", stamp: str = "19700101_000000",
          materialize: bool = False, prune: bool = False) -> AuditResult:
    """K2. ``articles(article_pos, title)`` may repeat titles (each occurrence is audited);
    ``pages(title, html[, ingest_pos])``, of which the last of a title counts; ``probes`` per
    ``schemas.PROBE_SCHEMA``; ``browser_obs`` per ``schemas.BROWSER_SCHEMA`` or None to skip the
    browser step. ``materialize``, ``prune``: see ``audit_pages``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # Each listed page is parsed once, however often its title repeats in the list: pages are
    # cut to the listed titles, audited per title, and the article occurrences are attached to
    # the small link rows afterwards (D1 after the parse).
    occ = _occurrences(listed_pages(articles, pages), mode, keys=("title",))
    occ = occ.join(articles.select("article_pos", "title"), "title")
    return _finish(occ, probes, browser_obs, mode, stamp, articles, materialize, prune)


def audit_pages(processed: DataFrame, probes: DataFrame, browser_obs: DataFrame | None,
                mode: str = "structure", stamp: str = "19700101_000000",
                materialize: bool = False, prune: bool = False) -> AuditResult:
    """K2 from article occurrences that already carry their HTML: ``(article_pos, title, html)``.

    ``materialize`` (several outputs from one run: report, totals, summaries): the classified
    link rows are checkpointed once to ``spark.checkpoint.dir`` (reliable storage, survives
    executor loss), so the HTML is parsed once and every output reads the checkpoint.
    ``prune`` (few links, much evidence): the link rows are written first, and only evidence on
    URLs they cite leaves its scan (``sources.evidence``).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    occ = _occurrences(processed, mode)
    return _finish(occ, probes, browser_obs, mode, stamp, processed, materialize, prune)


def _occurrences(pages: DataFrame, mode: str, keys=("article_pos", "title")) -> DataFrame:
    if mode == "structure":
        return _occurrences_structure(pages, keys)
    return _occurrences_flat(pages, mode, keys)


def _finish(occ: DataFrame, probes: DataFrame, browser_obs: DataFrame | None, mode: str, stamp: str,
            articles: DataFrame, materialize: bool = False, prune: bool = False) -> AuditResult:
    """Classification (one evidence join) and the report, from the link occurrences."""
    if prune:
        path = scratch_path(occ.sparkSession, "links")
        occ.write.parquet(path)
        occ = occ.sparkSession.read.schema(occ.schema).parquet(path)
        wanted = wanted_urls(occ.where(F.coalesce(F.col("first_archive"), F.lit("")) == ""), "original_url")
        probes = prune_evidence(probes, wanted)
        browser_obs = prune_evidence(browser_obs, wanted) if browser_obs is not None else None
    occ = (occ.withColumn("article_title", clean_title(F.col("title")))
           .withColumn("_has_archive", F.coalesce(F.col("first_archive"), F.lit("")) != ""))
    checked = B.classify_links(occ, probes, browser_obs, url_col="original_url",
                               skip_col="_has_archive")
    if materialize:
        checkpoint_dir(checked.sparkSession)
        checked = checked.checkpoint(eager=True)
    # Flat modes only check links without archives; the structure mode checks every original.
    results = checked if mode == "structure" else checked.where(~F.col("_has_archive"))
    validated = results.where(F.col("status") == "dead")
    report = R.report_rows(checked, stamp)
    return AuditResult(report=report, results=results, validated=validated, links=occ,
                       articles=articles)


def run_audit(pageviews: DataFrame, pages: DataFrame, probes: DataFrame, browser_obs: DataFrame | None,
              limit: int = 25, ranking: str = "all_time", day=None, mode: str = "structure",
              stamp: str = "19700101_000000") -> AuditResult:
    """K2 from page-view facts: choose the articles (E1 long-run ranking, or A1 one day's top
    list), then audit them. The long-run ranking is over the ten sample days."""
    from citescope.operators import popularity as POP

    if ranking == "all_time":
        top = POP.popular_scored(pageviews, limit=limit, all_days=False).select(
            F.col("top_pos").cast("long").alias("article_pos"), "title")
    elif ranking == "daily":
        top = POP.daily_top(pageviews, day, limit=limit).select(
            F.col("top_pos").cast("long").alias("article_pos"), F.col("article").alias("title"))
    else:
        raise ValueError("ranking must be 'all_time' or 'daily'")
    return audit(top, pages, probes, browser_obs, mode=mode, stamp=stamp)
