"""Archive pairing (P1, P2), flat-mode matching (D2), archive grouping (E2) and the
first-archive lookup (D3) over arrays held in one row.

URL forms are JVM expressions, computed once per link. What is matched with what is decided by
``functions.matching`` over whole Arrow batches: P1 needs lists that shrink as archives are used
and D2 an index of path containment, and neither has a form in array expressions that is not
quadratic in the links. Grouping and lookups of an article's pairs are sorted arrays again.
Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.functions import matching, urls
from citescope.operators.staging import stage
from citescope.session import bound_arrow_batches

_PAIRS = "array<struct<ref_pos:int,ref_kind:string,pair_pos:int,original_url:string,archive_url:string>>"
_UDFS: dict = {}
PIECE = 4096  # results handed back at a time (those of one page at least)


def _arrow(function, kind: str):
    """An Arrow function binds the context it is first used in, so one is kept per application."""
    key = (SparkContext._active_spark_context.applicationId, function.__name__)
    if key not in _UDFS:
        _UDFS[key] = F.arrow_udf(function, kind)
    return _UDFS[key]


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and passes it to ``body`` (a one-element ``transform``)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def url_parts(u: Column) -> list[Column]:
    """I3, I1, I2 host and the path piece of ``u`` (I1 computed once)."""
    norm = _let(urls.normalize(u), lambda n: F.struct(n.alias("norm"),
                                                      F.substring_index(n, "/", 1).alias("dom")))
    return [urls.basic_normalize(u).alias("basic"), norm["norm"].alias("norm"),
            norm["dom"].alias("dom"), urls.url_path(u).alias("path")]


def split_links(links: Column) -> tuple[Column, Column]:
    """External links of one reference split into originals and archives (list order), each
    carrying the URL parts the pairing compares, computed once per link; of a neighbour's link
    only an archive's is kept."""
    def neighbour(l: Column, side: str) -> list[Column]:
        archival = urls.is_archive(l[f"{side}_href"])
        return [F.when(archival, l[f"{side}_{x}"]).alias(f"{side}_{x}") for x in ("href", "key")]

    def archive(l: Column) -> Column:
        embedded = _let(urls.archive_original(l["href"]),
                        lambda x: F.struct(x.alias("ex"), *url_parts(x)))
        return F.struct(l["href"].alias("href"), l["elem_key"].alias("elem_key"),
                        l["parent_key"].alias("parent_key"),
                        l["grandparent_key"].alias("grandparent_key"),
                        *(embedded[n].alias(n) for n in ("ex", "basic", "norm", "dom", "path")))

    ext = F.filter(links, lambda l: urls.is_external(l["href"]))
    origs = F.transform(F.filter(ext, lambda l: ~urls.is_archive(l["href"])), lambda l: F.struct(
        l["href"].alias("href"), l["parent_key"].alias("parent_key"),
        l["grandparent_key"].alias("grandparent_key"), l["near_keys"].alias("near_keys"),
        *neighbour(l, "next"), *neighbour(l, "prev"), *url_parts(l["href"])))
    archs = F.transform(F.filter(ext, lambda l: urls.is_archive(l["href"])), archive)
    return origs, archs


def _pieces(rows: Iterable[list | None], kind: pa.DataType) -> Iterator[pa.Array]:
    """List rows as arrays of bounded length, so that one page's links are Python objects at a
    time, and few results, however many pages a batch has."""
    piece, held = [], 0
    for row in rows:
        piece.append(row)
        held += 1 + len(row or ())
        if held >= PIECE:
            yield pa.array(piece, type=kind)
            piece, held = [], 0
    if piece:
        yield pa.array(piece, type=kind)


def _pair_page(refs: list[dict] | None) -> list[dict] | None:
    return None if refs is None else [
        {"ref_pos": r["ref_pos"], "ref_kind": r["ref_kind"], "pair_pos": i, "original_url": o,
         "archive_url": a}
        for r in refs for i, (o, a) in enumerate(matching.pair_reference(r["origs"], r["archs"]))]


def _pair_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield from _pieces((_pair_page(page.as_py()) for page in pages), _PAIRS_ARROW)
    pa.default_memory_pool().release_unused()  # the worker is kept, its peak need not be


_PAIRS_ARROW = pa.list_(pa.struct([("ref_pos", pa.int32()), ("ref_kind", pa.string()),
                                   ("pair_pos", pa.int32()), ("original_url", pa.string()),
                                   ("archive_url", pa.string())]))


def pair_references(refs: Column) -> Column:
    """P1 over all reference elements of a page, flattened in reference order.

    Each element: ``struct<ref_pos, ref_kind, pair_pos, original_url, archive_url>``.
    """
    split = F.transform(refs, lambda r: F.struct(
        r["ref_pos"].alias("ref_pos"), r["ref_kind"].alias("ref_kind"),
        *(x.alias(n) for n, x in zip(("origs", "archs"), split_links(r["links"])))))
    return _arrow(_pair_pages, _PAIRS)(split)


def pair_reference_rows(refs_df: DataFrame, keys) -> DataFrame:
    """P1 with one row per pair; no shuffle (each reference stays in its page's partition)."""
    k = list(keys)
    paired = stage(refs_df, k, _pairs=pair_references(F.col("refs")))
    return (paired.select(*k, F.explode("_pairs").alias("p"))
            .select(*k, "p.ref_pos", "p.ref_kind", "p.pair_pos", "p.original_url", "p.archive_url"))


def elements_close(parent1: Column, index1: Column, parent2: Column, index2: Column,
                   max_distance: int = 3) -> Column:
    """P2 on (parent id, element-sibling index): the second is a later sibling with at most
    ``max_distance`` elements between them."""
    return (parent1 == parent2) & (index2 > index1) & (index2 - index1 <= max_distance + 1)


# ---- flat modes (D2, O1, H4) -------------------------------------------------------------------

def original_parts(links: Column) -> Column:
    """Originals of one article with their I1/I2/I3/path parts, computed once per link."""
    return F.transform(F.filter(links, lambda u: ~urls.is_archive(u)),
                       lambda u: F.struct(u.alias("url"), *url_parts(u)))


def archive_parts(links: Column) -> Column:
    """Archives of one article with the embedded URL and its parts, computed once per link."""
    return F.transform(F.filter(links, lambda u: urls.is_archive(u)), lambda u: _let(
        urls.archive_original(u), lambda x: F.struct(u.alias("url"), x.alias("ex"), *url_parts(x))))


def _match_pages(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for originals, archives in batches:
        yield from _pieces((matching.first_matches(o.as_py() or [], a.as_py() or [])
                            for o, a in zip(originals, archives)), pa.list_(pa.int32()))
    pa.default_memory_pool().release_unused()


def match_archives(df: DataFrame, keep) -> DataFrame:
    """For each archive link of one article, the first original (list order) equivalent to
    the URL embedded in the archive; NULL when none or when nothing can be extracted.

    ``df`` holds ``_origs`` (``original_parts``) and ``_archs`` (``archive_parts``). Adds
    ``matches``: ``array<struct<archive_pos, archive_url, original_url>>`` in archive order.
    """
    k = list(keep)
    bound_arrow_batches(df.sparkSession)
    found = stage(df, k + ["_origs", "_archs"], _at=_arrow(_match_pages, "array<int>")(
        F.col("_origs"), F.col("_archs")))
    return stage(found, k, matches=F.transform("_archs", lambda a, i: F.struct(
        i.alias("archive_pos"), a["url"].alias("archive_url"),
        F.get("_origs", F.get("_at", i))["url"].alias("original_url"))))


def first_archive_by_original(matches: Column) -> Column:
    """Step 1 of the flat-mode first-archive lookup: matched archives sorted by (original,
    archive position). Stage it, then apply ``first_archive_map_flat``."""
    return F.array_sort(F.transform(F.filter(matches, lambda m: m["original_url"].isNotNull()),
                                    lambda m: F.struct(m["original_url"].alias("k"), m["archive_pos"].alias("pos"),
                                                       m["archive_url"].alias("a"))))


def first_archive_map_flat(sorted_matches: Column) -> Column:
    """Step 2: ``map<original, first archive>`` from the run starts (unique keys)."""
    starts = F.filter(sorted_matches, lambda x, j: (j == 0) | (
        F.element_at(sorted_matches, F.greatest(j, F.lit(1))).getField("k") != x["k"]))
    return F.map_from_entries(F.transform(starts, lambda x: F.struct(x["k"], x["a"])))


def links_to_check(links: Column, matches: Column) -> Column:
    """H4: originals (list order) that received no archive."""
    matched = F.filter(F.transform(matches, lambda m: m["original_url"]), lambda u: u.isNotNull())
    # Hash-based difference, linear in the article's links (flat-mode lists are distinct).
    return F.array_except(F.filter(links, lambda u: ~urls.is_archive(u)), matched)


def archives_by_original(links: Column, matches: Column) -> Column:
    """H4/E2 (flat): ``array<struct<original_url, archives>>`` for originals with archives, in
    the originals' list order, archives in archive order. Sort-based: matches sorted by
    (original, archive position) form one run per original. O(n log n) per article."""
    order = F.map_from_entries(F.transform(F.array_distinct(F.filter(links, lambda u: ~urls.is_archive(u))),
                                           lambda u, i: F.struct(u, i)))
    srt = F.array_sort(F.transform(F.filter(matches, lambda m: m["original_url"].isNotNull()),
                                   lambda m: F.struct(m["original_url"].alias("k"), m["archive_pos"].alias("pos"),
                                                      m["archive_url"].alias("a"))))
    return _let(srt, lambda sm: _let(
        F.filter(F.transform(sm, lambda x, j: F.struct(x["k"].alias("k"), j.alias("start"))),
                 lambda y, j: (j == 0) | (F.element_at(sm, F.greatest(j, F.lit(1))).getField("k") != y["k"])),
        lambda runs: F.transform(
            F.array_sort(F.transform(runs, lambda r, n: F.struct(
                F.try_element_at(order, r["k"]).alias("o_pos"), r["k"].alias("original_url"),
                F.transform(F.slice(sm, r["start"] + 1,
                                    F.coalesce(F.try_element_at(runs, n + 2).getField("start"), F.size(sm))
                                    - r["start"]), lambda x: x["a"]).alias("archives")))),
            lambda g: F.struct(g["original_url"].alias("original_url"), g["archives"].alias("archives")))))


# ---- article-scope lookups (E2, D3) -------------------------------------------------------------

def first_archive_sorted(pairs: Column) -> Column:
    """D3 inside one article, step 1: the article's pairs sorted by (original, no archive,
    reference position, pair position). Stage the result once per row (``staging.stage``)."""
    return F.array_sort(F.transform(pairs, lambda p: F.struct(
        p["original_url"].alias("o"), (p["archive_url"] == "").alias("no_archive"),
        p["ref_pos"].alias("ref_pos"), p["pair_pos"].alias("pair_pos"), p["archive_url"].alias("a"))))


def first_archive_map(sorted_pairs: Column) -> Column:
    """D3 inside one article, step 2: ``map<original, first archive>``. The first element of
    each original's run in the sorted array holds its earliest archive, if it has one; keys are
    unique, so the map needs no de-duplication policy. O(n log n) per article, no shuffle."""
    starts = F.filter(sorted_pairs, lambda x, j: (j == 0) | (
        F.element_at(sorted_pairs, F.greatest(j, F.lit(1))).getField("o") != x["o"]))
    with_archive = F.filter(starts, lambda x: ~x["no_archive"] & (x["o"] != ""))
    return F.map_from_entries(F.transform(with_archive, lambda x: F.struct(x["o"], x["a"])))


def archive_groups_in_row(pairs: Column) -> Column:
    """E2 inside one article: ``array<struct<original_url, archives>>``, the archives of each
    original in reference order. The pairs with an archive are sorted by (original, reference
    position, pair position) and every run of one original becomes a group: O(n log n) per
    article, no shuffle and no per-group collection across rows."""
    srt = F.array_sort(F.transform(
        F.filter(pairs, lambda p: (p["original_url"] != "") & (p["archive_url"] != "")),
        lambda p: F.struct(p["original_url"].alias("k"), p["ref_pos"].alias("ref_pos"),
                           p["pair_pos"].alias("pair_pos"), p["archive_url"].alias("a"))))
    return _let(srt, lambda sm: _let(
        F.filter(F.transform(sm, lambda x, j: F.struct(x["k"].alias("k"), j.alias("start"))),
                 lambda y, j: (j == 0) | (F.element_at(sm, F.greatest(j, F.lit(1))).getField("k") != y["k"])),
        lambda runs: F.transform(runs, lambda r, n: F.struct(
            r["k"].alias("original_url"),
            F.transform(F.slice(sm, r["start"] + 1,
                                F.coalesce(F.try_element_at(runs, n + 2).getField("start"), F.size(sm))
                                - r["start"]), lambda x: x["a"]).alias("archives")))))
