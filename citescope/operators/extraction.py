"""Link extraction from article HTML.

One Arrow-batched Python function per document scans the markup into flat arrays
(``functions.markup``): parents, siblings and digests by element number, and the links,
reference elements and headings. What a link is - its reference, its neighbours, its section -
is derived from these arrays by expressions within the row, and so is every per-article step
after it (pairing, de-duplication, flat-mode matching): no shuffle is needed until links are
joined with evidence keyed by URL.
"""

from __future__ import annotations

from collections.abc import Iterator

import citescope
import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.functions import markup_batch, urls
from citescope.operators.staging import stage
from citescope.schemas import MARKUP
from citescope.session import bound_arrow_batches

# Ship the package's code with the functions so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(citescope)

# ---- fixed values ------------------------------------------------------------------------------
# Anchor classes that mark edit/redirect links rather than references.
SKIP_LINK_CLASSES = ["mw-editsection", "mw-editsection-bracket", "mw-redirect"]
# An anchor whose id contains one of these is not a reference.
SKIP_LINK_IDS = ["mw-content-text"]
# Headings of the section whose links count as references.
SECTION_TITLES = ["references", "notes", "external links"]
NEAR_SIBLINGS = 4           # "close in document": at most 3 elements before the later sibling
# -------------------------------------------------------------------------------------------------

_UDFS: dict = {}


def _scan_pages(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return markup_batch.scan_pieces(html)


def scan_udf():
    """A UDF object binds the context it is first used in, so one is kept per application."""
    app = SparkContext._active_spark_context.applicationId
    if app not in _UDFS:
        _UDFS[app] = F.arrow_udf(_scan_pages, MARKUP)
    return _UDFS[app]


def scan(html) -> Column:
    """The flat facts of a page."""
    return scan_udf()(_c(html))


def _scanned(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """``keep`` and the staged facts ``_m`` of every page."""
    bound_arrow_batches(pages.sparkSession)
    return stage(pages.withColumn("_scan", scan(html)), keep, _m=F.col("_scan"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# A reference element needs an <ol ...> or <ref ...> start tag; an anchor needs <a ...>. Tag names
# are case-insensitive, so these are exact necessary conditions, tested in the JVM.
# (The standard-library parser ends a tag name at whitespace, "/", ">" or NUL.)
REFERENCE_MARKUP = r"(?i)<(ol|ref)[\s/>\x00]"
ANCHOR_MARKUP = r"(?i)<a[\s/>\x00]"


def _external(href: Column) -> Column:
    return href.startswith("http://") | href.startswith("https://")


def references(m: Column, html: Column | None = None, external_only: bool = False) -> Column:
    """The reference elements of a scanned page, each with its links and the keys and links
    of their neighbours. ``external_only`` leaves other links out; positions count them."""
    def key(element: Column) -> Column:
        return F.get(m["key"], element)

    def following(element: Column) -> Column:
        after = F.get(m["last"], element) + 1
        return F.when(F.get(m["parent"], after) == F.get(m["parent"], element), after)

    def link_inside(element: Column) -> Column:
        found = F.get(m["links"], F.get(m["seen"], element))
        return F.when(found["at"] <= F.get(m["last"], element), found)

    def link(x: Column, pos: Column) -> Column:
        parent = F.get(m["parent"], x["at"])
        siblings = F.slice(F.aggregate(
            F.array(*[F.lit(i) for i in range(NEAR_SIBLINGS)]), F.array(x["at"]),
            lambda found, _: F.concat(found, F.array(following(F.element_at(found, -1))))),
            2, NEAR_SIBLINGS)
        after, before = link_inside(F.get(siblings, F.lit(0))), link_inside(
            F.get(m["previous"], x["at"]))
        return F.struct(
            pos.alias("link_pos"), x["href"].alias("href"), key(x["at"]).alias("elem_key"),
            key(parent).alias("parent_key"),
            F.coalesce(key(F.get(m["parent"], parent)), F.lit(0).cast("long"))
            .alias("grandparent_key"),
            F.transform(F.filter(siblings, lambda s: s.isNotNull()), key).alias("near_keys"),
            after["href"].alias("next_href"), key(after["at"]).alias("next_key"),
            before["href"].alias("prev_href"), key(before["at"]).alias("prev_key"))

    def reference(r: Column, pos: Column) -> Column:
        first = F.get(m["seen"], r["at"])
        links = F.transform(F.slice(m["links"], first + 1, F.get(m["seen"], F.get(
            m["last"], r["at"])) - first), link)
        if external_only:
            links = F.filter(links, lambda x: _external(x["href"]))
        text = (F.call_function("substring", html, r["start"] + 1, r["end"] - r["start"])
                if html is not None else F.lit(None).cast("string"))
        return F.struct(pos.alias("ref_pos"), r["kind"].alias("ref_kind"), links.alias("links"),
                        text.alias("reference_html"))

    none = F.array().cast("array<struct<at:int,kind:string,start:int,end:int>>")
    return F.transform(F.coalesce(m["refs"], none), reference)


def anchors(m: Column, external_only: bool = False) -> Column:
    """Every link of a scanned page in document order with the context it sits in."""
    titled = F.get(F.filter(m["headings"], lambda h: h["text"].isin(SECTION_TITLES)), F.lit(0))
    parent = F.get(m["parent"], titled["at"])
    later = F.get(F.filter(m["headings"], lambda h: (h["at"] > titled["at"])
                           & (F.get(m["parent"], h["at"]) == parent)), F.lit(0))
    section = F.struct(parent.alias("parent"), F.get(m["last"], titled["at"]).alias("after"),
                       F.coalesce(later["at"] - 1, F.get(m["last"], parent)).alias("last"))
    none = F.array().cast("array<struct<at:int,href:string,classes:array<string>,id:string,"
                          "in_ref:boolean>>")

    def anchor(x: Column, pos: Column, s: Column) -> Column:
        return F.struct(
            pos.alias("link_pos"), x["href"].alias("href"), x["in_ref"].alias("in_ref"),
            F.coalesce((x["at"] > s["after"]) & (x["at"] <= s["last"])
                       & (F.get(m["parent"], x["at"]) != s["parent"]), F.lit(False))
            .alias("in_section"), x["classes"].alias("classes"), x["id"].alias("id"))

    links = F.element_at(F.transform(F.array(section), lambda s: F.transform(
        F.coalesce(m["links"], none), lambda x, pos: anchor(x, pos, s))), 1)
    return F.filter(links, lambda x: _external(x["href"])) if external_only else links


# A reference element needs an <ol ...> or <ref ...> start tag; an anchor needs <a ...>. Tag names
# are case-insensitive, so these are exact necessary conditions, tested in the JVM.
REFERENCE_MARKUP = r"(?i)<(ol|ref)[\s/>\x00]"
ANCHOR_MARKUP = r"(?i)<a[\s/>\x00]"


def with_reference_tree(pages: DataFrame, html: str = "html", with_html: bool = False,
                        out: str = "refs", markup_guard: bool = True,
                        external_only: bool = False) -> DataFrame:
    """Adds the array of reference elements (each with its links) of every page.

    With ``markup_guard`` (for consumers that explode the references) pages that cannot hold a
    reference element are dropped in the JVM before any HTML is shipped to Python. Filters on
    other pass-through columns must be applied to ``pages`` before this call: they do not move
    below a Python evaluation. ``external_only``: only http(s) links are kept (enough for the
    pairing and everything after it). The scan and the array are staged, so that no filter on
    them moves below the scan and repeats it.
    """
    if markup_guard:
        pages = pages.where(_c(html).rlike(REFERENCE_MARKUP))
    keep = [c for c in pages.columns if c != out]
    scanned = _scanned(pages, html, keep)
    return stage(scanned, keep, **{out: references(
        F.col("_m"), F.col(html) if with_html else None, external_only)})


def with_anchor_tree(pages: DataFrame, html: str = "html", out: str = "anchors",
                     markup_guard: bool = False, external_only: bool = False) -> DataFrame:
    """Adds the anchors of every page; ``markup_guard`` drops pages without an anchor tag
    before the Python step (for consumers that explode the anchors); ``external_only`` keeps
    only http(s) anchors (what C4 uses), not the internal navigation links."""
    if markup_guard:
        pages = pages.where(_c(html).rlike(ANCHOR_MARKUP))
    keep = [c for c in pages.columns if c != out]
    scanned = _scanned(pages, html, keep)
    return stage(scanned, keep, **{out: anchors(F.col("_m"), external_only)})


def with_link_places(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per link of a reference (ref_pos, link_pos) with its ``parent`` element and its
    ``place`` among the parent's elements, as P2 compares them."""
    pages = pages.where(_c(html).rlike(REFERENCE_MARKUP))
    keep = [c for c in pages.columns if c != html]
    scanned = _scanned(pages, html, keep)
    m = F.col("_m")
    facts = {f"_{n}": m[n] for n in ("parent", "links", "seen", "last", "refs")}
    # Places follow from the elements sorted by parent: those of one parent stand together.
    by_parent = F.array_sort(F.transform(m["parent"], lambda p, i: F.struct(p.alias("p"), i.alias("at"))))
    rows = stage(scanned, keep, _sorted=by_parent, **facts)
    firsts = F.filter(F.transform("_sorted", lambda x, i: F.struct(x["p"].alias("p"), i.alias("first"))),
                      lambda x, i: (i == 0) | (F.get("_sorted", i - 1)["p"] != x["p"]))
    sorted_at = F.array_sort(F.transform("_sorted", lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))))
    rows = stage(rows, [*keep, *facts], _first=F.map_from_entries(firsts), _where=sorted_at)

    def link(x: Column, pos: Column) -> Column:
        parent = F.get("_parent", x["at"])
        place = F.get("_where", x["at"])["i"] - F.try_element_at("_first", parent)
        return F.struct(pos.alias("link_pos"), x["href"].alias("href"), parent.alias("parent"),
                        place.alias("place"))

    def of_reference(r: Column, pos: Column) -> Column:
        seen = F.get("_seen", r["at"])
        mine = F.slice("_links", seen + 1, F.get("_seen", F.get("_last", r["at"])) - seen)
        return F.transform(F.transform(mine, link), lambda x: F.struct(
            pos.alias("ref_pos"), *(x[c].alias(c) for c in ("link_pos", "href", "parent", "place"))))

    return rows.select(*keep, F.inline(F.flatten(F.transform("_refs", of_reference))))


def likely_reference_link(anchor: Column) -> Column:
    """B6 on an anchor struct: not an edit/redirect class, id not containing a skip id."""
    classes = F.coalesce(anchor["classes"], F.array().cast("array<string>"))
    bad_class = F.exists(classes, lambda c: c.isin(SKIP_LINK_CLASSES))
    ident = F.coalesce(anchor["id"], F.lit(""))
    bad_id = None
    for s in SKIP_LINK_IDS:
        t = ident.contains(s)
        bad_id = t if bad_id is None else (bad_id | t)
    return ~bad_class & ~bad_id


def comprehensive_links(anchors: Column) -> Column:
    """C4 + H1: distinct external hrefs found in ``ref`` elements, in the references section,
    or passing B6 anywhere; first-occurrence document order replaces set order."""
    kept = F.filter(anchors, lambda a: urls.is_external(a["href"])
                    & (a["in_ref"] | a["in_section"] | likely_reference_link(a)))
    return F.array_distinct(F.transform(kept, lambda a: a["href"]))


def reference_links_flat(refs: Column) -> Column:
    """Every link of every reference, flagged ``is_external`` / ``is_archive``."""
    per_ref = F.transform(refs, lambda r: F.transform(r["links"], lambda l: F.struct(
        r["ref_pos"].alias("ref_pos"), r["ref_kind"].alias("ref_kind"),
        l["link_pos"].alias("link_pos"), l["href"].alias("href"),
        urls.is_external(l["href"]).alias("is_external"),
        urls.is_archive(l["href"]).alias("is_archive"))))
    return F.flatten(per_ref)


def distinct_reference_urls(pairs: Column) -> Column:
    """C5 + E8: distinct non-empty originals and archives of the paired references, in
    first-occurrence order (original before its archive)."""
    both = F.flatten(F.transform(pairs, lambda p: F.array(p["original_url"], p["archive_url"])))
    return F.array_distinct(F.filter(both, lambda u: u != ""))
