"""URL algebra as Spark column expressions (JVM-side, inside whole-stage codegen).

Every function takes and returns a ``Column``; the same expressions work inside higher-order
function lambdas, which the pairing operator relies on. Regexes are Java regexes: ``\\z`` is the
true end of input (``$`` would also match before a final line break) and ``[^\\n]`` stands for
Python's ``.``, which excludes only the line feed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the audited tool's lists) -----------------------------------
# Substrings that mark an archive URL, tested anywhere in the URL.
ARCHIVE_HOSTS = [
    "web.archive.org",
    "archive.today",
    "archive.org",
    "archive.is",
    "archive.fo",
    "archive.md",
    "archive.ph",
    "archive.li",
    "archive.vn",
    "webcitation.org",
    "wayback.archive.org",
    "ghostarchive.org",
]
# Host suffixes mapped to ".com" before URLs are compared.
COUNTRY_SUFFIXES = [
    ".co.uk", ".co.za", ".co.au", ".co.nz", ".co.in", ".co.jp", ".co.kr", ".co.il",
    ".com.au", ".com.br", ".com.mx", ".com.sg", ".com.hk", ".com.tw", ".com.my", ".com.ph",
    ".com.vn", ".com.th", ".com.id",
]
# Archive services whose original URL is taken from the fourth "/" piece.
PATH_ARCHIVES = ["archive.today", "archive.is", "archive.fo"]
# Archive services whose original URL is never extracted.
OPAQUE_ARCHIVES = ["archive.md", "archive.ph", "archive.li", "archive.vn"]
# --------------------------------------------------------------------------------------------

# Python's str.split()/strip() whitespace, as a Java character class.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

_ARCHIVE_RE = "|".join(re.escape(h) for h in ARCHIVE_HOSTS)
_SUFFIX_RE = (r"^([^/]*)(?:" + "|".join(re.escape(s) for s in COUNTRY_SUFFIXES) + r")(?=/|\z)")
# Python's \d is any Unicode decimal digit.
_D = r"\p{Nd}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_external(url) -> Column:
    """Starts with ``http://`` or ``https://`` (case-sensitive)."""
    u = _c(url)
    return u.startswith("http://") | u.startswith("https://")


def is_archive(url) -> Column:
    """Contains any archive host string (plain substring test)."""
    return _c(url).rlike(_ARCHIVE_RE)


def strip_scheme(url) -> Column:
    return F.regexp_replace(_c(url), r"^https?://", "")


def normalize(url) -> Column:
    """Drop one scheme and one ``www.``, map a country suffix of the host to ``.com``."""
    u = F.regexp_replace(strip_scheme(url), r"^www\.", "")
    return F.regexp_replace(u, _SUFFIX_RE, "$1.com")


def domain(url) -> Column:
    """Host part of I1 (before the first ``/``)."""
    return F.substring_index(normalize(url), "/", 1)


def same_domain(url1, url2) -> Column:
    """I2."""
    return domain(url1) == domain(url2)


def basic_normalize(url) -> Column:
    """Strip whitespace, one scheme, lower-case, strip every trailing ``/``."""
    u = F.regexp_replace(_c(url), rf"^{WS}+|{WS}+\z", "")
    return F.regexp_replace(F.lower(strip_scheme(u)), r"/+\z", "")


def url_path(url) -> Column:
    """Fourth piece of a split on ``/`` into at most four pieces, else ``''``."""
    return F.coalesce(F.get(F.split(_c(url), "/", 4), 3), F.lit(""))


def _nonempty(u: Column) -> Column:
    return u.isNotNull() & (u != "")


def equivalent(url1, url2) -> Column:
    """I4: URL equivalence (not transitive: path containment counts)."""
    u1, u2 = _c(url1), _c(url2)
    p1, p2 = url_path(u1), url_path(u2)
    path_match = (p1 == p2) | ((p1 != "") & (p2 != "") & (p2.contains(p1) | p1.contains(p2)))
    cond = ((basic_normalize(u1) == basic_normalize(u2))
            | (normalize(u1) == normalize(u2))
            | (same_domain(u1, u2) & path_match))
    return _nonempty(u1) & _nonempty(u2) & F.coalesce(cond, F.lit(False))


def _any_contains(u: Column, needles) -> Column:
    out = None
    for n in needles:
        c = u.contains(n)
        out = c if out is None else (out | c)
    return out


def archive_original(url) -> Column:
    """Original URL embedded in an archive URL, ``''`` when none.

    An ordered CASE: the first branch whose host test holds decides, even on a pattern miss.
    """
    u = _c(url)
    fourth = url_path(u)
    return (
        F.when(u.contains("web.archive.org"),
               F.regexp_extract(u, rf"https?://web\.archive\.org/web/{_D}+/([^\n]+)", 1))
        .when(u.contains("ghostarchive.org"),
              F.regexp_extract(u, rf"https://ghostarchive\.org/archive/{_D}+/([^\n]+)", 1))
        .when(_any_contains(u, PATH_ARCHIVES),
              F.when(fourth.contains("."), fourth).otherwise(F.lit("")))
        .when(_any_contains(u, OPAQUE_ARCHIVES), F.lit(""))
        .when(u.contains("webcitation.org"),
              F.regexp_extract(u, r"https://webcitation\.org/[^/]+/([^\n]+)", 1))
        .when(u.contains("wayback.archive.org"),
              F.regexp_extract(u, rf"https://wayback\.archive\.org/web/{_D}+/([^\n]+)", 1))
        .otherwise(F.lit(""))
    )


def valid_archive_match(original_url, archive_url) -> Column:
    """The archive's embedded URL exists and is equivalent to the original."""
    o, a = _c(original_url), _c(archive_url)
    ex = archive_original(a)
    return _nonempty(o) & _nonempty(a) & (ex != "") & equivalent(o, ex)
