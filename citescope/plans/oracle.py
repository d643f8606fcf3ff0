"""Independent DuckDB SQL text for the correctness oracle.

These builders return DuckDB expressions (RE2 regexes, standard string literals) for the same
semantics the Spark column functions implement. They share only the fixed value lists.
"""

from __future__ import annotations

from citescope.functions.urls import ARCHIVE_HOSTS, COUNTRY_SUFFIXES, OPAQUE_ARCHIVES, PATH_ARCHIVES
from citescope.operators.browser import (ACCESS_DENIED_MARKERS, BLOCKING_INDICATORS,
                                         DEAD_DRIVER_ERRORS, ERROR_INDICATORS)
from citescope.operators.probes import BOT_HEADER_INDICATORS, RETRY_STATUS_CODES

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_contains(u: str, needles) -> str:
    return "(" + " OR ".join(f"contains({u}, {q(n)})" for n in needles) + ")"


def is_external(u: str) -> str:
    return f"(starts_with({u}, 'http://') OR starts_with({u}, 'https://'))"


def is_archive(u: str) -> str:
    return any_contains(u, ARCHIVE_HOSTS)


def normalize(u: str) -> str:
    s = f"regexp_replace(regexp_replace({u}, '^https?://', ''), '^www\\.', '')"
    alts = "|".join(x.replace(".", "\\.") for x in COUNTRY_SUFFIXES)
    return f"regexp_replace({s}, '^([^/]*)(?:{alts})(/|$)', '\\1.com\\2')"


def domain(u: str) -> str:
    return f"split_part({normalize(u)}, '/', 1)"


def strip_ws(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}, '^{WS}+', ''), '{WS}+$', '')"


def basic(u: str) -> str:
    return f"regexp_replace(lower(regexp_replace({strip_ws(u)}, '^https?://', '')), '/+$', '')"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[^/]*/){{3}}([\\s\\S]*)$', 1)"


def equivalent(a: str, b: str) -> str:
    pa, pb = path(a), path(b)
    return (f"(coalesce({a}, '') <> '' AND coalesce({b}, '') <> '' AND coalesce("
            f"{basic(a)} = {basic(b)} OR {normalize(a)} = {normalize(b)} OR "
            f"({domain(a)} = {domain(b)} AND ({pa} = {pb} OR ({pa} <> '' AND {pb} <> '' AND "
            f"(contains({pb}, {pa}) OR contains({pa}, {pb}))))), false))")


def archive_original(u: str) -> str:
    d = r"\p{Nd}"
    return (f"(CASE WHEN contains({u}, 'web.archive.org') THEN "
            f"regexp_extract({u}, 'https?://web\\.archive\\.org/web/{d}+/([^\\n]+)', 1) "
            f"WHEN contains({u}, 'ghostarchive.org') THEN "
            f"regexp_extract({u}, 'https://ghostarchive\\.org/archive/{d}+/([^\\n]+)', 1) "
            f"WHEN {any_contains(u, PATH_ARCHIVES)} THEN "
            f"(CASE WHEN contains({path(u)}, '.') THEN {path(u)} ELSE '' END) "
            f"WHEN {any_contains(u, OPAQUE_ARCHIVES)} THEN '' "
            f"WHEN contains({u}, 'webcitation.org') THEN "
            f"regexp_extract({u}, 'https://webcitation\\.org/[^/]+/([^\\n]+)', 1) "
            f"WHEN contains({u}, 'wayback.archive.org') THEN "
            f"regexp_extract({u}, 'https://wayback\\.archive\\.org/web/{d}+/([^\\n]+)', 1) "
            f"ELSE '' END)")


def valid_match(o: str, a: str) -> str:
    ex = archive_original(a)
    return (f"(coalesce({o}, '') <> '' AND coalesce({a}, '') <> '' AND {ex} <> '' "
            f"AND {equivalent(o, ex)})")


def collapse_ws(s: str) -> str:
    return f"trim(regexp_replace({s}, '{WS}+', ' ', 'g'))"


def clean_title(t: str) -> str:
    return collapse_ws(f"replace({t}, '_', ' ')")


def bot(h: str) -> str:
    return any_contains(f"lower(coalesce({h}, ''))", BOT_HEADER_INDICATORS)


def http_status_case(u: str, p: str) -> tuple[str, str]:
    """(status, code) CASE expressions over probe columns prefixed by ``p.``."""
    retry = ", ".join(str(c) for c in RETRY_STATUS_CODES)
    hs, gs = f"{p}.head_status", f"{p}.get_status"
    head_resp = f"(NOT coalesce({p}.head_failed, false) AND {hs} IS NOT NULL AND {hs} NOT IN ({retry}))"
    get_resp = f"(NOT coalesce({p}.get_failed, false) AND {gs} IS NOT NULL AND {gs} NOT IN ({retry}))"
    auth = f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    dns_fail = f"(NOT coalesce({p}.dns_ok, false) OR contains({auth}, ':') OR contains({auth}, '@'))"
    status = (f"(CASE WHEN {is_archive(u)} THEN 'archived' WHEN {p}.url IS NULL THEN 'connection_error' "
              f"WHEN {dns_fail} THEN 'connection_error' "
              f"WHEN {head_resp} THEN (CASE WHEN {hs} < 400 THEN 'alive' "
              f"  WHEN {hs} = 403 THEN (CASE WHEN {bot(p + '.head_headers')} THEN 'blocked' ELSE 'dead' END) "
              f"  WHEN {hs} = 404 THEN (CASE WHEN {get_resp} AND {gs} < 400 THEN 'alive' ELSE 'dead' END) "
              f"  ELSE 'dead' END) "
              f"WHEN {get_resp} THEN (CASE WHEN {gs} < 400 THEN 'alive' "
              f"  WHEN {gs} = 403 THEN (CASE WHEN {bot(p + '.get_headers')} THEN 'blocked' ELSE 'dead' END) "
              f"  ELSE 'dead' END) "
              f"ELSE 'connection_error' END)")
    code = (f"CAST((CASE WHEN {is_archive(u)} THEN NULL WHEN {p}.url IS NULL THEN NULL "
            f"WHEN {dns_fail} THEN NULL "
            f"WHEN {head_resp} THEN (CASE WHEN {hs} = 404 AND {get_resp} THEN {gs} ELSE {hs} END) "
            f"WHEN {get_resp} THEN {gs} ELSE NULL END) AS INTEGER)")
    return status, code


def first_phrase(src: str, phrases) -> str:
    whens = " ".join(f"WHEN contains({src}, {q(x)}) THEN {q(x)}" for x in phrases)
    return f"(CASE {whens} ELSE NULL END)"


def browser_case(url: str, b: str, in_status: str = "'dead'", in_code: str = "NULL") -> dict:
    """Browser decision columns over observation columns prefixed by ``b.``."""
    src = f"lower(coalesce({b}.page_source, ''))"
    denied = " AND ".join(f"contains({src}, {q(m)})" for m in ACCESS_DENIED_MARKERS)
    err = first_phrase(src, ERROR_INDICATORS)
    blk = first_phrase(src, BLOCKING_INDICATORS)
    dead_drv = any_contains(f"lower(coalesce({b}.failure_message, ''))", DEAD_DRIVER_ERRORS)
    page = f"({b}.url IS NOT NULL AND {b}.failure_kind IS NULL)"
    status = (f"(CASE WHEN {b}.url IS NULL THEN {in_status} "
              f"WHEN {b}.failure_kind = 'timeout' THEN 'timeout' "
              f"WHEN {b}.failure_kind = 'webdriver' THEN (CASE WHEN {dead_drv} THEN 'dead' ELSE 'error' END) "
              f"WHEN {b}.failure_kind IS NOT NULL THEN 'error' "
              f"WHEN {denied} THEN 'blocked' WHEN {err} IS NOT NULL THEN 'dead' "
              f"WHEN {blk} IS NOT NULL THEN 'blocked' ELSE 'alive' END)")
    error_ind = f"(CASE WHEN {page} AND NOT ({denied}) THEN {err} END)"
    block_ind = (f"(CASE WHEN {page} AND ({denied}) THEN 'access denied' "
                 f"WHEN {page} AND {err} IS NULL THEN {blk} END)")
    final_url = f"(CASE WHEN {page} THEN {b}.final_url END)"
    title = f"(CASE WHEN {page} THEN {b}.page_title END)"
    code = (f"CAST((CASE WHEN {b}.url IS NULL THEN {in_code} WHEN {page} AND NOT ({denied}) AND {err} IS NULL "
            f"AND {blk} IS NULL THEN 200 END) AS INTEGER)")
    error = (f"(CASE WHEN {b}.url IS NULL THEN 'no observation' WHEN {b}.failure_kind = 'timeout' "
             f"THEN 'Page load timeout' WHEN {b}.failure_kind IS NOT NULL THEN {b}.failure_message END)")

    def part(label, v):
        return f"(CASE WHEN coalesce({v}, '') <> '' THEN concat({q(label)}, {v}) END)"
    redirected = (f"(CASE WHEN coalesce({final_url}, '') <> '' AND {final_url} <> {url} "
                  f"THEN concat('Redirected to: ', {final_url}) END)")
    detail = (f"concat_ws('; ', {part('Error: ', error_ind)}, {part('Blocked: ', block_ind)}, "
              f"{redirected}, {part('Title: ', title)})")
    return {"status": status, "code": code, "error_indicator": error_ind,
            "blocking_indicator": block_ind, "final_url": final_url, "title": title,
            "error": error, "detail": detail,
            "redirected": f"(CASE WHEN {page} THEN {b}.final_url <> {url} END)"}


def one_decimal(x: str) -> str:
    return f"printf('%.1f', {x})"


def format_duration(s: str) -> str:
    return (f"(CASE WHEN {s} < 60 THEN concat({one_decimal(s)}, 's') "
            f"WHEN {s} < 3600 THEN concat({one_decimal(f'({s}) / CAST(60 AS DOUBLE)')}, 'm') "
            f"ELSE concat({one_decimal(f'({s}) / CAST(3600 AS DOUBLE)')}, 'h') END)")
