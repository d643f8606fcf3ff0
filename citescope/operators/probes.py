"""HTTP link classification over recorded evidence.

Live HEAD/GET requests are replaced by a probe table (see ``schemas.PROBE_SCHEMA``); of the
probes of one URL the last counts. The decision ladder keeps the precedence of the audited checker:
archive, DNS, HEAD, then GET.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.functions import urls

# ---- fixed values ------------------------------------------------------------------------------
# Words that mark a 403 as bot blocking when found in a lower-cased "name: value" header.
BOT_HEADER_INDICATORS = [
    "cloudflare", "captcha", "challenge", "bot", "automated",
    "rate limit", "access denied", "security", "blocked",
]
# Status codes retried by the HTTP client; once retries are exhausted the request raises.
RETRY_STATUS_CODES = [429, 500, 502, 503, 504]
STATUSES = ["alive", "dead", "blocked", "archived", "connection_error"]
# -------------------------------------------------------------------------------------------------


def bot_blocked(headers) -> Column:
    """J2 (header part): any indicator in the lower-cased header text."""
    h = F.lower(F.coalesce(F.col(headers) if isinstance(headers, str) else headers, F.lit("")))
    out = F.lit(False)
    for word in BOT_HEADER_INDICATORS:
        out = out | h.contains(word)
    return out


def authority_fails_dns(url) -> Column:
    """The DNS test runs on the whole authority, so a port or user-info never resolves."""
    u = F.col(url) if isinstance(url, str) else url
    auth = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return auth.contains(":") | auth.contains("@")


def _result(status: str, code) -> Column:
    c = F.lit(None).cast("int") if code is None else code.cast("int")
    return F.struct(F.lit(status).alias("status"), c.alias("status_code"))


def http_status(url: Column, probe: Column, retry_codes=RETRY_STATUS_CODES,
                authority_dns: bool = True) -> Column:
    """``struct<status, status_code>`` from one URL and its probe struct (NULL = no probe).

    A retried status (``retry_codes``) ends as a raised request, like a failed one. A URL without
    a probe row counts as a failed request (``connection_error``).
    """
    hs, gs = probe["head_status"], probe["get_status"]
    retry = list(retry_codes)
    head_resp = ~F.coalesce(probe["head_failed"], F.lit(False)) & hs.isNotNull() & ~hs.isin(retry)
    get_resp = ~F.coalesce(probe["get_failed"], F.lit(False)) & gs.isNotNull() & ~gs.isin(retry)
    dns_fail = ~F.coalesce(probe["dns_ok"], F.lit(False))
    if authority_dns:
        dns_fail = dns_fail | authority_fails_dns(url)

    def blocked_or_dead(headers, code):
        return F.when(bot_blocked(headers), _result("blocked", code)).otherwise(_result("dead", code))

    after_head = (
        F.when(hs < 400, _result("alive", hs))
        .when(hs == 403, blocked_or_dead(probe["head_headers"], hs))
        .when(hs == 404, F.when(get_resp & (gs < 400), _result("alive", gs))
              .when(get_resp, _result("dead", gs))
              .otherwise(_result("dead", hs)))
        .otherwise(_result("dead", hs)))
    after_failed_head = (
        F.when(get_resp & (gs < 400), _result("alive", gs))
        .when(get_resp & (gs == 403), blocked_or_dead(probe["get_headers"], gs))
        .when(get_resp, _result("dead", gs))
        .otherwise(_result("connection_error", None)))
    return (F.when(urls.is_archive(url), _result("archived", None))
            .when(probe.isNull(), _result("connection_error", None))
            .when(dns_fail, _result("connection_error", None))
            .when(head_resp, after_head)
            .otherwise(after_failed_head))


def last_per_url(df: DataFrame, result: Column, alias: str) -> DataFrame:
    """(url, result): the result of each URL's last observation (by ``observed_at``; without
    that column, or at equal times, the largest result, so that it is the same on every run).

    ``result`` is computed on the scan and must be narrow; headers and page sources never reach
    the exchange, and a URL observed often is reduced before it."""
    at = F.col("observed_at") if "observed_at" in df.columns else F.lit(0)
    return (df.select("url", F.struct(at.cast("long").alias("at"), result.alias("result")).alias("o"))
            .groupBy("url").agg(F.max("o").alias("o"))
            .select(F.col("url"), F.col("o.result").alias(alias)))


def probe_results(probes: DataFrame, **kw) -> DataFrame:
    """J1 + D4: ``(url, http)``, one row per probed URL, its last probe."""
    cols = [c for c in probes.columns if c not in ("url", "observed_at")]
    return last_per_url(probes, http_status(F.col("url"), F.struct(*cols), **kw), "http")


def link_outcome(url_col: str, skip_col: str | None):
    """(skip, outcome) of a link joined with ``http``: archived, without a probe, or probed."""
    u = F.col(url_col)
    skip = urls.is_archive(u)
    if skip_col:
        skip = skip | F.coalesce(F.col(skip_col), F.lit(False))
    return skip, (F.when(skip, _result("archived", None))
                  .when(F.col("http").isNull(), _result("connection_error", None))
                  .otherwise(F.col("http")))


def join_evidence(links: DataFrame, evidence: DataFrame, url_col: str, skip: Column) -> DataFrame:
    """Left join of link rows with evidence that has one narrow row per ``url``.

    Links that need no check must not match; they join on a key of their own, spread by their
    row, not on their URL. Both sides are exchanged on a key made for this join, so that AQE may
    split the partition of a URL that very many links cite, in any session: it only splits
    sides that come straight from an exchange, and the evidence would else come from the
    aggregate that made it."""
    key = F.when(skip, F.xxhash64(*links.columns).cast("string")).otherwise(
        F.concat(F.lit("="), F.col(url_col)))
    keyed = evidence.select(F.concat(F.lit("="), F.col("url")).alias("_evidence_key"),
                            *[c for c in evidence.columns if c != "url"])
    return (links.withColumn("_key", key)
            .join(keyed, F.col("_key") == F.col("_evidence_key"), "left")
            .drop("_key", "_evidence_key"))


def classify_urls(links: DataFrame, probes: DataFrame, url_col: str = "url",
                  skip_col: str | None = None, **kw) -> DataFrame:
    """J3 + D6: adds ``status`` and ``status_code`` to every link row; rows with an archive
    (``skip_col``) and archive URLs never match a probe and become ``archived``."""
    skip, outcome = link_outcome(url_col, skip_col)
    joined = join_evidence(links, probe_results(probes, **kw), url_col, skip)
    return (joined.withColumn("_r", outcome)
            .withColumn("status", F.col("_r.status"))
            .withColumn("status_code", F.col("_r.status_code"))
            .drop("_r", "http"))


def status_summary(results: DataFrame, keys=()) -> DataFrame:
    """Total and per-status counts."""
    aggs = [F.count("*").alias("total")] + [
        F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return results.groupBy(*keys).agg(*aggs) if keys else results.agg(*aggs)
