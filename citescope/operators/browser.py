"""Browser re-check of dead links over recorded observations.

Browser automation is replaced by an observation table (``schemas.BROWSER_SCHEMA``): either a
failure (``failure_kind`` timeout / webdriver / other, with its message) or a loaded page
(final URL, title, source). Of the observations of one URL the last counts, and it is decided
upon where it is read: page sources never reach an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citescope.operators.probes import join_evidence, last_per_url, link_outcome, probe_results

# ---- fixed values ------------------------------------------------------------------------------
# Both markers together mean an access-denied interstitial (blocked).
ACCESS_DENIED_MARKERS = ["error: access denied", "title: access denied"]
# Page-source phrases that mean the page is dead; the first one in this order is reported.
ERROR_INDICATORS = [
    "404 not found", "page not found", "error 404",
    "500 internal server error", "internal server error",
    "403 forbidden",
    "410 gone", "resource no longer available",
    "this page cannot be displayed",
    "the requested url was not found",
    "the page you are looking for could not be found",
    "server not found", "dns_probe_finished_nxdomain",
]
# Page-source phrases that mean bot blocking; the first one in this order is reported.
BLOCKING_INDICATORS = [
    "captcha", "challenge", "security check",
    "bot detected", "automated access",
    "cloudflare", "ddos protection",
    "please verify you are human",
    "checking your browser",
    "access denied",
]
# Driver error codes that mean the site is unreachable (dead) rather than a tool error.
DEAD_DRIVER_ERRORS = [
    "err_connection_closed", "err_name_not_resolved", "err_connection_refused",
    "err_connection_timed_out", "err_connection_reset", "err_network_changed",
    "err_internet_disconnected", "err_network_access_denied",
]
BROWSER_RESULT_TYPE = ("struct<status:string,code:int,final_url:string,redirected:boolean,title:string,"
                       "error_indicator:string,blocking_indicator:string,error:string>")
TIMEOUT_ERROR = "Page load timeout"
NO_OBSERVATION_ERROR = "no observation"
# -------------------------------------------------------------------------------------------------


def _first_found(src: Column, phrases) -> Column:
    arr = F.array(*[F.lit(p) for p in phrases])
    return F.try_element_at(F.filter(arr, lambda p: src.contains(p)), F.lit(1))


def browser_decision(url: Column, obs: Column, input_status: Column | None = None,
                     input_code: Column | None = None) -> Column:
    """J4 + J5 (+ J6 when ``obs`` is NULL): ``struct<status, code, final_url, redirected,
    title, error_indicator, blocking_indicator, error>``."""
    src = F.lower(F.coalesce(obs["page_source"], F.lit("")))
    kind, msg = obs["failure_kind"], obs["failure_message"]
    err_hit = _first_found(src, ERROR_INDICATORS)
    block_hit = _first_found(src, BLOCKING_INDICATORS)
    denied = src.contains(ACCESS_DENIED_MARKERS[0]) & src.contains(ACCESS_DENIED_MARKERS[1])
    dead_driver = F.lit(False)
    for e in DEAD_DRIVER_ERRORS:
        dead_driver = dead_driver | F.lower(F.coalesce(msg, F.lit(""))).contains(e)

    null_s = F.lit(None).cast("string")

    def rec(status, code=None, page=False, error=None, err_ind=None, block_ind=None):
        st = status if isinstance(status, Column) else F.lit(status)
        return F.struct(
            st.alias("status"),
            (code if isinstance(code, Column) else F.lit(code)).cast("int").alias("code"),
            (obs["final_url"] if page else null_s).alias("final_url"),
            ((obs["final_url"] != url) if page else F.lit(None).cast("boolean")).alias("redirected"),
            (obs["page_title"] if page else null_s).alias("title"),
            (err_ind if err_ind is not None else null_s).alias("error_indicator"),
            (block_ind if block_ind is not None else null_s).alias("blocking_indicator"),
            (error if error is not None else null_s).alias("error"))

    keep = rec(input_status if input_status is not None else F.lit("dead"),
               input_code if input_code is not None else None, error=F.lit(NO_OBSERVATION_ERROR))
    return (F.when(obs.isNull(), keep)
            .when(kind == "timeout", rec("timeout", error=F.lit(TIMEOUT_ERROR)))
            .when(kind == "webdriver", rec(F.when(dead_driver, "dead").otherwise("error"), error=msg))
            .when(kind.isNotNull(), rec("error", error=msg))
            .when(denied, rec("blocked", page=True, block_ind=F.lit("access denied")))
            .when(err_hit.isNotNull(), rec("dead", page=True, err_ind=err_hit))
            .when(block_hit.isNotNull(), rec("blocked", page=True, block_ind=block_hit))
            .otherwise(rec("alive", 200, page=True)))


def browser_detail(b: Column, original_url: Column) -> Column:
    """I16: ``'; '``-joined Error / Blocked / Redirected to / Title parts; ``''`` when none."""
    def part(label, v):
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v))
    redirected = F.when((F.coalesce(b["final_url"], F.lit("")) != "") & (b["final_url"] != original_url),
                        F.concat(F.lit("Redirected to: "), b["final_url"]))
    return F.concat_ws("; ", part("Error: ", b["error_indicator"]),
                       part("Blocked: ", b["blocking_indicator"]), redirected,
                       part("Title: ", b["title"]))


def browser_results(observations: DataFrame) -> DataFrame:
    """J4 + J5 + D5: ``(url, seen)``, the decision on each URL's last observation."""
    cols = [c for c in observations.columns if c not in ("url", "observed_at")]
    return last_per_url(observations, browser_decision(F.col("url"), F.struct(*cols)), "seen")


def browser_outcome() -> Column:
    """J6 of a row with ``status``, ``status_code`` and ``seen``: NULL unless dead; a dead link
    without an observation keeps its status."""
    kept = F.struct(
        F.col("status").alias("status"), F.col("status_code").alias("code"),
        F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("boolean").alias("redirected"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("error_indicator"),
        F.lit(None).cast("string").alias("blocking_indicator"),
        F.lit(NO_OBSERVATION_ERROR).alias("error"))
    return F.when(F.col("status") == "dead", F.coalesce(F.col("seen"), kept))


def with_browser(results: DataFrame, observations: DataFrame, url_col: str = "url") -> DataFrame:
    """D7 + J6: adds the ``browser`` struct to dead rows (NULL for the others), which alone
    match an observation."""
    joined = join_evidence(results, browser_results(observations), url_col,
                           F.col("status") != "dead")
    return joined.withColumn("browser", browser_outcome()).drop("seen")


def url_evidence(probes: DataFrame, observations: DataFrame | None, **kw) -> DataFrame:
    """``(url, http, seen)``: all evidence on a URL in one row, so that link rows are exchanged
    once. Both sides have one row per URL and the same partitioning."""
    http = probe_results(probes, **kw)
    if observations is None:
        return http.withColumn("seen", F.lit(None).cast(BROWSER_RESULT_TYPE))
    return http.join(browser_results(observations), "url", "left")


def classify_links(links: DataFrame, probes: DataFrame, observations: DataFrame | None,
                   url_col: str = "url", skip_col: str | None = None, **kw) -> DataFrame:
    """J3, D6, J6 and D7 in one join: adds ``status``, ``status_code`` and ``browser``."""
    skip, outcome = link_outcome(url_col, skip_col)
    joined = join_evidence(links, url_evidence(probes, observations, **kw), url_col, skip)
    decided = (joined.withColumn("_r", outcome).withColumn("status", F.col("_r.status"))
               .withColumn("status_code", F.col("_r.status_code")))
    browser = (browser_outcome() if observations is not None
               else F.lit(None).cast(BROWSER_RESULT_TYPE))
    return decided.withColumn("browser", browser).drop("_r", "http", "seen")


def validate_dead(results: DataFrame, observations: DataFrame, url_col: str = "url") -> DataFrame:
    """J6 result: only the dead rows, each with its browser decision."""
    return with_browser(results.where(F.col("status") == "dead"), observations, url_col)


def browser_totals(validated: DataFrame) -> DataFrame:
    """False positives (HTTP dead, browser alive), confirmed dead, blocked, timeout, error."""
    s = F.col("browser.status")
    return validated.agg(
        F.count_if(s == "alive").alias("false_positives"),
        F.count_if(s == "dead").alias("confirmed_dead"),
        F.count_if(s == "blocked").alias("blocked"),
        F.count_if(s == "timeout").alias("timeout"),
        F.count_if(s == "error").alias("error"))
