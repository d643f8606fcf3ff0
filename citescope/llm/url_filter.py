"""URL filters by a character language-model ratio; DataFrame functions only.

Rules decide first: a rule is a host and a path, it fits its host and all subdomains where the
path starts with the rule's, and the longest fitting rule wins. The URLs that rules allow and
block teach two variable-order Markov models over the characters of host + path: contexts of 0
to ``ORDER`` characters with Witten-Bell smoothing, each order falling back on the next shorter
one and the shortest on a uniform distribution. A URL's score is the mean over its characters
of log P(allowed) - log P(blocked). The threshold is the score that separates the URLs the
rules judge best (largest sum of both hit rates, ties to the lower score; in the middle of the
gap between the scores on its sides); URLs without a rule are allowed from it on.

Every distinct URL is judged once, and every distinct run of characters is scored once; page
rows meet the result in one join on the URL. Sums are taken over scaled integers, so that they
do not depend on the order of rows.

Defined cases: a null URL or one without ``://`` has an empty host and path and is allowed,
as nothing speaks against it; repeated URLs count as often as they occur and are judged alike;
equally long rules: the one with the longer host wins, then the one that sorts last; with no
allowed or no blocked URL to learn from every URL without a rule is allowed; an empty table gives
no rows; other columns are ignored; URLs are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.llm.joins import broadcast_if_small, join_exploded
from citescope.session import scratch_path

ORDER = 4
ALPHABET = 256      # of the uniform distribution under the shortest context
SCALE = 1_000_000   # scores are summed as whole millionths
BINS_PER_UNIT = 500
LIMIT = 10          # scores beyond +-LIMIT calibrate as +-LIMIT
START, END = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``rules``: (verdict, host followed by path) pairs."""
    rows = [(verdict, rule, *rule.partition("/")[::2]) for verdict, rule in rules]
    return spark.createDataFrame([(v, r, host, "/" + path) for v, r, host, path in rows],
                                 "rule_verdict string, rule string, rule_host string, "
                                 "rule_path string")


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the columns rule and rule_verdict."""
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))),
                           lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    fitting = (urls.select("url", "path", F.explode(suffixes).alias("rule_host"))
               .join(broadcast_if_small(rules, 400), "rule_host")
               .where(F.col("path").startswith(F.col("rule_path")))
               .groupBy("url").agg(F.max(F.struct(
                   F.length("rule").alias("size"), F.length("rule_host").alias("host_size"),
                   "rule", "rule_verdict")).alias("best"))
               .select(F.col("url").alias("ruled_url"), "best.rule", "best.rule_verdict"))
    return urls.join(fitting, F.col("url").eqNullSafe(F.col("ruled_url")), "left").drop("ruled_url")


def grams(text: Column) -> Column:
    """Every run of ORDER characters and the one behind it, from the padded text."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def gram_scores(counts: DataFrame) -> DataFrame:
    """gram, delta (scaled log-probability difference) for ``counts`` (gram, allowed, blocked):
    all grams that occur, and how often in allowed and blocked URLs."""
    last = F.substring("gram", ORDER + 1, 1)
    context = [F.substring("gram", ORDER + 1 - k, k) if k else F.lit("") for k in range(ORDER + 1)]
    by_order = counts.select("gram", "allowed", "blocked", last.alias("next"), F.posexplode(
        F.array(*context)).alias("order", "context"))
    seen = by_order.groupBy("order", "context", "next").agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    total = seen.groupBy("order", "context").agg(
        F.sum("allowed").alias("allowed_total"), F.sum("blocked").alias("blocked_total"),
        F.sum(F.signum("allowed").cast("long")).alias("allowed_kinds"),
        F.sum(F.signum("blocked").cast("long")).alias("blocked_kinds"))

    def backed_off(name: str) -> Column:
        """log P, from the shortest context to the longest."""
        return F.log(F.aggregate("levels", F.lit(1.0 / ALPHABET), lambda p, x: F.when(
            x[f"{name}_total"] > 0,
            (x[name] + x[f"{name}_kinds"] * p) / (x[f"{name}_total"] + x[f"{name}_kinds"])
        ).otherwise(p)))

    # the counts of a gram's contexts, one row per gram (ORDER + 1 levels)
    table = seen.join(total, ["order", "context"])
    levels = (by_order.select("gram", "order", "context", "next")
              .join(table, ["order", "context", "next"])
              .groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(
                  "order", "allowed", "blocked", "allowed_total", "blocked_total",
                  "allowed_kinds", "blocked_kinds"))).alias("levels")))
    return levels.select("gram", F.round((backed_off("allowed") - backed_off("blocked")) * SCALE)
                         .cast("long").alias("delta"))


def threshold(scored: DataFrame) -> float:
    """The score from which URLs are allowed; ``scored`` has rule_verdict, score and n."""
    bins = (scored.where("rule_verdict IS NOT NULL")
            .groupBy(F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), "score"))
                             * BINS_PER_UNIT).alias("bin"))
            .agg(F.sum(F.when(F.col("rule_verdict") == "allow", F.col("n")).otherwise(0)).alias("a"),
                 F.sum(F.when(F.col("rule_verdict") == "block", F.col("n")).otherwise(0)).alias("b"))
            .orderBy("bin").collect())  # at most 2 * LIMIT * BINS_PER_UNIT + 1 rows
    allowed, blocked = sum(r.a for r in bins), sum(r.b for r in bins)
    best, edge, lost, caught, last = 0.0, -math.inf, 0, 0, 0
    if allowed and blocked:
        for r in bins:
            gain = caught / blocked - lost / allowed
            if gain > best:
                best, edge = gain, (last + 1 + r.bin) / 2 / BINS_PER_UNIT
            lost, caught, last = lost + r.a, caught + r.b, r.bin
        if caught / blocked - lost / allowed > best:
            edge = math.inf
    return edge


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``."""
    spark = pages.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"))
    urls = written(apply_rules(rows.groupBy("url").agg(F.count("*").alias("n"))
                               .withColumns({"host": host, "path": path}),
                               rule_table(spark, rules)), "urls")
    own = urls.select("url", "n", "rule_verdict", F.explode(grams(F.concat("host", "path")))
                      .alias("gram"))
    counts = written(own.groupBy("gram").agg(
        F.sum(F.when(F.col("rule_verdict") == "allow", F.col("n")).otherwise(0)).alias("allowed"),
        F.sum(F.when(F.col("rule_verdict") == "block", F.col("n")).otherwise(0)).alias("blocked")),
        "grams")
    deltas = written(gram_scores(counts), "deltas")
    scores = (join_exploded(own, deltas, "gram", 32).groupBy("url")
              .agg((F.sum("delta") / F.count("*") / SCALE).alias("score"))
              .select(F.col("url").alias("scored_url"), "score"))
    scored = written(urls.join(scores, F.col("url").eqNullSafe(F.col("scored_url")), "left")
                     .drop("scored_url"), "scored")
    edge = threshold(scored)
    learned = (F.when((F.col("host") == "") & (F.col("path") == ""), "allow")
               .when(F.col("score") >= edge, "allow").otherwise("block"))
    verdicts = scored.select(F.col("url").alias("judged_url"), "host", "path", "rule",
                             F.coalesce("rule_verdict", learned).alias("verdict"), "score")
    return (rows.join(verdicts, F.col("url").eqNullSafe(F.col("judged_url")))
            .select("page_id", "host", "path", "rule", "verdict", "score"))
