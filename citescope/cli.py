"""Command-line run of the full audit, with the audited tool's run options.

    python -m citescope.cli --pages PAGES --probes PROBES [--browser BROWSER]
        (--pageviews DOCS | --use-popular-articles LIST.json) [--limit 25] [--daily --day D]
        [--no-html-structure [--all-links]] [--no-browser-validation] [--output-dir output]

On a cluster: ``spark-submit --py-files citescope.zip citescope/cli.py ...``.
Inputs are files or tables instead of live services: daily page-view documents (JSON, one
folder per ``view_day=``), article HTML (Parquet with ``title, html`` or a folder of ``.html``
files), recorded HTTP probes and recorded browser observations (Parquet, see
``citescope.schemas``). The report is written as ``all_references_<stamp>.csv`` under the output
folder; the run totals, the top dead-link articles and the browser totals are printed. Only
those small aggregates (a few rows) come back to the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.operators import browser as B
from citescope.operators import popular_links as PL
from citescope.operators import popularity as POP
from citescope.operators import report as R
from citescope.plans.audit import audit
from citescope.session import build_session
from citescope.sources import article_lists as AL
from citescope.sources import evidence as EV
from citescope.sources import pages as PG
from citescope.sources import pageviews as PV
from citescope.sources import report_io as RIO


def parse_args(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Audit the external citations of popular articles on Spark")
    p.add_argument("--pages", required=True,
                   help="article HTML: Parquet (title, html) or, with --pages-format html, .html files")
    p.add_argument("--pages-format", choices=["parquet", "html"], default="parquet")
    p.add_argument("--probes", default=None, help="recorded HTTP probes (Parquet or a catalog table)")
    p.add_argument("--browser", default=None, help="recorded browser observations (Parquet or a catalog table)")
    p.add_argument("--save-popular-list", default=None, metavar="LIST",
                   help="only extract the links of --pages (a saved popular-articles page) to LIST")
    p.add_argument("--pageviews", default=None, help="daily page-view JSON documents (view_day=... folders)")
    p.add_argument("--use-popular-articles", default=None, help="saved article list (JSON array)")
    p.add_argument("--limit", type=int, default=POP.DEFAULT_LIMIT, help="number of articles (default 25)")
    p.add_argument("--daily", action="store_true", help="one day's top list instead of the long-run ranking")
    p.add_argument("--day", default=None, help="day of the daily list (default: the day before today)")
    p.add_argument("--no-html-structure", dest="use_html_structure", action="store_false",
                   help="flat link extraction with URL-equivalence archive matching")
    p.add_argument("--all-links", dest="references_only", action="store_false",
                   help="with --no-html-structure: every reference-like link of the page")
    p.add_argument("--no-browser-validation", dest="browser_validation", action="store_false")
    p.add_argument("--output-dir", default="output")
    p.add_argument("--stamp", default=None, help="run stamp yyyyMMdd_HHmmss (default: now)")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    return p.parse_args(argv)


def _read_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "html":
        return PG.read_html_files(spark, path)
    pages = PG.read_pages(spark, path)
    return pages.select("title", "html", *[c for c in ("ingest_pos",) if c in pages.columns])


def save_popular_list(spark: SparkSession, page: str, path: str, limit: int) -> None:
    """The popular-list run: the links of a saved popular-articles page (C1), the first ``limit``
    (0: all of that page), written as a saved list for ``--use-popular-articles``."""
    html = PG.read_html_files(spark, page).withColumn("page_id", F.xxhash64("title"))
    links = PL.article_links_df(html).orderBy("page_id", "link_pos")
    AL.write_popular_records(links.limit(limit) if limit > 0 else links, path,
                             order=["page_id", "link_pos"])


def articles_for_run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Step 1: the article list."""
    if args.use_popular_articles:
        return AL.read_article_list(spark, args.use_popular_articles, limit=args.limit).select("article_pos", "title")
    if not args.pageviews:
        raise SystemExit("give --pageviews or --use-popular-articles")
    pv = PV.read_pageview_docs(spark, args.pageviews)
    if args.daily:
        day = args.day or (dt.date.today() - dt.timedelta(days=1)).isoformat()
        top = POP.daily_top(pv, day, limit=args.limit)
        return top.select(F.col("top_pos").cast("long").alias("article_pos"), F.col("article").alias("title"))
    top = POP.popular_scored(pv, limit=args.limit, all_days=False)
    return top.select(F.col("top_pos").cast("long").alias("article_pos"), "title")


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> dict:
    spark = spark or build_session(args.master)
    if args.save_popular_list:
        save_popular_list(spark, args.pages, args.save_popular_list, args.limit)
        return {"saved_list": args.save_popular_list}
    if not args.probes:
        raise SystemExit("give --probes")
    stamp = args.stamp or dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    mode = "structure" if args.use_html_structure else ("references" if args.references_only else "all")
    articles = articles_for_run(spark, args)
    observed = args.browser and args.browser_validation
    res = audit(articles, _read_pages(spark, args.pages, args.pages_format),
                EV.load_evidence(spark, args.probes, "probes"),
                EV.load_evidence(spark, args.browser, "browser") if observed else None,
                mode=mode, stamp=stamp, materialize=True)
    # The classified links are checkpointed once: the report and the summaries below all read
    # them, so the HTML is parsed once for the whole run.
    path = RIO.write_full_report(res.report, args.output_dir, stamp)
    totals = R.run_totals(res.results, res.articles).first().asDict()
    top = [r.asDict() for r in R.top_dead_articles(res.results).collect()]          # at most 5 rows
    summary = {"report": path, "mode": mode, "totals": totals, "top_dead_articles": top}
    if args.browser and args.browser_validation:
        summary["browser_totals"] = B.browser_totals(res.validated).first().asDict()
    return summary


def main(argv=None) -> None:
    print(json.dumps(run(parse_args(argv)), indent=2, default=str))


if __name__ == "__main__":
    main()
