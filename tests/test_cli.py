"""The command-line run: article list -> audit -> CSV report + printed totals."""

import json
import os

from citescope import cli
from citescope import fixtures as FX
from citescope.sources import report_io as RIO

SF = "/root/testdata/sf0.001"


def test_cli_run_from_saved_list(spark, tmp_out):
    fx = FX.register(spark, SF)
    pages = os.path.join(tmp_out, "pages.parquet")
    fx["fx_html"].select("title", "html", "ingest_pos").write.parquet(pages)
    probes = os.path.join(tmp_out, "probes.parquet")
    fx["fx_probe"].write.parquet(probes)
    browser = os.path.join(tmp_out, "browser.parquet")
    fx["fx_browser"].write.parquet(browser)
    titles = [r.title for r in fx["fx_html"].select("article_pos", "title").distinct().orderBy("article_pos").collect()]
    lst = os.path.join(tmp_out, "popular.json")
    with open(lst, "w", encoding="utf-8") as f:
        json.dump([{"title": t} for t in titles[:3]] + [titles[3]], f)
    out = os.path.join(tmp_out, "out")
    args = cli.parse_args(["--pages", pages, "--probes", probes, "--browser", browser,
                           "--use-popular-articles", lst, "--limit", "4", "--output-dir", out,
                           "--stamp", "20240101_000000"])
    summary = cli.run(args, spark)
    assert summary["report"].endswith("all_references_20240101_000000.csv")
    rep = RIO.read_report(spark, summary["report"])
    n_refs = fx["fx_refs"].where(fx["fx_refs"].title.isin(titles[:4])).count()
    assert rep.count() == n_refs == summary["totals"]["links_checked"]
    assert summary["totals"]["articles_processed"] == 4
    assert len(summary["top_dead_articles"]) <= 5 and "browser_totals" in summary
    flat = cli.run(cli.parse_args(["--pages", pages, "--probes", probes, "--use-popular-articles", lst,
                                   "--no-html-structure", "--output-dir", out, "--stamp", "20240101_000001"]), spark)
    assert flat["mode"] == "references" and "browser_totals" not in flat


def test_cli_run_from_pageview_documents(spark, tmp_out):
    fx = FX.register(spark, SF)
    pages = os.path.join(tmp_out, "pages.parquet")
    fx["fx_html"].select("title", "html", "ingest_pos").write.parquet(pages)
    probes = os.path.join(tmp_out, "probes.parquet")
    fx["fx_probe"].write.parquet(probes)
    titles = [r.title for r in fx["fx_html"].select("article_pos", "title").distinct().orderBy("article_pos").collect()]
    docs = os.path.join(tmp_out, "pageviews")
    for day, order in (("2024-01-01", titles), ("2024-01-02", list(reversed(titles)))):
        os.makedirs(os.path.join(docs, f"view_day={day}"))
        arts = [{"article": "Main_Page", "rank": 1, "views": 10 ** 6}] + [
            {"article": t, "rank": i + 2, "views": 1000 - i} for i, t in enumerate(order)]
        with open(os.path.join(docs, f"view_day={day}", "top.json"), "w") as f:
            json.dump({"items": [{"articles": arts}]}, f)
    base = ["--pages", pages, "--probes", probes, "--pageviews", docs, "--limit", "2", "--no-browser-validation"]
    long_run = cli.run(cli.parse_args(base + ["--output-dir", os.path.join(tmp_out, "o1"), "--stamp", "1"]), spark)
    daily = cli.run(cli.parse_args(base + ["--daily", "--day", "2024-01-02", "--output-dir",
                                           os.path.join(tmp_out, "o2"), "--stamp", "2"]), spark)
    n = lambda ts: fx["fx_refs"].where(fx["fx_refs"].title.isin(ts)).count()
    assert long_run["totals"]["links_checked"] == n(titles[:2])       # sample day 2024-01-01 only
    assert daily["totals"]["links_checked"] == n(titles[-2:])         # the reversed day


def test_cli_limit_zero_keeps_whole_list(spark, tmp_out):
    fx = FX.register(spark, SF)
    pages = os.path.join(tmp_out, "pages.parquet")
    fx["fx_html"].select("title", "html", "ingest_pos").write.parquet(pages)
    probes = os.path.join(tmp_out, "probes.parquet")
    fx["fx_probe"].write.parquet(probes)
    titles = [r.title for r in fx["fx_html"].select("title").distinct().collect()]
    lst = os.path.join(tmp_out, "all.json")
    with open(lst, "w", encoding="utf-8") as f:
        json.dump(titles, f)
    s = cli.run(cli.parse_args(["--pages", pages, "--probes", probes, "--use-popular-articles", lst,
                                "--limit", "0", "--output-dir", os.path.join(tmp_out, "o"), "--stamp", "3"]), spark)
    assert s["totals"]["articles_processed"] == len(titles)


def test_cli_popular_list_run(spark, tmp_out):
    page = os.path.join(tmp_out, "popular.html")
    with open(page, "w", encoding="utf-8") as f:
        f.write('<a href="./Alpha">Alpha page</a><a href="./Beta_%C3%A9">Beta</a><a href="./Talk:X">t</a>'
                '<a href="./Gamma">Gamma</a>')
    lst = os.path.join(tmp_out, "list")
    done = cli.run(cli.parse_args(["--pages", page, "--save-popular-list", lst, "--limit", "2"]), spark)
    assert done == {"saved_list": lst}
    args = cli.parse_args(["--pages", page, "--use-popular-articles", lst, "--limit", "0"])
    rows = cli.articles_for_run(spark, args).orderBy("article_pos").collect()
    assert [r.title for r in rows] == ["Alpha", "Beta_é"]
