"""Sources and sinks: saved lists, page-view documents, report CSV round trip."""

import json
import os

from pyspark.sql import functions as F

from citescope.operators import popularity as POP
from citescope.schemas import REPORT_SCHEMA
from citescope.sources import article_lists as AL
from citescope.sources import pages as PG
from citescope.sources import pageviews as PV
from citescope.sources import report_io as RIO


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_article_list_reader(spark, tmp_out):
    p = write(os.path.join(tmp_out, "list.json"),
              json.dumps([{"title": "A_b"}, "B", 3, {"x": 1}, {"title": "Ünï"}, "A_b"]))
    rows = AL.read_article_list(spark, p).orderBy("article_pos").collect()
    assert [(r.article_pos, r.title) for r in rows] == [(0, "A_b"), (1, "B"), (2, "Ünï"), (3, "A_b")]
    assert [r.title for r in AL.read_article_list(spark, p, limit=2).orderBy("article_pos").collect()] == ["A_b", "B"]


def test_article_list_reader_rejects_non_lists(spark, tmp_out):
    d = os.path.join(tmp_out, "bad")
    os.makedirs(d)
    write(os.path.join(d, "obj.json"), json.dumps({"title": "x"}))
    write(os.path.join(d, "broken.json"), "[{")
    assert AL.read_article_list(spark, d).count() == 0


def test_popular_records_round_trip(spark, tmp_out):
    recs = spark.createDataFrame([("Café", "Café au lait", "https://en.wikipedia.org/wiki/Café")],
                                 "title string, display_text string, url string")
    p = os.path.join(tmp_out, "pop")
    AL.write_popular_records(recs, p)
    assert AL.read_popular_records(spark, p).collect()[0].title == "Café"


def test_pageview_documents(spark, tmp_out):
    docs = os.path.join(tmp_out, "pv")
    os.makedirs(os.path.join(docs, "view_day=2024-01-01"))
    write(os.path.join(docs, "view_day=2024-01-01", "d.json"), json.dumps({"items": [{"articles": [
        {"article": "Main_Page", "rank": 1, "views": 100},
        {"article": "Special:Search", "rank": 2, "views": 90},
        {"rank": 3, "views": 80},
        {"article": "X", "views": 70},
        {"article": "Y", "rank": 5}]}]}))
    os.makedirs(os.path.join(docs, "view_day=2024-01-02"))
    write(os.path.join(docs, "view_day=2024-01-02", "d.json"), "not json")
    pv = PV.read_pageview_docs(spark, docs)
    top = POP.daily_top(pv, "2024-01-01", limit=2).collect()
    assert [(r.top_pos, r.article) for r in top] == [(1, ""), (2, "X")]   # absent title kept as ''
    d = POP.with_defaults(pv).where(F.col("article") == "X").first()
    assert (d.rank, d.views) == (1000, 70)
    assert POP.daily_top(pv, "2024-01-01", limit=0).count() == 0


def test_popular_scored_ties_and_weights(spark):
    rows = [("2024-01-01", 1, "A", 1, 100), ("2024-01-01", 2, "B", 4, 200), ("2024-01-02", 1, "B", 1, 10),
            ("2024-01-02", 2, "Main_Page", 2, 10 ** 6), ("2024-01-02", 3, "Z", 0, 5)]
    pv = spark.createDataFrame(rows, "view_day string, pos int, article string, rank long, views long") \
        .withColumn("view_day", F.to_date("view_day"))
    got = POP.popular_scored(pv, limit=5).collect()
    # A: 100/1 * 1.1 = 110 ; B: (200/2 + 10/1) * 1.2 = 132 ; Z has rank 0 and is dropped
    assert [(r.title, r.score, r.appearances, r.total_views) for r in got] == [
        ("B", 132.0, 2, 210), ("A", 110.0, 1, 100)]


def test_report_csv_round_trip(spark, tmp_out):
    p = os.path.join(tmp_out, "report")
    RIO.write_header_only(spark, p)
    assert RIO.read_report(spark, p).count() == 0
    rows = [("T", "https://e.com", None, False, "404", "20240101_000000", "dead", ""),
            ("T", "https://f.com", "https://web.archive.org/web/1/https://f.com", True, "None",
             "20240101_000000", "Browser validation not performed.", "")]
    RIO.append_report(spark.createDataFrame(rows, REPORT_SCHEMA), p, "S", 0)
    for _ in range(2):  # a batch that is written again counts once
        RIO.append_report(spark.createDataFrame(rows[:1], REPORT_SCHEMA), p, "S", 1)
    back = RIO.read_report(spark, p).orderBy("original_url").collect()
    assert len(back) == 3
    assert back[0].archive_url is None and back[0].browser_validation_check_detail == ""
    assert back[2].has_archive is True


def test_html_files_and_report_naming(spark, tmp_out):
    d = os.path.join(tmp_out, "html")
    os.makedirs(d)
    write(os.path.join(d, "Python_(language).html"), "<html>" + "x" * 150 + "</html>")
    pages = __import__("citescope.sources.pages", fromlist=["x"])
    df = pages.read_html_files(spark, d)
    r = df.first()
    assert r.title == "Python_(language)" and len(r.html) == 163
    assert RIO.report_path("out", "20240101_000000", 7) == "out/all_references_batch_007_20240101_000000.csv"
    rep = spark.createDataFrame([], REPORT_SCHEMA)
    p = RIO.write_full_report(rep, tmp_out, "20240101_000000")
    assert p.endswith("all_references_20240101_000000.csv") and RIO.read_report(spark, p).count() == 0


def test_run_audit_from_ranking(spark):
    from citescope.plans.audit import run_audit
    from citescope.schemas import BROWSER_SCHEMA, PROBE_SCHEMA
    pv = spark.createDataFrame([("2024-01-01", 1, "Alpha_page", 1, 500), ("2024-01-01", 2, "Beta", 2, 100)],
                               "view_day string, pos int, article string, rank long, views long") \
        .withColumn("view_day", F.to_date("view_day"))
    html = '<ol class="references"><li><a href="https://dead.example/">d</a></li></ol>' + " " * 100
    pages = spark.createDataFrame([("Alpha_page", html), ("Beta", html)], "title string, html string")
    probes = spark.createDataFrame([("https://dead.example/", True, 410, "", False, None, "", False, 1)], PROBE_SCHEMA)
    res = run_audit(pv, pages, probes, spark.createDataFrame([], BROWSER_SCHEMA), limit=1)
    rows = res.report.collect()
    assert [(r.article_title, r.error_code, r.browser_validation_check) for r in rows] == [("Alpha page", "410", "dead")]
    plan = res.report._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan


def test_sampled_days_prune_partitions(spark, tmp_out):
    import datetime as dt
    docs = os.path.join(tmp_out, "pv2")
    for day in ("2024-01-01", "2024-01-02"):
        os.makedirs(os.path.join(docs, f"view_day={day}"))
        write(os.path.join(docs, f"view_day={day}", "d.json"),
              json.dumps({"items": [{"articles": [{"article": "A", "rank": 1, "views": 3}]}]}))
    pv = PV.read_pageview_docs(spark, docs)
    df = POP.sampled_days(pv, days=[dt.date(2024, 1, 1)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(view_day" in plan and "2024-01-01" in plan.split("PartitionFilters")[1]
    assert [r.view_day.isoformat() for r in df.collect()] == ["2024-01-01"]


def test_articles_with_html_dedupes_after_semi_join(spark):
    from citescope.sources.pages import articles_with_html
    pages = spark.createDataFrame([("A", "<p>old</p>" + "x" * 100, 1), ("A", "<p>new</p>" + "x" * 100, 2),
                                   ("B", "<p>b</p>" + "x" * 100, 1), ("C", "short", 1)],
                                  "title string, html string, ingest_pos int")
    arts = spark.createDataFrame([(0, "A"), (1, "A"), (2, "C")], "article_pos long, title string")
    got = articles_with_html(arts, pages).orderBy("article_pos").collect()
    assert [(r.article_pos, r.html[:10]) for r in got] == [(0, "<p>new</p>"), (1, "<p>new</p>")]


def test_popular_records_array_round_trip(spark, tmp_out):
    from citescope.operators.popular_links import article_links_json
    html = '<a href="./Alpha">Alpha page</a><a href="./Beta_%C3%A9">Beta</a><a href="./Talk:X">t</a>'
    arr = article_links_json(spark.createDataFrame([(7, html)], "page_id long, html string")).first().json
    p = write(os.path.join(tmp_out, "popular_articles.json"), arr)
    back = AL.read_article_list(spark, p).orderBy("article_pos").collect()
    assert [r.title for r in back] == ["Alpha", "Beta_é"]
    assert json.loads(arr)[0] == {"title": "Alpha", "display_text": "Alpha page",
                                  "url": "https://en.wikipedia.org/wiki/Alpha"}


def test_saved_lists_as_lines_and_popular_records(spark, tmp_out):
    rows = [(7, '[{"title": "A\\u00e9"}, "B", 3, {"title": null}, {"x": 1}]'), (8, "[]"), (9, "{}"), (10, "no")]
    path = os.path.join(tmp_out, "lists")
    AL.write_lists(spark.createDataFrame(rows, "page_id long, value string"), path, key="page_id")
    back = AL.read_lists(spark, path, key="page_id", key_type="long").orderBy("article_pos").collect()
    assert [(r.page_id, r.article_pos, r.title) for r in back] == [(7, 0, "A\u00e9"), (7, 1, "B")]
    assert [r.title for r in AL.read_lists(spark, path, "page_id", limit=1).collect()] == ["A\u00e9"]
    records = spark.createDataFrame([(2, "Zé", "z", "u2"), (1, "A", "a", "u1")],
                                    "pos int, title string, display_text string, url string")
    out = os.path.join(tmp_out, "popular")
    AL.write_popular_records(records.repartition(2), out, order=["pos"])
    assert [r.title for r in AL.read_article_list(spark, out).orderBy("article_pos").collect()] == ["A", "Zé"]
    assert [r.url for r in AL.read_popular_records(spark, out).orderBy("url").collect()] == ["u1", "u2"]


def test_unique_pages_without_a_place_and_with_ties(spark):
    from citescope.sources.pages import unique_pages
    rows = [("A", "x"), ("A", "x"), ("B", "y"), ("B", "z"), ("C", None)]
    got = unique_pages(spark.createDataFrame(rows, "title string, html string")).collect()
    assert sorted(r.title for r in got) == ["A", "B", "C"]
    again = unique_pages(spark.createDataFrame(rows[::-1], "title string, html string").repartition(3))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)
    empty = spark.createDataFrame([], "title string, html string, ingest_pos long")
    assert unique_pages(empty).collect() == []


def test_files_are_read_whole(spark, tmp_out):
    page = write(os.path.join(tmp_out, "Two_lines.html"), "<p>one</p>\n<p>two</p>\n")
    assert [(r.title, r.html) for r in PG.read_html_files(spark, page).collect()] == [
        ("Two_lines", "<p>one</p>\n<p>two</p>\n")]
    lst = write(os.path.join(tmp_out, "list.json"), json.dumps(["A", {"title": "B"}], indent=2))
    assert [r.title for r in AL.read_article_list(spark, lst).orderBy("article_pos").collect()] == ["A", "B"]
