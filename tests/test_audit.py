"""Full audit on hand-made inputs and the stream = batch property."""

from pyspark.sql import functions as F

from citescope.plans.audit import audit
from citescope.schemas import BROWSER_SCHEMA, PROBE_SCHEMA
from citescope.sources.pages import unique_pages
from citescope.streaming.incremental import incremental_audit_from

WA = "https://web.archive.org/web/1/"


def inputs(spark):
    html1 = ('<ol class="references"><li><a href="https://a.com/x">a</a></li>'
             f'<li><a href="https://a.com/x">a</a> <a href="{WA}https://a.com/x">w</a></li>'
             '<li><a href="https://d.com/">d</a></li><li><a href="https://c.com/">c</a></li></ol>')
    html2 = '<ol class="references"><li><a href="https://d.com/">d</a></li></ol>' + "x" * 120
    old = '<ol class="references"><li><a href="https://old.com/">o</a></li></ol>' + "x" * 120
    pages = spark.createDataFrame([("Art_1", html1, 3), ("Art_1", old, 1), ("Art_2", html2, 1),
                                   ("Art_2", html2, 0), ("Short", "<p>tiny</p>", 1)],
                                  "title string, html string, ingest_pos long")
    arts = spark.createDataFrame([(0, "Art_1"), (1, "Art_2"), (2, "Art_2"), (3, "Short"), (4, "Missing")],
                                 "article_pos long, title string")
    probes = spark.createDataFrame([
        ("https://d.com/", True, 404, "", False, 404, "", False, 2),
        ("https://d.com/", True, 200, "", False, None, "", False, 1),           # an older probe
        ("https://c.com/", True, None, "", True, None, "", True, None)], PROBE_SCHEMA)
    browser = spark.createDataFrame([("https://d.com/", None, None, "https://d.com/", "Fine", "ok", 1),
                                     ("https://d.com/", None, None, "https://d.com/", "Gone", "410 gone", 2)],
                                    BROWSER_SCHEMA)
    return arts, pages, probes, browser


def test_report_rows(spark):
    arts, pages, probes, browser = inputs(spark)
    rep = audit(arts, pages, probes, browser, stamp="S").report
    got = sorted((r.article_pos, r.original_url, r.archive_url, r.has_archive, r.error_code,
                  r.browser_validation_check, r.browser_validation_check_detail) for r in rep.collect())
    arch = f"{WA}https://a.com/x"
    assert got == [
        (0, "https://a.com/x", arch, True, "None", "Browser validation not performed.", ""),  # later ref's archive
        (0, "https://a.com/x", arch, True, "None", "Browser validation not performed.", ""),
        (0, "https://c.com/", None, False, "ERROR", "connection_error", ""),
        (0, "https://d.com/", None, False, "404", "dead", "Error: 410 gone; Title: Gone"),
        (1, "https://d.com/", None, False, "404", "dead", "Error: 410 gone; Title: Gone"),   # repeated title kept
        (2, "https://d.com/", None, False, "404", "dead", "Error: 410 gone; Title: Gone"),
    ]
    assert {r.article_title for r in rep.collect()} == {"Art 1", "Art 2"}


def test_flat_modes(spark):
    arts, pages, probes, browser = inputs(spark)
    for mode in ("references", "all"):
        res = audit(arts, pages, probes, browser, mode=mode, stamp="S")
        rep = res.report.where(F.col("article_pos") == 0).collect()
        assert sorted((r.original_url, r.has_archive) for r in rep) == [
            ("https://a.com/x", True), ("https://c.com/", False), ("https://d.com/", False)]
        assert {r.status for r in res.results.collect()} == {"dead", "connection_error"}


def test_stream_equals_batch(spark):
    arts, pages, probes, browser = inputs(spark)
    pg = arts.join(unique_pages(pages), "title").select("article_pos", "title", "html")
    batch = audit(arts, pages, probes, browser, stamp="S").report
    streamed = incremental_audit_from(spark, pg, probes, browser, max_files_per_trigger=1, stamp="S").drop("batch_id")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.select(*streamed.columns).collect()))


def test_stream_goes_on_after_a_poisoned_file_and_keeps_last_copies(spark, tmp_path):
    from citescope.streaming.incremental import IncrementalAudit

    arts, pages, probes, browser = inputs(spark)
    pg = (arts.join(unique_pages(pages), "title").select("article_pos", "title", "html")
          .where(F.length("html") > 100))
    batch = audit(arts, pages, probes, browser, stamp="S").report
    n_articles = pg.count()
    stale = pg.withColumn("html", F.concat(F.lit("x" * 200), F.lit('<ol class="references"><li>'
                                           '<a href="https://stale.org/1">s</a></li></ol>')))
    arriving = str(tmp_path / "pages")

    def arrive(df, place, name):
        df.withColumn("ingest_pos", F.lit(place).cast("long")).coalesce(1).write.parquet(f"{arriving}/{name}")

    job = IncrementalAudit(spark, str(tmp_path / "out"), probes, browser, stamp="S")
    arrive(stale, 1, "w1")
    (tmp_path / "pages" / "w1" / "poison.parquet").write_bytes(b"no parquet at all")
    first = job.run(arriving, str(tmp_path / "check"), max_files_per_trigger=1)
    assert {r.original_url for r in first.collect()} == {"https://stale.org/1"}
    bad = job.quarantine().collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["poison.parquet"] and bad[0].bytes == 17 and bad[0].reason
    # A restart with the same checkpoint: newer copies, then older ones, which change nothing.
    arrive(pg, 3, "w2")
    job = IncrementalAudit(spark, str(tmp_path / "out"), probes, browser, stamp="S")
    job.run(arriving, str(tmp_path / "check"))
    arrive(stale, 2, "w3")
    rows = job.run(arriving, str(tmp_path / "check")).drop("batch_id")
    want = sorted(map(tuple, batch.select(*rows.columns).collect()))
    assert sorted(map(tuple, rows.collect())) == want and n_articles > 1
    # The poisoned file is mended: a replay reads it, and its newer copy counts.
    assert job.replay() == 1
    pg.limit(1).withColumn("ingest_pos", F.lit(9).cast("long")).coalesce(1).write.parquet(str(tmp_path / "mended"))
    assert job.replay({bad[0].path: str(tmp_path / "mended")}) == 0 and job.quarantine().count() == 0
    assert sorted(map(tuple, job.read_report().drop("batch_id").collect())) == want


def test_materialized_audit_parses_once(spark):
    arts, pages, probes, browser = inputs(spark)
    res = audit(arts, pages, probes, browser, stamp="S", materialize=True)
    for df in (res.report, res.results, res.validated):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    plain = audit(arts, pages, probes, browser, stamp="S")
    assert sorted(map(tuple, res.report.collect())) == sorted(map(tuple, plain.report.collect()))


def test_audit_plan_parses_once_without_window(spark):
    arts, pages, probes, browser = inputs(spark)
    for mode in ("structure", "references", "all"):
        plan = audit(arts, pages, probes, browser, mode=mode, stamp="S").report._jdf.queryExecution() \
            .executedPlan().toString()
        # the scan of the markup once; then only the matching of links
        assert plan.count("ArrowEvalPython [_scan_pages(") == 1, mode
        assert plan.count("ArrowEvalPython") == {"structure": 2, "references": 3, "all": 2}[mode], mode
        lines = plan.split("\n")
        for above, below in zip(lines, lines[1:]):   # neither HTML nor page sources are exchanged
            if "Exchange" in above and "Broadcast" not in above:
                assert "html#" not in below and "page_source" not in below, (mode, below)
        assert "Window " not in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_status_summary_per_article_sums_to_total(spark):
    from pyspark.sql import functions as F

    from citescope.operators.probes import STATUSES, status_summary
    arts, pages, probes, browser = inputs(spark)
    res = audit(arts, pages, probes, browser, stamp="S").results
    total = status_summary(res).first().asDict()
    per = status_summary(res, keys=("article_pos",)).agg(*[F.sum(c).alias(c) for c in ["total", *STATUSES]])
    assert {k: int(v) for k, v in per.first().asDict().items()} == total


def test_repeated_titles_are_parsed_once(spark):
    from pyspark.sql import functions as F
    arts, pages, probes, browser = inputs(spark)
    many = spark.range(60).select((F.col("id") + 100).alias("article_pos"), F.lit("Art_2").alias("title"))
    res = audit(arts.unionByName(many), pages, probes, browser, stamp="S")
    plan = res.report._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    py = next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x)
    cut = next(i for i, x in enumerate(lines) if "_row_index" in x or "getbit" in x)
    occ_join = next(i for i, x in enumerate(lines) if "Inner" in x and "Join" in x)
    assert occ_join < py < cut         # occurrences attached above the parse, pages cut below it
    assert res.report.where(F.col("article_pos") >= 100).count() == 60   # one row per occurrence
