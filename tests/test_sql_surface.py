"""SQL functions and table functions registered by ``register_sql``."""

from citescope.plans.sql_surface import register_pages, register_sql


def test_sql_functions(spark):
    register_sql(spark)
    r = spark.sql("""SELECT cs_normalize_url('https://www.bbc.co.uk/x') n,
                            cs_url_equivalent('https://e.com/a', 'http://e.com/a/') e,
                            cs_archive_original('https://archive.today/2020/http://e.com') o,
                            cs_is_archive('https://myarchive.org') a,
                            cs_format_duration(0.35D) d,
                            cs_clean_title('A__b') t""").first()
    assert (r.n, r.e, r.o, r.a, r.d, r.t) == ("bbc.com/x", True, "2020/http://e.com", True, "0.3s", "A b")


def test_page_views(spark):
    register_sql(spark)
    html = ('<ol class="references"><li><a href="https://e.com">o</a> '
            '<a href="https://web.archive.org/web/1/https://e.com">a</a></li></ol><ref><a href="/x">x</a></ref>')
    register_pages(spark, spark.createDataFrame([(1, html)], "page long, html string"), key="page")
    rows = spark.sql("SELECT ref_kind, href FROM reference_links ORDER BY ref_pos, link_pos").collect()
    assert [(r.ref_kind, r.href) for r in rows] == [
        ("list", "https://e.com"), ("list", "https://web.archive.org/web/1/https://e.com"), ("ref", "/x")]
    assert spark.sql("SELECT count(*) FROM page_links WHERE in_ref AND id IS NULL").first()[0] == 1


def test_scan_in_sql(spark):
    register_sql(spark)
    html = '<ol class="references"><li><a href="https://e.com">o</a></li></ol><p><a href="/x">x</a></p>'
    spark.createDataFrame([(html,)], "html string").createOrReplaceTempView("t_pages2")
    r = spark.sql("SELECT size(m.refs) n_refs, size(m.links) n_anchors "
                  "FROM (SELECT cs_scan(html) m FROM t_pages2)").first()
    assert (r.n_refs, r.n_anchors) == (1, 2)


def test_table_functions_over_any_column(spark):
    register_sql(spark)
    html = ('<ol class="references"><li><a href="https://e.com">o</a></li><li><a class="p q" id="i" href="/y">y</a>'
            '<a href="https://web.archive.org/web/1/x">a</a></li></ol><ref><a href="/x">x</a></ref>')
    spark.createDataFrame([(1, html), (2, "<p>n</p>"), (3, None), (4, html)],
                          "k int, body string").createOrReplaceTempView("any_table")
    df = spark.sql("SELECT a.k, t.* FROM any_table a, LATERAL reference_links(a.body) t")
    rows = sorted(map(tuple, df.where("k = 1").collect()))
    assert rows == [(1, 0, "list", 0, "https://e.com"), (1, 1, "list", 0, "/y"),
                    (1, 1, "list", 1, "https://web.archive.org/web/1/x"), (1, 2, "ref", 0, "/x")]
    assert df.count() == 8
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    links = spark.sql("SELECT t.* FROM any_table, LATERAL page_links(body) t WHERE k = 4").collect()
    assert [(r.link_pos, r.href, r.in_ref) for r in links] == [
        (0, "https://e.com", False), (1, "/y", False), (2, "https://web.archive.org/web/1/x", False), (3, "/x", True)]
    assert (links[1].classes, links[1].id) == (["p", "q"], "i")
