"""D1 by addresses: content is read once, for the pages that count, and never exchanged."""

import random
import re

import pytest

from citescope.sources import pages as PG

LONG = "x" * 120


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_with_html(df):
    return [s for s in re.findall(r"ReadSchema: struct<[^>]*", plan(df)) if "html:" in s]


def exchanges_html(df):
    """Whether a shuffle lies between a scan of content and the root of the plan."""
    text = plan(df).split("== Initial Plan ==")[0]
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "ReadSchema" in line and "html:" in line:
            depth = len(re.match(r"[ :+|-]*", line)[0])
            for above in reversed(lines[:i]):
                d = len(re.match(r"[ :+|-]*", above)[0])
                if d < depth:
                    depth = d
                    if "Exchange" in above and "Broadcast" not in above:
                        return True
    return False


@pytest.fixture
def crawl(spark, tmp_path):
    """Pages in several files: repeated titles, ties of place, short and missing content."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        title = rng.choice([f"T{rng.randrange(300)}", f"T{rng.randrange(300)}", None])
        html = rng.choice([f"<p>{i}</p>{LONG}", f"<p>{i}</p>{LONG}", f"<p>{i}</p>", None])
        rows.append((title, html, rng.choice([None, rng.randrange(50)])))
    df = spark.createDataFrame(rows, "title string, html string, ingest_pos long").repartition(7)
    return rows, PG.save_page_files(df, f"{tmp_path}/crawl")


def last(rows, enough):
    """title -> the contents that may stand for it (one of those of the last place)."""
    best = {}
    for title, html, place in rows:
        if enough and not (html and len(html) > 100):
            continue
        place = -(1 << 63) if place is None else place
        if title not in best or best[title][0] < place:
            best[title] = (place, {html})
        elif best[title][0] == place:
            best[title][1].add(html)
    return {t: h for t, (_, h) in best.items()}


@pytest.mark.parametrize("limit", [PG.BROADCAST_BYTES, 600, 1])
def test_last_page_of_every_title(crawl, monkeypatch, limit):
    rows, pages = crawl
    monkeypatch.setattr(PG._read_at, "__defaults__", (False, limit))
    got = PG.unique_pages(pages)
    want = last(rows, enough=False)
    found = got.collect()
    assert sorted(str(r.title) for r in found) == sorted(map(str, want))
    assert all(r.html in want[r.title] for r in found)
    if limit > 1:  # else the addresses of one file are too many to broadcast
        assert not exchanges_html(got)


@pytest.mark.parametrize("limit", [PG.BROADCAST_BYTES, 900])
def test_listed_titles_with_enough_content(spark, crawl, monkeypatch, limit):
    rows, pages = crawl
    monkeypatch.setattr(PG._read_at, "__defaults__", (False, limit))
    titles = [f"T{i}" for i in range(0, 400, 3)] + ["T3", "T6", "T6"]
    arts = spark.createDataFrame(list(enumerate(titles)), "article_pos long, title string")
    want = last(rows, enough=True)
    listed = PG.listed_pages(arts, pages)
    assert sorted(r.title for r in listed.collect()) == sorted({t for t in titles if t in want})
    with_html = PG.articles_with_html(arts, pages)
    got = {r.article_pos: r for r in with_html.collect()}
    assert sorted(got) == [i for i, t in enumerate(titles) if t in want]
    assert all(r.title == titles[i] and r.html in want[r.title] for i, r in got.items())
    chars = PG.articles_with_html_chars(arts, pages)
    assert {r.article_pos: r.html_chars for r in chars.collect()} == {
        i: len(r.html) for i, r in got.items()}
    for df in (listed, with_html):
        assert not exchanges_html(df)
    assert not scans_with_html(chars)


def files_with_html_read(df):
    """Per scan of content the number of files it read (after the plan has run)."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        elif "Scan parquet" in name and "html:" in node.toString().split("ReadSchema")[-1]:
            found.append(node.metrics().get("numFiles").get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_ranges_of_files_read_every_file_once(spark, crawl, monkeypatch):
    rows, pages = crawl
    n_files = pages.select("_metadata.file_path").distinct().count()
    one = PG.unique_pages(pages)
    one.collect()
    assert files_with_html_read(one) == [n_files]
    monkeypatch.setattr(PG._read_at, "__defaults__", (False, 600))
    many = PG.unique_pages(pages)
    many.collect()
    assert len(files_with_html_read(many)) > 1 and sum(files_with_html_read(many)) == n_files


def test_pages_that_are_no_files_are_written_first(spark):
    pages = spark.createDataFrame([("A", LONG + "1", 1), ("A", LONG + "2", 2), ("B", "short", 1)],
                                  "title string, html string, ingest_pos long")
    arts = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "article_pos long, title string")
    assert [tuple(r) for r in PG.listed_pages(arts, pages).collect()] == [("A", LONG + "2")]
    empty = pages.limit(0)
    assert PG.articles_with_html(arts, empty).collect() == []


def test_audit_scans_content_once(spark):
    import __spark_entry__ as E
    from citescope.plans import catalog

    catalog.forget_plans()
    df = E.queries()["report_rows"](spark, "/root/testdata/sf0.001")
    assert len(scans_with_html(df)) == 1 and not exchanges_html(df)
