"""Derived evidence tables built from the driver tables (``pages``, ``events``).

The driver tables hold no external or archive link, so the audit inputs are derived from them
by portable SQL: the same text runs in Spark SQL and in DuckDB (used by the oracle). Every
fixture is a pure function of the driver tables, so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citescope.session import scratch_path
from citescope.sources.pages import save_page_files

BASE_TABLES = ("pages", "events")

FX_REFS = """
SELECT page_id,
       CAST(floor(page_id / 10) AS BIGINT) AS article_pos,
       concat('Article__', CAST(CAST(floor(page_id / 10) AS BIGINT) AS VARCHAR(20)), '_x') AS title,
       page_id % 10 AS ref_pos,
       original_url,
       CASE page_id % 8
         WHEN 0 THEN concat('https://web.archive.org/web/20200101000000/', embedded_url)
         WHEN 1 THEN concat('https://ghostarchive.org/archive/20200101/', embedded_url)
         WHEN 2 THEN concat('https://archive.today/', embedded_url)
         WHEN 3 THEN concat('https://webcitation.org/abc123/', embedded_url)
         WHEN 4 THEN concat('https://archive.ph/Ab', CAST(page_id AS VARCHAR(20)))
         WHEN 5 THEN concat('https://web.archive.org/web/20200101im_/', embedded_url)
         ELSE NULL END AS archive_url
FROM (
  SELECT page_id, original_url,
         CASE page_id % 5
           WHEN 0 THEN original_url
           WHEN 1 THEN concat(original_url, '/')
           WHEN 2 THEN replace(original_url, '://', '://www.')
           WHEN 3 THEN CASE WHEN original_url LIKE 'https://%'
                            THEN replace(original_url, 'https://', 'http://')
                            ELSE replace(original_url, 'http://', 'https://') END
           ELSE concat(original_url, 'extra') END AS embedded_url
  FROM (SELECT page_id,
               CASE WHEN page_id % 7 = 0 THEN replace(url, '.example.com', '.example.co.uk')
                    ELSE url END AS original_url
        FROM pages) p0
) p1
"""

# Spark only: one HTML document per article with an ordered reference list, and for every third
# article an older copy that links elsewhere (the later ``ingest_pos`` counts).
FX_HTML = """
SELECT title, article_pos, 2 * article_pos + 1 AS ingest_pos,
       concat('<html><body><h2>References</h2><ol class="mw-references references">',
              listagg(concat('<li><cite><a href="', replace(original_url, '&', '&amp;'), '">o</a>',
                             CASE WHEN archive_url IS NULL THEN ''
                                  ELSE concat(' <a href="', replace(archive_url, '&', '&amp;'), '">a</a>') END,
                             '</cite><a href="#back">^</a></li>'), '')
                WITHIN GROUP (ORDER BY ref_pos),
              '</ol></body></html>') AS html
FROM fx_refs GROUP BY title, article_pos
UNION ALL
SELECT DISTINCT title, article_pos, 2 * article_pos AS ingest_pos,
       concat('<html><body><ol class="references"><li><a href="https://stale.example.org/',
              CAST(article_pos AS VARCHAR(20)), '">old</a></li></ol>', repeat('<p>old copy</p>', 10),
              '</body></html>') AS html
FROM fx_refs WHERE article_pos % 3 = 0
"""

FX_PAGEVIEWS = """
SELECT view_day, article, views,
       CAST(row_number() OVER (PARTITION BY view_day ORDER BY views DESC, article) AS BIGINT) AS rank
FROM (
  SELECT CAST(ts AS DATE) AS view_day,
         CASE WHEN event_type = 'error' AND user_id % 10 = 0
                THEN concat('Special:U', CAST(user_id AS VARCHAR(20)))
              WHEN user_id = 1 THEN 'Main_Page'
              ELSE concat('User_', CAST(user_id AS VARCHAR(20))) END AS article,
         count(*) AS views
  FROM events GROUP BY 1, 2
) d
"""

# Recorded evidence over time: three quarters of the URLs have an older probe, half an older
# observation, with other outcomes.
FX_PROBE = """
SELECT original_url AS url,
       page_id % 11 <> 9 AS dns_ok,
       CASE page_id % 11 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 403 WHEN 3 THEN 403
            WHEN 4 THEN 404 WHEN 5 THEN 404 WHEN 6 THEN 410 WHEN 7 THEN 503 ELSE NULL END AS head_status,
       CASE page_id % 11 WHEN 2 THEN 'Server: cloudflare' WHEN 3 THEN 'Server: nginx'
            ELSE 'Content-Type: text/html' END AS head_headers,
       page_id % 11 IN (8, 10) AS head_failed,
       CASE page_id % 11 WHEN 4 THEN 200 WHEN 5 THEN 404 WHEN 8 THEN 403 ELSE NULL END AS get_status,
       CASE page_id % 11 WHEN 8 THEN 'Strict-Transport-Security: max-age=1' ELSE '' END AS get_headers,
       page_id % 11 = 10 AS get_failed,
       2 * page_id + 1 AS observed_at
FROM fx_refs
UNION ALL
SELECT original_url, true, CASE page_id % 2 WHEN 0 THEN 200 ELSE 404 END, 'Server: old', false, NULL, '',
       false, 2 * page_id
FROM fx_refs WHERE page_id % 4 <> 1
"""

FX_BROWSER = """
SELECT original_url AS url,
       CASE page_id % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'webdriver' WHEN 2 THEN 'webdriver'
            WHEN 3 THEN 'other' ELSE NULL END AS failure_kind,
       CASE page_id % 9 WHEN 1 THEN 'unknown error: net::ERR_NAME_NOT_RESOLVED'
            WHEN 2 THEN 'chrome not reachable' WHEN 3 THEN 'boom' ELSE NULL END AS failure_message,
       CASE WHEN page_id % 2 = 0 THEN original_url ELSE concat(original_url, '#moved') END AS final_url,
       CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('Title ', CAST(page_id AS VARCHAR(20))) END AS page_title,
       CASE page_id % 9 WHEN 4 THEN 'Error: Access Denied / Title: Access Denied'
            WHEN 5 THEN 'Oops: Page Not Found (404 Not Found) captcha'
            WHEN 6 THEN 'Checking your browser before Cloudflare lets you in'
            WHEN 7 THEN 'access denied' ELSE 'plain body' END AS page_source,
       2 * page_id + 1 AS observed_at
FROM fx_refs
UNION ALL
SELECT original_url, CASE page_id % 4 WHEN 0 THEN 'timeout' ELSE NULL END, NULL, original_url, 'Old',
       'gateway: server not found', 2 * page_id
FROM fx_refs WHERE page_id % 2 = 0
"""

# Portable fixtures (Spark and DuckDB), in dependency order.
PORTABLE = {
    "fx_refs": FX_REFS,
    "fx_pageviews": FX_PAGEVIEWS,
    "fx_probe": FX_PROBE,
    "fx_browser": FX_BROWSER,
}


def cte(*names: str) -> str:
    """``WITH`` clause holding the named portable fixtures (plus their dependencies)."""
    needed = set(names)
    if needed & {"fx_probe", "fx_browser"}:
        needed.add("fx_refs")
    parts = [f"{n} AS ({PORTABLE[n]})" for n in PORTABLE if n in needed]
    # the last row of each URL, for the joins
    parts += [f"{n}_last AS (SELECT * FROM {n} QUALIFY row_number() OVER "
              "(PARTITION BY url ORDER BY observed_at DESC) = 1)"
              for n in ("fx_probe", "fx_browser") if n in needed]
    return "WITH " + ",\n".join(parts) + "\n"


_CACHE: dict = {}


def register(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Expose the driver tables and every fixture as temporary views of this session and
    return them as DataFrames. A DataFrame binds its plan when created, so the returned
    frames stay valid when another scale factor is registered later; they are reused for
    repeated calls with the same session and folder."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    hit = _CACHE.get(key)
    if hit is not None:
        return hit
    frames = {}
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in PORTABLE.items():
        spark.sql(sql).createOrReplaceTempView(name)
    spark.sql(FX_HTML).createOrReplaceTempView("fx_html")
    for name in (*BASE_TABLES, *PORTABLE, "fx_html"):
        frames[name] = spark.table(name)
    _CACHE.clear()
    _CACHE[key] = frames
    return frames


_FILES: dict = {}


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_html`` as page files, the form in which crawled pages arrive: written once per
    session and folder below the checkpoint folder."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _FILES:
        path = scratch_path(spark, "fx-html")
        save_page_files(register(spark, sf_dir)["fx_html"], path)
        _FILES[key] = path
    return spark.read.parquet(_FILES[key])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return html_files(spark, sf_dir) if name == "fx_html" else register(spark, sf_dir)[name]
