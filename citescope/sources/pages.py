"""Article HTML sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.operators.joins import BROADCAST_BYTES
from citescope.session import scratch_path

MIN_CONTENT_CHARS = 100   # fixed value: HTML is kept only when longer than this


def read_html_files(spark, path: str, title_from: str = "file") -> DataFrame:
    """A4: one page per file (``title`` = file name without extension), read whole."""
    df = spark.read.text(path, wholetext=True).withColumn("_path", F.input_file_name())
    return df.select(F.regexp_extract("_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"),
                     F.col("value").alias("html"))


def read_pages(spark, path: str) -> DataFrame:
    """Parquet pages. The scan's splits set the parallelism of the per-document work that
    follows: ``spark.sql.files.maxPartitionBytes`` against the row groups of the files."""
    return spark.read.parquet(path)


def save_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """Stores pages bucketed and sorted by title, for joins of their own by title."""
    pages.write.mode("overwrite").bucketBy(buckets, "title").sortBy("title").saveAsTable(table)


def min_content(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML present and longer than 100 characters."""
    return pages.where(F.col(html).isNotNull() & (F.length(html) > MIN_CONTENT_CHARS))


# ---- late HTML: content is read once, at the addresses of the pages that count ------------------
#
# A page's address is its file and its row there, from the scan's own metadata. Which pages count
# is decided on narrow rows (title, place, length, address). Their addresses, 64 rows of a file to
# a bit set, then meet the one scan that reads content: always as a broadcast side of checked
# size, so content is never exchanged. Beyond that size the addresses are cut at file boundaries
# into ranges of files; each range is a scan of its own files, and every file is still read once.

_BITS = 64
_ADDRESS = ["_file", "_row"]


def save_page_files(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages as Parquet with the length of their HTML (``html_chars``), so that what
    counts (B3, A5) is decided without reading content, and returns them read back."""
    pages.withColumn("html_chars", F.length("html")).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def _addressed(pages: DataFrame) -> DataFrame:
    """Pages with their addresses; pages that are no Parquet scan are written as files first."""
    def with_address(p: DataFrame) -> DataFrame:
        return p.select("*", F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.row_index").alias("_row"))

    hidden = pages._jdf.queryExecution().analyzed().metadataOutput()
    hidden = [hidden.apply(i) for i in range(hidden.size())]
    if any(c.name() == "_metadata" and "row_index" in c.dataType().simpleString() for c in hidden):
        return with_address(pages)
    return with_address(save_page_files(pages, scratch_path(pages.sparkSession, "pages")))


def _index(addressed: DataFrame, enough: bool, key: tuple[str, ...] = ("title",)) -> DataFrame:
    """Title, place, length and address of every page: narrow, without content where the files
    hold its length. Without a place pages are told apart by a hash of what they hold."""
    columns = addressed.columns
    rest = [c for c in columns if c not in (*key, "ingest_pos", "html_chars", *_ADDRESS)]
    mark = F.col("ingest_pos").cast("long") if "ingest_pos" in columns else F.xxhash64(*rest)
    chars = F.col("html_chars") if "html_chars" in columns else F.length("html")
    narrow = addressed.select(*key, F.coalesce(mark, F.lit(-(1 << 63))).alias("_mark"),
                              *([chars.alias("html_chars")] if "html" in columns else []), *_ADDRESS)
    return narrow.where(F.col("html_chars") > MIN_CONTENT_CHARS) if enough else narrow


def _last(index: DataFrame, key: tuple[str, ...] = ("title",)) -> DataFrame:
    """A5: the last page of every title; of rows with one place, one. A null title is a title."""
    newest = F.max(F.struct("_mark", *_ADDRESS, *[c for c in index.columns if c == "html_chars"]))
    return index.groupBy(*key).agg(newest.alias("p")).select(*key, "p.*")


def _read_at(addressed: DataFrame, chosen: DataFrame, columns: list[str],
             occurrences: bool = False, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``columns`` of the pages at ``chosen`` addresses, by one scan of content. With
    ``occurrences`` a page comes once for every ``article_pos`` chosen with its address."""
    spark = addressed.sparkSession
    word, bit = F.expr(f"_row div {_BITS}").alias("_word"), F.expr(f"cast(_row % {_BITS} as int)")
    places = [F.collect_list(F.struct(bit.alias("bit"), "article_pos")).alias("_places")]
    path = scratch_path(spark, "page-addresses")
    (chosen.groupBy("_file", word)
     .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_set"),
          *(places if occurrences else [])).write.parquet(path))
    words = spark.read.parquet(path)
    size = F.octet_length("_file") + 24
    if occurrences:
        size = size + 16 * F.size("_places")
    total = words.agg(F.coalesce(F.sum(size), F.lit(0))).head()[0]
    ranges = [(None, None, total)]
    if total > limit:
        ranges = [(r.first, r.last, r.bytes) for r in words.repartitionByRange(
            2 * total // limit + 1, "_file").groupBy(F.spark_partition_id()).agg(
                F.min("_file").alias("first"), F.max("_file").alias("last"),
                F.sum(size).alias("bytes")).collect()]  # one row a range of files
    found = None
    for first, last, held in ranges:
        side, content = words, addressed
        if first is not None:
            side = words.where(F.col("_file").between(first, last))
            content = addressed.where(F.col("_file").between(first, last))
        # One file whose addresses alone are beyond the limit is left to a shuffle join.
        side = F.broadcast(side) if held <= limit or first != last else side
        content = content.select(*columns, *_ADDRESS, F.expr(f"_row div {_BITS}").alias("_word"))
        part = (content.join(side, ["_file", "_word"])
                .where(F.call_function("getbit", F.col("_set"), bit) == 1))
        if occurrences:
            mine = F.filter("_places", lambda x: x["bit"] == bit)
            part = part.select(*columns, F.explode(mine).alias("_p")).select(
                *columns, "_p.article_pos")
        part = part.select(*columns, *(["article_pos"] if occurrences else []))
        found = part if found is None else found.unionByName(part)
    return found


def unique_pages(pages: DataFrame, key: tuple[str, ...] = ("title",), enough: bool = False) -> DataFrame:
    """A5: one page per ``key``, the last by ``ingest_pos``; rows of one key and place are one
    page. Without that column the page whose content hash is largest, the same on every run.
    ``enough``: of those with enough content (B3)."""
    columns = [c for c in pages.columns if c != "html_chars" and (c != "ingest_pos" or enough)]
    addressed = _addressed(pages)
    return _read_at(addressed, _last(_index(addressed, enough, key), key),
                    [*key, *(c for c in columns if c not in key)])


def listed_pages(articles: DataFrame, pages: DataFrame, columns=("html",)) -> DataFrame:
    """D1 + B3 + A5: the last page of every listed title that has enough content."""
    addressed = _addressed(pages)
    titles = articles.select("title").distinct()
    listed = _index(addressed, enough=True).join(titles, "title", "left_semi")
    return _read_at(addressed, _last(listed), ["title", *columns])


def articles_with_html(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """D1 + B7: article occurrences that have HTML (inner join; repeated titles kept)."""
    addressed = _addressed(pages)
    chosen = articles.select("article_pos", "title").join(
        _last(_index(addressed, enough=True)), "title")
    return _read_at(addressed, chosen, ["title", "html"], occurrences=True).select(
        "title", "article_pos", "html")


def articles_with_html_chars(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """D1 + B7 with the length of the HTML alone."""
    last = _last(_index(_addressed(pages), enough=True)).select("title", "html_chars")
    return articles.join(last, "title", "inner")


def article_counts(articles: DataFrame, processed: DataFrame) -> DataFrame:
    """Articles found, distinct titles, articles processed (had HTML)."""
    n_processed = processed.select(F.count("*")).scalar()
    return (articles.agg(F.count("*").alias("articles_found"),
                         F.count_distinct("title").alias("unique_titles"))
            .select("*", n_processed.alias("articles_processed")))
