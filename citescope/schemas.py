"""Explicit schemas. Nothing in the engine infers a schema."""

from pyspark.sql import types as T

# Report: fixed 8-column layout (7 strings and one boolean), in this order.
REPORT_COLUMNS = [
    "article_title",
    "original_url",
    "archive_url",
    "has_archive",
    "error_code",
    "timestamp",
    "browser_validation_check",
    "browser_validation_check_detail",
]

REPORT_SCHEMA = T.StructType([
    T.StructField("article_title", T.StringType()),
    T.StructField("original_url", T.StringType()),
    T.StructField("archive_url", T.StringType()),
    T.StructField("has_archive", T.BooleanType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("browser_validation_check", T.StringType()),
    T.StructField("browser_validation_check_detail", T.StringType()),
])

# One daily page-view document: only items[0].articles is read.
PAGEVIEW_ARTICLE = T.StructType([
    T.StructField("article", T.StringType()),
    T.StructField("rank", T.LongType()),
    T.StructField("views", T.LongType()),
])
PAGEVIEW_DOC_SCHEMA = T.StructType([
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("articles", T.ArrayType(PAGEVIEW_ARTICLE)),
    ]))),
])

# Popular-article record written by the popular-list extractor.
POPULAR_RECORD_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("display_text", T.StringType()),
    T.StructField("url", T.StringType()),
])

# Recorded HTTP evidence (replaces live HEAD/GET requests); the last row of a URL counts.
PROBE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("dns_ok", T.BooleanType()),
    T.StructField("head_status", T.IntegerType()),
    T.StructField("head_headers", T.StringType()),
    T.StructField("head_failed", T.BooleanType()),
    T.StructField("get_status", T.IntegerType()),
    T.StructField("get_headers", T.StringType()),
    T.StructField("get_failed", T.BooleanType()),
    T.StructField("observed_at", T.LongType()),
])

# Recorded browser evidence (replaces browser automation); the last row of a URL counts.
BROWSER_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("failure_kind", T.StringType()),
    T.StructField("failure_message", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("page_title", T.StringType()),
    T.StructField("page_source", T.StringType()),
    T.StructField("observed_at", T.LongType()),
])

# Flat facts of one page's markup. Elements are numbered in document order from 0, the document.
MARKUP = T.StructType([
    T.StructField("parent", T.ArrayType(T.IntegerType())),      # -1: none
    T.StructField("last", T.ArrayType(T.IntegerType())),        # last descendant, or itself
    T.StructField("previous", T.ArrayType(T.IntegerType())),    # sibling before, -1: none
    T.StructField("seen", T.ArrayType(T.IntegerType())),        # links up to the element
    T.StructField("key", T.ArrayType(T.LongType())),            # digest of the markup
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("at", T.IntegerType()),
        T.StructField("href", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("id", T.StringType()),
        T.StructField("in_ref", T.BooleanType()),
    ]))),
    T.StructField("refs", T.ArrayType(T.StructType([
        T.StructField("at", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]))),
    T.StructField("headings", T.ArrayType(T.StructType([
        T.StructField("at", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]))),
])
