"""Evidence tables (recorded HTTP probes, browser observations) stored for co-located joins.

The evidence is large, keyed by URL and reused by every audit run. Stored bucketed (and
sorted) by URL with as many buckets as the shuffle partitions of the audit, the URL-keyed
reduction to one narrow row per URL reads it bucket by bucket: headers and page sources are
never exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citescope.schemas import BROWSER_SCHEMA, PROBE_SCHEMA
from citescope.session import scratch_path


def save_evidence(df: DataFrame, table: str, buckets: int, key: str = "url") -> None:
    """Writes an evidence table bucketed and sorted by ``key`` into the session catalog."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def load_evidence(spark: SparkSession, name: str, kind: str = "probes") -> DataFrame:
    """A catalog table (bucketed) or a Parquet path, projected to the evidence schema."""
    schema = PROBE_SCHEMA if kind == "probes" else BROWSER_SCHEMA
    is_path = "/" in name or name.endswith(".parquet")
    df = spark.read.parquet(name) if is_path else spark.table(name)
    return df.select(*[F.col(f.name) if f.name in df.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


# ---- evidence of cited URLs alone ----------------------------------------------------------------
FILTER_BITS = 1 << 24   # of the set of wanted URLs: at most 2 ** 18 rows of 64 bits, four megabytes
_PLACE = "pmod(xxhash64({}), %d)" % FILTER_BITS


def wanted_urls(links: DataFrame, url_col: str) -> DataFrame:
    """The set of URLs that need evidence, as a hash filter of fixed size: one row for every 64
    places of which some are taken, however many URLs there are."""
    place = F.expr(_PLACE.format(url_col))
    path = scratch_path(links.sparkSession, "wanted-urls")
    (links.groupBy(F.expr(f"{_PLACE.format(url_col)} div 64").alias("_word"))
     .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("_set"))
     .write.parquet(path))
    return links.sparkSession.read.schema("_word long, _set long").parquet(path)


def prune_evidence(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """``evidence`` without rows whose URL is surely not wanted, dropped in the scan's own stage: the
    filter is a broadcast of fixed size. It keeps every wanted row, and few others."""
    bit = (F.expr(_PLACE.format("url")) % 64).cast("int")
    return (evidence.withColumn("_word", F.expr(f"{_PLACE.format('url')} div 64"))
            .join(F.broadcast(wanted), "_word")
            .where(F.call_function("getbit", F.col("_set"), bit) == 1)
            .select(*evidence.columns))
