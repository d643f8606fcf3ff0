"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; the edges are written to the shared folder after
each round, which cuts the lineage and survives lost executors. The number of rounds grows
with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.session import scratch_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.least("a", "m").alias("a"), "b").where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges hold a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return (joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
            .union(least.select(F.col("m").alias("a"), "b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of ``edges`` (a, b)."""
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        path = scratch_path(spark, "edges")
        df.write.parquet(path)
        table = spark.read.schema("a long, b long").parquet(path)
        mark = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return table, tuple(mark)

    table, mark = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                          .where("a <> b").distinct())
    while mark[0]:
        before = mark
        table, mark = written(_small_star(_large_star(table)))
        if mark == before:
            break
    # At rest every node points at its component's smallest node.
    return (table.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .union(table.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
