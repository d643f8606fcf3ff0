"""A hot URL (a third of all cited links) is split by the evidence join and stays correct."""

import os

import pytest
from pyspark.sql import functions as F

from citescope import fixtures as FX
from citescope.plans.audit import audit_pages

SF = "/root/testdata/sf0.01"
HOT = "https://hot.example.com/cited/everywhere"

# Thresholds scaled down to this test's size: the repeated hot URL compresses well, so its
# partition is only ~1.5x the median in shuffle bytes here (at cluster scale it is ~N/3 rows).
SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
}


def skewed_inputs(spark):
    fx = FX.register(spark, SF)
    refs = fx["fx_refs"].withColumn(
        "original_url", F.when(F.col("page_id") % 3 == 0, F.lit(HOT)).otherwise(F.col("original_url")))
    li = F.concat(F.lit('<li><cite><a href="'), F.col("original_url"), F.lit('">o</a></cite></li>'))
    pages = (refs.withColumn("li", li).groupBy("article_pos", "title")
             .agg(F.expr("listagg(li, '') WITHIN GROUP (ORDER BY ref_pos)").alias("l"))
             .select("article_pos", "title", F.concat(
                 F.lit('<ol class="references">'), F.col("l"), F.lit("</ol>" + " " * 100)).alias("html")))
    probes = fx["fx_probe"].unionByName(
        fx["fx_probe"].limit(1).withColumn("url", F.lit(HOT)).withColumn("head_status", F.lit(404))
        .withColumn("get_status", F.lit(410)).withColumn("head_failed", F.lit(False))
        .withColumn("get_failed", F.lit(False)).withColumn("dns_ok", F.lit(True))
        .withColumn("observed_at", F.lit(10 ** 9).cast("long")))
    return pages, probes, fx["fx_browser"]


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_hot_url_split_and_correct(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        pages, probes, browser = skewed_inputs(spark)
        rep = audit_pages(pages, probes, browser, stamp="S").report
        rows = sorted(map(tuple, rep.collect()))
        plan = rep._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan
        hot = [r for r in rows if r[1] == HOT]
        assert len(hot) == 84 and {(r[4], r[6]) for r in hot} == {("410", "dead")}
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        rep2 = audit_pages(pages, probes, browser, stamp="S").report
        assert rows == sorted(map(tuple, rep2.collect()))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
