"""Bucketed evidence: the audit's URL joins exchange only the link rows."""

import os

import pytest

from citescope import fixtures as FX
from citescope.plans.audit import audit_pages
from citescope.sources.evidence import load_evidence, save_evidence
from citescope.sources.pages import unique_pages

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_bucketed_evidence_is_not_shuffled(spark):
    fx = FX.register(spark, SF)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    save_evidence(fx["fx_probe"], "cs_probes_b", parts)
    save_evidence(fx["fx_browser"], "cs_browser_b", parts)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = unique_pages(fx["fx_html"])
        rep = audit_pages(pages, load_evidence(spark, "cs_probes_b"),
                          load_evidence(spark, "cs_browser_b", "browser"), stamp="S").report
        plan = rep._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        assert "Exchange hashpartitioning(url" not in plan
        plain = audit_pages(pages, fx["fx_probe"], fx["fx_browser"], stamp="S").report
        assert sorted(map(tuple, rep.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_pages_saved_as_a_table(spark):
    """Bucketed pages are a source like any other: content is read in place, at addresses."""
    from citescope.plans.audit import audit
    from citescope.sources.pages import articles_with_html, save_pages
    fx = FX.register(spark, SF)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    save_pages(fx["fx_html"].select("title", "html", "ingest_pos"), "cs_pages_b", parts)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arts = fx["fx_refs"].select("article_pos", "title")
        joined = articles_with_html(arts, spark.table("cs_pages_b"))
        rep = audit(arts.distinct(), spark.table("cs_pages_b"), fx["fx_probe"], fx["fx_browser"], stamp="S").report
        for df in (joined, rep):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            scans = [i for i, l in enumerate(lines) if "cs_pages_b" in l and "html" in l.split("ReadSchema")[-1]]
            assert len(scans) == 1
            # no exchange directly above the HTML scan (the projection/filter sit between)
            assert not [l for l in lines[max(0, scans[0] - 4):scans[0]] if "Exchange hash" in l]
        assert joined.count() == arts.count() and rep.count() == fx["fx_refs"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_evidence_on_uncited_urls_stays_in_its_scan(spark):
    from pyspark.sql import functions as F

    from citescope.sources.evidence import prune_evidence, wanted_urls
    fx = FX.register(spark, SF)
    cited = fx["fx_refs"].select("original_url").distinct().sort("original_url").limit(20)
    noise = fx["fx_probe"].withColumn("url", F.concat("url", F.lit("#x")))
    evidence = fx["fx_probe"].unionByName(noise)
    kept = prune_evidence(evidence, wanted_urls(cited, "original_url"))
    wanted = {r[0] for r in cited.collect()}
    rows = kept.collect()
    assert kept.columns == evidence.columns
    assert sorted(r.url for r in rows if r.url in wanted) == sorted(
        r.url for r in evidence.collect() if r.url in wanted)
    assert len(rows) <= 1.1 * sum(r.url in wanted for r in rows)    # few others pass the hash filter
    pages = unique_pages(fx["fx_html"])
    pruned = audit_pages(pages, evidence, fx["fx_browser"], stamp="S", prune=True).report
    plain = audit_pages(pages, fx["fx_probe"], fx["fx_browser"], stamp="S").report
    assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, plain.collect()))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    probe_side = plan[plan.index("BroadcastHashJoin [_word"):]
    assert "getbit" in plan and "Exchange hash" in plan[:plan.index("BroadcastHashJoin [_word")] and probe_side
