"""Summarises the physical plan of every registered query into PLANS.md.

    python tools/plan_report.py [sf_dir]

Per query: shuffles (Exchange), join strategies, Python evaluations, whole-stage codegen
stages, generators, windows and the columns each file scan reads. Broadcast joins are
disabled for the report (``autoBroadcastJoinThreshold=-1``) so the plans show the
strategy used when every side is large, as on a cluster.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citescope.plans import catalog  # noqa: E402
from citescope.session import build_session  # noqa: E402

HEAD = """# Physical plans

Generated by `tools/plan_report.py` from `{sf}` with broadcast joins disabled, i.e. the plan
shapes used when every side is large, and AQE off so the static plan (with its whole-stage
codegen stages) is shown; at run time AQE re-plans joins, skew and partition counts. Fixture construction (the derived evidence tables) is
part of each plan; in production those inputs are plain tables.

| query | exchanges | joins | python | codegen stages | other | scans (columns read) |
| --- | --- | --- | --- | --- | --- | --- |
"""


FOOT = """
Reading the table:

* `python` counts Python steps in the plan, all over Arrow batches: the scan of the markup, once in
  every HTML query, and the matching of links (P1, D2).
* Pages are page files. Which copies count is decided by narrow jobs while the plan is built; the
  plan itself has one scan that reads `html`, joined with a broadcast of the pages' addresses.
* The audits (`checked_links`, `validated_dead`, the flat reports...) exchange evidence reduced to one
  row per URL, and the link rows once to meet it. `report_rows` (full K2 from the article list)
  adds the join that attaches the article occurrences to the link rows after the parse. Pairing,
  de-duplication and the first-archive lookup add no exchange.
* Ranking queries: two exchanges build the page-view fixture (its daily rank window); the
  long-run score adds one partial/final HashAggregate exchange and a TakeOrderedAndProject;
  `daily_top` keeps at most 25 rows per day per partition (WindowGroupLimit).
* Scans read only the columns used (`ReadSchema`), e.g. `url` functions never read `html`.
"""


def summarise(plan: str) -> list[str]:
    exchanges = len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
    joins = sorted(set(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|"
                                  r"BroadcastNestedLoopJoin|CartesianProduct)", plan)))
    py = len(re.findall(r"(ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas)", plan))
    codegen = len(set(re.findall(r"\*\((\d+)\)", plan)))
    other = sorted(set(re.findall(r"\b(Window|WindowGroupLimit|TakeOrderedAndProject|Generate|"
                                  r"HashAggregate|ObjectHashAggregate|SortAggregate)\b", plan)))
    scans = sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan)))
    return [str(exchanges), ", ".join(joins) or "-", str(py), str(codegen), ", ".join(other) or "-",
            "; ".join(s.replace("#", "").strip() for s in scans)]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1",
                                                "spark.sql.adaptive.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false"})
    lines = [HEAD.format(sf=sf_dir)]
    for name, fn in catalog.queries().items():
        if name.startswith("incremental_"):
            lines.append(f"| `{name}` | stream: per micro-batch the `report_rows` plan | | | | | |\n")
            continue
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"#\d+L?", "", plan)
        lines.append(f"| `{name}` | " + " | ".join(summarise(plan)) + " |\n")
    lines.append(FOOT)
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w", encoding="utf-8") as f:
        f.writelines(lines)
    print(out)


if __name__ == "__main__":
    main()
