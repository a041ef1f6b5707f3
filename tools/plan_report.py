"""Write PLANS.md: the physical-plan shape of every catalogue query.

    python tools/plan_report.py [--sf-dir DIR] [--out PLANS.md]

Plans are taken with broadcast joins disabled (``autoBroadcastJoinThreshold
= -1``), i.e. the plan Spark picks when every table is too large to
broadcast; explicit broadcasts of one-row aggregates still show.  Operators
that materialise through ``checkpoint()`` (global position) run jobs while the
query is built; these are counted in their own columns.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bazaar.plans.catalog import PLANS  # noqa: E402
from bazaar.plans.warehouse import warehouse_for  # noqa: E402
from bazaar.session import build_session  # noqa: E402

PATTERNS = {
    "hash shuffles": r"(?<!Reused)Exchange hashpartitioning",
    "range shuffles": r"(?<!Reused)Exchange rangepartitioning",
    "round-robin": r"(?<!Reused)Exchange RoundRobinPartitioning",
    "single-partition": r"(?<!Reused)Exchange SinglePartition",
    "reused": r"Reused(Exchange|QueryStage)",
    "broadcasts": r"BroadcastExchange",
    "sort-merge joins": r"SortMergeJoin",
    "broadcast joins": r"Broadcast(HashJoin|NestedLoopJoin)",
    "windows": r"\bWindow \[",
    "top-k": r"TakeOrderedAndProject",
    "bucketed scans": r"Bucketed: true",
}


def shape(plan: str) -> dict[str, int]:
    # AQE prints each query stage as "ShuffleQueryStage ... +- Exchange ..."; a
    # reused stage prints as "ReusedExchange"/"ReusedQueryStage" and is not
    # executed again.
    final = plan.split("== Initial Plan ==")[0]
    lines = [ln for ln in final.splitlines() if "Reused" not in ln or "Reused" in ln.split("Exchange")[0]]
    text = "\n".join(lines)
    return {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                                                  "PLANS.md"))
    args = ap.parse_args()
    spark = build_session("plan-report", extra={"spark.ui.showConsoleProgress": "false",
                                                "spark.sql.autoBroadcastJoinThreshold": "-1"})
    wh = warehouse_for(spark, args.sf_dir)
    rows = []
    wh.core, wh.rfm  # noqa: B018 — written once; their jobs belong to no query
    tracker = spark.sparkContext.statusTracker()
    for key in PLANS:
        spark.sparkContext.setJobGroup(key, key)
        known = set(tracker.getJobIdsForGroup(None))   # jobs of helper threads carry no group
        df = PLANS[key](wh)
        jobs = [j for j in [*tracker.getJobIdsForGroup(key), *(set(tracker.getJobIdsForGroup(None)) - known)]]
        stages = sum(len(tracker.getJobInfo(j).stageIds) for j in jobs if tracker.getJobInfo(j))
        df.collect()   # execute this DataFrame's own plan so AQE finalises it (small at sf0.01)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows.append((key, {"jobs while built": len(jobs), "their stages": stages} | shape(plan)))
    cols = ["jobs while built", "their stages", *PATTERNS]
    lines = ["# PLANS — physical plan shape per query",
             "",
             "Generated by `tools/plan_report.py` at " + os.path.basename(args.sf_dir.rstrip("/")) +
             " with broadcast joins disabled (the plan for tables too large to broadcast);",
             "final adaptive plans after execution, so exchanges reused at runtime are counted once",
             "(column `reused`).  Global-position operators run their range sort and checkpoint",
             "when the query is built: the first two columns count these jobs and their stages",
             "(a stage per shuffle and one for the checkpoint); the plan then scans the result.",
             "Single-partition exchanges are the final merge of global aggregates (one row after",
             "partial aggregation), final ORDER BYs of small results, or windows over calendar- or",
             "segment-bounded inputs (months, the 20 top sellers, 8 segments); none sits over a",
             "growing row set.",
             "",
             "| query | " + " | ".join(cols) + " |",
             "| --- | " + " | ".join("---:" for _ in cols) + " |"]
    for key, sh in rows:
        lines.append(f"| `{key}` | " + " | ".join(str(sh[c]) for c in cols) + " |")
    with open(args.out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {args.out} ({len(rows)} queries)")
    spark.stop()


if __name__ == "__main__":
    main()
