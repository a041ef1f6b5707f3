"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Steps: start the session and warm the JVM (untimed), build and write the core
layer once ("core_build"), then run each headline query to completion with
the no-op sink (full execution, nothing collected).  Each query is run
``BENCH_REPEAT`` times (default 3) and the best time is reported; "value" is the
sum of these and of the core build, "headline_queries_total" that of the queries alone
(the first round's "value").
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bazaar.plans.catalog import PLANS  # noqa: E402
from bazaar.plans.warehouse import Warehouse  # noqa: E402
from bazaar.session import apply_semantics, build_session  # noqa: E402
from bazaar.sources.staging import staging_from_driver  # noqa: E402

HEADLINE = ["fact_orders", "fact_order_items", "fact_reviews", "revenue_total_vs_delivered",
            "monthly_revenue_growth", "seller_top20", "cohort_matrix", "rfm_customer"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    extra = {"spark.ui.showConsoleProgress": "false"}
    if os.environ.get("BENCH_EVENTLOG_DIR"):  # per-stage timings, read offline
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENTLOG_DIR"]})
    parts = os.environ.get("BENCH_SHUFFLE_PARTITIONS")
    spark = build_session("bench", cpus=cpus, shuffle_partitions=int(parts) if parts else None, extra=extra)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up

    times: dict[str, float] = {}
    apply_semantics(spark)
    # The driver's files are one row group each: deal them out to the cores.
    wh = Warehouse(spark, staging_from_driver(spark, sf_dir, spread=int(cpus)))
    spark.sparkContext.setJobGroup("core_build", "core_build")
    t0 = time.perf_counter()
    wh.core  # noqa: B018 — builds, writes and key-checks the seven core tables
    times["core_build"] = round(time.perf_counter() - t0, 3)

    for key in HEADLINE:
        best = None
        spark.sparkContext.setJobGroup(key, key)
        for _ in range(repeat):
            t0 = time.perf_counter()
            run(PLANS[key](wh))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[key] = round(best, 3)

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "core_build_and_headline_queries_total", "value": total, "unit": "sec",
                      "headline_queries_total": round(total - times["core_build"], 3), "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))
    wh.close()
    spark.stop()


if __name__ == "__main__":
    main()
