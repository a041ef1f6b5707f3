"""Full warehouse build: staging -> checks -> core -> analytics -> tests.

    python -m bazaar.plans.build --out OUT (--csv-dir DIR | --driver-dir DIR)

Writes, under OUT:
  core/v-*/<table>           the seven star-schema tables (Parquet), a folder for each version
  analytics/v-*/<table>      rfm_customer, rfm_segment_summary (Parquet), likewise
  */CURRENT.json             the published version of the layer; ``published_set`` reads both
  reports/staging/<check>    each row-level staging check (duplicates, orphans,
                             distributions, unmapped categories)
  reports/staging/<t>_counts NULL-key and rule-violation counts of table <t>, one scan each
  reports/tests/<test>       each warehouse test's rows (Parquet)
  reports/<query>            every metric, cohort and RFM validation query (D, E, F2-F9)
  reports/tests_summary      one row per test: rows found (not capped), PASS/FAIL
A test passes when it finds no rows, when every returned status is PASS, or, for
the two RFM value checks, when no value is NULL and all scores lie in 1..5.

Runs in the session that it is submitted to: master, parallelism and memory are
the submitter's.
"""

from __future__ import annotations

import argparse
import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.plans import checks, cleaning
from bazaar.plans.catalog import REPORT_KEYS, PLANS
from bazaar.plans.warehouse import StoredStaging, Warehouse
from bazaar.session import apply_semantics
from bazaar.sources.staging import Staging, staging_from_driver, staging_from_files


def warehouse_tests(wh: Warehouse) -> dict[str, DataFrame]:
    c, r = wh.core, wh.rfm
    return {
        "t_row_counts": checks.t_row_counts(wh.staging),
        "t_unique_fact_orders": checks.t_unique_fact_orders(c),
        "t_unique_customer_sk": checks.t_unique_customer_sk(c),
        "t_unique_product_sk": checks.t_unique_product_sk(c),
        "t_unique_seller_sk": checks.t_unique_seller_sk(c),
        "t_unique_fact_order_items": checks.t_unique_fact_order_items(c),
        "t_orphan_orders_customer": checks.t_orphan_orders_customer(c),
        "t_orphan_items_product": checks.t_orphan_items_product(c),
        "t_orphan_items_seller": checks.t_orphan_items_seller(c),
        "t_negative_items": checks.t_negative_items(c),
        "t_negative_payments": checks.t_negative_payments(c),
        "t_unique_rfm_customer": checks.t_unique_rfm_customer(r),
        "t_rfm_nulls": checks.t_rfm_nulls(r),
        "t_rfm_score_ranges": checks.t_rfm_score_ranges(r),
        "t_revenue_reconciliation": checks.t_revenue_reconciliation(r, c),
    }


# Tests that return one row of values: each value's condition.
VALUE_RULES = {
    "t_rfm_nulls": lambda row: all(v == 0 for v in row),
    # an empty table has no scores to be out of range
    "t_rfm_score_ranges": lambda row: all(v is None or 1 <= v <= 5 for v in row),
}


def _concurrently(fn, items, workers: int = 8):
    """Submit independent small jobs together so the cluster is not idle between them."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(fn, items))


def build_warehouse(spark: SparkSession, staging: Staging, out: str,
                 catalog_prefix: str | None = None) -> DataFrame:
    """Run every layer, write everything under ``out``; return the tests summary.

    With ``catalog_prefix`` (possibly "") the layers are also registered as
    catalog databases ``{prefix}staging``, ``{prefix}core``, ``{prefix}analytics``.
    """
    out = out.rstrip("/")

    wh = Warehouse(spark, staging, root=out)   # raw text files are parsed once, on first use
    if isinstance(wh.staging, StoredStaging):
        wh.staging.keep()   # checks and core both read them: derived tables are derived once

    def write_check(item):
        name, df = item
        df.write.mode("overwrite").parquet(f"{out}/reports/staging/{name}")

    _concurrently(write_check, list(cleaning.staging_report(wh.staging).items()))

    wh.core  # noqa: B018 — writes and publishes the core tables, checks keys
    wh.rfm_summary  # noqa: B018 — writes rfm_customer and rfm_segment_summary and publishes both

    def write_report(key):
        PLANS[key](wh).write.mode("overwrite").parquet(f"{out}/reports/{key}")

    _concurrently(write_report, REPORT_KEYS)

    found = checks.violations(wh.core)

    def run_test(item):
        name, df = item
        path = f"{out}/reports/tests/{name}"
        df.write.mode("overwrite").parquet(path)
        written = spark.read.parquet(path)
        # Listed rows are limited; the summary counts all of them.
        n = found[name].count() if name in found else written.count()
        if "status" in written.columns:
            ok = written.where(~F.col("status").eqNullSafe("PASS")).isEmpty()
        elif name in VALUE_RULES:
            ok = VALUE_RULES[name](written.first())
        else:
            ok = n == 0
        return name, n, "PASS" if ok else "FAIL"

    summary = _concurrently(run_test, list(warehouse_tests(wh).items()))
    if catalog_prefix is not None:
        wh.register_catalog(catalog_prefix)
    wh.close()   # the run's own catalog metadata; written files and registrations stay
    report = spark.createDataFrame(summary, "test string, rows bigint, status string")
    report.write.mode("overwrite").parquet(f"{out}/reports/tests_summary")
    return spark.read.parquet(f"{out}/reports/tests_summary")


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--out", required=True)
    ap.add_argument("--catalog-prefix", default=None,
                    help="also register the layers as catalog databases <prefix>staging/core/analytics")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv-dir", help="folder with <table>.csv for the nine staging tables")
    ap.add_argument("--file", action="append", default=[], metavar="TABLE=NAME",
                    help="file of one table below --csv-dir, if it is not <table>.csv")
    src.add_argument("--driver-dir", help="folder with the TPC-H-like parquet tables")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("bazaar-build").getOrCreate()
    apply_semantics(spark)
    named = dict(x.split("=", 1) for x in args.file)
    staging = (staging_from_files(spark, args.csv_dir, "csv", named) if args.csv_dir
               else staging_from_driver(spark, args.driver_dir))
    report = build_warehouse(spark, staging, args.out, args.catalog_prefix)
    rows = report.orderBy("test").collect()
    for r in rows:
        print(f"{r.test:32s} {r.rows:8d} {r.status}")
    return 0 if all(r.status == "PASS" for r in rows) else 1


if __name__ == "__main__":
    sys.exit(main())
