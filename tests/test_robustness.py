"""Behaviour on other sessions and bad batches: bounds, caps, publishing, lazy loads."""

import json
import os
import subprocess
import sys
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaar.operators.ordering import Ordered, global_position, ntile_by_bounds, ntile_bounds, ntile_from_position
from bazaar.operators.quality import ConstraintViolation, assert_keys, key_groups
from bazaar.plans import build
from bazaar.plans import core
from bazaar.plans.core import CORE_TABLES, SURROGATE_KEYS, materialize_core, published_set, published_tables, published_version
from bazaar.plans.catalog import PLANS
from bazaar.plans.warehouse import Warehouse
from bazaar.sources import driver_tables
from bazaar.sources.driver_tables import LINE_NUMBER, number_lines
from bazaar.sources.staging import Staging, read_staging, staging_from_files

from .fixtures import ITEMS, TABLES, frames, golden_staging

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_build_keeps_the_submitted_session():
    out = tempfile.mkdtemp(prefix="bazaar-submit-")
    code = ("import sys, json; from bazaar.plans import build; "
            f"rc = build.main(['--out', {out!r}, '--driver-dir', '/root/testdata/sf0.001']); "
            "from pyspark.sql import SparkSession; s = SparkSession.getActiveSession(); "
            "print(json.dumps([rc, s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions')]))")
    args = "--master local[2] --conf spark.sql.shuffle.partitions=5 --conf spark.ui.enabled=false --driver-memory 1g pyspark-shell"
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": args}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tempfile.mkdtemp(), capture_output=True, text=True, timeout=600)
    assert json.loads(run.stdout.strip().splitlines()[-1]) == [0, "local[2]", "5"], run.stderr[-2000:]
    for report in ("monthly_revenue_growth", "cohort_matrix", "rfm_segment_summary", "tests_summary"):
        assert os.path.isdir(f"{out}/reports/{report}")


@pytest.fixture
def many_partitions(spark):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "512b"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_position_with_more_partitions_than_shuffle_partitions(spark, many_partitions):
    got = global_position(spark.range(2000).select((F.lit(1999) - F.col("id")).alias("x")), ["x"], "p", "n").collect()
    assert sorted((r.x, r.p, r.n) for r in got) == [(i, i + 1, 2000) for i in range(2000)]


@pytest.mark.parametrize("rows", [0, 1, 3, 5, 17, 200])
def test_bounds_give_the_same_buckets(spark, rows):
    df = spark.range(rows).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.col("id") % 4).alias("v"))
    for order in ([Ordered("v"), Ordered("id")], [Ordered("v", False, True), Ordered("id")], [Ordered("v", True, True), Ordered("id", False)]):
        by_bounds = df.select("id", ntile_by_bounds(ntile_bounds(df, 5, order), order).alias("b"))
        ranked = global_position(df, [o.sort() for o in order], "p", "n")
        assert dict(by_bounds.collect()) == dict(ranked.select("id", ntile_from_position(F.col("p"), F.col("n"), 5)).collect())


def test_line_numbers_of_a_hot_order(spark):
    rows = [(1, n * 3 % 5000, n % 7, 1, 1.0, 0.1, None) for n in range(5000)] + [(k, n, 1, 1, 1.0, 0.1, None) for k in range(2, 50) for n in range(k % 5)]
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_tax double, l_shipdate date"
    lines = spark.createDataFrame(rows, names)
    for hot_lines in (1000, 10**9):
        got = number_lines(lines, hot_lines).withColumn("expected", F.expr(LINE_NUMBER))
        assert got.count() == len(rows) and got.where("line_position <> expected").isEmpty()


def test_lines_are_counted_by_cells_and_dealt_into_tasks_as_they_grow(spark, monkeypatch):
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(None if k == 7 else k, n * 3 % 5, n % 7, 1, 1.0, 0.1, None) for k in range(40) for n in range(k % 9 + 1)] + [(3, 9, n, 1, 1.0, 0.1, None) for n in range(200)]
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_tax double, l_shipdate date"
    lines = spark.createDataFrame(rows, names)
    monkeypatch.setattr(driver_tables, "LINE_CELLS", 2)   # cells are full although few of their orders are hot
    for hot_lines in (100, 210, 10**9):
        got = number_lines(lines, hot_lines, 1).withColumn("expected", F.expr(LINE_NUMBER))
        assert got.count() == len(rows) and got.where("line_position <> expected").isEmpty()
    few, many = (number_lines(lines, task_lines=n)._jdf.queryExecution().executedPlan().toString() for n in (10**9, 1))
    assert few.count("Exchange hashpartitioning(l_orderkey") == many.count("Exchange") == 1
    assert len(rows) > shuffles and f", {len(rows)})" in many and f", {len(rows)})" not in few   # one shuffle, as many tasks as asked for


def test_order_items_are_numbered_once_for_the_core_and_their_query(spark):
    raw = golden_staging(spark)
    wh = Warehouse(spark, Staging(raw.table, columnar=True, derived=True))
    got = PLANS["fact_order_items"](wh)
    assert any("/staging/order_items/" in f for f in got.inputFiles())
    assert sorted(got.collect(), key=str) == sorted(wh.core.fact_order_items.collect(), key=str)
    other = Warehouse(spark, Staging(raw.table, columnar=True, derived=True))
    other.core   # noqa: B018 — the core alone reads the lines in place
    assert not other.staging.stored("order_items")


def test_line_numbers_of_a_hot_order_with_one_line_number(spark, many_partitions):
    """10^5 lines that share their order and number: equal ones too, all in one range if that went by the number."""
    same = spark.range(100_000).select(F.lit(1).cast("long").alias("l_orderkey"), F.lit(1).cast("long").alias("l_linenumber"), (F.col("id") % 300).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
                                       F.lit(1.0).alias("l_extendedprice"), F.lit(0.1).alias("l_tax"), F.lit(None).cast("date").alias("l_shipdate"))
    lines = same.unionByName(same.limit(50).withColumn("l_orderkey", F.lit(2).cast("long")))
    got = number_lines(lines, 1000).where("l_orderkey = 1").groupBy("l_partkey").agg(F.min("line_position").alias("lo"), F.max("line_position").alias("hi"), F.count_distinct("line_position").alias("n"))
    ends, last = got.orderBy("l_partkey").collect(), 0
    for r in ends:
        assert r.lo == last + 1 and r.n == r.hi - r.lo + 1
        last = r.hi
    assert last == 100_000
    hot = number_lines(lines, 1000).where("l_orderkey = 1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert hot < 50_000


def test_summary_counts_all_violations(spark):
    tables = {k: list(v) for k, v in TABLES.items()}
    tables["order_payments"] = [("o1", n + 1, "voucher", 1, -1) for n in range(1000)]
    out = tempfile.mkdtemp(prefix="bazaar-many-")
    tables["order_payments"] = [(*r[:4], Decimal(-1)) for r in tables["order_payments"]]
    report = {r.test: (r.rows, r.status) for r in build.build_warehouse(spark, golden_staging(spark, tables), out).collect()}
    assert report["t_negative_payments"] == (1000, "FAIL")
    assert spark.read.parquet(f"{out}/reports/tests/t_negative_payments").count() == 50


def test_value_rules_fail_on_nulls_and_odd_scores():
    assert build.VALUE_RULES["t_rfm_nulls"]((0, 0, 0)) and not build.VALUE_RULES["t_rfm_nulls"]((0, 1, 0))
    assert build.VALUE_RULES["t_rfm_score_ranges"]((1, 5, 1, 5, 2, 4)) and not build.VALUE_RULES["t_rfm_score_ranges"]((1, 6, 1, 5, 1, 5))


def test_a_bad_batch_never_lands(spark):
    root = tempfile.mkdtemp(prefix="bazaar-bad-") + "/core"
    good = materialize_core(spark, golden_staging(spark), root)
    before = {n: sorted(map(str, good.table(n).collect())) for n in ("dim_customers", "fact_orders")}
    bad = {k: list(v) for k, v in TABLES.items()}
    bad["customers"] = [*bad["customers"], bad["customers"][0], (None, "U9", "1", "x", "SP")]
    with pytest.raises(ConstraintViolation):
        materialize_core(spark, golden_staging(spark, bad), root)
    for name, rows in before.items():
        assert sorted(map(str, spark.read.parquet(published_tables(spark, root)[name]).drop("created_at").collect())) == rows
    again = materialize_core(spark, golden_staging(spark), root)   # and a good one replaces it
    assert again.fact_order_items.count() == len(ITEMS) - 1


def test_only_asked_text_tables_are_loaded(spark):
    raw = tempfile.mkdtemp(prefix="bazaar-csv-")
    for name, df in frames(spark).items():
        df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{raw}/{name}.csv")
    wh = Warehouse(spark, staging_from_files(spark, raw, "csv", {"sellers": "sellers.csv"}))
    assert wh.staging.sellers.count() == 4
    assert os.listdir(f"{wh.root}/staging".removeprefix("file:")) == ["sellers"]


def test_header_must_match(spark):
    path = tempfile.mkdtemp(prefix="bazaar-csv-") + "/customers.csv"
    with open(path, "w") as f:
        f.write("customer_unique_id,customer_id,customer_zip_code_prefix,customer_city,customer_state\nu1,c1,01310,sao paulo,SP\n")
    with pytest.raises(Exception, match="(?i)header|column name"):
        read_staging(spark, "customers", path).collect()


def test_segment_averages_of_unrounded_ratios(spark):
    """The summary sums ratios as decimals of ten places; plain averages agree within that."""
    from .fixtures import skewed_tables

    wh = Warehouse(spark, golden_staging(spark, skewed_tables()))
    plain = {r.rfm_segment: r for r in wh.rfm.groupBy("rfm_segment").agg(
        F.avg(F.col("monetary_total").cast("double") / F.col("frequency")).alias("aov"),
        F.avg(F.col("frequency") / F.col("lifespan_months") * (F.col("monetary_total").cast("double") / F.col("frequency")) * 12).alias("ltv")).collect()}
    for r in wh.rfm_summary.collect():
        assert r.avg_order_value == pytest.approx(plain[r.rfm_segment].aov, rel=1e-9)
        assert r.avg_ltv_12m_approx == pytest.approx(plain[r.rfm_segment].ltv, rel=1e-9)


def test_a_second_load_keeps_surrogate_keys(spark):
    root = tempfile.mkdtemp(prefix="bazaar-keys-") + "/core"
    keys = {"dim_customers": "customer_id", "dim_products": "product_id", "dim_sellers": "seller_id"}
    held = lambda c: {n: {r[k]: r[SURROGATE_KEYS[n]] for r in c.table(n).collect()} for n, k in keys.items()}
    first = held(materialize_core(spark, golden_staging(spark), root))
    more = {k: list(v) for k, v in TABLES.items()}
    gone = more["customers"].pop()
    more["customers"] += [("a0", "U90", "1", "x", "SP"), ("zz", "U91", "1", "x", "SP")]   # the first sorts before all others
    second = held(materialize_core(spark, golden_staging(spark, more), root))
    old = {k: v for k, v in first["dim_customers"].items() if k != gone[0]}
    n = len(first["dim_customers"])
    assert second["dim_customers"] == old | {"a0": n + 1, "zz": n + 2} and second["dim_products"] == first["dim_products"]
    more["customers"] += [gone, ("mm", "U92", "1", "x", "SP")]   # one comes back
    third = held(materialize_core(spark, golden_staging(spark, more), root))
    assert third["dim_customers"] == first["dim_customers"] | {"a0": n + 1, "zz": n + 2, "mm": n + 3}


def test_a_failed_publication_leaves_the_old_set_whole(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="bazaar-crash-") + "/core"
    materialize_core(spark, golden_staging(spark), root)
    before = published_tables(spark, root)
    rows = {n: spark.read.parquet(p).count() for n, p in before.items()}

    def crash(*_):
        raise OSError("lost the connection")

    monkeypatch.setattr(core, "publish_version", crash)
    with pytest.raises(OSError):
        materialize_core(spark, golden_staging(spark), root)
    assert published_tables(spark, root) == before and rows == {n: spark.read.parquet(p).count() for n, p in before.items()}
    monkeypatch.undo()
    after = materialize_core(spark, golden_staging(spark), root).paths
    assert all(published_tables(spark, root)[n] == after[n] and after[n] != before[n] for n in CORE_TABLES)
    assert len({p.split("/")[-2] for p in published_tables(spark, root).values()}) == 1


def test_layers_are_published_as_one_load(spark, monkeypatch):
    from bazaar.plans import warehouse

    root = tempfile.mkdtemp(prefix="bazaar-layers-")

    def load(tables=None):
        wh = Warehouse(spark, golden_staging(spark, tables) if tables else golden_staging(spark), root=root)
        wh.core  # noqa: B018
        return wh

    counts = lambda held: {n: spark.read.parquet(p).count() for n, p in held.items()}
    wh = load()
    assert published_set(spark, root) == wh.core.paths   # no analytics yet
    assert wh.rfm.count() == 3 and published_version(spark, f"{root}/analytics") == (None, None)   # one of two written
    wh.rfm_summary  # noqa: B018
    first = published_set(spark, root)
    rows = counts(first)
    assert len(first) == len(CORE_TABLES) + 2 and published_version(spark, f"{root}/analytics")[1] == wh.core.version

    more = {k: list(v) for k, v in TABLES.items()}
    more["customers"] += [("a0", "U90", "1", "x", "SP")]
    for _ in range(2):   # newer cores, whose analytics fail at the last step
        later = load(more)
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(warehouse, "publish_version", lambda *_: (_ for _ in ()).throw(OSError("lost the connection")))
            later.rfm_summary  # noqa: B018
        assert published_set(spark, root) == first and counts(first) == rows
    assert published_tables(spark, f"{root}/core")["dim_customers"] != first["dim_customers"]

    later.rfm_summary  # noqa: B018 — asked for again, it is published
    new = published_set(spark, root)
    assert {n: p for n, p in new.items() if n in CORE_TABLES} == later.core.paths
    assert counts(new)["dim_customers"] == rows["dim_customers"] + 1


def test_derived_staging_is_stored_for_its_second_reader(spark):
    made = []
    raw = golden_staging(spark)
    wh = Warehouse(spark, Staging(lambda t: made.append(t) or raw.table(t), columnar=True, derived=True))
    assert wh.staging.sellers.count() == 4 and not wh.staging.stored("sellers")
    assert wh.staging.sellers.count() == 4 and wh.staging.stored("sellers")
    assert wh.staging.sellers.count() == 4 and os.listdir(f"{wh.root}/staging".removeprefix("file:")) == ["sellers"]
    wh.staging.keep("orders")
    assert wh.staging.orders.count() == 9 and wh.staging.stored("orders")


def test_key_check_groups_lines_by_order_and_ships_no_keys(spark):
    lines = spark.range(600).select(F.concat(F.lit("order "), F.col("id") % 100).alias("order_id"), (1 + F.col("id") / 100).cast("int").alias("item"))
    _, groups = key_groups(lines, ["order_id", "item"], ["order_id"])
    assert groups.agg(F.count("*"), F.sum("_n"), F.min(F.col("_n") == F.col("_most"))).first() == (100, 600, True)
    shuffled = [x for x in groups._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert shuffled and all("order_id" not in x for x in shuffled)   # a hash of fixed width, not the texts
    assert assert_keys(lines, "lines", ["order_id", "item"], ["order_id", "item"]) is lines


@pytest.mark.parametrize("rows, problem", [
    ([("x", i) for i in range(-130, 200)], None),
    ([("x", i) for i in range(-130, 200)] + [("x", 64), ("x", -1), ("x", -1)], "2 duplicated"),
    ([("x", 1), ("y", 1), ("x", 65), ("x", -63)], None),
    ([("x", None), ("x", 0)], "b: 1 NULL"),
    ([("x", None), ("x", None), (None, 3), (None, 3)], "a: 2 NULL; b: 2 NULL; 2 duplicated"),
    ([], None)])
def test_key_check_is_exact(spark, rows, problem):
    df = spark.createDataFrame(rows, "a string, b int")
    if problem is None:
        assert_keys(df, "t", ["a", "b"], ["a", "b"])
    else:
        with pytest.raises(ConstraintViolation, match=problem):
            assert_keys(df, "t", ["a", "b"], ["a", "b"])


def test_key_check_of_one_column_and_of_optional_integers(spark):
    assert_keys(spark.createDataFrame([("x", None), ("x", 0), ("y", None)], "a string, b bigint"), "t", ["a", "b"], ["a"])
    assert_keys(spark.createDataFrame([("x", 1), ("y", 1)], "a string, b int"), "t", ["a"], ["b"])
    with pytest.raises(ConstraintViolation, match="1 duplicated"):
        assert_keys(spark.createDataFrame([("x", 1), ("y", 1)], "a string, b int"), "t", ["b"])
    with pytest.raises(ConstraintViolation, match="a: 1 NULL"):
        assert_keys(spark.createDataFrame([("x", 1), (None, 1)], "a string, b int"), "t", [], ["a"])
