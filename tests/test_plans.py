"""Physical-plan properties the design relies on."""

import pytest

from bazaar.plans import cleaning, core, metrics
from bazaar.plans.warehouse import warehouse_for

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wh(spark):
    return warehouse_for(spark, SF)


def test_orphan_checks_use_anti_join(wh):
    p = plan(cleaning.dq_items_without_product(wh.staging))
    assert "LeftAnti" in p


def test_delivered_filter_pushed_to_parquet_scan(wh):
    p = plan(metrics.delivered_orders(wh.core, "customer_sk"))
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,delivered)]" in p
    # column pruning: the scan reads only the needed columns
    assert "ReadSchema: struct<order_id:string,customer_sk:bigint,order_status:string>" in p


def test_latest_review_uses_window_group_limit(wh):
    p = plan(core.build_fact_reviews(wh.staging))
    assert "WindowGroupLimit" in p


def test_seller_top_k_is_take_ordered(wh):
    p = plan(metrics.seller_top20(wh.core))
    assert "TakeOrderedAndProject" in p


def test_revenue_pre_aggregated_before_join(wh):
    p = plan(metrics.revenue_total_vs_delivered(wh.core))
    # order lines are partially aggregated per order_id below the join
    below_join = p[p.index("Join"):]
    assert "HashAggregate(keys=[order_id" in below_join and "partial_sum" in below_join


def _below_first_join(p: str) -> str:
    return p[p.index("Join"):]


def test_cohorts_dedup_customer_months_before_customer_join(wh):
    from bazaar.plans import cohorts
    p = plan(cohorts.cohort_sizes(wh.core))
    assert "HashAggregate(keys=[customer_sk" in _below_first_join(p)


def test_distinct_customers_before_customer_join(wh):
    p = plan(metrics.unique_customers_delivered(wh.core))
    assert "HashAggregate(keys=[customer_sk" in _below_first_join(p)


def test_rfm_base_aggregates_per_customer_key_before_person(wh):
    from bazaar.plans import rfm
    p = plan(rfm.customer_base(wh.core))
    # the per-customer-key aggregate feeds the dimension join; the per-person one sits above it
    assert "HashAggregate(keys=[customer_sk" in _below_first_join(p)
    assert p.index("HashAggregate(keys=[customer_unique_id") < p.index("Join")


def test_orders_read_bucketed_in_revenue_join(spark, wh):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(metrics.revenue_total_vs_delivered(wh.core))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "Bucketed: true" in p
    # only the pre-aggregated order lines are shuffled for the join
    assert p.count("Exchange hashpartitioning") == 1
