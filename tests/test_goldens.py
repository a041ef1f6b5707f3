"""End-to-end goldens on the hand-built fixture (expected values derived by hand)."""

import datetime as dt
from decimal import Decimal as D

import pytest

from bazaar.operators.quality import ConstraintViolation
from bazaar.plans import checks, cleaning, cohorts, metrics, rfm
from bazaar.plans.warehouse import Warehouse

from .fixtures import dirty_tables, golden_staging


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse(spark, golden_staging(spark))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((v is not None, v if v is not None else 0) for v in t))


def one(df):
    return df.first().asDict()


# -- core --------------------------------------------------------------------
def test_dim_products_category_rules(wh):
    got = rows(wh.core.dim_products, "product_sk", "product_id", "product_category_name_english",
               "is_category_unmapped")
    assert got == [(1, "p1", "a_en", False), (2, "p2", "unknown", True),
                   (3, "p3", "unknown", False), (4, "p4", "unknown", True)]


def test_dim_customers_dense_keys(wh):
    assert rows(wh.core.dim_customers, "customer_sk", "customer_id") == \
        [(1, "c1"), (2, "c2"), (3, "c3"), (4, "c4"), (5, "c5")]


def test_fact_orders_drops_orphans_and_flags_never_null(wh):
    fo = {r.order_id: r for r in wh.core.fact_orders.collect()}
    assert sorted(fo) == [f"o{i}" for i in range(1, 9)]
    assert (fo["o1"].is_delivery_date_inconsistent, fo["o1"].is_approved_before_purchase,
            fo["o1"].is_estimated_before_purchase) == (True, True, False)
    assert (fo["o2"].is_delivery_date_inconsistent, fo["o2"].is_approved_before_purchase,
            fo["o2"].is_estimated_before_purchase) == (False, False, True)
    assert fo["o1"].customer_sk == 1 and fo["o2"].customer_sk == 2


def test_fact_order_items_rounds_half_up_and_drops_unknown_product(wh):
    fi = rows(wh.core.fact_order_items, "order_id", "order_item_id", "price", "product_sk", "seller_sk")
    assert len(fi) == 8
    assert fi[0] == ("o1", 1, D("10.13"), 1, 1)
    assert str(wh.core.fact_order_items.schema["price"].dataType) == "DecimalType(10,2)"


def test_fact_reviews_latest_per_order(wh):
    assert rows(wh.core.fact_reviews, "order_id", "review_id") == [("o1", "r2"), ("o2", "r4"), ("o3", "r6")]


def test_fact_payments_keeps_orphans_and_negatives(wh):
    assert rows(checks.t_negative_payments(wh.core), "order_id", "payment_sequential") == [("o2", 2)]


def test_write_guard_rejects_duplicate_keys(spark):
    bad = Warehouse(spark, golden_staging(spark, dirty_tables()))
    with pytest.raises(ConstraintViolation):
        bad.core  # noqa: B018


# -- staging checks ------------------------------------------------------------
def test_staging_checks_on_clean_fixture(wh):
    s = wh.staging
    assert one(cleaning.dq_orders_without_customer(s)) == {"orders_without_customer": 1}
    assert one(cleaning.dq_items_without_product(s)) == {"order_items_without_product": 1}
    assert one(cleaning.dq_items_without_order(s)) == {"order_items_without_order": 0}
    assert one(cleaning.dq_approved_before_purchase(s)) == {"approved_before_purchase": 1}
    assert one(cleaning.dq_delivered_before_carrier(s)) == {"delivered_before_carrier": 1}
    assert one(cleaning.dq_estimated_before_purchase(s)) == {"estimated_before_purchase": 1}
    assert one(cleaning.dq_negative_payment(s)) == {"negative_payment": 1}
    # 'C' has a translation row (with a NULL English name): mapped for this check
    assert one(cleaning.dq_unmapped_products(s)) == {"products_with_unmapped_category": 1}
    assert rows(cleaning.dq_unmapped_by_category(s), "product_category_name", "n_products") == [("B", 1)]
    assert rows(cleaning.dist_product_category(s), "product_category_name", "count") == \
        [(None, 1), ("A", 1), ("B", 1), ("C", 1)]


def test_staging_checks_find_violations(spark):
    s = golden_staging(spark, dirty_tables())
    assert rows(cleaning.dq_dup_orders(s), "order_id", "count") == [("o1", 2)]
    assert rows(cleaning.dq_dup_customers(s), "customer_id", "count") == [("c1", 2)]
    assert rows(cleaning.dq_dup_sellers(s), "seller_id", "count") == [("s1", 2)]
    assert rows(cleaning.dq_dup_products(s), "product_id", "count") == [("p1", 2)]
    assert rows(cleaning.dq_dup_order_items(s), "order_id", "order_item_id", "count") == [("o1", 1, 2)]
    for fn, name in [(cleaning.dq_null_order_id, "null_order_id"), (cleaning.dq_null_customer_id, "null_customer_id"),
                     (cleaning.dq_null_product_id, "null_product_id"), (cleaning.dq_null_seller_id, "null_seller_id")]:
        assert one(fn(s)) == {name: 1}
    assert one(cleaning.dq_items_without_product(s)) == {"order_items_without_product": 2}  # pX and NULL
    assert one(cleaning.dq_negative_price(s)) == {"negative_price": 1}
    assert one(cleaning.dq_negative_freight(s)) == {"negative_freight": 1}


# -- metrics -------------------------------------------------------------------
def test_revenue_and_status(wh):
    assert one(metrics.revenue_total_vs_delivered(wh.core)) == {
        "revenue_all_orders": D("211.63"), "revenue_delivered_only": D("156.63")}
    assert rows(metrics.status_mix(wh.core), "order_status", "orders", "pct_orders") == \
        [("delivered", 7, D("87.50")), ("shipped", 1, D("12.50"))]
    assert one(metrics.unique_customers_delivered(wh.core)) == {"unique_customers_delivered": 3}


def test_aov(wh):
    r = one(metrics.aov_mean_median(wh.core))
    vals = sorted([11.13, 22.00, 35.50, 44.00, 16.50, 27.50])
    assert r["avg_aov_delivered"] == pytest.approx(sum(vals) / 6)
    assert r["median_aov_delivered"] == pytest.approx((vals[2] + vals[3]) / 2)


def test_monthly_growth_uses_previous_present_month(wh):
    got = [tuple(r) for r in metrics.monthly_revenue_growth(wh.core).collect()]
    assert got == [
        (dt.date(2020, 1, 1), D("63.13"), D("63.13"), None, None),
        (dt.date(2020, 2, 1), D("22.00"), D("85.13"), D("-41.13"), D("-65.15")),
        (dt.date(2020, 3, 1), D("44.00"), D("129.13"), D("22.00"), D("100.00")),
        (dt.date(2021, 2, 1), D("27.50"), D("156.63"), D("-16.50"), D("-37.50")),
    ]


def test_category_and_seller_rank(wh):
    cats = rows(metrics.category_performance(wh.core), "category_rank", "category", "revenue")
    # a_en: 11.13 + 30.00 = 41.13; unknown: 22 + 5.5 + 44 + 16.5 + 27.5 = 115.50
    assert cats == [(1, "unknown", D("115.50")), (2, "a_en", D("41.13"))]
    sellers = rows(metrics.seller_top20(wh.core), "seller_rank", "seller_id", "revenue", "pct_of_delivered_revenue")
    assert sellers == [(1, "s2", D("66.00"), D("42.14")), (2, "s4", D("44.00"), D("28.09")),
                       (3, "s1", D("41.13"), D("26.26")), (4, "s3", D("5.50"), D("3.51"))]


# -- cohorts ---------------------------------------------------------------------
def test_cohorts(wh):
    c = wh.core
    assert rows(cohorts.cohort_sizes(c), "cohort_month", "customers_in_cohort") == [(dt.date(2020, 1, 1), 3)]
    counts = rows(cohorts.cohort_active_counts(c), "months_since", "active_customers")
    assert counts == [(0, 3), (1, 1), (2, 1), (13, 1), (14, 1)]
    ret = rows(cohorts.cohort_retention(c), "months_since", "retention_rate")
    assert ret == [(0, D("1.0000")), (1, D("0.3333")), (2, D("0.3333"))]   # 13, 14 cut
    m = one(cohorts.cohort_matrix(c))
    assert (m["m0"], m["m1"], m["m2"], m["m3"], m["m12"]) == (D("1.0000"), D("0.3333"), D("0.3333"), None, None)
    assert one(cohorts.cohort_min_months_since(c)) == {"min_months_since": 0}
    # the delivered order without lines counts here
    assert one(cohorts.cohort_base_count(c)) == {"delivered_orders_cnt": 7}


# -- RFM -----------------------------------------------------------------------------
def test_rfm_customer(wh):
    got = {r.customer_unique_id: r for r in wh.rfm.collect()}
    assert sorted(got) == ["U1", "U3", "U5"]
    u1, u3, u5 = got["U1"], got["U3"], got["U5"]
    assert (u1.frequency, u1.monetary_total, u1.recency_days, u1.lifespan_months) == (2, D("33.13"), 366, 1)
    assert (u3.frequency, u3.monetary_total, u3.recency_days, u3.lifespan_months) == (2, D("79.50"), 356, 1)
    assert (u5.frequency, u5.monetary_total, u5.recency_days, u5.lifespan_months) == (2, D("44.00"), 24, 13)
    assert [(g.r_score, g.f_score, g.m_score) for g in (u1, u3, u5)] == [(1, 1, 1), (2, 2, 3), (3, 3, 2)]
    assert [g.rfm_segment for g in (u1, u3, u5)] == ["Hibernating", "Others", "Others"]
    assert u1.rfm_score == "111"
    assert u1.avg_order_value == pytest.approx(16.565)
    assert u5.ltv_12m_approx == pytest.approx(2 / 13 * 22.0 * 12)


def test_rfm_checks_and_reconciliation(wh):
    assert one(checks.t_revenue_reconciliation(wh.rfm, wh.core)) == {
        "total_rfm_revenue": D("156.63"), "total_core_revenue": D("156.63"), "diff": D("0.00"), "status": "PASS"}
    assert one(rfm.rfm_row_count(wh.rfm)) == {"total_customers_rfm": 3}
    assert checks.t_unique_rfm_customer(wh.rfm).count() == 0
    summary = {r.rfm_segment: r for r in rfm.rfm_segment_summary(wh.rfm).collect()}
    assert summary["Others"].customers == 2
    assert summary["Others"].revenue_share + summary["Hibernating"].revenue_share == D("1.000000")
    assert summary["Others"].avg_ltv_12m_approx == pytest.approx((954.0 + 2 / 13 * 22.0 * 12) / 2)


def test_row_count_tests_pass(wh):
    got = rows(checks.t_row_counts(wh.staging), "table_name", "status")
    assert len(got) == 7 and all(s == "PASS" for _, s in got)


def test_table_counts_fold_the_count_checks(spark):
    s = golden_staging(spark, dirty_tables())
    counts = {t: one(df) for t, df in cleaning.table_counts(s).items()}
    assert counts["orders"] == {"null_order_id": 1, "approved_before_purchase": 2,
                                "delivered_before_carrier": 2, "estimated_before_purchase": 2}
    assert counts["order_items"] == {"negative_price": 1, "negative_freight": 1}
    assert counts["customers"] == {"null_customer_id": 1}
    # each summary is one aggregation over one scan
    plan = cleaning.table_counts(s)["orders"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
