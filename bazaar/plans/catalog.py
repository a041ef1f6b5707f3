"""The query catalogue: key -> callable(spark, sf_dir) -> DataFrame.

Keys follow the inventory: A (staging scans), B (staging checks), C (core
builds), D (metrics), E (cohorts), F (RFM), G (tests).  C and F1 return the
build plans themselves; queries that read a built table use the warehouse's
written copy.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from bazaar.plans import checks, cleaning, cohorts, core, metrics, rfm
from bazaar.plans.warehouse import StoredStaging, Warehouse, warehouse_for

Query = Callable[[SparkSession, str], DataFrame]

STAGING_KEYS = {
    "stg_orders": "orders", "stg_customers": "customers", "stg_order_items": "order_items",
    "stg_sellers": "sellers", "stg_products": "products", "stg_order_payments": "order_payments",
    "stg_order_reviews": "order_reviews", "stg_geolocation": "geolocation",
    "stg_category_translation": "product_category_name_translation",
}


def _staging_table(name: str):
    return lambda wh: wh.staging.table(name)


def _fact_order_items(wh: Warehouse) -> DataFrame:
    """The order lines are numbered once, for the core and for this build."""
    if isinstance(wh.staging, StoredStaging):
        wh.staging.keep("order_items")
    return core.build_fact_order_items(wh.staging, wh.core.dim_products, wh.core.dim_sellers)


def _wraps(fn, plan):
    plan.__wrapped__ = fn
    return plan


def _on_staging(fn):
    return _wraps(fn, lambda wh: fn(wh.staging))


def _on_core(fn):
    return _wraps(fn, lambda wh: fn(wh.core))


def _on_rfm(fn):
    return _wraps(fn, lambda wh: fn(wh.rfm))


# key -> function of a Warehouse
PLANS: dict[str, Callable[[Warehouse], DataFrame]] = {}
PLANS.update({k: _staging_table(t) for k, t in STAGING_KEYS.items()})
PLANS.update({k: _on_staging(fn) for k, fn in cleaning.CHECKS.items()})
PLANS.update({
    "dim_customers": lambda wh: core.build_dim_customers(wh.staging),
    "dim_products": lambda wh: core.build_dim_products(wh.staging),
    "dim_sellers": lambda wh: core.build_dim_sellers(wh.staging),
    "fact_orders": lambda wh: core.build_fact_orders(wh.staging, wh.core.dim_customers),
    "fact_order_items": _fact_order_items,
    "fact_payments": lambda wh: core.build_fact_payments(wh.staging),
    "fact_reviews": lambda wh: core.build_fact_reviews(wh.staging),
})
PLANS.update({
    "status_mix": _on_core(metrics.status_mix),
    "revenue_total_vs_delivered": _on_core(metrics.revenue_total_vs_delivered),
    "unique_customers_delivered": _on_core(metrics.unique_customers_delivered),
    "aov_mean_median": _on_core(metrics.aov_mean_median),
    "monthly_revenue_growth": _on_core(metrics.monthly_revenue_growth),
    "category_performance": _on_core(metrics.category_performance),
    "seller_top20": _on_core(metrics.seller_top20),
})
PLANS.update({
    "cohort_base_preview": _on_core(cohorts.cohort_base_preview),
    "cohort_base_count": _on_core(cohorts.cohort_base_count),
    "cohort_base_grain": _on_core(cohorts.cohort_base_grain),
    "cohort_base_nulls": _on_core(cohorts.cohort_base_nulls),
    "cohort_base_range": _on_core(cohorts.cohort_base_range),
    "cohort_assignment": _on_core(cohorts.cohort_assignment),
    "cohort_assignment_check": _on_core(cohorts.cohort_assignment_check),
    "cohort_sizes": _on_core(cohorts.cohort_sizes),
    "cohort_activity": _on_core(cohorts.cohort_activity_preview),
    "cohort_active_counts": _on_core(cohorts.cohort_active_counts),
    "cohort_retention": _on_core(cohorts.cohort_retention),
    "cohort_matrix": _on_core(cohorts.cohort_matrix),
    "cohort_size_check": _on_core(cohorts.cohort_size_check),
    "cohort_min_months_since": _on_core(cohorts.cohort_min_months_since),
})
PLANS.update({
    "rfm_customer": _on_core(rfm.rfm_customer),
    "rfm_base": _on_core(rfm.customer_base),
    "rfm_metrics": _on_core(rfm.rfm_metrics),
    "rfm_scores": _on_core(rfm.rfm_scored),
    "rfm_segments": _on_core(rfm.rfm_segmented),
    "rfm_ltv": _on_core(rfm.rfm_ltv_inputs),
    "rfm_row_count": _on_rfm(rfm.rfm_row_count),
    "rfm_segment_distribution": _on_rfm(rfm.rfm_segment_distribution),
    "rfm_null_check": _on_rfm(rfm.rfm_null_check),
    "rfm_negative_check": _on_rfm(rfm.rfm_negative_check),
    "rfm_score_ranges": _on_rfm(rfm.rfm_score_ranges),
    "rfm_total_revenue": _on_rfm(rfm.rfm_total_revenue),
    "core_delivered_revenue": _on_core(rfm.core_delivered_revenue),
    "rfm_segment_summary": _on_rfm(rfm.rfm_segment_summary),
})
PLANS.update({
    "t_row_counts": _on_staging(checks.t_row_counts),
    "t_unique_fact_orders": _on_core(checks.t_unique_fact_orders),
    "t_unique_customer_sk": _on_core(checks.t_unique_customer_sk),
    "t_unique_product_sk": _on_core(checks.t_unique_product_sk),
    "t_unique_seller_sk": _on_core(checks.t_unique_seller_sk),
    "t_unique_fact_order_items": _on_core(checks.t_unique_fact_order_items),
    "t_orphan_orders_customer": _on_core(checks.t_orphan_orders_customer),
    "t_orphan_items_product": _on_core(checks.t_orphan_items_product),
    "t_orphan_items_seller": _on_core(checks.t_orphan_items_seller),
    "t_negative_items": _on_core(checks.t_negative_items),
    "t_negative_payments": _on_core(checks.t_negative_payments),
    "t_unique_rfm_customer": _on_rfm(checks.t_unique_rfm_customer),
    "t_rfm_nulls": _on_rfm(checks.t_rfm_nulls),
    "t_rfm_score_ranges": _on_rfm(checks.t_rfm_score_ranges),
    "t_revenue_reconciliation": lambda wh: checks.t_revenue_reconciliation(wh.rfm, wh.core),
})


# Metrics, cohorts and RFM validations: what a full run reports beside the tables and tests.
REPORT_KEYS = ("status_mix", "revenue_total_vs_delivered", "unique_customers_delivered", "aov_mean_median",
               "monthly_revenue_growth", "category_performance", "seller_top20",
               *(k for k in PLANS if k.startswith("cohort_")),
               "rfm_row_count", "rfm_segment_distribution", "rfm_null_check", "rfm_negative_check",
               "rfm_score_ranges", "rfm_total_revenue", "core_delivered_revenue", "rfm_segment_summary")


def query(key: str) -> Query:
    plan = PLANS[key]
    return lambda spark, sf_dir: plan(warehouse_for(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {k: query(k) for k in PLANS}
