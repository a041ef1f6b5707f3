"""Warehouse tests as queries.

A test passes when it returns no rows, or when its ``status`` is 'PASS'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.quality import duplicate_keys, orphan_rows, reconcile, row_count_check
from bazaar.plans.core import Core
from bazaar.plans.rfm import (core_delivered_revenue, rfm_core_nulls, rfm_score_ranges,
                              rfm_total_revenue, rfm_unique_check)
from bazaar.sources.staging import Staging

ROW_COUNT_TABLES = ("orders", "customers", "order_items", "order_payments", "order_reviews",
                    "products", "sellers")
ORPHAN_LIMIT = 50


def t_row_counts(stg: Staging) -> DataFrame:
    """G1: every staging table has rows."""
    return row_count_check({f"staging.{t}": stg.table(t) for t in ROW_COUNT_TABLES}).orderBy("table_name")


def t_unique_fact_orders(core: Core) -> DataFrame:
    return duplicate_keys(core.fact_orders, ["order_id"])


def t_unique_customer_sk(core: Core) -> DataFrame:
    return duplicate_keys(core.dim_customers, ["customer_sk"])


def t_unique_product_sk(core: Core) -> DataFrame:
    return duplicate_keys(core.dim_products, ["product_sk"])


def t_unique_seller_sk(core: Core) -> DataFrame:
    return duplicate_keys(core.dim_sellers, ["seller_sk"])


def t_unique_fact_order_items(core: Core) -> DataFrame:
    return duplicate_keys(core.fact_order_items, ["order_id", "order_item_id"])


def violations(core: Core) -> dict[str, DataFrame]:
    """All rows that break the rules of G7-G11, as many as there are."""
    items = core.fact_order_items
    return {
        "t_orphan_orders_customer": orphan_rows(core.fact_orders, core.dim_customers, ["customer_sk"]),
        "t_orphan_items_product": orphan_rows(items, core.dim_products, ["product_sk"]),
        "t_orphan_items_seller": orphan_rows(items, core.dim_sellers, ["seller_sk"]),
        "t_negative_items": items.where((F.col("price") < 0) | (F.col("freight_value") < 0)),
        "t_negative_payments": core.fact_payments.where(F.col("payment_value") < 0),
    }


def _listed(core: Core, name: str, order_by: list[str], only_keys: bool = False) -> DataFrame:
    rows = violations(core)[name]
    return (rows.select(*order_by) if only_keys else rows).orderBy(*order_by).limit(ORPHAN_LIMIT)


def t_orphan_orders_customer(core: Core) -> DataFrame:
    return _listed(core, "t_orphan_orders_customer", ["order_id"], True)


def t_orphan_items_product(core: Core) -> DataFrame:
    return _listed(core, "t_orphan_items_product", ["order_id", "order_item_id"], True)


def t_orphan_items_seller(core: Core) -> DataFrame:
    return _listed(core, "t_orphan_items_seller", ["order_id", "order_item_id"], True)


def t_negative_items(core: Core) -> DataFrame:
    return _listed(core, "t_negative_items", ["order_id", "order_item_id"])


def t_negative_payments(core: Core) -> DataFrame:
    return _listed(core, "t_negative_payments", ["order_id", "payment_sequential"])


def t_unique_rfm_customer(rfm: DataFrame) -> DataFrame:
    return rfm_unique_check(rfm)


def t_rfm_nulls(rfm: DataFrame) -> DataFrame:
    return rfm_core_nulls(rfm)


def t_rfm_score_ranges(rfm: DataFrame) -> DataFrame:
    return rfm_score_ranges(rfm)


def t_revenue_reconciliation(rfm: DataFrame, core: Core) -> DataFrame:
    """RFM revenue equals core delivered revenue exactly (NULL diff fails)."""
    return reconcile(rfm_total_revenue(rfm), core_delivered_revenue(core))
