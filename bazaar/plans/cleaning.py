"""Data-quality checks on the staging layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.quality import (duplicate_keys, null_count, orphan_count, orphan_rows,
                                      value_distribution, violation_count)
from bazaar.sources.staging import Staging


# -- duplicate natural keys ---------------------------------------------------
def dq_dup_orders(stg: Staging) -> DataFrame:
    return duplicate_keys(stg.orders, ["order_id"])


def dq_dup_customers(stg: Staging) -> DataFrame:
    return duplicate_keys(stg.customers, ["customer_id"])


def dq_dup_sellers(stg: Staging) -> DataFrame:
    return duplicate_keys(stg.sellers, ["seller_id"])


def dq_dup_products(stg: Staging) -> DataFrame:
    return duplicate_keys(stg.products, ["product_id"])


def dq_dup_order_items(stg: Staging) -> DataFrame:
    return duplicate_keys(stg.order_items, ["order_id", "order_item_id"])


# -- NULL keys ----------------------------------------------------------------
def dq_null_order_id(stg: Staging) -> DataFrame:
    return null_count(stg.orders, {"null_order_id": "order_id"})


def dq_null_customer_id(stg: Staging) -> DataFrame:
    return null_count(stg.customers, {"null_customer_id": "customer_id"})


def dq_null_product_id(stg: Staging) -> DataFrame:
    return null_count(stg.products, {"null_product_id": "product_id"})


def dq_null_seller_id(stg: Staging) -> DataFrame:
    return null_count(stg.sellers, {"null_seller_id": "seller_id"})


# -- referential integrity ------------------------------------------------------
def dq_orders_without_customer(stg: Staging) -> DataFrame:
    return orphan_count(stg.orders, stg.customers, ["customer_id"], "orders_without_customer")


def dq_items_without_order(stg: Staging) -> DataFrame:
    return orphan_count(stg.order_items, stg.orders, ["order_id"], "order_items_without_order")


def dq_items_without_product(stg: Staging) -> DataFrame:
    return orphan_count(stg.order_items, stg.products, ["product_id"], "order_items_without_product")


def dq_items_without_seller(stg: Staging) -> DataFrame:
    return orphan_count(stg.order_items, stg.sellers, ["seller_id"], "order_items_without_seller")


# -- date and money coherence ---------------------------------------------------
def order_date_rules() -> dict:
    return {
        "approved_before_purchase": F.col("order_approved_at") < F.col("order_purchase_timestamp"),
        "delivered_before_carrier": F.col("order_delivered_customer_date") < F.col("order_delivered_carrier_date"),
        "estimated_before_purchase": F.col("order_estimated_delivery_date") < F.col("order_purchase_timestamp"),
    }


def order_date_violations(stg: Staging) -> DataFrame:
    """All three order-date rules in one scan of orders."""
    return violation_count(stg.orders, order_date_rules())


def dq_approved_before_purchase(stg: Staging) -> DataFrame:
    return order_date_violations(stg).select("approved_before_purchase")


def dq_delivered_before_carrier(stg: Staging) -> DataFrame:
    return order_date_violations(stg).select("delivered_before_carrier")


def dq_estimated_before_purchase(stg: Staging) -> DataFrame:
    return order_date_violations(stg).select("estimated_before_purchase")


def item_money_violations(stg: Staging) -> DataFrame:
    return violation_count(stg.order_items, {"negative_price": F.col("price") < 0,
                                             "negative_freight": F.col("freight_value") < 0})


def dq_negative_price(stg: Staging) -> DataFrame:
    return item_money_violations(stg).select("negative_price")


def dq_negative_freight(stg: Staging) -> DataFrame:
    return item_money_violations(stg).select("negative_freight")


def dq_negative_payment(stg: Staging) -> DataFrame:
    return violation_count(stg.order_payments, {"negative_payment": F.col("payment_value") < 0})


# -- categorical distributions ----------------------------------------------------
def dist_order_status(stg: Staging) -> DataFrame:
    return value_distribution(stg.orders, "order_status")


def dist_payment_type(stg: Staging) -> DataFrame:
    return value_distribution(stg.order_payments, "payment_type")


def dist_customer_state(stg: Staging) -> DataFrame:
    return value_distribution(stg.customers, "customer_state")


def dist_seller_state(stg: Staging) -> DataFrame:
    return value_distribution(stg.sellers, "seller_state")


def dist_product_category(stg: Staging) -> DataFrame:
    return value_distribution(stg.products, "product_category_name")


# -- categories without an English name ---------------------------------------------
def unmapped_products(stg: Staging) -> DataFrame:
    """Products with a category that has no translation row."""
    p = stg.products.where(F.col("product_category_name").isNotNull())
    return orphan_rows(p, stg.translation, ["product_category_name"])


def dq_unmapped_products(stg: Staging) -> DataFrame:
    return unmapped_products(stg).agg(F.count(F.lit(1)).alias("products_with_unmapped_category"))


def dq_unmapped_by_category(stg: Staging) -> DataFrame:
    return (unmapped_products(stg).groupBy("product_category_name")
            .agg(F.count(F.lit(1)).alias("n_products"))
            .orderBy(F.col("n_products").desc(), "product_category_name"))


# Count checks grouped by the table they read.
_COUNT_CHECKS = {
    "orders": ["dq_null_order_id", "dq_approved_before_purchase", "dq_delivered_before_carrier",
               "dq_estimated_before_purchase"],
    "customers": ["dq_null_customer_id"],
    "products": ["dq_null_product_id"],
    "sellers": ["dq_null_seller_id"],
    "order_items": ["dq_negative_price", "dq_negative_freight"],
    "order_payments": ["dq_negative_payment"],
}


def table_counts(stg: Staging) -> dict[str, DataFrame]:
    """One row per staging table with all its NULL-key and rule-violation counts,
    computed in a single scan of the table."""
    rules = {**order_date_rules(),
             "null_order_id": F.col("order_id").isNull(), "null_customer_id": F.col("customer_id").isNull(),
             "null_product_id": F.col("product_id").isNull(), "null_seller_id": F.col("seller_id").isNull(),
             "negative_price": F.col("price") < 0, "negative_freight": F.col("freight_value") < 0,
             "negative_payment": F.col("payment_value") < 0}
    out = {}
    for table, checks in _COUNT_CHECKS.items():
        names = [c[3:] for c in checks]   # check key without the "dq_" prefix = column name
        out[table] = violation_count(stg.table(table), {n: rules[n] for n in names})
    return out


def staging_report(stg: Staging) -> dict[str, DataFrame]:
    """The staging checks for a report: row-level checks by name, and the count
    checks folded into one single-scan summary per table (``<table>_counts``)."""
    folded = {c for cs in _COUNT_CHECKS.values() for c in cs}
    report = {name: fn(stg) for name, fn in CHECKS.items() if name not in folded}
    report.update({f"{t}_counts": df for t, df in table_counts(stg).items()})
    return report


CHECKS = {
    "dq_dup_orders": dq_dup_orders, "dq_dup_customers": dq_dup_customers,
    "dq_dup_sellers": dq_dup_sellers, "dq_dup_products": dq_dup_products,
    "dq_dup_order_items": dq_dup_order_items,
    "dq_null_order_id": dq_null_order_id, "dq_null_customer_id": dq_null_customer_id,
    "dq_null_product_id": dq_null_product_id, "dq_null_seller_id": dq_null_seller_id,
    "dq_orders_without_customer": dq_orders_without_customer,
    "dq_items_without_order": dq_items_without_order,
    "dq_items_without_product": dq_items_without_product,
    "dq_items_without_seller": dq_items_without_seller,
    "dq_approved_before_purchase": dq_approved_before_purchase,
    "dq_delivered_before_carrier": dq_delivered_before_carrier,
    "dq_estimated_before_purchase": dq_estimated_before_purchase,
    "dq_negative_price": dq_negative_price, "dq_negative_freight": dq_negative_freight,
    "dq_negative_payment": dq_negative_payment,
    "dist_order_status": dist_order_status, "dist_payment_type": dist_payment_type,
    "dist_customer_state": dist_customer_state, "dist_seller_state": dist_seller_state,
    "dist_product_category": dist_product_category,
    "dq_unmapped_products": dq_unmapped_products, "dq_unmapped_by_category": dq_unmapped_by_category,
}
