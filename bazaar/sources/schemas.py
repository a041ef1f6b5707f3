"""Staging-layer schemas: the nine raw tables, all columns nullable.

Money is DECIMAL(38,18) on read (the raw type is an unbounded numeric, Spark
has none); coordinates are DECIMAL(38,18).  Timestamps carry no zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
TS = T.TimestampNTZType()
MONEY_RAW = T.DecimalType(38, 18)
COORD = T.DecimalType(38, 18)


def _struct(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STAGING_SCHEMAS: dict[str, T.StructType] = {
    "orders": _struct(
        ("order_id", S), ("customer_id", S), ("order_status", S),
        ("order_purchase_timestamp", TS), ("order_approved_at", TS),
        ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
        ("order_estimated_delivery_date", TS)),
    "customers": _struct(
        ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", S),
        ("customer_city", S), ("customer_state", S)),
    "order_items": _struct(
        ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", TS), ("price", MONEY_RAW), ("freight_value", MONEY_RAW)),
    "sellers": _struct(
        ("seller_id", S), ("seller_zip_code_prefix", S), ("seller_city", S), ("seller_state", S)),
    "products": _struct(
        ("product_id", S), ("product_category_name", S), ("product_name_length", I),
        ("product_description_length", I), ("product_photos_qty", I), ("product_weight_g", I),
        ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I)),
    "order_payments": _struct(
        ("order_id", S), ("payment_sequential", I), ("payment_type", S),
        ("payment_installments", I), ("payment_value", MONEY_RAW)),
    "order_reviews": _struct(
        ("review_id", S), ("order_id", S), ("review_score", I), ("review_comment_title", S),
        ("review_comment_message", S), ("review_creation_date", TS), ("review_answer_timestamp", TS)),
    "geolocation": _struct(
        ("geolocation_zip_code_prefix", S), ("geolocation_lat", COORD), ("geolocation_lng", COORD),
        ("geolocation_city", S), ("geolocation_state", S)),
    "product_category_name_translation": _struct(
        ("product_category_name", S), ("product_category_name_english", S)),
}

STAGING_TABLES = tuple(STAGING_SCHEMAS)
