import datetime as dt
import tempfile
from decimal import Decimal

import pytest

from bazaar.sources.staging import read_staging, staging_from_driver, staging_from_files


def _write(tmp, name, text):
    p = f"{tmp}/{name}"
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_csv_reader_applies_schema_and_multiline_text(spark):
    tmp = tempfile.mkdtemp(prefix="bazaar-csv-")
    p = _write(tmp, "order_reviews.csv",
               'review_id,order_id,review_score,review_comment_title,review_comment_message,'
               'review_creation_date,review_answer_timestamp\n'
               'r1,o1,5,"Great","line one\nline ""two""",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
               'r2,o2,1,,,2018-03-10 00:00:00,\n')
    df = read_staging(spark, "order_reviews", p)
    rows = df.orderBy("review_id").collect()
    assert [r.review_id for r in rows] == ["r1", "r2"]
    assert rows[0].review_comment_message == 'line one\nline "two"'
    assert rows[0].review_answer_timestamp == dt.datetime(2018, 1, 18, 21, 46, 59)
    assert rows[1].review_comment_title is None and rows[1].review_answer_timestamp is None
    assert dict(df.dtypes)["review_creation_date"] == "timestamp_ntz"


def test_csv_reader_keeps_zip_prefix_text_and_money(spark):
    tmp = tempfile.mkdtemp(prefix="bazaar-csv-")
    _write(tmp, "customers.csv", "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,"
                                 "customer_state\nc1,u1,01310,sao paulo,SP\n")
    _write(tmp, "order_items.csv", "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,"
                                   "freight_value\no1,1,p1,s1,2017-09-19 09:45:35,58.9,13.29\n")
    stg = staging_from_files(spark, tmp, "csv")
    assert stg.customers.first().customer_zip_code_prefix == "01310"
    item = stg.order_items.first()
    assert item.price == Decimal("58.900000") and item.order_item_id == 1


def test_csv_reader_fails_fast_on_malformed_rows(spark):
    tmp = tempfile.mkdtemp(prefix="bazaar-csv-")
    p = _write(tmp, "order_items.csv", "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,"
                                       "freight_value\no1,notanint,p1,s1,2017-09-19 09:45:35,58.9,13.29\n")
    with pytest.raises(Exception):
        read_staging(spark, "order_items", p).collect()


def test_parquet_round_trip(spark):
    tmp = tempfile.mkdtemp(prefix="bazaar-pq-")
    stg = staging_from_driver(spark, "/root/testdata/sf0.001")
    stg.sellers.write.mode("overwrite").parquet(f"{tmp}/sellers.parquet")
    back = read_staging(spark, "sellers", f"{tmp}/sellers.parquet", fmt="parquet")
    assert back.count() == stg.sellers.count()
    assert back.columns == ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]


def test_driver_mapping_types(spark):
    stg = staging_from_driver(spark, "/root/testdata/sf0.001")
    assert dict(stg.orders.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert dict(stg.order_items.dtypes)["price"] == "decimal(10,2)"
    assert stg.order_items.groupBy("order_id", "order_item_id").count().where("count > 1").count() == 0
