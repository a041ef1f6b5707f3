"""Cohorts and retention over the core model.

Cohort = month of a person's first delivered purchase; retention is the
share of the cohort active in each later month (non-cumulative).  Order-grain
queries start from ``delivered_person_orders``; cohort queries start from the
distinct person-months, which are reduced before any join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.dates import month_start, months_apart
from bazaar.operators.cohorts import (active_counts, active_pairs, assign_cohort,
                                      cohort_matrix as pivot_matrix, retention)
from bazaar.operators.quality import grain_check
from bazaar.plans.core import Core

PERSON = "customer_unique_id"


def delivered_person_orders(core: Core) -> DataFrame:
    """[order_id, customer_unique_id, order_purchase_timestamp, order_month], one row per delivered order."""
    o = core.fact_orders.where(F.col("order_status") == "delivered").select(
        "order_id", "customer_sk", "order_purchase_timestamp")
    return (o.join(core.dim_customers.select("customer_sk", PERSON), "customer_sk")
             .select("order_id", PERSON, "order_purchase_timestamp",
                     month_start(F.col("order_purchase_timestamp")).alias("order_month")))


def delivered_person_months(core: Core, count: str | None = None) -> DataFrame:
    """Distinct [customer_unique_id, order_month] with a delivered purchase (and the number of orders).

    Orders are first reduced to distinct (customer key, month) pairs — a
    partial aggregation, so a customer with a huge number of orders ships at
    most one row per month per task — and only then joined to the customer
    dimension and reduced again per person.
    """
    n = count or "_n"
    o = (core.fact_orders.where(F.col("order_status") == "delivered")
         .select("customer_sk", month_start(F.col("order_purchase_timestamp")).alias("order_month"))
         .groupBy("customer_sk", "order_month").agg(F.count(F.lit(1)).alias(n)))
    pairs = o.join(core.dim_customers.select("customer_sk", PERSON), "customer_sk")
    if count is None:
        return active_pairs(pairs, PERSON, "order_month")
    return pairs.groupBy(PERSON, "order_month").agg(F.sum(n).alias(n))


def _cohorts(core: Core) -> DataFrame:
    return assign_cohort(delivered_person_months(core), PERSON, "order_month", "cohort_month")


def _counts(core: Core) -> DataFrame:
    return active_counts(delivered_person_months(core), PERSON, "order_month",
                         "cohort_month", "months_since", "active_customers")


def _last(*names: str):
    """Ascending, unknown values last, as the SQL dialect of the model sorts."""
    return [F.col(n).asc_nulls_last() for n in names]


def _null_flag_sum(c: str, name: str):
    return F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("bigint").alias(name)


def cohort_base_preview(core: Core) -> DataFrame:
    """First 10 delivered orders (by order_id)."""
    return delivered_person_orders(core).orderBy("order_id").limit(10)


def cohort_base_count(core: Core) -> DataFrame:
    """E2"""
    return delivered_person_orders(core).agg(F.count(F.lit(1)).alias("delivered_orders_cnt"))


def cohort_base_grain(core: Core) -> DataFrame:
    """One row per order?"""
    return grain_check(delivered_person_orders(core), "order_id", "rows", "distinct_orders", "duplicated_rows")


def cohort_base_nulls(core: Core) -> DataFrame:
    """E4"""
    return delivered_person_orders(core).agg(
        _null_flag_sum("order_id", "null_order_id"),
        _null_flag_sum(PERSON, "null_customer_unique_id"),
        _null_flag_sum("order_purchase_timestamp", "null_purchase_ts"),
        _null_flag_sum("order_month", "null_order_month"))


def cohort_base_range(core: Core) -> DataFrame:
    """E5"""
    return delivered_person_orders(core).agg(
        F.min("order_purchase_timestamp").alias("min_purchase_ts"),
        F.max("order_purchase_timestamp").alias("max_purchase_ts"))


def cohort_assignment(core: Core) -> DataFrame:
    """First 20 persons by (cohort, person)."""
    return _cohorts(core).orderBy(*_last("cohort_month", PERSON)).limit(20)


def cohort_assignment_check(core: Core) -> DataFrame:
    """E7"""
    c = _cohorts(core)
    return (c.agg(F.count(F.lit(1)).alias("cohort_rows"), F.count_distinct(PERSON).alias("distinct_customers"),
                  _null_flag_sum("cohort_month", "null_cohort_month"))
             .withColumn("duplicated_customers", F.col("cohort_rows") - F.col("distinct_customers")))


def cohort_sizes(core: Core) -> DataFrame:
    """New persons per cohort month."""
    return (_cohorts(core).groupBy("cohort_month")
            .agg(F.count(F.lit(1)).alias("customers_in_cohort")).orderBy(*_last("cohort_month")))


def cohort_activity_preview(core: Core) -> DataFrame:
    """Per delivered order, months since the person's cohort; first 30 rows."""
    # The cohort comes from the person-months (reduced before they are keyed by
    # person); each month then stands for as many rows as it has orders.
    months = delivered_person_months(core, count="orders")
    w = Window.partitionBy(PERSON)
    act = (months.withColumn("cohort_month", F.min("order_month").over(w))
                 .withColumn("months_since", months_apart(F.col("order_month"), F.col("cohort_month")))
                 .orderBy(*_last("cohort_month", PERSON, "order_month")).limit(30)
                 .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("orders"), F.lit(30)).cast("int")))))
    return (act.select(PERSON, "cohort_month", "order_month", "months_since")
               .orderBy(*_last("cohort_month", PERSON, "order_month")).limit(30))


def cohort_active_counts(core: Core) -> DataFrame:
    """Distinct active persons per (cohort, months since)."""
    return _counts(core).orderBy(*_last("cohort_month", "months_since"))


def cohort_retention(core: Core) -> DataFrame:
    """Retention rate per (cohort, months since 0..12)."""
    r = retention(_counts(core), "cohort_month", "months_since", "active_customers", "cohort_size",
                  "retention_rate")
    return (r.select("cohort_month", "months_since", "active_customers", "cohort_size", "retention_rate")
             .orderBy(*_last("cohort_month", "months_since")))


def cohort_matrix(core: Core) -> DataFrame:
    """One row per cohort, retention m0..m12 (NULL where nobody was active)."""
    r = retention(_counts(core), "cohort_month", "months_since", "active_customers", "cohort_size",
                  "retention_rate")
    return pivot_matrix(r, "cohort_month", "months_since", "retention_rate").orderBy(*_last("cohort_month"))


def cohort_size_check(core: Core) -> DataFrame:
    """Cohort sizes again, from the assignment."""
    return (_cohorts(core).groupBy("cohort_month")
            .agg(F.count(F.lit(1)).alias("cohort_size")).orderBy(*_last("cohort_month")))


def cohort_min_months_since(core: Core) -> DataFrame:
    """Smallest months-since over all activity (never negative)."""
    return _counts(core).agg(F.min("months_since").alias("min_months_since"))
