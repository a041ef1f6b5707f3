"""RFM segmentation and a 12-month value estimate per person.

Per person: first/last delivered purchase, frequency (delivered orders with
lines), monetary (their revenue), recency in days to the latest delivered
purchase of anyone.  Scores are NTILE(5) over the whole customer base
(recency descending, frequency and monetary ascending, ties broken by
person id), from bucket bounds found by distributed global position — never by
a single-partition window.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions.dates import days_between, whole_months_between
from bazaar.functions.numeric import MONEY_TOTAL, exact_mean, round_ratio, safe_ratio
from bazaar.functions.rfm import rfm_code, rfm_segment
from bazaar.operators.ordering import Ordered, ntile_bounds, ntile_by_bounds
from bazaar.operators.quality import duplicate_keys, null_count
from bazaar.operators.windows import with_total
from bazaar.plans.core import Core
from bazaar.plans.metrics import DELIVERED, revenue_per_order
from bazaar.session import checkpoint_root

PERSON = "customer_unique_id"

RFM_COLUMNS = ("customer_unique_id", "first_order_ts", "last_order_ts", "recency_days", "frequency",
               "monetary_total", "avg_order_value", "r_score", "f_score", "m_score", "rfm_score",
               "rfm_segment", "lifespan_months", "ltv_12m_approx")


def customer_base(core: Core) -> DataFrame:
    """One row per person: first/last purchase, frequency, monetary.

    Aggregated per customer key first (partial aggregation absorbs a hot
    customer), then per person after the key lookup.  order_id is the primary
    key of fact_orders and revenue_per_order has one row per order, so the
    distinct order count is a plain count.
    """
    orders = core.fact_orders.where(F.col("order_status") == DELIVERED).select(
        "order_id", "customer_sk", "order_purchase_timestamp")
    rev = revenue_per_order(core.fact_order_items)
    per_sk = (orders.join(rev, "order_id")
                    .groupBy("customer_sk")
                    .agg(F.min("order_purchase_timestamp").alias("first_order_ts"),
                         F.max("order_purchase_timestamp").alias("last_order_ts"),
                         F.count("order_id").alias("frequency"),
                         F.sum("order_revenue").alias("monetary_total")))
    return (per_sk.join(core.dim_customers.select("customer_sk", PERSON), "customer_sk")
                  .groupBy(PERSON)
                  .agg(F.min("first_order_ts").alias("first_order_ts"),
                       F.max("last_order_ts").alias("last_order_ts"),
                       F.sum("frequency").cast("bigint").alias("frequency"),
                       F.sum("monetary_total").cast(MONEY_TOTAL).alias("monetary_total")))


def rfm_metrics(core: Core) -> DataFrame:
    """customer_base + recency_days against the latest delivered purchase overall.

    The reference date includes delivered orders without lines.
    """
    ref = (core.fact_orders.where(F.col("order_status") == DELIVERED)
           .agg(F.max("order_purchase_timestamp").alias("_max_ts")))
    return (customer_base(core).crossJoin(F.broadcast(ref))
            .withColumn("recency_days", days_between(F.col("_max_ts"), F.col("last_order_ts")))
            .drop("_max_ts"))


def rfm_scores(metrics: DataFrame) -> DataFrame:
    """r/f/m scores 1..5 (5 = best): NTILE(5) of the customer base, in one pass over it.

    Only (value, person) is ordered, to find each score's four last rows of a
    bucket; all rows are then compared with these twelve.
    """
    tie = Ordered(PERSON)
    orders = {"r_score": [Ordered("recency_days", ascending=False, nulls_first=True), tie],
              "f_score": [Ordered("frequency"), tie], "m_score": [Ordered("monetary_total"), tie]}
    with ThreadPoolExecutor(max_workers=len(orders)) as pool:
        bounds = dict(zip(orders, pool.map(lambda o: ntile_bounds(metrics, 5, o), orders.values())))
    return metrics.select("*", *(ntile_by_bounds(bounds[name], order).alias(name) for name, order in orders.items()))


def rfm_scored(core: Core) -> DataFrame:
    """Metrics + r/f/m scores."""
    metrics = rfm_metrics(core)
    checkpoint_root(metrics.sparkSession)
    # Materialise once: the three orderings and the scoring pass each re-read it.
    return rfm_scores(metrics.checkpoint(eager=True))


def rfm_segmented(core: Core) -> DataFrame:
    """F1d: scores + score string + segment."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return (rfm_scored(core).withColumn("rfm_score", rfm_code(r, f, m))
                            .withColumn("rfm_segment", rfm_segment("r_score", "f_score", "m_score")))


def rfm_ltv_inputs(core: Core) -> DataFrame:
    """F1e: segments + lifespan in whole months (at least 1) + average order value."""
    lifespan = F.greatest(F.lit(1), whole_months_between(F.col("last_order_ts"), F.col("first_order_ts")))
    return (rfm_segmented(core)
            .withColumn("lifespan_months", lifespan.cast("int"))
            .withColumn("avg_order_value", safe_ratio(F.col("monetary_total"), F.col("frequency"))))


def rfm_customer(core: Core) -> DataFrame:
    """the analytics.rfm_customer table (without its load timestamp)."""
    ltv = (F.col("frequency").cast("double") / F.col("lifespan_months").cast("double")
           * F.col("avg_order_value") * F.lit(12.0))
    return rfm_ltv_inputs(core).withColumn("ltv_12m_approx", ltv).select(*RFM_COLUMNS)


# -- checks over the rfm table (F2-F8) ----------------------------------------
def rfm_row_count(rfm: DataFrame) -> DataFrame:
    return rfm.agg(F.count(F.lit(1)).alias("total_customers_rfm"))


def rfm_segment_distribution(rfm: DataFrame) -> DataFrame:
    return (rfm.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"))
               .orderBy(F.col("customers").desc(), "rfm_segment"))


def rfm_null_check(rfm: DataFrame) -> DataFrame:
    any_score_null = F.col("r_score").isNull() | F.col("f_score").isNull() | F.col("m_score").isNull()
    return rfm.agg(F.count_if(F.col("recency_days").isNull()).alias("null_recency"),
                   F.count_if(F.col("frequency").isNull()).alias("null_frequency"),
                   F.count_if(F.col("monetary_total").isNull()).alias("null_monetary"),
                   F.count_if(any_score_null).alias("null_scores"))


def rfm_negative_check(rfm: DataFrame) -> DataFrame:
    return rfm.agg(F.count_if(F.col("recency_days") < 0).alias("negative_recency"),
                   F.count_if(F.col("frequency") < 0).alias("negative_frequency"),
                   F.count_if(F.col("monetary_total") < 0).alias("negative_monetary"))


def rfm_score_ranges(rfm: DataFrame) -> DataFrame:
    return rfm.agg(*[f(c).alias(f"{n}_{c[0]}") for c in ("r_score", "f_score", "m_score")
                     for f, n in ((F.min, "min"), (F.max, "max"))])


def rfm_total_revenue(rfm: DataFrame) -> DataFrame:
    return rfm.agg(F.sum("monetary_total").cast(MONEY_TOTAL).alias("total_rfm_revenue"))


def core_delivered_revenue(core: Core) -> DataFrame:
    """F8: SUM(price + freight) over lines of delivered orders.

    Summed per order first (exact decimals, so the total is identical): the
    join then sees one row per order, whatever an order's number of lines.
    """
    rev = revenue_per_order(core.fact_order_items).join(
        core.fact_orders.where(F.col("order_status") == DELIVERED).select("order_id"), "order_id")
    return rev.agg(F.sum("order_revenue").cast(MONEY_TOTAL).alias("total_core_revenue"))


# Averages of per-person ratios are summed as exact decimals (ratios rounded
# HALF_UP at 10 decimals), so the result does not depend on summation order.
RATIO_SCALE = 10


def exact_aov():
    """monetary / frequency per person as DECIMAL(38,10)."""
    return round_ratio(F.col("monetary_total"), F.col("frequency"), RATIO_SCALE, precision=38)


def exact_ltv():
    """(frequency / lifespan) * (monetary / frequency) * 12 = 12 * monetary / lifespan
    (frequency > 0), as DECIMAL(38,10); NULL when frequency is 0."""
    v = round_ratio(F.col("monetary_total") * F.lit(12), F.col("lifespan_months"), RATIO_SCALE, precision=38)
    return F.when(F.col("frequency") != 0, v)


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    """the analytics.rfm_segment_summary table (without its load timestamp).

    One row per segment (8 at most); the revenue share uses a one-row grand
    total rather than SUM(SUM()) OVER ().
    """
    seg = rfm.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary_total").cast(MONEY_TOTAL).alias("revenue_total"),
        exact_mean(F.col("monetary_total")).alias("revenue_avg_per_customer"),
        exact_mean(exact_aov()).alias("avg_order_value"),
        exact_mean(F.col("frequency")).alias("avg_orders_per_customer"),
        exact_mean(F.col("recency_days")).alias("avg_recency_days"),
        exact_mean(exact_ltv()).alias("avg_ltv_12m_approx"))
    return (with_total(seg, "revenue_total", "_all")
            .withColumn("revenue_share", round_ratio(F.col("revenue_total"), F.col("_all"), 6, 1))
            .drop("_all"))


def rfm_unique_check(rfm: DataFrame) -> DataFrame:
    return duplicate_keys(rfm, [PERSON])


def rfm_core_nulls(rfm: DataFrame) -> DataFrame:
    return null_count(rfm, {"null_recency": "recency_days", "null_frequency": "frequency",
                            "null_monetary": "monetary_total"})
