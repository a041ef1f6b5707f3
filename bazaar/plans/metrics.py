"""Business metrics over the core model.

Revenue = SUM(price + freight_value) at order-line grain; "real sales" are
orders with status 'delivered'.  Money stays DECIMAL(38,2); rounded
percentages are exact DECIMALs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions.dates import month_start
from bazaar.functions.numeric import MONEY_TOTAL, money_sum, safe_ratio
from bazaar.operators.ordering import percentile_cont_global, rank_desc, top_k_ranked
from bazaar.operators.windows import period_growth, share_of_total
from bazaar.plans.core import Core

DELIVERED = "delivered"


def line_revenue():
    return F.col("price") + F.col("freight_value")


def revenue_per_order(items: DataFrame) -> DataFrame:
    """[order_id, order_revenue]: lines pre-aggregated per order before any join."""
    return items.groupBy("order_id").agg(money_sum(line_revenue()).alias("order_revenue"))


def delivered_orders(core: Core, *cols: str) -> DataFrame:
    return core.fact_orders.where(F.col("order_status") == DELIVERED).select("order_id", *cols)


def status_mix(core: Core) -> DataFrame:
    """Orders per status and their % of all orders."""
    counts = core.fact_orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
    return share_of_total(counts, "orders", "pct_orders", 2).orderBy(F.col("orders").desc())


def revenue_total_vs_delivered(core: Core) -> DataFrame:
    """Revenue of all orders with lines vs delivered orders only."""
    rpo = revenue_per_order(core.fact_order_items)
    j = core.fact_orders.select("order_id", "order_status").join(rpo, "order_id")
    delivered_rev = F.when(F.col("order_status") == DELIVERED, F.col("order_revenue")).otherwise(F.lit(0))
    return j.agg(F.sum("order_revenue").cast(MONEY_TOTAL).alias("revenue_all_orders"),
                 F.sum(delivered_rev).cast(MONEY_TOTAL).alias("revenue_delivered_only"))


def unique_customers_delivered(core: Core) -> DataFrame:
    """D3: distinct persons with a delivered order (exact COUNT DISTINCT)."""
    # distinct customer keys first (partial aggregation absorbs a hot customer),
    # then the key lookup, then the distinct persons
    d = core.fact_orders.where(F.col("order_status") == DELIVERED).select("customer_sk").distinct()
    persons = d.join(core.dim_customers.select("customer_sk", "customer_unique_id"), "customer_sk")
    return persons.agg(F.count_distinct("customer_unique_id").alias("unique_customers_delivered"))


def delivered_order_revenue(core: Core, *cols: str) -> DataFrame:
    """[order_id, order_revenue, *cols] for delivered orders that have lines.

    Both sides are keyed by order_id; the aggregate's output partitioning is
    reused by the join, so the lines are shuffled once.
    """
    return revenue_per_order(core.fact_order_items).join(delivered_orders(core, *cols), "order_id")


def aov_mean_median(core: Core) -> DataFrame:
    """Mean and exact median (PERCENTILE_CONT 0.5) of delivered order revenue."""
    rev = delivered_order_revenue(core)
    # sum and count over distinct amounts, each weighted by its number of orders
    total = F.sum(F.col("order_revenue").cast("decimal(24,2)") * F.col("_n").cast("decimal(13,0)"))
    both = percentile_cont_global(rev, "order_revenue", 0.5, "median_aov_delivered",
                                  also=[("_sum", total), ("_count", F.sum("_n"))])
    return both.select(safe_ratio(F.col("_sum"), F.col("_count")).alias("avg_aov_delivered"), "median_aov_delivered")


def monthly_revenue_growth(core: Core) -> DataFrame:
    """Delivered revenue per purchase month, running total, MoM change and %."""
    rev = delivered_order_revenue(core, "order_purchase_timestamp")
    months = (rev.groupBy(month_start(F.col("order_purchase_timestamp")).alias("month"))
                 .agg(F.sum("order_revenue").cast(MONEY_TOTAL).alias("revenue_delivered")))
    g = period_growth(months, "month", "revenue_delivered", "revenue_running_total",
                      "mom_abs_change", "mom_pct_change")
    return g.select("month", "revenue_delivered",
                    F.col("revenue_running_total").cast(MONEY_TOTAL).alias("revenue_running_total"),
                    F.col("mom_abs_change").cast(MONEY_TOTAL).alias("mom_abs_change"),
                    "mom_pct_change").orderBy(F.col("month").asc_nulls_last())


def _revenue_by(core: Core, key: str) -> DataFrame:
    """Delivered revenue per dimension key.

    Lines are summed per (order, key) before anything is joined: partial sums
    shrink an order with a huge share of all lines on the map side, and the
    second key spreads what is left of it.
    """
    lines = core.fact_order_items.groupBy("order_id", key).agg(money_sum(line_revenue()).alias("revenue"))
    orders = core.files("fact_orders").where(F.col("order_status") == DELIVERED).select("order_id")
    return (lines.join(orders, "order_id", "left_semi")
            .groupBy(key).agg(F.sum("revenue").cast(MONEY_TOTAL).alias("revenue")))


def category_performance(core: Core) -> DataFrame:
    """Delivered revenue per English category, RANK and % of total."""
    per_product = _revenue_by(core, "product_sk")
    cats = (per_product.join(core.dim_products.select("product_sk", "product_category_name_english"),
                             "product_sk")
            .groupBy(F.col("product_category_name_english").alias("category"))
            .agg(F.sum("revenue").cast(MONEY_TOTAL).alias("revenue")))
    shared = share_of_total(cats, "revenue", "pct_of_delivered_revenue", 2)
    ranked = rank_desc(shared, "revenue", ["category"], "category_rank")
    return (ranked.select("category_rank", "category", "revenue", "pct_of_delivered_revenue")
                  .orderBy(F.col("revenue").desc_nulls_first(), "category"))


def seller_top20(core: Core, k: int = 20) -> DataFrame:
    """Top sellers by delivered revenue with RANK and % of total (all sellers)."""
    shared = share_of_total(_revenue_by(core, "seller_sk"), "revenue", "pct_of_delivered_revenue", 2)
    # Surrogate keys follow the order of seller_id, so they break ties alike; names go to the k rows.
    top = top_k_ranked(shared, "revenue", k, ["seller_sk"], "seller_rank")
    named = core.dim_sellers.select("seller_sk", "seller_id", "seller_state").join(F.broadcast(top), "seller_sk")
    return (named.select("seller_rank", "seller_id", "seller_state", "revenue", "pct_of_delivered_revenue")
               .orderBy(F.col("revenue").desc_nulls_first(), "seller_id"))
