"""Map the driver's TPC-H-like tables onto the nine staging tables.

The mapping is portable SQL text so that Spark and the DuckDB oracle see
identical rows: ``{TS}`` becomes TIMESTAMP_NTZ in Spark and TIMESTAMP in DuckDB,
and ``{table}`` placeholders become DataFrame references (Spark) or the
driver's pre-registered views (DuckDB).  Money columns are cast to DECIMAL
before any multiplication so both engines round identically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaar.operators.ordering import global_position

# Fixed mapping (one SELECT per staging table).
MAPPING_SQL: dict[str, str] = {
    "orders": """
SELECT CAST(o_orderkey AS STRING) AS order_id,
       CAST(o_custkey AS STRING) AS customer_id,
       CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
       CAST(o_orderdate + INTERVAL '1' SECOND * CAST((o_orderkey * 7919) % 86400 AS INT) AS {TS}) AS order_purchase_timestamp,
       CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL
                 WHEN o_orderkey % 101 = 0 THEN o_orderdate - INTERVAL '1' DAY
                 ELSE o_orderdate + INTERVAL '1' DAY END AS {TS}) AS order_approved_at,
       CAST(o_orderdate + INTERVAL '2' DAY AS {TS}) AS order_delivered_carrier_date,
       CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 20 AS INT) END AS {TS}) AS order_delivered_customer_date,
       CAST(o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 30 - 1 AS INT) AS {TS}) AS order_estimated_delivery_date
FROM {orders}""",
    "customers": """
SELECT CAST(c_custkey AS STRING) AS customer_id,
       'U' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) AS customer_unique_id,
       lpad(CAST(c_nationkey AS STRING), 5, '0') AS customer_zip_code_prefix,
       n_name AS customer_city,
       r_name AS customer_state
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "order_items": """
SELECT CAST(l_orderkey AS STRING) AS order_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax, l_shipdate) AS INT) AS order_item_id,
       CAST(l_partkey AS STRING) AS product_id,
       CAST(l_suppkey AS STRING) AS seller_id,
       CAST(l_shipdate AS {TS}) AS shipping_limit_date,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS freight_value
FROM {lineitem}""",
    "sellers": """
SELECT CAST(s_suppkey AS STRING) AS seller_id,
       lpad(CAST(s_nationkey AS STRING), 5, '0') AS seller_zip_code_prefix,
       n_name AS seller_city,
       r_name AS seller_state
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "products": """
SELECT CAST(p_partkey AS STRING) AS product_id,
       CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS product_category_name,
       CAST(length(p_name) AS INT) AS product_name_length,
       CAST(length(p_name) + length(p_type) AS INT) AS product_description_length,
       CAST(p_size % 6 AS INT) AS product_photos_qty,
       CAST(p_size * 100 AS INT) AS product_weight_g,
       CAST(p_size AS INT) AS product_length_cm,
       CAST(p_size + 1 AS INT) AS product_height_cm,
       CAST(p_size + 2 AS INT) AS product_width_cm
FROM {part}""",
    "order_payments": """
SELECT CAST(o_orderkey AS STRING) AS order_id,
       1 AS payment_sequential,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'boleto' WHEN o_orderpriority = '2-HIGH' THEN 'voucher'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'debit_card' ELSE 'credit_card' END AS payment_type,
       CAST(o_orderkey % 12 + 1 AS INT) AS payment_installments,
       CAST(o_totalprice AS DECIMAL(10,2)) AS payment_value
FROM {orders}
UNION ALL
SELECT CAST(o_orderkey AS STRING), 2, 'voucher', 1, CAST(10.00 AS DECIMAL(10,2))
FROM {orders} WHERE o_orderkey % 10 = 0""",
    "order_reviews": """
SELECT CAST(event_id AS STRING) AS review_id,
       CAST(user_id AS STRING) AS order_id,
       CAST(event_id % 5 + 1 AS INT) AS review_score,
       event_type AS review_comment_title,
       props AS review_comment_message,
       CAST(CAST(ts AS DATE) AS {TS}) AS review_creation_date,
       CAST(ts AS {TS}) AS review_answer_timestamp
FROM {events}""",
    "geolocation": """
SELECT lpad(CAST(n_nationkey AS STRING), 5, '0') AS geolocation_zip_code_prefix,
       CAST(n_nationkey - 12 AS DECIMAL(20,6)) AS geolocation_lat,
       CAST(n_nationkey * 2 AS DECIMAL(20,6)) AS geolocation_lng,
       n_name AS geolocation_city,
       r_name AS geolocation_state
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "product_category_name_translation": """
SELECT DISTINCT p_brand AS product_category_name,
       'cat_' || substr(p_brand, 7) AS product_category_name_english
FROM {part} WHERE p_brand NOT IN ('Brand#24', 'Brand#25')""",
}

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Input columns each mapping needs: the scan reads only these (column pruning
# happens anyway, this just keeps the DataFrame references narrow).
_SOURCES = {
    "orders": ("orders",),
    "customers": ("customer", "nation", "region"),
    "order_items": ("lineitem",),
    "sellers": ("supplier", "nation", "region"),
    "products": ("part",),
    "order_payments": ("orders",),
    "order_reviews": ("events",),
    "geolocation": ("nation", "region"),
    "product_category_name_translation": ("part",),
}


def _source(spark: SparkSession, sf_dir: str, table: str, spread: int | None) -> DataFrame:
    """Scan one driver table as its files are split, or dealt out to ``spread`` partitions."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.repartition(spread) if spread else df


# The line number of the order_items mapping, as DuckDB computes it.
LINE_NUMBER = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax, l_shipdate)"
# Lines from which an order is hot: its lines are not numbered by one task.
HOT_LINES = 1_000_000
# Lines that a task numbers, about: their sort fits a task's memory, so it does not spill as the table grows.
TASK_LINES = 2_000_000
# Cells (of a hash of the order) that lines are counted by.
LINE_CELLS = 1 << 16
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_shipdate")


def number_lines(lines: DataFrame, hot_lines: int = HOT_LINES, task_lines: int = TASK_LINES) -> DataFrame:
    """``lines`` with ``line_position``: their rank within the order (LINE_NUMBER's values).

    One shuffle of the lines, by order, into more partitions than usual if there are more
    than ``task_lines`` to each.  Counts per cell of orders (of a fixed number, so the
    partial sums stay small) say where hot orders may be; only those cells are counted by order.
    The lines of hot orders, if any, are numbered over sorted ranges, each
    order's first position taken off, so that a range holds no more than its share,
    also of lines that share one line number.
    """
    order = [F.col(c).asc_nulls_first() for c in _LINE_ORDER]
    cell = F.pmod(F.xxhash64("l_orderkey"), F.lit(LINE_CELLS))
    counted = lines.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    found = counted.agg(F.sum("_n").alias("lines"), F.collect_list(F.when(F.col("_n") > hot_lines, F.col("_cell"))).alias("full")).first()
    parts = -(-(found["lines"] or 0) // task_lines)

    def numbered(some: DataFrame) -> DataFrame:
        if parts > int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            some = some.repartition(parts, "l_orderkey")
        return some.withColumn("line_position", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("bigint"))

    if not found["full"]:
        return numbered(lines)
    hot = (lines.where(cell.isin(found["full"])).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > hot_lines).select(F.col("l_orderkey").alias("_hot")))
    keys = [r["_hot"] for r in hot.collect()]   # an order for each HOT_LINES lines at most
    if not keys:
        return numbered(lines)
    of_hot = F.coalesce(F.col("l_orderkey").isin([k for k in keys if k is not None]), F.lit(None in keys))
    cold = numbered(lines.where(~of_hot))
    # Equal lines are interchangeable; a number of their own spreads them over the ranges.
    ranged = global_position(lines.where(of_hot).withColumn("_tie", F.monotonically_increasing_id()), [F.col("l_orderkey").asc_nulls_first(), *order, F.col("_tie")], out="_at")
    first = ranged.groupBy(F.col("l_orderkey").alias("_order")).agg(F.min("_at").alias("_first"))   # partial minima: a row for each hot order
    joined = ranged.join(F.broadcast(first), F.col("l_orderkey").eqNullSafe(F.col("_order")))
    return cold.unionByName(joined.withColumn("line_position", F.col("_at") - F.col("_first") + 1).drop("_tie", "_at", "_order", "_first"))


def mapped_staging_table(spark: SparkSession, sf_dir: str, name: str, spread: int | None = None) -> DataFrame:
    """One staging table derived (lazily) from the driver's parquet files."""
    dfs = {t: _source(spark, sf_dir, t, spread) for t in _SOURCES[name]}
    text = MAPPING_SQL[name].replace("{TS}", "TIMESTAMP_NTZ")
    if name == "order_items":
        dfs["lineitem"] = number_lines(dfs["lineitem"])
        text = text.replace(LINE_NUMBER, "line_position")
    return spark.sql(text, **dfs)


def oracle_staging_cte(name: str) -> str:
    """The same mapping as DuckDB SQL over the driver's pre-registered views."""
    text = MAPPING_SQL[name].replace("{TS}", "TIMESTAMP")
    for t in DRIVER_TABLES:
        text = text.replace("{" + t + "}", t)
    return text.strip()
