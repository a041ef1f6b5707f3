"""Core star schema (C1-C7): three dimensions with surrogate keys, four facts.

Builds are lazy DataFrames over a ``Staging``.  ``materialize_core`` writes
them once (dimensions first, since facts look their keys up), checks the
model's key rules on the written tables, and hands back DataFrames that read
the written Parquet, so downstream queries scan columnar files with pruning
and pushdown instead of re-deriving the model.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.functions.numeric import as_money
from bazaar.operators.ordering import surrogate_key
from bazaar.operators.quality import assert_dense, assert_keys
from bazaar.operators.windows import latest_per_key
from bazaar.sources.staging import Staging

CORE_TABLES = ("dim_customers", "dim_products", "dim_sellers", "fact_orders",
               "fact_order_items", "fact_payments", "fact_reviews")

# Model rules checked before a table is published: (primary/unique natural key,
# not-null columns), and the surrogate keys, unique as well.
SURROGATE_KEYS = {"dim_customers": "customer_sk", "dim_products": "product_sk", "dim_sellers": "seller_sk"}
CORE_KEYS = {
    "dim_customers": (["customer_id"], ["customer_sk", "customer_id", "customer_unique_id"]),
    "dim_products": (["product_id"], ["product_sk", "product_id", "product_category_name_english",
                                      "is_category_unmapped"]),
    "dim_sellers": (["seller_id"], ["seller_sk", "seller_id"]),
    "fact_orders": (["order_id"], ["order_id", "customer_sk", "is_delivery_date_inconsistent",
                                   "is_approved_before_purchase", "is_estimated_before_purchase"]),
    "fact_order_items": (["order_id", "order_item_id"], ["order_id", "order_item_id", "product_sk", "seller_sk"]),
    "fact_payments": (["order_id", "payment_sequential"], ["order_id", "payment_sequential"]),
    "fact_reviews": (["order_id"], ["order_id"]),
}


def _both_present_and_before(a: str, b: str):
    """a < b with both sides known; FALSE (never NULL) when either is missing."""
    return F.coalesce(F.col(a) < F.col(b), F.lit(False))


def build_dim_customers(stg: Staging, known: DataFrame | None = None) -> DataFrame:
    c = stg.customers.select("customer_id", "customer_unique_id", "customer_zip_code_prefix",
                             "customer_city", "customer_state")
    return surrogate_key(c, "customer_sk", ["customer_id"], known, check=True)


def build_dim_products(stg: Staging, known: DataFrame | None = None) -> DataFrame:
    t = stg.translation.select("product_category_name", "product_category_name_english")
    p = stg.products
    joined = p.join(t, p["product_category_name"] == t["product_category_name"], "left")
    rows = joined.select(
        p["product_id"], p["product_category_name"],
        F.coalesce(t["product_category_name_english"], F.lit("unknown")).alias("product_category_name_english"),
        (p["product_category_name"].isNotNull() & t["product_category_name_english"].isNull())
        .alias("is_category_unmapped"),
        p["product_name_length"], p["product_description_length"], p["product_photos_qty"],
        p["product_weight_g"], p["product_length_cm"], p["product_height_cm"], p["product_width_cm"])
    return surrogate_key(rows, "product_sk", ["product_id"], known, check=True)


def build_dim_sellers(stg: Staging, known: DataFrame | None = None) -> DataFrame:
    s = stg.sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
    return surrogate_key(s, "seller_sk", ["seller_id"], known, check=True)


def build_fact_orders(stg: Staging, dim_customers: DataFrame) -> DataFrame:
    """Orders with their customer key and three date-consistency flags.

    Inner join: an order whose customer is unknown is dropped (reported by
    the staging orphan checks).
    """
    o = stg.orders
    keys = dim_customers.select("customer_id", "customer_sk")
    return o.join(keys, "customer_id").select(
        "order_id", "customer_sk", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
        _both_present_and_before("order_delivered_customer_date", "order_delivered_carrier_date")
        .alias("is_delivery_date_inconsistent"),
        _both_present_and_before("order_approved_at", "order_purchase_timestamp")
        .alias("is_approved_before_purchase"),
        _both_present_and_before("order_estimated_delivery_date", "order_purchase_timestamp")
        .alias("is_estimated_before_purchase"))


def build_fact_order_items(stg: Staging, dim_products: DataFrame, dim_sellers: DataFrame,
                           items: DataFrame | None = None) -> DataFrame:
    """Order lines with product/seller keys; money stored as DECIMAL(10,2).

    Inner joins drop lines with an unknown product or seller.  The dimension
    sides are key lookups; the planner broadcasts them only when their
    measured size is under the broadcast threshold, else sort-merge joins.
    """
    i = stg.order_items if items is None else items
    return (i.join(dim_products.select("product_id", "product_sk"), "product_id")
             .join(dim_sellers.select("seller_id", "seller_sk"), "seller_id")
             .select("order_id", "order_item_id", "product_sk", "seller_sk",
                     as_money(F.col("price")).alias("price"),
                     as_money(F.col("freight_value")).alias("freight_value"),
                     "shipping_limit_date"))


def build_fact_payments(stg: Staging) -> DataFrame:
    return stg.order_payments.select(
        "order_id", "payment_sequential", "payment_type", "payment_installments",
        as_money(F.col("payment_value")).alias("payment_value"))


def build_fact_reviews(stg: Staging) -> DataFrame:
    """Latest review per order: creation date, then answer time (both DESC
    NULLS LAST), then review_id DESC as the final tie-break."""
    r = stg.order_reviews
    latest = latest_per_key(r, ["order_id"], [
        F.col("review_creation_date").desc_nulls_last(),
        F.col("review_answer_timestamp").desc_nulls_last(),
        F.col("review_id").desc_nulls_last()])
    return latest.select("order_id", "review_id", "review_score", "review_comment_title",
                         "review_comment_message", "review_creation_date", "review_answer_timestamp")


@dataclass
class Core:
    dim_customers: DataFrame
    dim_products: DataFrame
    dim_sellers: DataFrame
    fact_orders: DataFrame
    fact_order_items: DataFrame
    fact_payments: DataFrame
    fact_reviews: DataFrame
    paths: dict = field(default_factory=dict)   # table -> written folder
    version: str = ""

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def files(self, name: str) -> DataFrame:
        """The table read as plain files, without its bucket spec.

        A join of raw order lines with orders must shuffle both sides: AQE
        can only split a hot order's partition when both join inputs are
        shuffle stages, and a bucketed side is not.
        """
        df = self.table(name)
        path = self.paths.get(name)
        return df.sparkSession.read.parquet(path).drop("created_at") if path else df


# fact_orders is written bucketed by its primary key order_id: every bucket
# holds about the same number of orders (the key is unique, so no bucket can
# be hot), and the per-order revenue aggregate of the order lines is shuffled
# straight into the matching buckets, so joins on order_id never shuffle
# fact_orders again.  Order lines are NOT bucketed: one order may hold a huge
# share of all lines, and a bucketed scan would give that bucket to a single
# task; unbucketed, they are partially aggregated per order before any shuffle.
BUCKETED = {"fact_orders": ["order_id"]}


def bucket_count(spark: SparkSession) -> int:
    """Buckets per fact table: the cluster's shuffle parallelism."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_checked(df: DataFrame, path: str, name: str, with_created_at: bool = True,
                  bucket_by: list[str] | None = None, known: bool = False) -> DataFrame:
    """Write a table to a new ``path`` and check its rules; the read-back.

    With ``bucket_by`` the files are hash-partitioned and written as buckets
    (one file each), through a catalog entry that is dropped again.  A dimension's
    natural key was checked while it was numbered; ``known`` says that keys of an
    earlier load were joined to it, which is checked by a count of its own.
    """
    spark = df.sparkSession
    out = df.withColumn("created_at", F.current_timestamp()) if with_created_at else df
    if bucket_by:
        n, table = bucket_count(spark), f"bazaar_write_{uuid.uuid4().hex[:12]}"
        (out.repartition(n, *bucket_by).write.format("parquet")
            .option("path", path).bucketBy(n, *bucket_by).saveAsTable(table))
        spark.sql(f"DROP TABLE {table}")   # external: the files stay
    else:
        out.write.parquet(path)
    back = spark.read.parquet(path)
    if name in CORE_KEYS:
        unique, not_null = CORE_KEYS[name]
        if name in SURROGATE_KEYS and not known:
            assert_dense(back, name, SURROGATE_KEYS[name], not_null)
        else:
            assert_keys(back, name, unique=unique, not_null=not_null)
            if name in SURROGATE_KEYS:
                assert_keys(back, name, unique=[SURROGATE_KEYS[name]])
    return back.drop("created_at")


def _bucketed(spark: SparkSession, database: str, name: str, path: str, sample: DataFrame) -> DataFrame:
    """Catalog entry (metadata only) that tells Spark the buckets of a published table."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sample.schema.fields)
    spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet CLUSTERED BY ({', '.join(BUCKETED[name])}) "
              f"INTO {bucket_count(spark)} BUCKETS LOCATION '{path}'")
    return spark.table(f"{database}.{name}")


MANIFEST = "CURRENT.json"


def _manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the published version of the tables under ``root``, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{MANIFEST}")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{root}/{MANIFEST}").collect()))


def published_version(spark: SparkSession, root: str) -> tuple[str | None, str | None]:
    """The published version under ``root`` and the core version that it was computed from, if any."""
    found = _manifest(spark, root) or {}
    return found.get("version"), found.get("of")


def published_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Table -> folder of the published version: all of one load, whatever happens to others."""
    found = _manifest(spark, root)
    return {name: f"{root}/{found['version']}/{name}" for name in found["tables"]} if found else {}


def published_set(spark: SparkSession, out: str) -> dict[str, str]:
    """Table -> folder of the published analytics and of the core version that they were computed from.

    One load throughout, also while a newer core waits for its analytics; the published
    core alone if there are no analytics yet.
    """
    _, of = published_version(spark, f"{out}/analytics")
    if not of:
        return published_tables(spark, f"{out}/core")
    return {name: f"{out}/core/{of}/{name}" for name in CORE_TABLES} | published_tables(spark, f"{out}/analytics")


def new_version() -> str:
    """Name of a new version's folder; names sort by time."""
    return f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish_version(spark: SparkSession, root: str, version: str, tables: list[str], of: str | None = None,
                    keep: tuple[str, ...] = ()) -> None:
    """Make ``root/version`` the published version of all its tables, by one rename of the manifest.

    ``of`` names the core version that the tables were computed from.  Readers that opened
    the version before still find it, as they do those in ``keep``; older ones go.
    """
    jvm, earlier = spark._jvm, (_manifest(spark, root) or {}).get("version")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    fresh, current = (jvm.org.apache.hadoop.fs.Path(f"{root}/{n}") for n in (f"manifest-{version}.json", MANIFEST))
    fs = current.getFileSystem(conf)
    out = fs.create(fresh)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)} | ({"of": of} if of else {})).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(current).toUri(), conf).rename(fs.makeQualified(fresh), fs.makeQualified(current), over)
    for status in fs.listStatus(current.getParent()):
        if status.isDirectory() and status.getPath().getName().startswith("v-") and status.getPath().getName() not in (version, earlier, *keep):
            fs.delete(status.getPath(), True)


def materialize_core(spark: SparkSession, stg: Staging, root: str, parallel: bool = True,
                     database: str | None = None, keep: tuple[str, ...] = ()) -> Core:
    """Build and write the seven core tables under ``root``; return read-backs.

    Every table is submitted as its own concurrent Spark job as soon as its
    inputs exist: dimensions, payments and reviews right away; orders and
    order lines once the dimensions they look keys up in are written.  All
    tables are written to the folder of a new version and checked there; only when all keep
    their rules is the version published (``publish_version``), so a bad batch never lands
    and readers never see tables of two loads.  Surrogate keys of an earlier published
    version stay: rows known from any load before keep theirs, newcomers follow.
    Of older versions, the one before this and those in ``keep`` stay.
    The bucketed table is registered (external, metadata only) in ``database``.
    """
    database = database or "bazaar_" + uuid.uuid4().hex[:12]
    version = new_version()
    fresh, earlier = f"{root}/{version}", published_tables(spark, root)
    known = {name: spark.read.parquet(earlier.get(f"keys_{name}", earlier[name])).select(*CORE_KEYS[name][0], key)
             for name, key in SURROGATE_KEYS.items() if name in earlier}

    def w(name, build):
        back = write_checked(build(), f"{fresh}/{name}", name, bucket_by=BUCKETED.get(name), known=name in known)
        if name in known:   # all keys that were ever given, also of rows that left
            natural = CORE_KEYS[name][0]
            new = back.select(*natural, SURROGATE_KEYS[name]).join(known[name], natural, "left_anti")
            known[name].unionByName(new).write.parquet(f"{fresh}/keys_{name}")
        return back

    if not parallel:
        t = {}
        for name, build in _builds(stg, lambda n: t[n], known).items():
            t[name] = w(name, build)
    else:
        with ThreadPoolExecutor(max_workers=len(CORE_TABLES)) as pool:
            futures: dict = {}
            for name, build in _builds(stg, lambda n: futures[n].result(), known).items():
                futures[name] = pool.submit(w, name, build)
            t = {n: futures[n].result() for n in CORE_TABLES}

    publish_version(spark, root, version, [*CORE_TABLES, *(f"keys_{n}" for n in known)], None, keep)
    paths = {n: f"{fresh}/{n}" for n in CORE_TABLES}
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    tables = {}
    for name, path in paths.items():
        files = spark.read.parquet(path)
        tables[name] = (_bucketed(spark, database, name, path, files) if name in BUCKETED else files).drop("created_at")
    return Core(**tables, paths=paths, version=version)


def _builds(stg: Staging, dim, known: dict[str, DataFrame]):
    """Build functions in dependency order; ``dim(name)`` yields a written dimension, ``known`` holds earlier keys."""
    return {
        "dim_customers": lambda: build_dim_customers(stg, known.get("dim_customers")),
        "dim_products": lambda: build_dim_products(stg, known.get("dim_products")),
        "dim_sellers": lambda: build_dim_sellers(stg, known.get("dim_sellers")),
        "fact_payments": lambda: build_fact_payments(stg),
        "fact_reviews": lambda: build_fact_reviews(stg),
        "fact_orders": lambda: build_fact_orders(stg, dim("dim_customers")),
        # The lines first: what is counted for them need not wait for the dimensions.
        "fact_order_items": lambda: (lambda items: build_fact_order_items(stg, dim("dim_products"), dim("dim_sellers"), items))(stg.order_items),
    }
