"""All catalogue queries on hand-built and skewed fixtures vs the DuckDB oracle.

The staging tables are written once as Parquet; Spark builds the warehouse from
them and DuckDB runs the same oracle SQL with its staging CTEs reading the same
files (brute force on small inputs, hot keys included).
"""

import tempfile

import duckdb
import pytest

from bazaar.plans.catalog import PLANS
from bazaar.plans.oracle_sql import oracle_sql_over_staging
from bazaar.plans.warehouse import Warehouse
from bazaar.sources.staging import staging_from_frames

from .fixtures import TABLES, frames, skewed_tables, unknown_time_tables
from .test_oracle import _canon


@pytest.fixture(scope="module", params=["golden", "unknown_time", "skewed"])
def case(spark, request):
    tables = {"golden": lambda: TABLES, "unknown_time": unknown_time_tables, "skewed": skewed_tables}[request.param]()
    root = tempfile.mkdtemp(prefix=f"bazaar-{request.param}-")
    paths = {}
    for name, df in frames(spark, tables).items():
        paths[name] = f"{root}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    stg = staging_from_frames({n: spark.read.parquet(p) for n, p in paths.items()})
    return Warehouse(spark, stg, load_raw=False), duckdb.connect(), oracle_sql_over_staging(paths)


@pytest.mark.parametrize("key", sorted(PLANS))
def test_fixture_matches_oracle(case, key):
    wh, con, sql = case
    df = PLANS[key](wh)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql[key])
    names = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert len(s_rows) == len(d_rows)
    assert _canon(df.columns, s_rows) == _canon(names, d_rows)


def test_skewed_fixture_really_is_skewed(spark, case):
    wh, _, _ = case
    from pyspark.sql import functions as F
    lines = wh.staging.order_items
    top = lines.groupBy("order_id").count().orderBy(F.desc("count")).first()
    assert top["count"] * 3 >= lines.count() or wh.staging.orders.count() < 100
