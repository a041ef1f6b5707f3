"""Every catalogue key against its DuckDB oracle on the smallest driver tables."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from bazaar.plans.catalog import queries
from bazaar.plans.oracle_sql import oracle_sql

SF = "/root/testdata/sf0.001"
VIEWS = "region nation customer supplier part orders lineitem events".split()


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return "" if v is None else str(v)


def _canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for v in VIEWS:
        c.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{SF}/{v}.parquet')")
    return c


def test_every_key_has_an_oracle():
    assert set(queries()) == set(oracle_sql()) <= set(entry.queries()) & set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(queries()))
def test_matches_oracle(spark, con, key):
    df = queries()[key](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[key])
    d_names = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(df.columns) == sorted(d_names)
    assert len(s_rows) == len(d_rows)
    assert _canon(df.columns, s_rows) == _canon(d_names, d_rows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "revenue_delivered", "revenue_running_total", "mom_abs_change",
                          "mom_pct_change"]
    assert df.count() > 0
