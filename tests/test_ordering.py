"""Distributed global-order operators against Spark's single-partition windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaar.operators.ordering import (global_position, ntile_global, percentile_cont_global,
                                      rank_desc, surrogate_key, top_k_ranked)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    # one value holds a third of the rows, the rest spread out
    rows = [(f"id{i:05d}", 3 if i % 3 == 0 else rnd.randint(0, 50), rnd.randint(0, 10 ** 6) / 100.0)
            for i in range(3000)]
    return spark.createDataFrame(rows, "id string, freq int, amount double").repartition(5)


def test_global_position_matches_row_number(spark, skewed):
    order = [F.col("freq").desc(), F.col("id")]
    got = global_position(skewed, order, out="pos", num_partitions=7)
    want = skewed.withColumn("want", F.row_number().over(Window.orderBy(*order)))
    diff = got.join(want, "id").where(F.col("pos") != F.col("want")).count()
    assert diff == 0
    assert got.agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (1, 3000, 3000)


def test_surrogate_key_dense_by_natural_key(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", "d", "c"]], "k string")
    got = surrogate_key(df, "sk", ["k"]).orderBy("sk").collect()
    assert [(r.sk, r.k) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert surrogate_key(df, "sk", ["k"]).columns == ["sk", "k"]


@pytest.mark.parametrize("n_rows,buckets", [(7, 5), (3, 5), (5, 5), (1, 5), (3000, 5), (1001, 4)])
def test_ntile_matches_window_ntile(spark, n_rows, buckets):
    rnd = random.Random(n_rows)
    df = spark.createDataFrame([(f"id{i:05d}", rnd.randint(0, 4)) for i in range(n_rows)], "id string, freq int")
    order = [F.col("freq").asc(), F.col("id")]
    got = ntile_global(df, buckets, order, "b")
    want = df.withColumn("w", F.ntile(buckets).over(Window.orderBy(*order)))
    assert got.count() == n_rows
    assert got.join(want, "id").where(F.col("b") != F.col("w")).count() == 0
    sizes = [r["count"] for r in got.groupBy("b").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_ntile_bucket_sizes_7_into_5(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "x int")
    sizes = sorted((r.b, r["count"]) for r in ntile_global(df, 5, ["x"], "b").groupBy("b").count().collect())
    assert sizes == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 1)]


def test_percentile_cont_matches_exact(spark, skewed):
    vals = sorted(r.amount for r in skewed.select("amount").collect())
    n = len(vals)
    for frac in (0.5, 0.25, 0.9):
        rn = 1 + frac * (n - 1)
        lo, hi = int(rn // 1), int(-(-rn // 1))
        want = vals[lo - 1] + (vals[hi - 1] - vals[lo - 1]) * (rn - lo)
        got = percentile_cont_global(skewed, "amount", frac, "p").first().p
        assert got == pytest.approx(want, rel=1e-12)
    empty = skewed.where("freq < 0")
    assert percentile_cont_global(empty, "amount", 0.5, "p").first().p is None


def test_top_k_rank_is_global_rank(spark):
    # ties straddle the cut at 20
    rows = [(f"s{i:02d}", float(100 - i // 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "seller string, revenue double")
    got = top_k_ranked(df, "revenue", 20, ["seller"], "rk").orderBy("seller").collect()
    full = {r.seller: r.rk for r in df.withColumn(
        "rk", F.rank().over(Window.orderBy(F.col("revenue").desc()))).collect()}
    assert len(got) == 20
    assert [r.seller for r in got] == [f"s{i:02d}" for i in range(20)]
    assert all(r.rk == full[r.seller] for r in got)


def test_ntile_plan_has_no_single_partition_exchange(spark, skewed):
    ranked = ntile_global(skewed, 5, [F.col("freq"), F.col("id")], "b")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_global_position_with_many_mostly_empty_partitions(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string")
    got = global_position(df, ["k"], out="pos", num_partitions=400).orderBy("k").collect()
    assert [r.pos for r in got] == list(range(1, 51))


def test_rank_desc_matches_window_rank_with_ties_and_nulls(spark):
    rnd = random.Random(9)
    rows = [(f"c{i:04d}", None if i % 97 == 0 else float(rnd.choice([5, 5, 5, 7, 9, rnd.randint(0, 100)])))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "cat string, revenue double")
    got = rank_desc(df, "revenue", ["cat"], "rk")
    want = df.withColumn("w", F.rank().over(Window.orderBy(F.col("revenue").desc_nulls_first())))
    assert got.count() == 1500
    assert got.join(want, "cat").where(F.col("rk") != F.col("w")).count() == 0


def test_selection_by_rank_equals_sorting(spark):
    import random

    from bazaar.operators.ordering import Ordered, select_at
    r = random.Random(3)
    rows = [(r.choice([None, 1, 1, 1, 2, r.randint(-5, 900)]), r.choice(["", "a", "ab"]) + f"{i:05x}" if i else None, r.randint(1, 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "v int, id string, w long").withColumn("v", F.col("v").cast("decimal(10,2)")).cache()
    ranks = [1, 2, 17, 450, 451, 600, 899, 900]
    for ascending in (True, False):
        for nulls_first in (True, False):
            key = lambda x: ((x[0] is None) != nulls_first, (x[0] or 0) * (1 if ascending else -1), x[1] is None, (x[1] or "").encode())
            plain = sorted(rows, key=key)
            order = [Ordered("v", ascending, nulls_first), Ordered("id")]
            for few, cells in ((10_000, 1024), *([(3, 8)] if ascending != nulls_first else [])):
                assert [(None if v is None else int(v), i) for v, i in select_at(df, order, ranks, few=few, cells=cells)] == [plain[k - 1][:2] for k in ranks]
            weighed = [x[0] for x in plain for _ in range(x[2])]
            got = select_at(df, order[:1], [1, 500, len(weighed)], weight="w", few=3, cells=16)
            assert [None if v is None else int(v) for (v,) in got] == [weighed[k - 1] for k in (1, 500, len(weighed))]


def test_numbering_notices_repeated_and_null_keys(spark):
    import pytest

    from bazaar.operators.quality import ConstraintViolation
    assert surrogate_key(spark.createDataFrame([("a",), ("b",)], "k string"), "sk", ["k"], check=True).count() == 2
    for bad in ([("a",), ("b",), ("a",)], [("a",), (None,)]):
        with pytest.raises(ConstraintViolation):
            surrogate_key(spark.createDataFrame(bad, "k string").repartition(3), "sk", ["k"], check=True)
