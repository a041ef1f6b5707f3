"""Property checks on many generated cases at once (one Spark job per property)."""

import calendar
import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from bazaar.functions import round_ratio, whole_months_between
from bazaar.plans import cohorts, rfm
from bazaar.plans.warehouse import warehouse_for


def test_whole_months_agree_with_duckdb_age(spark):
    rnd = random.Random(3)
    pairs = []
    for _ in range(3000):
        a = dt.datetime(2019, 1, 1) + dt.timedelta(days=rnd.randint(0, 1200), seconds=rnd.randint(0, 86399),
                                                   microseconds=rnd.choice([0, 1, 999999]))
        if rnd.random() < 0.3:   # land on month ends
            a = a.replace(day=calendar.monthrange(a.year, a.month)[1] - rnd.randint(0, 2))
        b = a + dt.timedelta(days=rnd.randint(0, 800), seconds=rnd.randint(-3600, 3600))
        if b < a:
            a, b = b, a
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    got = [r.m for r in df.select(whole_months_between(F.col("b"), F.col("a")).alias("m")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (a TIMESTAMP, b TIMESTAMP)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    want = [r[0] for r in con.execute(
        "SELECT CAST(date_part('year', age(b, a)) * 12 + date_part('month', age(b, a)) AS INTEGER) FROM p").fetchall()]
    assert got == want


def test_round_ratio_random_cases(spark):
    rnd = random.Random(5)
    cases = []
    for _ in range(2000):
        den = rnd.choice([rnd.randint(1, 50), rnd.randint(1, 10 ** 9)]) * rnd.choice([1, -1])
        num = rnd.randint(-10 ** 12, 10 ** 12) if rnd.random() < 0.5 else den * rnd.randint(0, 7) // 8
        cases.append((Decimal(num) / 100, Decimal(den) / 100))
    df = spark.createDataFrame(cases, "n decimal(20,2), d decimal(20,2)")
    out = df.select("n", "d", *[round_ratio(F.col("n"), F.col("d"), s, f).alias(f"r{s}_{f}")
                                for s, f in ((2, 100), (4, 1), (6, 1))]).collect()
    for r in out:
        for s, f in ((2, 100), (4, 1), (6, 1)):
            x = Fraction(r.n) * f / Fraction(r.d)
            with localcontext() as ctx:
                ctx.prec = 60
                q = (Decimal(abs(x.numerator)) / Decimal(x.denominator)).quantize(
                    Decimal(1).scaleb(-s), rounding=ROUND_HALF_UP)
            assert r[f"r{s}_{f}"] == (-q if x < 0 else q), (r.n, r.d, s, f)


def test_every_cohort_starts_at_full_retention(spark):
    wh = warehouse_for(spark, "/root/testdata/sf0.001")
    m = cohorts.cohort_matrix(wh.core)
    assert m.count() > 0
    assert m.where(F.col("m0") != Decimal("1.0000")).count() == 0


def test_segment_shares_sum_to_one(spark):
    wh = warehouse_for(spark, "/root/testdata/sf0.001")
    s = rfm.rfm_segment_summary(wh.rfm).agg(F.sum("revenue_share").alias("t")).first().t
    assert abs(s - Decimal(1)) <= Decimal("0.000008")   # 8 segments, each rounded at 6 decimals
