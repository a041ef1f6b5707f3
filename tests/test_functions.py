import datetime as dt
import itertools
from decimal import ROUND_HALF_UP, Decimal, localcontext
from fractions import Fraction

from pyspark.sql import functions as F

from bazaar.functions import (SEGMENT_NAMES, days_between, month_start, months_apart, rfm_code,
                              rfm_segment, round_ratio, whole_months_between)


def _half_up(num, den, scale, factor=1):
    """Reference: exact rational, rounded HALF_UP with a 60-digit decimal context."""
    x = Fraction(num) * factor / Fraction(den)
    with localcontext() as ctx:
        ctx.prec = 60
        q = Decimal(abs(x.numerator)) / Decimal(x.denominator)
        r = q.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP)
    return -r if x < 0 else r


def test_round_ratio_is_exact_half_up(spark):
    cases = [(1, 8, 2, 1), (1, 32, 4, 1), (3, 160, 4, 1), (2, 3, 4, 1), (-1, 8, 2, 1), (1, -8, 2, 1),
             (0, 7, 2, 100), (123457, 1000000, 2, 100), (-3, 7, 2, 100),
             ("1000.005", "3.00", 2, 1), ("12345678901.23", "7.77", 6, 1), (1, 3, 10, 1)]
    rows = [(i, Decimal(str(n)), Decimal(str(d))) for i, (n, d, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, n decimal(20,3), d decimal(20,3)")
    exprs = [F.when(F.col("i") == i, round_ratio(F.col("n"), F.col("d"), s, f).cast("string"))
             for i, (_, _, s, f) in enumerate(cases)]
    got = {r.i: r.x for r in df.select("i", F.coalesce(*exprs).alias("x")).collect()}
    for i, (n, d, s, f) in enumerate(cases):
        assert Decimal(got[i]) == _half_up(Fraction(str(n)), Fraction(str(d)), s, f), (n, d, s, f, got[i])


def test_round_ratio_null_and_zero(spark):
    df = spark.createDataFrame([(1, 0), (None, 3), (3, None)], "n bigint, d bigint")
    assert [r.x for r in df.select(round_ratio(F.col("n"), F.col("d"), 4).alias("x")).collect()] == \
        [None, None, None]


def test_whole_months_between_borrows_like_age(spark):
    ts = dt.datetime
    pairs = [
        (ts(2020, 1, 31), ts(2020, 2, 29), 0),
        (ts(2020, 1, 10, 23), ts(2020, 2, 10, 1), 0),
        (ts(2020, 1, 10, 1), ts(2020, 2, 10, 23), 1),
        (ts(2020, 1, 10, 1), ts(2020, 2, 10, 1), 1),
        (ts(2019, 12, 31, 12), ts(2020, 12, 31, 11, 59, 59, 999999), 11),
        (ts(2019, 12, 31, 12), ts(2020, 12, 31, 12), 12),
        (ts(2020, 3, 15), ts(2020, 3, 20), 0),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a timestamp_ntz, b timestamp_ntz")
    got = [r.m for r in df.select(whole_months_between(F.col("b"), F.col("a")).alias("m")).collect()]
    assert got == [m for _, _, m in pairs]


def test_month_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 3, 31, 23, 59), dt.datetime(2020, 11, 1, 0, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(month_start(F.col("a")).alias("m"), months_apart(F.col("a"), F.col("b")).alias("d"),
                  days_between(F.col("a"), F.col("b")).alias("days")).first()
    assert r.m == dt.date(2021, 3, 1) and r.d == 4 and r.days == 150


def _segment_rule(r, f, m):
    if r >= 4 and f >= 4 and m >= 4:
        return "Champions"
    if r >= 4 and f >= 3:
        return "Loyal Customers"
    if r == 5 and f <= 2:
        return "New Customers"
    if r >= 3 and f >= 2 and m >= 3:
        return "Potential Loyalist"
    if r == 3 and f == 1:
        return "Need Attention"
    if r <= 2 and f >= 3:
        return "At Risk"
    if r == 1 and f <= 2:
        return "Hibernating"
    return "Others"


def test_rfm_segments_all_125_cells(spark):
    triples = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r int, f int, m int")
    out = df.select("r", "f", "m", rfm_segment("r", "f", "m").alias("s"),
                    rfm_code(F.col("r"), F.col("f"), F.col("m")).alias("code")).collect()
    counts = {}
    for row in out:
        assert row.s == _segment_rule(row.r, row.f, row.m)
        assert row.code == f"{row.r}{row.f}{row.m}"
        counts[row.s] = counts.get(row.s, 0) + 1
    assert counts == {"Champions": 8, "Loyal Customers": 22, "New Customers": 10, "Potential Loyalist": 15,
                      "Need Attention": 5, "At Risk": 30, "Hibernating": 10, "Others": 25}
    assert set(counts) == set(SEGMENT_NAMES)


def test_rfm_code_null_propagates(spark):
    df = spark.createDataFrame([(1, None, 3)], "r int, f int, m int")
    assert df.select(rfm_code(F.col("r"), F.col("f"), F.col("m")).alias("c")).first().c is None
