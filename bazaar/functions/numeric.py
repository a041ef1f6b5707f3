"""Exact money and ratio arithmetic as JVM-side Column expressions.

Money stays DECIMAL end to end (sums are exact); ratios that the source
workload rounds (``ROUND(a::numeric / b, s)``) are rounded HALF_UP from an
exact integer quotient, so the result does not depend on float rounding or on
the engine.  Unrounded ratios are DOUBLE, computed as one division of exact
operands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"        # stored money (fact columns)
MONEY_TOTAL = "decimal(38,2)"  # any SUM of money
_WORK = "decimal(38,6)"        # exact working type for counts and money


def as_money(c: Column) -> Column:
    """Cast to the stored money type; HALF_UP at 2 decimals, overflow errors (ANSI)."""
    return c.cast(MONEY)


def money_sum(c: Column) -> Column:
    """Exact SUM of a money expression (NULL on no rows)."""
    return F.sum(c).cast(MONEY_TOTAL)


def exact_mean(c: Column) -> Column:
    """AVG as one double division of an exact sum by the count (NULL on no rows)."""
    return F.sum(c).cast("double") / F.count(c).cast("double")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / NULLIF(den, 0) in DOUBLE."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def round_ratio(num: Column, den: Column, scale: int, factor: int = 1,
                precision: int = 20) -> Column:
    """ROUND(factor * num / NULLIF(den, 0), scale), HALF_UP, computed exactly.

    ``num`` and ``den`` are exact numbers (integers or decimals with at most 6
    fractional digits).  q = floor((2|n|*factor*10^s + |d|) / (2|d|)) is the
    half-up rounded magnitude; floor uses ``a - a % b`` so no decimal division
    rounds an intermediate value.
    """
    n = num.cast(_WORK)
    d = den.cast(_WORK)
    a = F.abs(n) * F.lit(2 * factor * 10 ** scale) + F.abs(d)
    b = F.abs(d) * F.lit(2)
    # Quotient precision chosen so quotient * 10^-scale fits decimal(38, scale)
    # without Spark trimming the scale.
    q = ((a - a % b) / b).cast(f"decimal({36 - scale},0)")
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    unit = F.lit("1" if scale == 0 else "0." + "0" * (scale - 1) + "1").cast(f"decimal({scale + 1},{scale})")
    out = (signed * unit).cast(f"decimal({precision},{scale})")
    return F.when(d != 0, out)
