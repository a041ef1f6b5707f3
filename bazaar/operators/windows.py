"""Keyed window operators and ratio-to-total helpers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.numeric import round_ratio


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """Keep the first row per key in ``order_by`` order (ROW_NUMBER() = 1).

    Spark plans ``row_number() ... = 1`` with a partial WindowGroupLimit before
    the shuffle, so a key with very many rows ships at most one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1)
              .drop("_rn"))


def with_total(df: DataFrame, measure: str, total: str) -> DataFrame:
    """Attach SUM(measure) over all rows as a column.

    The total is a one-row aggregate joined back with a broadcast nested-loop
    join, not ``SUM() OVER ()`` (which would move every row into one task).
    """
    tot = df.agg(F.sum(measure).alias(total))
    return df.crossJoin(F.broadcast(tot))


def share_of_total(df: DataFrame, measure: str, out: str, scale: int, factor: int = 100) -> DataFrame:
    """ROUND(factor * measure / SUM(measure over all rows), scale), exact decimal."""
    return (with_total(df, measure, "_total")
            .withColumn(out, round_ratio(F.col(measure), F.col("_total"), scale, factor))
            .drop("_total"))


def period_growth(df: DataFrame, period: str, measure: str, running: str, abs_change: str,
                  pct_change: str, pct_scale: int = 2) -> DataFrame:
    """Running total, change and % change versus the previous present period.

    Input has one row per period (a few hundred months), so the ordered
    window runs in one small task by design.
    """
    w = Window.orderBy(F.col(period).asc_nulls_last())   # an unknown period comes last
    prev = F.lag(measure).over(w)
    return (df.withColumn(running, F.sum(measure).over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn(abs_change, F.col(measure) - prev)
              .withColumn(pct_change, round_ratio(F.col(measure) - prev, prev, pct_scale, 100)))
