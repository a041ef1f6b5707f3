"""Cohort retention operators.

An entity's cohort is the first period in which it is active.  Activity is
reduced to distinct (entity, period) pairs before anything is keyed by entity
alone: the pre-aggregation is partial on the map side, so an entity with a
huge number of orders contributes at most one row per period per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.dates import months_apart
from bazaar.functions.numeric import round_ratio


def active_pairs(events: DataFrame, entity: str, period: str) -> DataFrame:
    """Distinct (entity, period) pairs."""
    return events.select(entity, period).distinct()


def assign_cohort(events: DataFrame, entity: str, period: str, cohort: str) -> DataFrame:
    """One row per entity with its first period (MIN, partial aggregation)."""
    return events.groupBy(entity).agg(F.min(period).alias(cohort))


def cohort_activity(events: DataFrame, cohorts: DataFrame, entity: str, period: str,
                    cohort: str, since: str) -> DataFrame:
    """Each event with its entity's cohort and the whole months since it (INT)."""
    return (events.join(cohorts, entity)
                  .withColumn(since, months_apart(F.col(period), F.col(cohort))))


def active_counts(events: DataFrame, entity: str, period: str, cohort: str, since: str,
                  active: str) -> DataFrame:
    """COUNT(DISTINCT entity) per (cohort, periods since cohort).

    Pairs are distinct, and every pair of an entity shares its cohort, so the
    distinct count is a plain count of pairs.  The cohort comes from a MIN
    window over each entity's pairs (one shuffle on entity, no self join).
    """
    pairs = active_pairs(events, entity, period)
    w = Window.partitionBy(entity)
    tagged = (pairs.withColumn(cohort, F.min(period).over(w))
                   .withColumn(since, months_apart(F.col(period), F.col(cohort))))
    return tagged.groupBy(cohort, since).agg(F.count(F.lit(1)).alias(active))


def retention(counts: DataFrame, cohort: str, since: str, active: str, size: str,
              rate: str, max_since: int = 12, scale: int = 4) -> DataFrame:
    """Active / cohort size (the count at period 0), ROUND(scale), periods 0..max_since.

    The size is taken with a window over the cohort's own rows instead of a
    self join, so the cohort computation below runs once.  ``counts`` has one
    row per (cohort, period): calendar-bounded, small.
    """
    w = Window.partitionBy(cohort)
    with_size = counts.withColumn(size, F.max(F.when(F.col(since) == 0, F.col(active))).over(w))
    return (with_size.where(F.col(size).isNotNull() & F.col(since).between(0, max_since))
                     .withColumn(rate, round_ratio(F.col(active), F.col(size), scale)))


def cohort_matrix(ret: DataFrame, cohort: str, since: str, rate: str, max_since: int = 12,
                  prefix: str = "m") -> DataFrame:
    """Pivot to one row per cohort with columns m0..m{max_since} (NULL = no activity).

    The pivot values are listed explicitly, so Spark skips the distinct pass.
    """
    values = list(range(max_since + 1))
    piv = ret.groupBy(cohort).pivot(since, values).agg(F.max(rate))
    return piv.select(cohort, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])
