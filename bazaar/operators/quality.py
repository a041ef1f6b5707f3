"""Data-quality operators: duplicates, NULL keys, orphans, rule violations,
value distributions, grain checks and pre-write key assertions.

All are single-pass aggregations or anti joins; every check over one table is
meant to be folded into one ``agg`` so the table is scanned once.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintViolation(Exception):
    """A table broke a PRIMARY KEY / UNIQUE / NOT NULL rule of the model."""


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def duplicate_keys(df: DataFrame, keys: Sequence[str], count_col: str = "count") -> DataFrame:
    """Key values occurring more than once: GROUP BY keys HAVING COUNT(*) > 1.

    The aggregation is partial on the map side, so even a key holding a large
    share of the rows sends one row per task through the shuffle.
    """
    return (df.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias(count_col))
              .where(F.col(count_col) > 1))


def null_count(df: DataFrame, checks: Mapping[str, str | Column]) -> DataFrame:
    """One row: for each name, the number of rows where the column is NULL."""
    return df.agg(*[F.count_if(_cols([c])[0].isNull()).alias(n) for n, c in checks.items()])


def violation_count(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row: for each name, rows where the predicate is TRUE (NULL counts as not violated)."""
    return df.agg(*[F.count_if(p).alias(n) for n, p in checks.items()])


def violating_rows(df: DataFrame, predicate: Column, order_by: Sequence[str | Column],
                   limit: int | None = None) -> DataFrame:
    """Rows breaking a rule, ordered (and capped when the report asks for it)."""
    out = df.where(predicate).orderBy(*_cols(order_by))
    return out.limit(limit) if limit is not None else out


def orphan_rows(child: DataFrame, parent: DataFrame,
                on: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Child rows whose key has no parent row (NULL child keys are orphans).

    Equivalent to LEFT JOIN parent ... WHERE parent.key IS NULL, written as a
    left-anti join so no parent columns are carried and no fan-out happens.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {k: k for k in on}
    cond = None
    for ck, pk in pairs.items():
        c = child[ck] == parent[pk]
        cond = c if cond is None else cond & c
    return child.join(parent.select(*pairs.values()), cond, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, on, name: str) -> DataFrame:
    return orphan_rows(child, parent, on).agg(F.count(F.lit(1)).alias(name))


def value_distribution(df: DataFrame, col: str, count_col: str = "count") -> DataFrame:
    """Value counts, most frequent first (NULL is a value of its own)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))
              .orderBy(F.col(count_col).desc(), F.col(col).asc_nulls_last()))


def grain_check(df: DataFrame, key: str, rows: str = "rows", distinct: str = "distinct_keys",
                duplicated: str = "duplicated_rows") -> DataFrame:
    """Rows, distinct keys and their difference (0 when the key is the grain)."""
    return (df.agg(F.count(F.lit(1)).alias(rows), F.count_distinct(key).alias(distinct))
              .withColumn(duplicated, F.col(rows) - F.col(distinct)))


def row_count_check(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name, row count, and PASS if it has rows."""
    counts = reduce(DataFrame.unionByName,
                    (df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
                     for name, df in tables.items()))
    return counts.withColumn("status", F.when(F.col("row_count") > 0, "PASS").otherwise("FAIL"))


def reconcile(left: DataFrame, right: DataFrame, scale: int = 2) -> DataFrame:
    """Two one-row totals side by side, their difference, and PASS if it is zero (a NULL total fails)."""
    diff = F.col(left.columns[0]) - F.col(right.columns[0])
    return (left.crossJoin(F.broadcast(right)).withColumn("diff", diff.cast(f"decimal(38,{scale})"))
                .withColumn("status", F.when(F.col("diff") == 0, "PASS").otherwise("FAIL")))


def key_violations(df: DataFrame, unique: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """One row: number of duplicated key values, and NULL counts per column.

    A single job: the table is grouped by the unique key (partial
    aggregation), and NULL counts ride along as per-group partial sums.
    """
    groups = df.groupBy(*unique).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in not_null])
    return groups.agg(F.count_if(F.col("_n") > 1).alias("duplicated_keys"),
                      *[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(c) for c in not_null])


_INTEGERS = ("byte", "short", "integer", "long")


def key_groups(df: DataFrame, unique: Sequence[str], not_null: Sequence[str] = ()) -> tuple[Column, DataFrame]:
    """A 64-bit hash of the key, and per hash: rows (``_n``), rows with a NULL (``_nulls``), rows it holds at most if all differ (``_most``).

    What is shuffled and held has a fixed, small width, whatever the key.  Where the last of
    several key columns is an integer, 64 consecutive values of it are one group and
    each row is a bit of it, so an order's lines are one group.
    """
    *others, last = unique
    spans = bool(others) and df.schema[last].dataType.typeName() in _INTEGERS
    key = F.xxhash64(*others, F.shiftright(last, 6)) if spans else F.xxhash64(*unique)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(last).bitwiseAND(F.lit(63)).cast("int")) if spans else F.lit(None).cast("bigint")
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in not_null), F.lit(False))
    groups = df.select(key.alias("_key"), bit.alias("_bit"), missing.alias("_missing")).groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_missing").alias("_nulls"),
        (F.bit_count(F.coalesce(F.bit_or("_bit"), F.lit(0).cast("bigint"))) if spans else F.lit(1)).alias("_most"))
    return key, groups


def assert_keys(df: DataFrame, table: str, unique: Sequence[str] = (),
                not_null: Sequence[str] = ()) -> DataFrame:
    """Raise ConstraintViolation if ``unique`` is duplicated or a ``not_null`` column is NULL.

    Meant for a table that was just written (only the key columns are read
    back).  Equal keys have equal hashes, so only rows whose hash repeats are compared by
    the key itself.  Returns ``df`` so it can be chained.
    """
    key, groups = key_groups(df, list(unique) or list(not_null[:1]), not_null)
    repeats = F.col("_n") > F.col("_most")
    found = groups.agg(F.count_if(repeats).alias("repeats"), F.sum("_nulls").alias("nulls")).first()
    problems = []
    if found["nulls"]:
        nulls = null_count(df, {c: c for c in not_null}).first()
        problems += [f"{c}: {nulls[c]} NULL" for c in not_null if nulls[c]]
    if unique and found["repeats"]:
        again = df.select(*unique, key.alias("_key")).join(groups.where(repeats).select("_key"), "_key", "left_semi")
        if duplicated := key_violations(again, unique).first()["duplicated_keys"]:
            problems.append(f"{duplicated} duplicated {tuple(unique)} values")
    if problems:
        raise ConstraintViolation(f"{table}: " + "; ".join(problems))
    return df


def assert_dense(df: DataFrame, table: str, key: str, not_null: Sequence[str] = ()) -> DataFrame:
    """Raise ConstraintViolation unless ``key`` runs from 1 to n, or if a ``not_null`` column is NULL.

    The sums of the keys and of their squares have closed forms; with the bounds and the
    count they are compared in one pass without a shuffle of rows.
    """
    k = F.col(key).cast("decimal(19,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"),
                 F.sum(k.cast("decimal(38,0)")).alias("s1"), F.sum((k * k).cast("decimal(38,0)")).alias("s2"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in not_null]).first()
    n, problems = row["n"], [f"{c}: {row['_null_' + c]} NULL" for c in not_null if row[f"_null_{c}"]]
    if n and (row["lo"], row["hi"], int(row["s1"]), int(row["s2"])) != (1, n, n * (n + 1) // 2, n * (n + 1) * (2 * n + 1) // 6):
        problems.append(f"{key} does not run from 1 to {n}")
    if problems:
        raise ConstraintViolation(f"{table}: " + "; ".join(problems))
    return df
