"""Operators over one global order, without a single-partition sort.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.  For
tables that grow with the data (customers, products, orders) the global
position of each row is computed instead as

1. range-partition on the full (unique) order key, sort inside partitions and
   tag each row with ``monotonically_increasing_id`` (partition index in the
   high bits, row index inside the partition in the low 33 bits);
2. cut lineage with a reliable ``checkpoint`` so the range bounds and the tags
   are fixed even if a task is retried;
3. count rows per partition (one small row per partition — bounded by the
   partition count, not by the data) and turn the counts into prefix offsets,
   a constant array in the plan;
4. position = offset[partition] + index inside partition + 1.

Surrogate keys, NTILE buckets and exact percentiles are pure functions of the
position and the total count.  The order key must be unique (add a tie-break
column) so ties never pile up in one range partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.quality import ConstraintViolation
from bazaar.session import checkpoint_root

_LOW_BITS = (1 << 33) - 1


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_position(df: DataFrame, order_by: Sequence[str | Column], out: str = "_pos",
                    total: str | None = None, num_partitions: int | None = None,
                    key: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order_by`` order (BIGINT).

    ``order_by`` may hold sort expressions (``F.col(x).desc_nulls_first()``)
    and must identify rows uniquely for a deterministic numbering.  With
    ``total`` the overall row count is added as a column too.  With ``key`` (the
    only column of the order) that column is checked on the way: equal values are
    neighbours in one sorted range, so a repeated or NULL value is noticed without a
    shuffle of its own and raises ``ConstraintViolation``.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    # Without an explicit count AQE sizes the range partitions from the data
    # (it only merges contiguous ranges, so the global order is kept).
    order = _as_cols(order_by)
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order)
    if key:
        # The ranges are by the key alone, so the window needs no exchange.
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        ranged = ranged.withColumn("_again", (nth > 1) | F.col(key).isNull())
    tagged = ranged.withColumn("_rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright(F.col("_rid"), 33).cast("int")
    # One small row per range partition (p is the partition count, not a data
    # size): prefix offsets become a constant array looked up per row.
    again = F.count_if("_again") if key else F.lit(0)
    rows = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), again.alias("_again")).collect()
    if any(r["_again"] for r in rows):
        raise ConstraintViolation(f"{key}: {sum(r['_again'] for r in rows)} NULL or repeated values")
    counts = {r["_part"]: r["_n"] for r in rows}
    offsets, run = [], 0
    for i in range(max(counts, default=0) + 1):   # as many partitions as the rows lie in
        offsets.append(run)
        run += counts.get(i, 0)
    offset = F.element_at(F.lit(offsets).cast("array<bigint>"), part + 1)   # one array literal
    pos = offset + F.col("_rid").bitwiseAND(F.lit(_LOW_BITS)) + 1
    res = tagged.withColumn(out, pos.cast("bigint"))
    if total:
        res = res.withColumn(total, F.lit(run).cast("bigint"))
    return res.drop("_rid", "_again") if key else res.drop("_rid")


def surrogate_key(df: DataFrame, name: str, order_by: Sequence[str], known: DataFrame | None = None,
                  check: bool = False) -> DataFrame:
    """Dense BIGINT key 1..n in natural-key order, placed as the first column.

    With ``known`` (natural key and ``name`` of an earlier load) known rows keep
    their keys; newcomers follow the largest of them, in natural-key order.
    ``check`` raises if the natural key (one column) repeats or is NULL among the
    numbered rows.
    """
    key = order_by[0] if check and len(order_by) == 1 else None
    if known is None:
        return global_position(df, order_by, out=name, key=key).select(name, *df.columns)
    held = known.select(*order_by, name)
    last = held.agg(F.max(name)).first()[0] or 0
    new = global_position(df.select(*order_by).join(held, list(order_by), "left_anti"), order_by, out=name, key=key)
    every = held.unionByName(new.withColumn(name, F.col(name) + F.lit(last)))
    return df.join(every, list(order_by), "left").select(name, *df.columns)


def ntile_from_position(pos: Column, total: Column, n: int) -> Column:
    """NTILE(n) bucket of a 1-based position among ``total`` rows (INT).

    The first ``total % n`` buckets hold ``total div n + 1`` rows, the others
    ``total div n`` rows.
    """
    i0 = pos - 1
    q = ((total - total % n) / n).cast("bigint")
    r = (total % n).cast("bigint")
    big = r * (q + 1)
    in_big = (i0 - i0 % (q + 1)) / (q + 1) + 1
    # q == 0 means every row is in a "big" bucket; guard the divisor.
    safe_q = F.when(q == 0, F.lit(1)).otherwise(q)
    in_small = ((i0 - big) - (i0 - big) % safe_q) / safe_q + r + 1
    return F.when(i0 < big, in_big).otherwise(in_small).cast("int")


def ntile_global(df: DataFrame, n: int, order_by: Sequence[str | Column], out: str) -> DataFrame:
    """NTILE(n) OVER (ORDER BY order_by) without a single-partition window."""
    ranked = global_position(df, order_by, out="_npos", total="_ntotal")
    return (ranked.withColumn(out, ntile_from_position(F.col("_npos"), F.col("_ntotal"), n))
                  .drop("_npos", "_ntotal"))


# Rows that a selection brings to the driver at last, and cells that it counts in a pass.
FEW, CELLS = 10_000, 1024


@dataclass(frozen=True)
class Ordered:
    """One column of an order, its direction and where NULLs go."""

    column: str
    ascending: bool = True
    nulls_first: bool = False

    def sort(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()

    def after(self, value) -> Column:
        """The row's value comes after ``value`` in this order."""
        c = F.col(self.column)
        if value is None:
            return c.isNotNull() if self.nulls_first else F.lit(False)
        later = F.coalesce(c > F.lit(value) if self.ascending else c < F.lit(value), F.lit(False))
        return later if self.nulls_first else c.isNull() | later


def ntile_bounds(df: DataFrame, n: int, order: Sequence[Ordered]) -> list[tuple]:
    """Order-column values of the last row of each NTILE(n) bucket but the last non-empty one.

    ``order`` is a numeric column and a unique tie-break.  The rows are selected by
    rank (``select_at``); nothing is sorted.  ``df`` is read several times: store it.
    """
    total = df.count()
    q, r = divmod(total, n)
    ends = [b * q + min(b, r) for b in range(1, min(n, total))]
    return select_at(df, order, ends)


@dataclass
class _Interval:
    """Rows whose value lies in [low, high] (NULLs if ``null``), and the ranks wanted among them."""

    null: bool
    low: object
    high: object
    rows: int
    wanted: list            # (place in the answer, rank among the interval's rows)

    def holds(self, key: Column) -> Column:
        return key.isNull() if self.null else F.coalesce(key.between(F.lit(self.low), F.lit(self.high)), F.lit(False))


def _hand_out(cells: list[tuple], wanted: list) -> list[tuple[int, list]]:
    """(cell, ranks inside it) of cells in order, (..., weight) each, for the ranks wanted over all."""
    out, run = [], 0
    for i, cell in enumerate(cells):
        inside = [(at, rank - run) for at, rank in wanted if run < rank <= run + cell[-1]]
        if inside:
            out.append((i, inside))
        run += cell[-1]
    return out


def select_at(df: DataFrame, order: Sequence[Ordered], ranks: Sequence[int], weight: str | None = None,
              few: int = FEW, cells: int = CELLS) -> list[tuple]:
    """The rows at some 1-based ranks in an order, by counting cells that shrink; nothing is sorted.

    ``order`` is a numeric column and, where that has ties, a column that is unique
    among them: numeric, or a string (ascending, NULLs last); a row counts ``weight`` times.  A
    pass counts the rows per cell of each interval in question and goes on in
    the cells that hold a rank, until an interval holds one value or at most ``few``
    rows, which come to the driver.  Ties are told apart in the same way, a string column by
    longer and longer beginnings.  ``df`` is read once a pass: store it.
    """
    value, tie = order[0], order[1] if len(order) > 1 else None
    key = F.col(value.column) if value.ascending else -F.col(value.column)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    frame = df.select(key.alias("_v"), *([F.col(tie.column).alias("_t")] if tie else []), *([weight] if weight else []))
    v = F.col("_v")
    groups = frame.groupBy(v.isNull().alias("null")).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("rows"), n.alias("n")).collect()
    groups.sort(key=lambda r: r["null"] != value.nulls_first)
    parts = _hand_out([(r["n"],) for r in groups], list(enumerate(ranks)))
    todo = [_Interval(groups[i]["null"], groups[i]["lo"], groups[i]["hi"], groups[i]["rows"], inside) for i, inside in parts]
    answer: list = [None] * len(ranks)
    original = lambda x: x if value.ascending or x is None else -x
    while todo:
        done = [t for t in todo if t.rows <= few or t.null or t.low == t.high]
        for t in done:
            if t.rows <= few:
                rows = sorted((tuple(r) for r in frame.where(t.holds(v)).collect()), key=lambda r: (r[0] is None, r[0] or 0, *(_sortable(r[1], tie) if tie else ())))
                for i, inside in _hand_out([(*r, 1) if not weight else r for r in rows], t.wanted):
                    for at, _ in inside:
                        answer[at] = (original(rows[i][0]), *(rows[i][1:2] if tie else ()))
            elif not tie:
                for at, _ in t.wanted:
                    answer[at] = (original(t.low),)
            else:
                among = frame.where(t.holds(v))
                for (at, _), (x,) in zip(t.wanted, _select_tie(among, tie, [r for _, r in t.wanted], weight, few, cells)):
                    answer[at] = (original(t.low), x)
        todo = [t for t in todo if not any(t is d for d in done)]
        if todo:
            todo = _narrowed(frame, v, todo, n, cells)
    return answer


def _sortable(x, order: Ordered) -> tuple:
    if x is None:
        return (not order.nulls_first, 0)
    return (order.nulls_first, x.encode() if isinstance(x, str) else x if order.ascending else -x)


def _narrowed(frame: DataFrame, v: Column, todo: list[_Interval], n: Column, cells: int) -> list[_Interval]:
    """One pass: the cells of some intervals that hold a wanted rank."""
    which, cell = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i, t in enumerate(todo):
        low, width = float(t.low), (float(t.high) - float(t.low)) / cells
        # Monotone in the value; where doubles cannot tell values apart, each value is a cell.
        at = F.floor((v.cast("double") - F.lit(low)) / F.lit(width)).cast("double") if width > 0 else F.lit(0.0)
        which, cell = F.when(t.holds(v), F.lit(i)).otherwise(which), F.when(t.holds(v), at).otherwise(cell)
    exact = [i for i, t in enumerate(todo) if float(t.high) <= float(t.low)]
    by = [which.alias("which"), cell.alias("cell"), F.when(which.isin(exact), v).alias("exact")]
    counted = frame.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("rows"), n.alias("n")).where("which IS NOT NULL").collect()
    out = []
    for i, t in enumerate(todo):
        mine = sorted((r for r in counted if r["which"] == i), key=lambda r: r["lo"])
        out += [_Interval(False, mine[k]["lo"], mine[k]["hi"], mine[k]["rows"], inside) for k, inside in _hand_out([(r["n"],) for r in mine], t.wanted)]
    return out


def _select_tie(among: DataFrame, tie: Ordered, ranks: list[int], weight: str | None, few: int, cells: int) -> list[tuple]:
    """Values of ``_t`` at some ranks."""
    if among.schema["_t"].dataType.typeName() != "string":
        return select_at(among.select("_t", *([weight] if weight else [])), [Ordered("_t", tie.ascending, tie.nulls_first)], ranks, weight, few, cells)
    if not tie.ascending or tie.nulls_first:
        raise ValueError("a string tie-break is ascending, NULLs last")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    answer: list = [None] * len(ranks)
    todo = [("", -1, list(enumerate(ranks)))]   # beginning, rows with it (-1: not counted yet), ranks
    while todo:
        start, rows, wanted = todo.pop()
        mine = among.where(F.startswith("_t", F.lit(start))) if start else among
        if 0 <= rows <= few:
            held = sorted(((r["_t"], r[weight] if weight else 1) for r in mine.collect()), key=lambda r: _sortable(r[0], tie))
            for i, inside in _hand_out(held, wanted):
                for at, _ in inside:
                    answer[at] = (held[i][0],)
            continue
        cell = F.substring("_t", 1, len(start) + 2)
        found = [tuple(r) for r in mine.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"), n.alias("n")).collect()]
        found.sort(key=lambda r: _sortable(r[0], tie))
        for i, inside in _hand_out(found, wanted):
            text, rows, _ = found[i]
            if text is None or len(text) < len(start) + 2:   # whole values, all equal
                for at, _ in inside:
                    answer[at] = (text,)
            else:
                todo.append((text, rows, inside))
    return answer


def ntile_by_bounds(bounds: Sequence[tuple], order: Sequence[Ordered]) -> Column:
    """Bucket number (INT): 1 + how many of the bounds the row comes after."""
    def after(bound: tuple) -> Column:
        out = F.lit(False)
        for o, value in reversed(list(zip(order, bound))):
            out = o.after(value) | (F.col(o.column).eqNullSafe(F.lit(value)) & out)
        return out

    return reduce(lambda a, b: a + b, (after(b).cast("int") for b in bounds), F.lit(1))


def percentile_cont_global(df: DataFrame, value: str, fraction: float, out: str,
                           also: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Exact PERCENTILE_CONT(fraction) WITHIN GROUP (ORDER BY value), one row (DOUBLE).

    Rows are first reduced to distinct values and their counts, which are stored;
    the one or two values at the bracketing ranks are selected by rank, without a sort.
    NULL values are ignored, as in SQL; an empty input yields NULL.  ``also`` holds
    (name, aggregate) pairs over columns ``value`` and ``_n`` (rows with that value)
    of the same reduced rows.
    """
    checkpoint_root(df.sparkSession)
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
    extra = counted.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(name) for name, c in also])
    total = counted.agg(F.sum("_n")).first()[0] or 0
    if not total:
        return extra.withColumn(out, F.lit(None).cast("double")).drop("_rows")
    rank = 1 + fraction * (total - 1)
    low, high = (float(v) for (v,) in select_at(counted, [Ordered(value)], [math.floor(rank), math.ceil(rank)], weight="_n"))
    return extra.withColumn(out, F.lit(low) + F.lit(high - low) * F.lit(rank - math.floor(rank))).drop("_rows")


def rank_desc(df: DataFrame, measure: str, tie_break: Sequence[str], out: str) -> DataFrame:
    """RANK() OVER (ORDER BY measure DESC) for every row, without a single-partition window.

    Rows get their global position in (measure DESC NULLS FIRST, tie_break)
    order; a row's RANK is the smallest position among rows with the same
    measure (ties share it, gaps follow).  That minimum is one aggregate per
    distinct value, joined back null-safely (NULL measures are peers).
    """
    order = [F.col(measure).desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    ranked = global_position(df, order, out="_rpos")
    first = ranked.groupBy(F.col(measure).alias("_rv")).agg(F.min("_rpos").alias(out))
    joined = ranked.join(first, ranked[measure].eqNullSafe(first["_rv"]))
    return joined.drop("_rv", "_rpos").withColumn(out, F.col(out).cast("int"))


def top_k_ranked(df: DataFrame, measure: str, k: int, tie_break: Sequence[str],
                 rank_col: str) -> DataFrame:
    """The k rows with the largest ``measure`` plus their RANK() over the whole table.

    RANK of a top row = 1 + rows with a larger measure, and all of those are in
    the top k themselves, so ranking the k rows alone is exact.  The top-k is a
    per-partition bounded heap (TakeOrderedAndProject); the rank window sees k
    rows.  NULL measures sort first, as in a descending SQL ORDER BY.
    """
    order = [F.col(measure).desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    top = df.orderBy(*order).limit(k)
    return top.withColumn(rank_col, F.rank().over(Window.orderBy(F.col(measure).desc_nulls_first())))
