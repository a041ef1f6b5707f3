"""Calendar arithmetic as built-in Column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(ts: Column) -> Column:
    """First day of the month as a DATE (DATE_TRUNC('month', ts)::date)."""
    return F.trunc(ts, "MM")


def month_index(d: Column) -> Column:
    """Months since year 0, so that month differences are plain subtraction."""
    return F.year(d) * 12 + F.month(d)


def months_apart(later: Column, earlier: Column) -> Column:
    """12 * (year difference) + (month difference), ignoring days: INT."""
    return (month_index(later) - month_index(earlier)).cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    """later::date - earlier::date as INT days."""
    return F.datediff(F.to_date(later), F.to_date(earlier))


def whole_months_between(later: Column, earlier: Column) -> Column:
    """Whole months of an age interval, with borrowing (INT).

    Equals 12 * years + months of the calendar age from ``earlier`` to
    ``later``: a month is borrowed when the later (day of month, time of day)
    is before the earlier one.  Unlike ``months_between`` it is not fooled by
    month ends (Jan 31 -> Feb 29 is 0 whole months) or by time of day.
    Defined for later >= earlier.
    """
    key = "dd HH:mm:ss.SSSSSS"
    borrow = (F.date_format(later, key) < F.date_format(earlier, key)).cast("int")
    return (months_apart(later, earlier) - borrow).cast("int")
