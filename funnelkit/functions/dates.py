"""Date helpers: lookback bounds, the start-date gate, two month differences."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelkit.functions.columns import ColumnOrName, _c


def _date_lit(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def lookback_start(start, days: int) -> Column:
    """First instant of the lookback window: ``start - days`` at midnight.

    Comparing a bare timestamp column with this literal keeps the predicate pushable
    to the parquet scan (a ``cast(ts as date)`` on the column side would not be).
    """
    return F.date_sub(_date_lit(start), days)


def date_gate(col: ColumnOrName, start) -> Column:
    """the value's date if it is on or after ``start``, else NULL."""
    d = _c(col).cast("date")
    return F.when(d >= _date_lit(start), d)


def months_fractional(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Fractional months between two dates (whole months when the days of month
    agree or both are month ends, otherwise the day difference over 31)."""
    return F.months_between(_c(later).cast("date"), _c(earlier).cast("date"))


def month_boundaries(earlier: ColumnOrName, later: ColumnOrName) -> Column:
    """I2 / trap T1: number of month boundaries crossed from ``earlier`` to ``later``
    (Jan 31 -> Feb 1 is 1). This is the warehouse ``datediff(month, a, b)``; Spark's
    own ``datediff``-by-month counts whole months and differs."""
    a, b = _c(earlier).cast("date"), _c(later).cast("date")
    return (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))
