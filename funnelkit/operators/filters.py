"""B: row filters. Every predicate is written on bare columns against literals so
Catalyst can push it into the parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions.columns import ColumnOrName, _c
from funnelkit.functions.dates import _date_lit, lookback_start


#: Columns a table may be partitioned by, named after its time column: its date, or the first day of its month.
PERIODS = {"_date": "day", "_month": "month"}


def since(df: DataFrame, ts_col: str, bound: Column) -> DataFrame:
    """Rows whose time is at or after ``bound``, a date (its midnight).

    Where the frame has the time's date or month as a column (``created_month`` beside ``created``), which a large
    log is partitioned by, that is compared too: the scan then lists and reads these partitions only."""
    cond = F.col(ts_col) >= bound
    for suffix, unit in PERIODS.items():
        if ts_col + suffix in df.columns:
            cond = cond & (F.col(ts_col + suffix) >= F.trunc(bound, unit) if unit != "day" else F.col(ts_col + suffix) >= bound)
    return df.where(cond)


def lookback(df: DataFrame, ts_col: str, start, days: int = 365) -> DataFrame:
    """B1: keep rows whose event time is on or after ``start - days`` (midnight)."""
    return since(df, ts_col, lookback_start(start, days))


def stage_prefilter(
    df: DataFrame,
    count_col: str,
    dedupe_col: str | None,
    state_col: str,
    states: Sequence[str],
) -> DataFrame:
    """A stage row counts when it ran at least one decider, is the kept copy after
    de-duplication and ended in one of ``states``. Applied before the stitch: a full
    outer join would block pushing it down afterwards."""
    cond = F.coalesce(F.col(count_col), F.lit(0)) > 0
    if dedupe_col is not None:
        cond = cond & (F.col(dedupe_col) == 1)
    return df.where(cond & F.col(state_col).isin(*states))


def window_condition(
    start,
    start_cols: Sequence[ColumnOrName],
    capture_cols: Sequence[ColumnOrName],
    applied_cols: Sequence[ColumnOrName],
) -> Column:
    """B6 + B7 as one predicate: (coalesced start date >= start OR coalesced capture
    date >= start) AND coalesce(applied..., 0) > 0."""
    s = _date_lit(start)
    started = F.coalesce(*[_c(c) for c in start_cols]).cast("date") >= s
    captured = F.coalesce(*[_c(c) for c in capture_cols]).cast("date") >= s
    applied = F.coalesce(*[_c(c) for c in applied_cols], F.lit(0)) > 0
    return (started | captured) & applied


def report_window(
    df: DataFrame,
    start,
    start_cols: Sequence[ColumnOrName],
    capture_cols: Sequence[ColumnOrName],
    applied_cols: Sequence[ColumnOrName],
) -> DataFrame:
    """The reporting-window gate applied after the stitch."""
    return df.where(window_condition(start, start_cols, capture_cols, applied_cols))
