"""D/E: per-key reductions: distinct keys, latest non-NULL value, signal roll-ups.

All are single ``groupBy`` aggregations, so Spark aggregates partially on the map
side before the shuffle: a key holding a third of the rows is reduced to one row per
map task before it is shuffled, and no group is ever materialised in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GROUP BY keys without aggregates."""
    return df.select(*keys).distinct()


def latest_value(value: Column, order: Sequence[Column]) -> Column:
    """Aggregate: ``value`` of the row with the greatest ``order``, ignoring rows where
    ``value`` is NULL (E1). ``order`` should end with a tie key; the value itself is
    appended as the last tie-breaker so the result is deterministic even when the tie
    key repeats. Rows whose order columns are NULL sort lowest."""
    key = F.when(value.isNotNull(), F.struct(*order, value))
    return F.max_by(value, key)


def latest_non_null(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str] | dict[str, str],
) -> DataFrame:
    """Per key, the latest non-NULL value of each value column, by ``order``.

    Equivalent to ``filter(v is not null) + row_number() over (partition by keys order
    by order desc) = 1`` per value column, but one aggregation for all of them.
    """
    names = values if isinstance(values, dict) else {v: v for v in values}
    ord_cols = [F.col(o) for o in order]
    aggs = [latest_value(F.col(src), ord_cols).alias(out) for out, src in names.items()]
    cond = None
    for src in names.values():
        t = F.col(src).isNotNull()
        cond = t if cond is None else (cond | t)
    return df.where(cond).groupBy(*keys).agg(*aggs)


def signal_rollup(
    df: DataFrame,
    keys: Sequence[str],
    max_zero: dict[str, tuple[str, float | None]],
    latest: dict[str, str] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """D2-D4 + E1 in one aggregation.

    ``max_zero`` maps output -> (input, divisor): ``max(coalesce(input, 0)) / divisor``
    (NULL read as 0 *inside* the max, trap T8), as DOUBLE whatever type the input has. ``latest`` maps output -> input for
    latest-non-NULL values by ``order``.
    """
    aggs = []
    for out, (src, div) in max_zero.items():
        m = F.max(F.coalesce(F.col(src), F.lit(0))).cast("double")
        aggs.append((m / F.lit(div) if div else m).alias(out))
    ord_cols = [F.col(o) for o in order]
    for out, src in (latest or {}).items():
        aggs.append(latest_value(F.col(src), ord_cols).alias(out))
    return df.groupBy(*keys).agg(*aggs)
