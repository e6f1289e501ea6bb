"""State that is carried from run to run, so that a run reads new days only.

Both kinds of state are greatest elements of an order (the last event of a key; the maxima and
the last non-NULL values of a key and day). Merging is taking the maximum again, so states combine in any
order and any number of steps, combine on the map side, and a state merged twice does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.operators.asof import asof_latest
from funnelkit.operators.filters import since


# --- as-of (C1) --------------------------------------------------------------------------
def event_snapshot(events: DataFrame, by: str, ts: str, tie: Sequence[str], upto) -> DataFrame:
    """Each key's last event before ``upto``, as a row of ``events``: all that an as-of at or after ``upto`` can
    still need of the events before it. NULL keys and times match nothing and are left out."""
    rest = [c for c in events.columns if c not in (by, ts, *tie)]
    last = F.max(F.struct(ts, *tie, *rest)).alias("__last")
    before = events.where((F.col(ts) < upto) & F.col(by).isNotNull())
    return before.groupBy(by).agg(last).select(by, "__last.*").select(*events.columns)


def advance_snapshot(snapshot: DataFrame, events: DataFrame, by: str, ts: str, tie: Sequence[str], upto) -> DataFrame:
    """The snapshot as of a later ``upto``, from the snapshot and the events that came in since, late ones
    with an earlier time included. Events that the snapshot knows may be among them."""
    return event_snapshot(snapshot.unionByName(events.select(*snapshot.columns)), by, ts, tie, upto)


def asof_from_snapshot(
    left: DataFrame, snapshot: DataFrame, events: DataFrame, by: str, left_ts: str, right_ts: str, right_cols, floor, **options
) -> DataFrame:
    """``asof_latest`` for left rows at or after ``floor``, from the snapshot at ``floor`` and the events since.
    The log before ``floor`` is not read: the filter on ``right_ts`` reaches its scan."""
    right = snapshot.unionByName(since(events, right_ts, floor).select(*snapshot.columns))
    return asof_latest(left, right, by, left_ts, right_ts, right_cols, left_floor=floor, **options)


# --- roll-ups (D2-D4, E1) ----------------------------------------------------------------
def _entry(value: Column, order: Sequence[str]) -> Column:
    return F.when(value.isNotNull(), F.struct(*order, value.alias("value")))


def signal_state(
    df: DataFrame, keys: Sequence[str], ts: str, max_zero: dict[str, tuple[str, float | None]], latest: dict[str, str], order: Sequence[str]
) -> DataFrame:
    """``signal_rollup``'s state per key and day of ``ts``: maxima with NULL read as 0, undivided, and the last
    non-NULL value of each ``latest`` column with its order. Rows without a time belong to no day."""
    aggs = [F.max(F.coalesce(F.col(src), F.lit(0))).alias(out) for out, (src, _) in max_zero.items()]
    aggs += [F.max(_entry(F.col(src), order)).alias(out) for out, src in latest.items()]
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(*aggs)


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per ``keys`` (with "day" among them: per day) of any number of states."""
    return states.groupBy(*keys).agg(*[F.max(c).alias(c) for c in states.columns if c not in (*keys, "day")])


def finish_signals(state: DataFrame, keys: Sequence[str], max_zero: dict[str, tuple[str, float | None]], latest: dict[str, str]) -> DataFrame:
    """The roll-up's output of a merged state."""
    cols = []
    for out, (_, div) in max_zero.items():
        m = F.col(out).cast("double")
        cols.append((m / F.lit(div) if div else m).alias(out))
    return state.select(*keys, *cols, *[F.col(out)["value"].alias(out) for out in latest])


def distinct_state(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """``distinct_keys`` per day: (keys, day). Its merge is ``distinct_keys`` of the days wanted."""
    return df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("date").alias("day")).distinct()


# --- state tables ------------------------------------------------------------------------
def write_days(states: DataFrame, path: str) -> None:
    """Put the days that ``states`` holds into the table at ``path``, partitioned by day; other days stay. Written
    again, a day is replaced, so a failed refresh is simply repeated."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, since) -> DataFrame:
    """States from day ``since`` on; earlier partitions are not listed for reading."""
    return spark.read.parquet(path).where(F.col("day") >= since)
