"""Backward as-of join.

For every left row (a decision) find the right row (a state event) of the same key
with the greatest ``(right_ts, tie)`` such that ``right_ts <= left_ts``; left rows
without one keep NULLs. The matched event travels as one struct, so an event whose
state is NULL still wins over an older non-NULL one (trap T2).

Plan: both sides are unioned and a running ``last(struct, ignorenulls)`` is taken
over a window ordered by time, events before decisions at equal time. This is linear
in the input, unlike a range join followed by ``row_number`` which multiplies rows
per key before filtering.

Hot keys. A window partitioned by the key alone puts one key's rows in one task. With
``bucket_seconds`` set, the work is split by (key, time bucket):

1. per (key, bucket) the last event of the bucket (an aggregation: map-side partial);
2. per key, the carry-in of each decision bucket = last event of any *earlier*
   bucket (a window over per-bucket summaries: at most two rows per bucket and key,
   bounded by the time span, not by the data volume);
3. per (key, bucket) the running window over decisions, the bucket's events and the
   carry-in row sorted first.

NULL keys on the left can match nothing; they are partitioned by a salted key so
they do not pile into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.functions.columns import match_key, salted_key

_SIDE = "__asof_side"
_TS = "__asof_ts"
_EVT = "__asof_evt"
_KEY = "__asof_key"
_BKT = "__asof_bucket"
_ORD = "__asof_ord"


def time_bucket(col: Column, dtype: T.DataType, seconds: int) -> Column:
    """Bucket number of a time value, non-decreasing in time.

    Wall-clock timestamps (``TIMESTAMP_NTZ``) are bucketed on their own fields, so no
    time-zone shift can reorder them; zone-aware timestamps on epoch seconds.
    """
    if isinstance(dtype, T.TimestampType):
        secs = F.unix_seconds(col)
    else:
        days = F.datediff(F.to_date(col), F.lit("1970-01-01").cast("date")).cast("long")
        secs = days * 86400
        if isinstance(dtype, T.TimestampNTZType):
            secs = secs + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)
    return F.floor(secs / F.lit(seconds))


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_ts: str,
    right_ts: str,
    right_cols: Sequence[str] | dict[str, str],
    tie: Sequence[str] = (),
    left_salt: Sequence[str] = (),
    bucket_seconds: int | None = None,
    left_floor: Column | None = None,
) -> DataFrame:
    """Return ``left`` plus the matched event's columns (``right_cols`` maps output
    name -> right column; a list keeps the names).

    ``tie`` orders events with equal time (the last one wins); the whole event is the
    final ordering key, so even repeated (time, tie) pairs resolve the same way when a
    lost task is recomputed. ``left_salt`` names left columns hashed to spread NULL
    keys (default: all left columns).

    ``left_floor`` promises that no left row is earlier. Of all events before it only each key's
    last can be matched, so with buckets they form one bucket that is only summarised.
    """
    outs = right_cols if isinstance(right_cols, dict) else {c: c for c in right_cols}
    left_cols = left.columns
    salt = list(left_salt) or left_cols

    # Event payload: ordering fields first so struct comparison orders by time, tie.
    payload_fields = [F.col(right_ts).alias("t")] + [F.col(c).alias(f"k{i}") for i, c in enumerate(tie)]
    payload_fields += [F.col(src).alias(out) for out, src in outs.items()]
    ev = right.where(F.col(right_ts).isNotNull() & F.col(by).isNotNull()).select(
        match_key(left, right, by, by).alias(_KEY),
        F.col(right_ts).alias(_TS),
        *[F.col(c).alias(f"__asof_tie{i}") for i, c in enumerate(tie)],
        F.struct(*payload_fields).alias(_EVT),
    )
    key_expr = salted_key(left, by, *salt)
    dec = left.select(*[F.col(c) for c in left_cols], key_expr.alias(_KEY), F.col(left_ts).alias(_TS))
    tie_cols = [f"__asof_tie{i}" for i in range(len(tie))]

    if bucket_seconds is None:
        u = dec.withColumn(_SIDE, F.lit(1)).unionByName(
            ev.withColumn(_SIDE, F.lit(0)), allowMissingColumns=True
        )
        w = (
            Window.partitionBy(_KEY)
            .orderBy(F.col(_TS).asc_nulls_first(), F.col(_SIDE), *[F.col(t) for t in tie_cols], F.col(_EVT))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        matched = u.withColumn(_EVT, F.last(_EVT, ignorenulls=True).over(w)).where(F.col(_SIDE) == 1)
    else:
        ltype = left.schema[left_ts].dataType
        rtype = right.schema[right_ts].dataType
        if type(ltype) is not type(rtype):
            raise TypeError(f"as-of times differ in type: {ltype} vs {rtype}")
        dec = dec.withColumn(_BKT, time_bucket(F.col(_TS), ltype, bucket_seconds))
        ev = ev.withColumn(_BKT, time_bucket(F.col(_TS), rtype, bucket_seconds))
        inside = ev
        if left_floor is not None:
            before = time_bucket(left_floor.cast(rtype), rtype, bucket_seconds) - 1
            ev = ev.withColumn(_BKT, F.when(F.col(_TS) < left_floor, before).otherwise(F.col(_BKT)))
            inside = inside.where(F.col(_TS) >= left_floor)
        # 1. last event per (key, bucket): struct max orders by (t, tie...) first.
        summary = ev.groupBy(_KEY, _BKT).agg(F.max(_EVT).alias(_EVT)).withColumn(_SIDE, F.lit(1))
        # 2. carry-in per decision bucket from strictly earlier buckets.
        dbuckets = dec.where(F.col(_TS).isNotNull()).select(_KEY, _BKT).distinct().withColumn(_SIDE, F.lit(0))
        wk = (
            Window.partitionBy(_KEY)
            .orderBy(F.col(_BKT), F.col(_SIDE))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        carry = (
            dbuckets.unionByName(summary, allowMissingColumns=True)
            .withColumn(_EVT, F.last(_EVT, ignorenulls=True).over(wk))
            .where((F.col(_SIDE) == 0) & F.col(_EVT).isNotNull())
            .select(_KEY, _BKT, _EVT)
        )
        # 3. running window inside (key, bucket); carry-in row first.
        u = (
            dec.withColumn(_SIDE, F.lit(1)).withColumn(_ORD, F.lit(1))
            .unionByName(inside.withColumn(_SIDE, F.lit(0)).withColumn(_ORD, F.lit(1)), allowMissingColumns=True)
            .unionByName(carry.withColumn(_SIDE, F.lit(0)).withColumn(_ORD, F.lit(0)), allowMissingColumns=True)
        )
        w = (
            Window.partitionBy(_KEY, _BKT)
            .orderBy(F.col(_ORD), F.col(_TS).asc_nulls_first(), F.col(_SIDE), *[F.col(t) for t in tie_cols], F.col(_EVT))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        matched = u.withColumn(_EVT, F.last(_EVT, ignorenulls=True).over(w)).where(F.col(_SIDE) == 1)

    # A NULL decision time or key matches nothing, whatever its salted key met in the window.
    evt = F.when(F.col(_TS).isNotNull() & F.col(by).isNotNull(), F.col(_EVT))
    return matched.select(*[F.col(c) for c in left_cols], *[evt.getField(o).alias(o) for o in outs])
