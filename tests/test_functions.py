"""Row-level functions: month differences (T1), slots (T10, T14), null-safe sum, gates."""

import datetime as dt

from pyspark.sql import functions as F

from funnelkit.functions import (
    date_gate, is_missing, month_boundaries, months_fractional, not_in_list, null_safe_sum,
    slot_count_leading, slot_max, slot_min, slot_min_sentinel,
)

D = dt.date


def test_month_boundaries_vs_whole_months(spark):
    rows = [
        (D(2024, 1, 31), D(2024, 2, 1)),   # crosses one boundary, zero whole months
        (D(2024, 1, 15), D(2024, 1, 15)),  # same day
        (D(2024, 1, 31), D(2024, 2, 29)),  # both month ends
        (D(2024, 3, 1), D(2024, 1, 31)),   # reversed
        (None, D(2024, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "a date, b date")
    out = df.select(month_boundaries("a", "b").alias("mb"), months_fractional("b", "a").alias("mf")).collect()
    assert [r.mb for r in out] == [1, 0, 1, -2, None]
    assert out[0].mf == round(1 - 30 / 31, 8)                           # fractional, not 1
    assert out[1].mf == 0.0
    assert out[2].mf == 1.0
    assert out[4].mf is None


def test_months_fractional_formula(spark):
    df = spark.createDataFrame([(D(2024, 3, 10), D(2024, 1, 25))], "a date, b date")
    v = df.select(months_fractional("a", "b").alias("m")).first().m
    assert v == round(2 + (10 - 25) / 31, 8)


def test_slots_min_max_and_sentinel(spark):
    rows = [(None, None, None), (3.0, None, 1.0), (2.0, 2.0, 2.0), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    out = df.select(
        slot_min(["a", "b", "c"]).alias("mn"),
        slot_max(["a", "b", "c"]).alias("mx"),
        slot_min_sentinel(["a", "b", "c"], 999999.0).alias("leak"),
        slot_min_sentinel(["a", "b", "c"], 999999.0, leak=False).alias("noleak"),
        slot_count_leading(["a", "b", "c"]).alias("lead"),
    ).collect()
    assert [(r.mn, r.mx) for r in out] == [(None, None), (1.0, 3.0), (2.0, 2.0), (5.0, 5.0)]
    assert [r.leak for r in out] == [999999.0, 1.0, 2.0, 5.0]          # T10: sentinel leaks
    assert [r.noleak for r in out] == [None, 1.0, 2.0, 5.0]
    assert [r.lead for r in out] == [0, 1, 3, 0]                        # T14: must be consecutive
    for r in out:
        assert (r.mn is None and r.mx is None) or r.mn <= r.mx


def test_null_safe_sum_and_missing(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (2.0, 3.0)], "g double, x double")
    out = df.select(null_safe_sum("g", "x", "g").alias("s"), is_missing(F.col("x")).alias("m")).collect()
    assert [r.s for r in out] == [None, 2.0, 5.0]
    assert [r.m for r in out] == [False, True, False]


def test_not_in_null_falls_through(spark):
    df = spark.createDataFrame([(None,), (1,), (3,)], "m int")
    out = df.select(F.when(not_in_list("m", [1, 2]), "out").otherwise("in").alias("x")).collect()
    assert [r.x for r in out] == ["in", "in", "out"]                    # T3


def test_date_gate_never_before_start(spark):
    rows = [(dt.datetime(1999, 12, 31, 23, 59),), (dt.datetime(2000, 1, 1, 0, 0),), (None,)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    out = [r.d for r in df.select(date_gate("t", "2000-01-01").alias("d")).collect()]
    assert out == [None, D(2000, 1, 1), None]
