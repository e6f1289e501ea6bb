"""Carried state against full recomputation, and partitioned logs."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from funnelkit.operators import (
    advance_snapshot, asof_from_snapshot, asof_latest, distinct_state, event_snapshot, finish_signals, merge_states, read_days,
    signal_rollup, signal_state, write_days,
)
from funnelkit.plans.mart import (
    card_state, card_state_snapshot, no_file_keys, signals_from_states, underwriting_signals, underwriting_states,
)
from funnelkit.plans.params import MartParams
from funnelkit.sources.fixture import roles
from funnelkit.sources.schemas import check_roles, read_roles

SF = "/root/testdata/sf0.001"
BASE = dt.datetime(2024, 1, 1)


def _events(rnd, n, days, start=0):
    hot = lambda: 1 if rnd.random() < 0.34 else rnd.choice([None, 2, 3, 4, 5])
    time = lambda: None if rnd.random() < 0.04 else BASE + dt.timedelta(minutes=rnd.randrange(0, 1440 * days, 120))
    return [(start + i, hot(), time(), None if rnd.random() < 0.2 else f"s{i}") for i in range(n)]


EVENT = "event_id int, user_id int, created timestamp_ntz, state_to string"


def _day(n):
    return F.lit((BASE + dt.timedelta(days=n)).date())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_of_from_a_snapshot_equals_the_full_log(spark, seed):
    """Snapshots taken in steps, with late events and events sent twice; ties at the floor."""
    rnd = random.Random(seed)
    rows = _events(rnd, 400, 12)
    left = spark.createDataFrame([(i, u, t) for i, u, t, _ in _events(rnd, 200, 12, 1000)], "decision_id int, user_id int, created timestamp_ntz")
    left = left.where(F.col("created") >= _day(8))
    whole = spark.createDataFrame(rows, EVENT)
    late = [r for r in rows if rnd.random() < 0.1]  # arrive after the first snapshot, whatever their time
    first = spark.createDataFrame([r for r in rows if r not in late], EVENT).where(F.col("created") < _day(5))
    since_then = spark.createDataFrame(late + [r for r in rows if r[2] and r[2] >= BASE + dt.timedelta(days=4)], EVENT)
    snapshot = event_snapshot(first, "user_id", "created", ["event_id"], _day(3))
    snapshot = advance_snapshot(snapshot, first, "user_id", "created", ["event_id"], _day(5))
    snapshot = advance_snapshot(snapshot, since_then, "user_id", "created", ["event_id"], _day(8))
    assert snapshot.columns == whole.columns and snapshot.count() == snapshot.select("user_id").distinct().count() <= 5
    out = {"eid": "event_id", "state": "state_to"}
    want = asof_latest(left, whole, "user_id", "created", "created", out, tie=["event_id"])
    for bucket in (None, 3600):
        got = asof_from_snapshot(left, snapshot, whole, "user_id", "created", "created", out, _day(8), tie=["event_id"], bucket_seconds=bucket)
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_snapshots_merge_in_any_order(spark):
    rnd = random.Random(7)
    rows = _events(rnd, 300, 9)
    parts = [spark.createDataFrame(rows[i::3], EVENT) for i in range(3)]
    args = ("user_id", "created", ["event_id"], _day(6))
    want = sorted(event_snapshot(spark.createDataFrame(rows, EVENT), *args).collect())
    for order in ((0, 1, 2), (2, 0, 1), (1, 1, 2, 0)):
        snapshot = event_snapshot(parts[order[0]], *args)
        for i in order[1:]:
            snapshot = advance_snapshot(snapshot, parts[i], *args)
        assert sorted(snapshot.collect()) == want
    empty = spark.createDataFrame([], EVENT)
    assert event_snapshot(empty, *args).collect() == []
    assert sorted(advance_snapshot(event_snapshot(empty, *args), spark.createDataFrame(rows, EVENT), *args).collect()) == want


def test_the_log_before_the_snapshot_is_not_read(spark):
    path = tempfile.mkdtemp(prefix="run-log-", dir="/tmp") + "/events"
    s = roles(spark, SF)
    s["card_state_event"].write.parquet(path)
    p = MartParams(start=dt.date(2025, 1, 15))
    log = read_roles(spark, {"card_state_event": path})["card_state_event"]
    snapshot = spark.createDataFrame(card_state_snapshot(log, p).collect(), log.schema)
    out = card_state(s["prequal_decision"], log, p, bucket_seconds=3600, snapshot=snapshot)
    scans = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Scan parquet" in line and "state_to" in line]
    assert scans and all("GreaterThanOrEqual(created,2024-01-16T00:00)" in line for line in scans)
    full = card_state(s["prequal_decision"], log, p, bucket_seconds=3600)
    assert out.exceptAll(full).count() == full.exceptAll(out).count() == 0


MAXIMA = {"dollars": ("cents", 100), "top": ("top", None)}


def _signals(rnd, n):
    key = lambda: 1 if rnd.random() < 0.34 else rnd.randrange(2, 9)
    return [(key(), BASE + dt.timedelta(hours=rnd.randrange(0, 240, 7)), i % 5, rnd.choice([None, -5, 250]), rnd.choice([None, -1.5, 2.5]),
             rnd.choice([None, f"m{i}"])) for i in range(n)]


def test_daily_states_equal_the_rollup(spark):
    """Whatever the split of the rows, a state sent twice included; days before the lookback are left out whole."""
    schema = "k int, created timestamp_ntz, line int, cents int, top double, metro string"
    rows = _signals(random.Random(5), 300)
    whole = spark.createDataFrame(rows, schema)
    args = (["k"], "created", MAXIMA, {"metro": "metro"}, ["created", "line"])
    states = [signal_state(spark.createDataFrame(rows[i::3], schema), *args) for i in range(3)]
    union = states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[1])
    daily = merge_states(union, ["k", "day"])
    assert daily.count() == daily.select("k", "day").distinct().count()
    for floor in (0, 4, 30):
        want = signal_rollup(whole.where(F.col("created") >= _day(floor)), ["k"], MAXIMA, {"metro": "metro"}, ["created", "line"])
        for s in (union, daily):
            got = finish_signals(merge_states(s.where(F.col("day") >= _day(floor)), ["k"]), ["k"], MAXIMA, {"metro": "metro"})
            assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())


def test_a_refresh_writes_its_days_and_reads_those_of_the_lookback(spark):
    path = tempfile.mkdtemp(prefix="run-states-", dir="/tmp") + "/signals"
    s = roles(spark, SF, ["app_run_bridge", "decision_run"])
    p = MartParams(start=dt.date(1998, 6, 1))
    runs = s["decision_run"].where(F.col("created") >= F.lit(dt.date(1997, 3, 1)))
    for cut in (dt.date(1998, 3, 1), dt.date(1998, 8, 1)):  # the second refresh starts again a month early
        days = runs.where((F.col("created") >= F.add_months(F.lit(cut), -13)) & (F.col("created") < F.lit(cut)))
        write_days(underwriting_states(s["app_run_bridge"], days).coalesce(1), path)
    upto = s["decision_run"].where(F.col("created") < F.lit(dt.date(1998, 8, 1)))
    want = underwriting_signals(s["app_run_bridge"], upto, p)
    states = read_days(spark, path, dt.date(1997, 6, 1))
    got = signals_from_states(states, p)
    assert want.count() > 50 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    scan = next(line for line in states._jdf.queryExecution().executedPlan().toString().split("\n") if "Scan parquet" in line)
    assert "PartitionFilters: [isnotnull(day" in scan and ">= 1997-06-01" in scan


def test_distinct_state(spark):
    df = spark.createDataFrame([(1, BASE), (1, BASE), (1, BASE + dt.timedelta(days=3)), (2, BASE), (3, None), (None, BASE)], "k int, t timestamp_ntz")
    state = distinct_state(df, ["k"], "t")
    assert state.count() == 4
    assert {r.k for r in state.where(F.col("day") >= _day(1)).collect()} == {1}


def test_partitioned_logs_are_pruned_by_the_lookback(spark):
    root = tempfile.mkdtemp(prefix="run-parts-", dir="/tmp")
    s = roles(spark, SF)
    p = MartParams(start=dt.date(1998, 6, 1))
    log = s["decision_log"].withColumn("event_time_month", F.trunc("event_time", "month"))
    log.coalesce(1).write.partitionBy("event_time_month").parquet(f"{root}/log")
    runs = s["decision_run"].withColumn("created_date", F.col("created").cast("date")).where(F.col("created") >= F.lit(dt.date(1997, 4, 1)))
    runs.coalesce(1).write.partitionBy("created_date").parquet(f"{root}/runs")
    read = read_roles(spark, {"decision_log": f"{root}/log", "decision_run": f"{root}/runs"})
    assert not [x for x in check_roles(read) if "missing role" not in x]
    keys = no_file_keys(read["decision_log"], p)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_time_month" in plan and "event_time_month" in plan and "1997-06-01" in plan
    want = no_file_keys(s["decision_log"], p)
    assert want.count() > 0 and keys.exceptAll(want).count() == want.exceptAll(keys).count() == 0
    signals = underwriting_signals(s["app_run_bridge"], read["decision_run"], p)
    assert "PartitionFilters: [isnotnull(created_date" in signals._jdf.queryExecution().executedPlan().toString()
    whole = underwriting_signals(s["app_run_bridge"], s["decision_run"], p)
    assert signals.exceptAll(whole).count() == whole.exceptAll(signals).count() == 0
