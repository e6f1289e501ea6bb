"""Randomised equivalence: the scalable plans against brute-force definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from funnelkit.operators import asof_latest, prefixed, stitch, stitch_split


def _random_asof(spark, seed):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)

    def ts():
        if rnd.random() < 0.05:
            return None
        # coarse minutes so equal timestamps are common; spans many hour/day buckets
        return base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 10, 7))

    users = [None, 1, 2, 3, 4, 5]
    hot = 1  # a third of the rows belong to one user
    dec = [(i, hot if rnd.random() < 0.34 else rnd.choice(users), ts()) for i in range(300)]
    evt = [(1000 + i, hot if rnd.random() < 0.34 else rnd.choice(users), ts(),
            None if rnd.random() < 0.2 else f"s{i}") for i in range(600)]
    d = spark.createDataFrame(dec, "decision_id int, user_id int, created timestamp_ntz")
    e = spark.createDataFrame(evt, "event_id int, user_id int, created timestamp_ntz, state_to string")
    return dec, evt, d, e


def _brute_asof(dec, evt):
    out = {}
    for did, u, t in dec:
        best = None
        if u is not None and t is not None:
            for eid, eu, et, st in evt:
                if eu == u and et is not None and et <= t and (best is None or (et, eid) > (best[2], best[0])):
                    best = (eid, eu, et, st)
        out[did] = (best[0], best[3]) if best else (None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_plans_equal_brute_force(spark, seed):
    dec, evt, d, e = _random_asof(spark, seed)
    want = _brute_asof(dec, evt)
    for bucket in (None, 3600, 86400 * 3):
        out = asof_latest(d, e, "user_id", "created", "created", {"eid": "event_id", "state_to": "state_to"},
                          tie=["event_id"], bucket_seconds=bucket)
        got = {r.decision_id: (r.eid, r.state_to) for r in out.collect()}
        assert got == want, bucket


@pytest.mark.parametrize("seed", [3, 4])
def test_stitch_plans_equal_full_outer(spark, seed):
    rnd = random.Random(seed)
    keys = [None, None, 1, 2, 3, 4, 5, 6, 7, 8]
    late = spark.createDataFrame([(i, rnd.choice(keys)) for i in range(200)], "id int, link int")
    # early is unique per non-NULL key, as the de-duplicated prequal stage is
    early_rows = [(k, f"e{k}") for k in range(1, 12) if rnd.random() < 0.7] + [(None, f"n{i}") for i in range(5)]
    early = spark.createDataFrame(early_rows, "link int, v string")
    late, early = prefixed(late, "cf_"), prefixed(early, "pq_")
    ref = late.join(early, F.col("cf_link") == F.col("pq_link"), "full").select("cf_id", "pq_v")
    want = sorted(map(tuple, ref.collect()), key=str)
    for df in (stitch(late, early, "cf_link", "pq_link"), stitch_split(late, early, "cf_link", "pq_link")):
        assert sorted(map(tuple, df.select("cf_id", "pq_v").collect()), key=str) == want


def test_bounded_history_keeps_in_window_states(spark):
    from funnelkit.plans.mart import card_state
    from funnelkit.plans.params import MartParams

    p = MartParams(start=dt.date(2024, 1, 10), lookback_days=5)   # window starts 2024-01-05
    dec, evt, d, e = _random_asof(spark, 7)
    d = d.withColumn("guarantee_id", F.col("decision_id"))
    got = {r.decision_id: r.state_to for r in card_state(d, e, p, bucket_seconds=3600).collect()}
    full = _brute_asof(dec, evt)
    floor = dt.datetime(2024, 1, 5)
    want = {did: (full[did][1] if t is not None and t >= floor else None) for did, u, t in dec}
    assert got == want


def test_waterfall_first_match_three_valued(spark):
    """G0 against a Python first-match reference: NULL comparisons are not true, so a
    rule with a NULL condition is skipped and the next one is tried."""
    from funnelkit.operators import waterfall

    rnd = random.Random(11)
    rows = [tuple(None if rnd.random() < 0.25 else rnd.randrange(0, 10) for _ in range(3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    rules = [
        (F.col("a") > 5, "x"),
        (F.col("b") < 3, "y"),
        ((F.col("a") == F.col("b")) | (F.col("c") == 0), "z"),
        (~F.col("c").isin(1, 2, 3), "w"),
    ]
    got = [r.k for r in df.select(waterfall(rules, "d").alias("k")).collect()]

    def gt(x, y):
        return None if x is None or y is None else x > y

    def lt(x, y):
        return None if x is None or y is None else x < y

    def eq(x, y):
        return None if x is None or y is None else x == y

    def or3(p, q):
        if p is True or q is True:
            return True
        return None if p is None or q is None else False

    def not_in(x, vals):
        return None if x is None else x not in vals

    want = []
    for a, b, c in rows:
        for cond, label in ((gt(a, 5), "x"), (lt(b, 3), "y"), (or3(eq(a, b), eq(c, 0)), "z"), (not_in(c, (1, 2, 3)), "w")):
            if cond is True:
                want.append(label)
                break
        else:
            want.append("d")
    assert got == want
