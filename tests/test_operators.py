"""DataFrame operators on hand-made frames: as-of (T2, T16, T18), stitch, enrichment,
roll-ups (T8, T9, T17), latest values."""

import datetime as dt

from pyspark.sql import functions as F

from funnelkit.operators import (
    Lookup, asof_latest, enrich_group, enrich_left, flag_member, key_violations, latest_non_null,
    prefixed, signal_rollup, stitch, stitch_split,
)

T = dt.datetime


def _asof_frames(spark):
    decisions = spark.createDataFrame(
        [
            (1, 10, T(2024, 1, 5)),    # latest event has a NULL state -> NULL, not the older one (T2)
            (2, 10, T(2024, 1, 3)),    # equal timestamp with an event -> that event counts (<=)
            (3, 20, T(2024, 1, 5)),    # no event for the user
            (4, 30, T(2024, 1, 1)),    # only a later event
            (5, 10, None),             # NULL decision time matches nothing (T18)
            (6, None, T(2024, 1, 5)),  # NULL user matches nothing
            (7, 40, T(2024, 1, 9)),    # two events at the same time: the tie key decides (T16)
            (8, 10, T(2024, 1, 20)),   # carry-in from an earlier day (bucketed plan)
        ],
        "decision_id int, user_id int, created timestamp_ntz",
    )
    events = spark.createDataFrame(
        [
            (100, 10, T(2024, 1, 2), "old"),
            (101, 10, T(2024, 1, 3), "at"),
            (102, 10, T(2024, 1, 4), None),
            (103, 30, T(2024, 1, 2), "late"),
            (104, 40, T(2024, 1, 9), "a"),
            (105, 40, T(2024, 1, 9), "b"),
            (106, None, T(2024, 1, 1), "nouser"),
            (107, 10, None, "notime"),
        ],
        "event_id int, user_id int, created timestamp_ntz, state_to string",
    )
    return decisions, events


EXPECTED_ASOF = {1: (102, None), 2: (101, "at"), 3: (None, None), 4: (None, None), 5: (None, None),
                 6: (None, None), 7: (105, "b"), 8: (102, None)}


def test_asof_traps_plain_and_bucketed(spark):
    d, e = _asof_frames(spark)
    for bucket in (None, 3600, 86400):
        out = asof_latest(d, e, "user_id", "created", "created", {"eid": "event_id", "state_to": "state_to"},
                          tie=["event_id"], bucket_seconds=bucket)
        got = {r.decision_id: (r.eid, r.state_to) for r in out.collect()}
        assert got == EXPECTED_ASOF, bucket
        assert out.count() == d.count()


def test_asof_matches_range_join_on_fixture(spark):
    from funnelkit.sources.fixture import role_frame
    sf = "/root/testdata/sf0.001"
    d = role_frame(spark, sf, "prequal_decision")
    e = role_frame(spark, sf, "card_state_event")
    fast = asof_latest(d, e, "user_id", "created", "created", {"eid": "event_id"}, tie=["event_id"], bucket_seconds=3600)
    d.createOrReplaceTempView("d_t")
    e.createOrReplaceTempView("e_t")
    brute = spark.sql("""
        SELECT decision_id, eid FROM (
          SELECT d.decision_id, e.event_id AS eid,
                 row_number() OVER (PARTITION BY d.decision_id ORDER BY e.created DESC, e.event_id DESC) AS rn
          FROM d_t d LEFT JOIN e_t e ON e.user_id = d.user_id AND e.created <= d.created) WHERE rn = 1""")
    assert sorted(map(tuple, fast.select("decision_id", "eid").collect())) == sorted(map(tuple, brute.collect()))


def _stages(spark):
    late = spark.createDataFrame(
        [(1, 10), (2, 10), (3, None), (4, 30), (5, None)], "id int, link int")
    early = spark.createDataFrame(
        [(10, "a"), (20, "b"), (None, "c"), (None, "d")], "link int, v string")
    return prefixed(late, "cf_"), prefixed(early, "pq_")


def test_stitch_forms_equal_full_outer(spark):
    late, early = _stages(spark)
    ref = sorted(map(tuple, late.join(early, F.col("cf_link") == F.col("pq_link"), "full")
                     .select("cf_id", "pq_v").collect()), key=str)
    for df in (stitch(late, early, "cf_link", "pq_link"),
               stitch(late, early, "cf_link", "pq_link", salt=False),
               stitch_split(late, early, "cf_link", "pq_link")):
        got = sorted(map(tuple, df.select("cf_id", "pq_v").collect()), key=str)
        assert got == ref
    # one early row to many late rows; NULL links on both sides never match
    assert len(ref) == 5 + 3


def test_stitch_does_not_take_the_salt_of_an_unlinked_row_for_an_id(spark):
    salt = lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long"))).first()[0]
    late = spark.createDataFrame([(1, salt(7)), (2, None)], "cf_id long, cf_link long")
    early = spark.createDataFrame([(7, None), (8, salt(2)), (9, None)], "pq_v long, pq_link long")
    want = [(1, None), (2, None), (None, 7), (None, 8), (None, 9)]
    for kind in ("long", "string"):
        l2, e2 = late.withColumn("cf_link", F.col("cf_link").cast(kind)), early.withColumn("pq_link", F.col("pq_link").cast(kind))
        df = stitch_split(l2, e2, "cf_link", "pq_link", late_salt=["cf_id"], early_salt=["pq_v"])
        assert sorted(map(tuple, df.select("cf_id", "pq_v").collect()), key=lambda r: (r[0] is None, r)) == want


def test_stitch_parts_disjoint_and_exhaustive(spark):
    late, early = _stages(spark)
    s = stitch_split(late, early, "cf_link", "pq_link")
    both = s.where(F.col("cf_id").isNotNull() & F.col("pq_v").isNotNull()).count()
    late_only = s.where(F.col("pq_v").isNull()).count()
    early_only = s.where(F.col("cf_id").isNull()).count()
    assert both + late_only + early_only == s.count() == 8
    assert (both, late_only, early_only) == (2, 3, 3)


def test_enrich_group_nulls_never_match_and_flags_dedupe(spark):
    df = spark.createDataFrame([(1, "k1"), (2, None), (3, "k2")], "id int, k string")
    salt_like = spark.createDataFrame(
        [("k1", "x"), ("\u0000null:0", "bad"), ("\u0000null:1", "bad")] +
        [(f"\u0000null:{i}", "bad") for i in range(2, 70000, 997)], "k string, v string")
    keys = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "k string")
    out = enrich_group(df, "k", [Lookup(salt_like, "k", {"v": "v"}), Lookup(keys, "k", {"m": "k"}, member=True)],
                       salt_cols=["id"])
    got = {r.id: (r.v, r.m) for r in out.collect()}
    assert got == {1: ("x", 1), 2: (None, 0), 3: (None, 1)}


def test_enrichment_keeps_row_count_when_unique(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "id int, k int")
    dim = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    assert enrich_left(df, dim, "k", "k", ["name"]).count() == 50
    assert enrich_left(df, dim, "k", "k", ["name"], spread_nulls=True, salt_cols=["id"]).count() == 50
    assert key_violations(dim, ["k"]).count() == 0
    dup = dim.unionByName(dim)
    assert key_violations(dup, ["k"]).count() == 2


def test_flag_member_distinct(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = sorted(map(tuple, flag_member(df, keys, "k", "k", "f").collect()), key=str)
    assert got == sorted([(1, 1), (2, 0), (None, 0)], key=str)


def test_signal_rollup_traps(spark):
    rows = [
        ("a", T(2024, 1, 1), 1, -500.0, None, "m1"),   # negative + NULL -> max(nvl(x,0)) = 0, not -5 (T8)
        ("a", T(2024, 1, 2), 2, None, None, None),     # NULL metro does not win (latest non-NULL)
        ("b", T(2024, 1, 1), 1, None, None, None),     # all NULL -> 0, still has a row (T9)
        ("c", T(2024, 1, 1), 1, 300.0, 5.0, "m2"),
        ("c", T(2024, 1, 1), 2, 100.0, None, "m3"),    # same time: tie key decides
    ]
    df = spark.createDataFrame(rows, "app string, ts timestamp_ntz, line int, x double, y double, metro string")
    out = signal_rollup(df, ["app"], {"x_d": ("x", 100), "y_max": ("y", None)}, {"metro": "metro"}, ["ts", "line"])
    got = {r.app: (r.x_d, r.y_max, r.metro) for r in out.collect()}
    assert got == {"a": (0.0, 0.0, "m1"), "b": (0.0, 0.0, None), "c": (3.0, 5.0, "m3")}


def test_latest_non_null_matches_row_number(spark):
    rows = [(1, T(2024, 1, i % 5 + 1), i, None if i % 4 == 0 else f"v{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, tie int, v string")
    got = {r.k: r.v for r in latest_non_null(df, ["k"], ["ts", "tie"], ["v"]).collect()}
    best = max((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[2]))
    assert got == {1: best[3]}
