"""Classification rules on hand-made rows (traps T3-T7, T11-T13, T15, T19, T20)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.operators.filters import window_condition
from funnelkit.operators.waterfall import tracing_arms, waterfall
from funnelkit.plans import rules as R
from funnelkit.plans.params import MartParams

P = MartParams()
L = P.labels

SCHEMA = T.StructType([
    T.StructField("cf_application_id", T.LongType()),
    T.StructField("cf_prequal_id", T.LongType()),
    T.StructField("cf_merchant_id", T.LongType()),
    T.StructField("cf_user_id", T.LongType()),
    T.StructField("cf_guarantee_id", T.LongType()),
    T.StructField("cf_start_date", T.TimestampNTZType()),
    T.StructField("cf_checkout_created_dt", T.TimestampNTZType()),
    T.StructField("cf_captured_dt", T.TimestampNTZType()),
    T.StructField("cf_first_capture_dt", T.TimestampNTZType()),
    T.StructField("cf_is_checkout_applied", T.IntegerType()),
    T.StructField("cf_is_captured", T.IntegerType()),
    T.StructField("cf_is_approved", T.IntegerType()),
    T.StructField("cf_is_approved_instalment", T.IntegerType()),
    T.StructField("cf_is_approved_split", T.IntegerType()),
    T.StructField("cf_financing_type", T.StringType()),
    T.StructField("cf_total_amount", T.DoubleType()),
    T.StructField("cf_plan_frequency", T.StringType()),
    T.StructField("cf_plan_interval", T.IntegerType()),
    T.StructField("cf_loan_type", T.StringType()),
    T.StructField("cf_flow_type", T.StringType()),
    T.StructField("cf_apr", T.DoubleType()),
    T.StructField("pq_is_applied", T.IntegerType()),
    T.StructField("pq_merchant_id", T.LongType()),
    T.StructField("pq_user_id", T.LongType()),
    T.StructField("pq_start_date", T.TimestampNTZType()),
    T.StructField("pq_decision_state", T.StringType()),
    T.StructField("person_first_capture", T.TimestampNTZType()),
    T.StructField("person_first_capture_at_group", T.TimestampNTZType()),
    T.StructField("purchase_member", T.IntegerType()),
    T.StructField("charge_mart_product_platform", T.StringType()),
    T.StructField("charge_mart_product_group", T.StringType()),
    T.StructField("session_instrument_type", T.StringType()),
    T.StructField("checkout_mart_is_platform", T.IntegerType()),
])


def frame(spark, *rows):
    names = [f.name for f in SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


TS = dt.datetime


def test_funnel_stage_and_applied_late_zero_beats_early(spark):
    df = frame(
        spark,
        {"pq_is_applied": 1},                                                  # early only
        {"cf_application_id": 1, "cf_prequal_id": 5, "pq_is_applied": 1},     # both
        {"cf_application_id": 2},                                              # late only
        {"cf_application_id": 3, "cf_prequal_id": 7, "cf_is_checkout_applied": 0, "pq_is_applied": 1},  # T7
    )
    out = df.select(R.funnel_stage(P).alias("s"), R.is_applied().alias("a")).collect()
    assert [r.s for r in out] == [L.early_no_late, L.early_at_late, L.late_only, L.early_at_late]
    assert [r.a for r in out] == [1, 1, 0, 0]


def test_report_window_gate(spark):
    start = "2000-01-01"
    df = frame(
        spark,
        {"pq_start_date": TS(1999, 6, 1), "cf_captured_dt": TS(2000, 1, 1, 0, 0, 1), "pq_is_applied": 1},  # T19
        {"cf_start_date": TS(1999, 12, 31, 23, 59), "cf_is_checkout_applied": 1},
        {"cf_start_date": TS(2000, 1, 1), "cf_is_checkout_applied": 0, "pq_is_applied": 1},              # T7
        {"pq_start_date": TS(2000, 2, 1), "cf_start_date": TS(1999, 1, 1), "pq_is_applied": 1},          # early first
    )
    cond = window_condition(start, ["pq_start_date", "cf_start_date"], ["cf_captured_dt", "cf_first_capture_dt"],
                            ["cf_is_checkout_applied", "pq_is_applied"])
    kept = [r.k for r in df.select(F.coalesce(cond, F.lit(False)).alias("k")).collect()]
    assert kept == [True, False, False, True]


def test_customer_flags_fallback_time_and_as_of(spark):
    p = MartParams(as_of=dt.date(2001, 1, 1))
    df = frame(
        spark,
        {"cf_checkout_created_dt": TS(2000, 5, 1), "person_first_capture": TS(2000, 4, 1)},            # repeat
        {"pq_start_date": TS(2000, 3, 1), "cf_checkout_created_dt": TS(2000, 5, 1),
         "person_first_capture": TS(2000, 4, 1)},                                                       # T5: early time
        {"cf_checkout_created_dt": TS(2001, 1, 3)},                                                  # T6: after as_of+1
        {"cf_checkout_created_dt": TS(2000, 1, 3)},                                                  # never captured
    )
    assert [r.f for r in df.select(R.repeat_flag(p).alias("f")).collect()] == [L.repeat, L.new, L.repeat, L.new]


def test_new_to_group_null_merchant_falls_through(spark):
    df = frame(
        spark,
        {"cf_merchant_id": 9, "cf_user_id": 1},                                                     # not in group
        {"cf_user_id": 1, "cf_checkout_created_dt": TS(2000, 1, 1)},                               # NULL merchant (T3)
        {"pq_merchant_id": 1, "cf_merchant_id": 9, "cf_user_id": 1, "cf_checkout_created_dt": TS(2000, 1, 1),
         "person_first_capture_at_group": TS(1999, 1, 1)},                                            # early merchant first (T4)
        {"cf_merchant_id": 1},                                                                      # unknown user
    )
    got = [r.f for r in df.select(R.new_to_group_flag(P).alias("f")).collect()]
    assert got == [L.not_in_group, L.new_to_group, L.repeat_in_group, L.unknown]


def test_approval_cutoffs_midnight_and_product_of_legs(spark):
    base = {"cf_application_id": 1, "cf_merchant_id": 1, "cf_financing_type": "2-HIGH", "cf_total_amount": 100.0,
            "cf_is_approved_instalment": 1, "cf_is_approved_split": 0, "cf_is_approved": 1}
    df = frame(
        spark,
        dict(base, cf_start_date=TS(1997, 7, 1)),                       # exactly midnight of the cut-off (T20)
        dict(base, cf_start_date=TS(1997, 7, 1, 0, 0, 1)),              # one second past midnight
        dict(base, cf_start_date=TS(1999, 12, 1), cf_is_approved_split=1),  # after split cut-off: product of legs
        dict(base, cf_start_date=TS(1997, 1, 1), pq_start_date=TS(2000, 1, 1), cf_total_amount=200000.0),  # T15
        {"pq_decision_state": "approved"},                              # early fallback
        {"cf_application_id": 2, "cf_merchant_id": 5, "cf_is_approved": -1},  # floored at 0 in G6 only
    )
    out = df.select(R.is_approved(P).alias("a"), R.is_checkout_approved(P).alias("c")).collect()
    assert [r.a for r in out] == [1, 0, 1, 1, 1, 0]
    assert [r.c for r in out] == [1, 0, 1, 1, None, -1]


def test_plan_categories_traps(spark):
    card = {"cf_guarantee_id": 1, "purchase_member": 1, "charge_mart_product_platform": P.card_platform,
            "session_instrument_type": P.card_instrument}
    df = frame(
        spark,
        dict(card, cf_is_captured=1, cf_plan_frequency="daily", cf_plan_interval=30),       # card short, pay in 30
        dict(card, cf_is_captured=1, cf_plan_frequency="biweekly", cf_loan_type="other"),   # card other -> IL sub (T12)
        {"cf_is_captured": 1, "cf_plan_frequency": "monthly"},                              # core instalment
        {"cf_is_captured": 1, "cf_plan_frequency": "monthly", "cf_apr": 0.2},               # core interest
        {"cf_is_captured": 0, "cf_merchant_id": 4},                                          # retailer even if uncaptured (T11)
        {"cf_is_captured": 1, "checkout_mart_is_platform": 1, "cf_loan_type": P.go_loan},            # platform short
        {"cf_is_captured": 1, "cf_flow_type": P.short_flow_types[0]},                       # core short via flow
    )
    kind = R.plan_kind(P)
    cat = R.captured_category(P, kind)
    out = df.select(kind.alias("k"), cat.alias("c"), R.captured_subcategory(P, kind).alias("s"),
                    R.merchant_category(P, cat).alias("m"), R.core_index(P, cat).alias("i")).collect()
    assert [r.k for r in out] == ["card short", "card other", "other", "other", "other", "other", "other"]
    assert [r.c for r in out] == ["card/direct short", "card/direct other", "core instalment", "core instalment",
                                  "not captured", "platform short", "core short"]
    assert [r.s for r in out] == ["card/direct pay in 30", "card/direct instalment", "core instalment",
                                  "core instalment", "not captured", "platform pay in 4", "core pay in 4"]
    assert [r.m for r in out] == ["card/direct short", "card/direct other", L.core_zero, L.core_interest,
                                  "retailer a", "platform short", "core short"]          # NULL APR -> zero (T13)
    assert [r.i for r in out] == [0, 0, 1, 1, 0, 0, 0]


def test_monthly_complement(spark):
    df = frame(spark, {"cf_plan_frequency": "daily", "cf_plan_interval": 30}, {"cf_plan_frequency": "monthly"},
               {"cf_plan_frequency": None}, {"cf_plan_frequency": "weekly"})
    m = R.monthly_index()
    out = df.select(m.alias("m"), (F.lit(1) - m).alias("b")).collect()
    assert [(r.m, r.b) for r in out] == [(1, 0), (1, 0), (0, 1), (0, 1)]
    assert all(r.m + r.b == 1 for r in out)


def test_every_arm_of_every_rule_is_reached(spark):
    """So every arm of the mart's first-match rules is held against the oracle somewhere."""
    from funnelkit.plans.mart import rule_coverage
    from funnelkit.sources.fixture import roles

    rows = rule_coverage(roles(spark, "/root/testdata/sf0.01"), MartParams()).collect()
    assert len(rows) == 92 and [(r.rule, r.arm) for r in rows if r.rows == 0] == []
    total = {}
    for r in rows:
        total[r.rule] = total.get(r.rule, 0) + r.rows
    assert len(total) == 19 and len(set(total.values())) == 1


def test_arm_names_of_nested_waterfalls(spark):
    a, b = F.col("a"), F.col("b")

    def rule():
        inner = waterfall([(b == 1, "x")], "y")
        return waterfall([(a == 1, "one"), (a == 2, inner), (a == 3, waterfall([(b == 1, "z")]))], waterfall([(b == 2, "w")], "v"))

    with tracing_arms() as trace:
        traced = rule()
        names = trace[id(traced)][1]
    assert names == ["1", "2.1", "2.else", "3.1", "3.else", "else.1", "else.else"]
    df = spark.createDataFrame([(1, 1), (2, 1), (2, None), (3, 1), (3, 2), (None, 2), (4, None)], "a int, b int")
    got = [(r.arm, r.v) for r in df.select(traced.alias("arm"), rule().alias("v")).collect()]
    assert got == [("1", "one"), ("2.1", "x"), ("2.else", "y"), ("3.1", "z"), ("3.else", None), ("else.1", "w"), ("else.else", "v")]
