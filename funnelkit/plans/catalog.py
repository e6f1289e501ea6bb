"""Query catalogue: one Spark query per operator of the survey, on the fixture.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the whole fixture
tables. Rule queries (G*) read the enriched, windowed spine the mart itself builds and
return the application id plus the rule's output; operator queries read their role
tables directly. ``funnelkit.plans.oracle`` holds the matching DuckDB SQL.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.functions.columns import flag, is_missing, not_in_list
from funnelkit.functions.dates import date_gate, lookback_start, month_boundaries, months_fractional
from funnelkit.functions.slots import (
    null_safe_sum, slot_coalesce, slot_count_leading, slot_max, slot_min, slot_min_sentinel,
)
from funnelkit.operators.asof import asof_latest
from funnelkit.operators.enrich import Step, enrich_chain, enrich_left, flag_member, key_violations
from funnelkit.operators.filters import lookback, report_window, stage_prefilter
from funnelkit.operators.latest import distinct_keys, latest_non_null
from funnelkit.operators.stitch import prefixed, stitch, stitch_split
from funnelkit.plans import rules as R
from funnelkit.plans.mart import (
    card_state, card_state_snapshot, enrich_spine, enriched_spine, fan_out_report, funnel_mart, prequal_stage, rule_coverage, signals_from_states, stitched_spine,
    underwriting_signals, underwriting_states,
)
from funnelkit.plans.params import MartParams
from funnelkit.plans.refresh import ROW_KEY, keyed_mart, refresh_mart
from funnelkit.session import as_given, bound_tasks
from funnelkit.sources.fixture import role_frame, roles
from funnelkit.sources.schemas import OPTIONAL, conform, read_roles, role_schema, role_schemas
from funnelkit.sources.shared import shared_folder, written
from funnelkit.sources.tables import read_table

P = MartParams()
Query = Callable[[SparkSession, str], DataFrame]


def _app_id() -> F.Column:
    return F.coalesce(F.col("cf_application_id"), F.col("pq_application_id")).alias("application_id")


def _enriched(spark: SparkSession, sf_dir: str, *need: str) -> DataFrame:
    """The windowed spine with the enrichments that the columns ``need`` take. Its narrow rows compress well: small tasks."""
    bound_tasks(spark)
    return enriched_spine(roles(spark, sf_dir), P, need=need)


def _stitched(spark: SparkSession, sf_dir: str, stitcher=stitch_split) -> DataFrame:
    bound_tasks(spark)
    late = prefixed(role_frame(spark, sf_dir, "checkout_funnel"), "cf_")
    early = prefixed(prequal_stage(role_frame(spark, sf_dir, "prequal_funnel"), P), "pq_")
    return stitcher(late, early, "cf_prequal_id", "pq_prequal_id", late_salt=["cf_application_id"], early_salt=["pq_application_id"])


# --- B: filters -----------------------------------------------------------------------
def lookback_filter(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return lookback(orders, "o_orderdate", P.start, P.lookback_days).select("o_orderkey", "o_orderdate", "o_orderpriority")


def stage_prefilter_q(spark, sf_dir):
    pq = role_frame(spark, sf_dir, "prequal_funnel")
    return stage_prefilter(pq, "num_deciders_run", "is_deduped", "decision_state", P.prequal_states).select(
        "prequal_id", "start_date", "decision_state", "num_deciders_run")


def distinct_keys_lookback(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    recent = lookback(orders, "o_orderdate", P.start, P.lookback_days)
    report = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return distinct_keys(recent.where(is_missing(report, "1-URGENT")), ["o_custkey"])


def no_file_keys_q(spark, sf_dir):
    from funnelkit.plans.mart import no_file_keys
    return no_file_keys(role_frame(spark, sf_dir, "decision_log"), P)


def no_file_keys_partitioned(spark, sf_dir):
    """The decision log as a table partitioned by month: the lookback reads the months it reaches."""
    from funnelkit.plans.mart import no_file_keys
    path = shared_folder(spark, "decision_log")
    log = role_frame(spark, sf_dir, "decision_log").withColumn("event_time_month", F.trunc("event_time", "month"))
    log.repartition("event_time_month").write.partitionBy("event_time_month").parquet(path)
    return no_file_keys(read_roles(spark, {"decision_log": path})["decision_log"], P)


def null_not_in(spark, sf_dir):
    cf = role_frame(spark, sf_dir, "checkout_funnel")
    label = F.when(not_in_list("merchant_id", [1, 2]), "outside").otherwise("inside")
    return cf.select("application_id", "merchant_id", label.alias("label"))


def pattern_flags(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    prio = F.col("o_orderpriority")
    return o.select(
        "o_orderkey",
        R.risk_pattern_flag(MartParams(risk_flag_pattern="%NOT%"), prio).alias("contains_flag"),
        flag(prio.like("%NOT%")).alias("contains_index"),
        flag(prio.like("1-%")).alias("prefix_index"),
        flag(prio.ilike("%urgent%")).alias("ilike_index"),
        flag(prio.ilike("%2_high%")).alias("wildcard_index"),
    )


def report_window_q(spark, sf_dir):
    s = _stitched(spark, sf_dir)
    w = report_window(s, P.start, ["pq_start_date", "cf_start_date"], ["cf_captured_dt", "cf_first_capture_dt"],
                      ["cf_is_checkout_applied", "pq_is_applied"])
    return w.select(_app_id(), R.is_applied().alias("is_applied"))


def date_gate_q(spark, sf_dir):
    cf = role_frame(spark, sf_dir, "checkout_funnel")
    return cf.select("application_id", date_gate("start_date", P.start).alias("start_date"))


# --- C1/E: per-key state ----------------------------------------------------------------
def _asof(spark, sf_dir, bucket_seconds):
    d = role_frame(spark, sf_dir, "prequal_decision")
    e = role_frame(spark, sf_dir, "card_state_event")
    out = asof_latest(d, e, "user_id", "created", "created",
                      {"state_event_id": "event_id", "state_created": "created", "state_to": "state_to"},
                      tie=["event_id"], bucket_seconds=bucket_seconds)
    return out.select("decision_id", "user_id", "created", "state_event_id", "state_created", "state_to")


def asof_latest_state(spark, sf_dir):
    """Comparison form: one window per user, so a hot user's events meet in one task."""
    return _asof(spark, sf_dir, None)


def asof_latest_state_bucketed(spark, sf_dir):
    return _asof(spark, sf_dir, 3600)


#: A run whose lookback floor (2024-01-16) lies inside the fixture's event log.
LATE_START = dataclasses.replace(P, start=dt.date(2025, 1, 15))


def asof_bounded_history(spark, sf_dir):
    """The mart's card state: decisions before the floor keep their row without a state, later
    ones may match the last event before it."""
    s = roles(spark, sf_dir, ["prequal_decision", "card_state_event"])
    return card_state(s["prequal_decision"], s["card_state_event"], LATE_START, bucket_seconds=3600)


def asof_from_snapshot_q(spark, sf_dir):
    """The card state from a snapshot: taken a week before the lookback, advanced by that week's events, and
    joined with the events since. The log before is read for the first snapshot only."""
    s = roles(spark, sf_dir, ["prequal_decision", "card_state_event"])
    events = s["card_state_event"]
    week_before = dataclasses.replace(LATE_START, start=LATE_START.start - dt.timedelta(days=7))
    first = card_state_snapshot(events, week_before)
    week = events.where((F.col("created") >= lookback_start(week_before.start, P.lookback_days))
                        & (F.col("created") < lookback_start(LATE_START.start, P.lookback_days)))
    snapshot = card_state_snapshot(week, LATE_START, before=first)
    return card_state(s["prequal_decision"], events, LATE_START, bucket_seconds=3600, snapshot=snapshot)


#: Runs before it are an earlier refresh's, later ones this one's.
REFRESHED = dt.date(1998, 6, 1)


def _signal_states(s):
    """Daily signal states as two refreshes leave them."""
    runs, new = s["decision_run"], F.col("created") >= F.lit(REFRESHED)
    parts = [underwriting_states(s["app_run_bridge"], runs.where(part)) for part in (~new, new)]
    return parts[0].unionByName(parts[1])


def signals_incremental(spark, sf_dir):
    return signals_from_states(_signal_states(roles(spark, sf_dir, ["app_run_bridge", "decision_run"])), P)


def funnel_mart_incremental(spark, sf_dir):
    """The flagship from carried state: a card-state snapshot and daily signal states in place of their logs."""
    s = roles(spark, sf_dir)
    states = {"card_state_snapshot": card_state_snapshot(s["card_state_event"], P), "signal_states": _signal_states(s)}
    return funnel_mart(s | states, P)


def earlier_roles(s: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The roles as an earlier run found them, and the keys that changed since: late and early rows missing or linked
    otherwise, other owners, moved addresses, metros of other postal codes, later runs and card events missing."""
    i = F.col("application_id")
    late, early = s["checkout_funnel"], s["prequal_funnel"]
    before = {
        "checkout_funnel": late.where(i % 97 != 3).withColumn("prequal_id", F.when(i % 89 == 5, i + 1).otherwise(F.col("prequal_id"))),
        "prequal_funnel": early.where(i % 83 != 7).withColumn("merchant_id", F.when(i % 79 == 4, F.lit(None)).otherwise(F.col("merchant_id"))),
        "user_dim": s["user_dim"].withColumn("label", F.when(F.col("user_id") % 71 == 1, F.lit("partner")).otherwise(F.col("label"))),
        "address": s["address"].withColumn("postal_code", F.when(F.col("address_id") % 73 == 2, F.lit("z0")).otherwise(F.col("postal_code"))),
        "postal_metro": s["postal_metro"].withColumn("metro", F.when(F.col("postal_code") == "z7", F.lit("metro 2")).otherwise(F.col("metro"))),
        "decision_run": s["decision_run"].where((F.col("run_id") % 67 != 9) | (F.col("line_no") != 2)),
        "card_state_event": s["card_state_event"].where(F.col("event_id") % 61 != 11),
    }
    stage = lambda role, hit: before[role].unionByName(s[role]).where(hit).select("application_id", "prequal_id").distinct()
    changes = {
        "checkout_funnel": stage("checkout_funnel", (i % 97 == 3) | (i % 89 == 5)),
        "prequal_funnel": stage("prequal_funnel", (i % 83 == 7) | (i % 79 == 4)),
        "user_dim": s["user_dim"].where(F.col("user_id") % 71 == 1),
        "address": s["address"].where(F.col("address_id") % 73 == 2),
        "postal_metro": s["postal_metro"].where(F.col("postal_code") == "z7"),
        "decision_run": s["decision_run"].where((F.col("run_id") % 67 == 9) & (F.col("line_no") == 2)),
        "card_state_event": s["card_state_event"].where(F.col("event_id") % 61 == 11),
    }
    return s | before, changes


def funnel_mart_refreshed(spark, sf_dir):
    """The flagship as a refresh: the mart of earlier roles is written, then brought up to date by the changed keys."""
    s = roles(spark, sf_dir)
    # The early stage is an aggregation of lineitem that the earlier mart, the changed keys and the refresh take in turn.
    s["prequal_funnel"] = written(s["prequal_funnel"], "prequal_funnel")
    before, changes = earlier_roles(s)
    path = shared_folder(spark, "mart")
    keyed_mart(before, P).write.parquet(path)
    return refresh_mart(spark.read.parquet(path), s, changes, P).drop(*ROW_KEY)


def latest_non_null_q(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").withColumn(
        "prio", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return latest_non_null(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"latest_priority": "prio"})


def signals_rollup(spark, sf_dir):
    return underwriting_signals(role_frame(spark, sf_dir, "app_run_bridge"), role_frame(spark, sf_dir, "decision_run"), P)


# --- C4-C10: stitch and enrichment ---------------------------------------------------------
def _stitch_out(s: DataFrame) -> DataFrame:
    return s.select(
        _app_id(),
        F.col("cf_application_id").alias("late_id"),
        F.col("pq_application_id").alias("early_id"),
        F.coalesce(F.col("pq_start_date"), F.col("cf_start_date")).alias("start_early_first"),
        F.coalesce(F.col("cf_user_id"), F.col("pq_user_id")).alias("user_late_first"),
    )


def stitch_full_outer(spark, sf_dir):
    """Comparison form: one full outer join, whose hot link ids Spark cannot split."""
    return _stitch_out(_stitched(spark, sf_dir, stitch))


def stitch_split_q(spark, sf_dir):
    return _stitch_out(_stitched(spark, sf_dir))


def slot_coalesce_q(spark, sf_dir):
    s = _stitched(spark, sf_dir)
    a = slot_coalesce([F.col(f"cf_offered_apr{i}") for i in (1, 2, 3)], [F.col(f"pq_offered_apr{i}") for i in (1, 2, 3)])
    return s.select(_app_id(), F.coalesce(F.col("cf_total_amount"), F.col("pq_approved_amount")).alias("amount"),
                    *[x.alias(f"offered_apr{i}") for i, x in enumerate(a, 1)])


def enrich_left_q(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    return enrich_left(o, c, "o_custkey", "c_custkey", ["c_name", "c_mktsegment"]).select(
        "o_orderkey", "c_name", "c_mktsegment")


def enrich_chain_q(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    out = enrich_chain(o, [
        Step(read_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name", "c_nationkey"]),
        Step(read_table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"]),
        Step(read_table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", ["r_name"]),
    ])
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


def enrich_coalesced_key(spark, sf_dir):
    s = _stitched(spark, sf_dir)
    md = role_frame(spark, sf_dir, "merchant_dim")
    key = F.coalesce(F.col("cf_merchant_id"), F.col("pq_merchant_id"))
    out = enrich_left(s, md, key, "merchant_id", {"merchant_name": "merchant_name"}, spread_nulls=True,
                      salt_cols=["cf_application_id", "pq_application_id"])
    return out.select(_app_id(), key.alias("merchant_key"), "merchant_name")


def fallback_key_join(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    regions = role_frame(spark, sf_dir, "risky_region")
    df = enrich_left(cust, nation, "c_nationkey", "n_nationkey", ["n_regionkey"])
    key = F.coalesce(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey") % 5), F.col("n_regionkey"))
    df = df.withColumn("metro_key", key)
    df = enrich_left(df, regions, "metro_key", "r_regionkey", {"risk_flag": "r_name"}, spread_nulls=True, salt_cols=["c_custkey"])
    return df.select("c_custkey", "metro_key", "risk_flag", flag(F.col("risk_flag").isNotNull()).alias("risk_index"))


def membership_flag(spark, sf_dir):
    cf = role_frame(spark, sf_dir, "checkout_funnel")
    return flag_member(cf, role_frame(spark, sf_dir, "purchases"), "checkout_id", "checkout_id", "is_member").select(
        "application_id", "is_member")


def key_uniqueness(spark, sf_dir):
    return key_violations(read_table(spark, sf_dir, "lineitem"), ["l_orderkey"])


# --- G: rules on the enriched spine ------------------------------------------------------
def _rule(col_fn, *need: str) -> Query:
    """A rule on the spine, joined with the lookups of the columns ``need`` only."""

    def q(spark, sf_dir):
        return _enriched(spark, sf_dir, *need).select(_app_id(), *col_fn())
    return q


PLAN = ("purchase_member", "charge_mart_product_platform", "charge_mart_product_group", "session_instrument_type")
CAPTURED = (*PLAN, "checkout_mart_is_platform")
funnel_stage = _rule(lambda: [R.funnel_stage(P).alias("funnel_stage"), R.proactive_flag(P).alias("proactive_flag"),
                              R.prequal_flag(P).alias("prequal_flag")], "prequal_creation_type")
repeat_flag = _rule(lambda: [R.repeat_flag(P).alias("repeat_flag")], "person_first_capture")
new_to_group_flag = _rule(lambda: [R.new_to_group_flag(P).alias("group_new_flag")], "person_first_capture_at_group")
approval_rules = _rule(lambda: [R.is_approved(P).alias("is_approved"), R.is_checkout_approved(P).alias("is_checkout_approved")])
reason_select = _rule(lambda: [R.decline_reason().alias("decline_reason")])
application_category = _rule(
    lambda: [R.application_category(P).alias("application_category")], "checkout_mart_is_platform", "checkout_mart_is_adaptive",
    "ud_label", "ud_is_onboarded", "ud_first_onboarded", "md_product_type", "md_merchant_id", "cs_state_to", "dec_created",
)
plan_kind = _rule(lambda: [R.plan_kind(P).alias("plan_kind")], *PLAN)
captured_category = _rule(lambda: [R.captured_category(P, R.plan_kind(P)).alias("captured_category")], *CAPTURED)
captured_subcategory = _rule(lambda: [R.captured_subcategory(P, R.plan_kind(P)).alias("captured_subcategory")], *CAPTURED)
category_index = _rule(lambda: [R.core_index(P, R.captured_category(P, R.plan_kind(P))).alias("core_index")], *CAPTURED)
merchant_category = _rule(
    lambda: [R.merchant_category(P, R.captured_category(P, R.plan_kind(P))).alias("captured_merchant_category")], *CAPTURED
)
version_select = _rule(lambda: [R.score_version(P).alias("score_version"), R.score_by_loan(P).alias("score_v1")])
label_map = _rule(lambda: [R.partner_flag(P, F.col("md_partner_id")).alias("merchant_partner_flag")], "md_partner_id")


def offer_count(spark, sf_dir):
    e = _enriched(spark, sf_dir, "terms_loan_type1")
    slots = [F.col(f"terms_loan_type{i}") for i in (1, 2, 3)]
    return e.select(_app_id(), R.number_of_offers(P, slots).alias("number_of_offers"),
                    slot_count_leading(slots).alias("leading_slots"))


def slot_min_max(spark, sf_dir):
    s = _stitched(spark, sf_dir)
    a = slot_coalesce([F.col(f"cf_offered_apr{i}") for i in (1, 2, 3)], [F.col(f"pq_offered_apr{i}") for i in (1, 2, 3)])
    return s.select(_app_id(), slot_min(a).alias("min_offered_apr"), slot_max(a).alias("max_offered_apr"))


def slot_min_sentinel_q(spark, sf_dir):
    t = role_frame(spark, sf_dir, "offered_terms")
    dps = [F.col(f"down_payment{i}") for i in (1, 2, 3)]
    return t.select("checkout_id", slot_min_sentinel(dps, P.dp_sentinel).alias("min_down_payment"))


def indicator_complement(spark, sf_dir):
    cf = prefixed(role_frame(spark, sf_dir, "checkout_funnel"), "cf_")
    m = R.monthly_index()
    return cf.select(F.col("cf_application_id").alias("application_id"), m.alias("monthly_index"),
                     (F.lit(1) - m).alias("biweekly_index"))


def indicator_defaults(spark, sf_dir):
    e = _enriched(spark, sf_dir, "bo_indicator", "uw_student_balance")
    return e.select(
        _app_id(),
        F.coalesce(F.col("cf_is_confirmed"), F.lit(0)).alias("is_confirmed"),
        F.coalesce(F.col("bo_indicator"), F.lit(0)).alias("bad_outcome_index"),
        R.autopay_flag(P).alias("autopay_flag"),
        flag(F.coalesce(F.col("uw_student_balance"), F.lit(0)) > 0).alias("student_loan_index"),
    )


def flag_and(spark, sf_dir):
    e = _enriched(spark, sf_dir, "risky_flag", "risky_metro_flag")
    e = e.withColumn("risk_pattern_index", R.risk_pattern_index(P, F.col("risky_flag")))
    e = e.withColumn("risk_metro_index", flag(F.col("risky_metro_flag").isNotNull()))
    both = flag((F.col("risk_metro_index") == 1) & (F.col("risk_pattern_index") == 1))
    return e.select(_app_id(), "risk_pattern_index", "risk_metro_index", both.alias("risk_merchant_and_metro_index"))


def _tenure_pairs(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship")).join(
        read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def tenure_fractional(spark, sf_dir):
    t = _tenure_pairs(spark, sf_dir)
    return t.select("o_orderkey", months_fractional("last_ship", "o_orderdate").alias("tenure_months"))


def tenure_month_boundaries(spark, sf_dir):
    t = _tenure_pairs(spark, sf_dir)
    return t.select("o_orderkey", month_boundaries("o_orderdate", "last_ship").alias("month_boundaries"))


def null_safe_sum_q(spark, sf_dir):
    uw = signals_rollup(spark, sf_dir)
    return uw.select("application_id", null_safe_sum("min_exposure_dollars", "exposure_dollars", "min_exposure_dollars")
                     .alias("exposure_limit_dollars"))


def funnel_mart_q(spark, sf_dir):
    """The flagship: as-of split into (user, hour) buckets so a hot user is spread."""
    return funnel_mart(roles(spark, sf_dir), P)


def funnel_mart_key_window(spark, sf_dir):
    """The flagship with the as-of in windows of a user and a day (fewer, longer windows)."""
    return funnel_mart(roles(spark, sf_dir), P, bucket_seconds=86400)


#: Mart outputs that are ids.
ID_COLUMNS = ("application_id", "charge_id", "prequal_id", "checkout_id", "user_id", "numeric_user_id", "person_id", "merchant_id")


def funnel_mart_string_ids(spark, sf_dir):
    """The flagship over roles with string ids and without the optional tie keys."""
    schemas = role_schemas(id_type="STRING")
    sources = {}
    for role, df in roles(spark, sf_dir).items():
        optional = OPTIONAL.get(role, ())
        kinds = {f.name: f.dataType for f in role_schema(role, schemas).fields}
        df = df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns if c not in optional])
        sources[role] = conform(df, role, schemas)
    return funnel_mart(sources, P)


def funnel_mart_reference_order(spark, sf_dir):
    """The flagship with all enrichment joins after the stitch, in the reference's order: same
    rows, more shuffles of the spine at scale."""
    p = P
    s = roles(spark, sf_dir)
    spine = stitched_spine(s["checkout_funnel"], s["prequal_funnel"], p)
    from funnelkit.plans.mart import mart_columns, narrowed
    return mart_columns(enrich_spine(narrowed(spine, p), s, p, bucket_seconds=3600, order="reference"), p)


def lookup_key_report(spark, sf_dir):
    from funnelkit.plans.mart import lookup_key_report as report
    sources = roles(spark, sf_dir)
    return report(sources | {"risky_metro": role_frame(spark, sf_dir, "risky_metro_repeated")})


def mart_fan_out(spark, sf_dir):
    """The fan-out guard inside the mart, on a metro list with repeated names."""
    sources = roles(spark, sf_dir)
    return fan_out_report(sources | {"risky_metro": role_frame(spark, sf_dir, "risky_metro_repeated")}, P)


def rule_coverage_q(spark, sf_dir):
    return rule_coverage(roles(spark, sf_dir), P)


def _own_tasks(query: Query) -> Query:
    """``query``, not touched by the task size that a query before it took in this session."""

    @wraps(query)
    def q(spark, sf_dir):
        return query(as_given(spark), sf_dir)
    return q


QUERIES: dict[str, Query] = {name: _own_tasks(query) for name, query in {
    "lookback_filter": lookback_filter,
    "stage_prefilter": stage_prefilter_q,
    "distinct_keys_lookback": distinct_keys_lookback,
    "no_file_keys": no_file_keys_q,
    "no_file_keys_partitioned": no_file_keys_partitioned,
    "null_not_in": null_not_in,
    "pattern_flags": pattern_flags,
    "report_window": report_window_q,
    "date_gate": date_gate_q,
    "asof_latest_state": asof_latest_state,
    "asof_latest_state_bucketed": asof_latest_state_bucketed,
    "asof_bounded_history": asof_bounded_history,
    "asof_from_snapshot": asof_from_snapshot_q,
    "signals_incremental": signals_incremental,
    "latest_non_null": latest_non_null_q,
    "signals_rollup": signals_rollup,
    "stitch_full_outer": stitch_full_outer,
    "stitch_split": stitch_split_q,
    "slot_coalesce": slot_coalesce_q,
    "enrich_left": enrich_left_q,
    "enrich_chain": enrich_chain_q,
    "enrich_coalesced_key": enrich_coalesced_key,
    "fallback_key_join": fallback_key_join,
    "membership_flag": membership_flag,
    "key_uniqueness": key_uniqueness,
    "lookup_key_report": lookup_key_report,
    "mart_fan_out": mart_fan_out,
    "rule_coverage": rule_coverage_q,
    "funnel_stage": funnel_stage,
    "repeat_flag": repeat_flag,
    "new_to_group_flag": new_to_group_flag,
    "approval_rules": approval_rules,
    "reason_select": reason_select,
    "offer_count": offer_count,
    "slot_min_max": slot_min_max,
    "slot_min_sentinel": slot_min_sentinel_q,
    "plan_kind": plan_kind,
    "captured_category": captured_category,
    "captured_subcategory": captured_subcategory,
    "category_index": category_index,
    "merchant_category": merchant_category,
    "application_category": application_category,
    "indicator_complement": indicator_complement,
    "indicator_defaults": indicator_defaults,
    "version_select": version_select,
    "label_map": label_map,
    "flag_and": flag_and,
    "tenure_fractional": tenure_fractional,
    "tenure_month_boundaries": tenure_month_boundaries,
    "null_safe_sum": null_safe_sum_q,
    "funnel_mart": funnel_mart_q,
    "funnel_mart_incremental": funnel_mart_incremental,
    "funnel_mart_refreshed": funnel_mart_refreshed,
    "funnel_mart_key_window": funnel_mart_key_window,
    "funnel_mart_string_ids": funnel_mart_string_ids,
    "funnel_mart_reference_order": funnel_mart_reference_order,
}.items()}
