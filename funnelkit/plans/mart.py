"""The flagship: one wide row per application across the two funnel stages.

Data flow (each step is a DataFrame operator; Catalyst/AQE choose the physical plan):

1. early stage: ``prequal_stage`` (B5 filter + applied flag); late stage: the part of the
   reporting window that a late row can decide by itself goes to its scan;
2. ``stitch_branches`` late x early on the prequal id (the exact split form of the full
   outer join, C4: skew-splittable joins, salted NULL keys) with the prequal master, which shares
   that key and its shuffle, and on both branches the whole reporting window (B6/B7);
3. rows with a late stage that report: the key groups only they have (checkout, charge,
   application, address, postal code, metro, guarantee), then the early-only rows join them;
4. the groups keyed by either stage (merchant, user); every key is shuffled once
   (``enrichment_steps``, ``GROUPED_ORDER``) and the non-key columns travel packed in a struct;
5. classification columns (G rules), each computed once;
6. projection to the 94-column contract.

The side paths are aggregations (signals, no-file keys, person statistics) or a
linear as-of (card state): no range join, no ``collect``, no per-key Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.functions.columns import default_zero, flag, is_missing
from funnelkit.functions.dates import date_gate, lookback_start, month_boundaries, months_fractional
from funnelkit.functions.slots import null_safe_sum, slot_coalesce, slot_max, slot_min, slot_min_sentinel
from funnelkit.operators.asof import asof_latest
from funnelkit.operators.enrich import Lookup, enrich_colocated, key_violations
from funnelkit.operators.enrich import enrich_group as _enrich_group
from funnelkit.operators.filters import since, stage_prefilter, window_condition
from funnelkit.operators.incremental import (
    advance_snapshot, asof_from_snapshot, event_snapshot, finish_signals, merge_states, signal_state,
)
from funnelkit.operators.latest import distinct_keys, signal_rollup
from funnelkit.operators.stitch import prefixed, stitch_branches
from funnelkit.plans import rules as R
from funnelkit.plans.params import MartParams

PREQUAL_COLUMNS = (
    "application_id", "charge_id", "user_id", "prequal_id", "checkout_id", "start_date",
    "decision_state", "is_applied", "merchant_id", "declined_reason", "approved_amount",
    "offered_apr1", "offered_apr2", "offered_apr3", "bureau_score", "score_version",
    "risk_score_v1", "risk_score",
)


def prequal_stage(prequal_funnel: DataFrame, p: MartParams) -> DataFrame:
    """Decided, de-duplicated, approved-or-declined prequal rows, with the applied
    flag derived from the decider count."""
    df = stage_prefilter(prequal_funnel, "num_deciders_run", "is_deduped", "decision_state", p.prequal_states)
    df = df.withColumn("is_applied", flag(default_zero("num_deciders_run") > 0))
    return df.select(*PREQUAL_COLUMNS)


def no_file_keys(decision_log: DataFrame, p: MartParams) -> DataFrame:
    """Charges decided in the lookback without a bureau score and without a
    usable credit report."""
    df = since(decision_log, "event_time", lookback_start(p.start, p.lookback_days)).where(
        F.col("decision_type").isin(*p.decision_types)
        & F.col("bureau_score").isNull()
        & is_missing("report_id", *p.report_sentinels)
    )
    return distinct_keys(df, ["charge_id"])


def present(df: DataFrame, *cols: str) -> list[str]:
    """Those of ``cols`` that ``df`` has (tie keys are optional)."""
    return [c for c in cols if c in df.columns]


def bounded_history(events: DataFrame, key: str, ts: str, tie: list[str], floor) -> DataFrame:
    """Events at or after ``floor``, plus each key's latest event before it.

    For as-of lookups at or after ``floor`` this is exact: of all older events only
    the latest per key can ever be matched. The older history (an append-only log that
    grows without bound) shrinks to one row per key by a partial aggregation.
    """
    return since(events, ts, floor).unionByName(event_snapshot(events, key, ts, tie, floor))


def card_state(
    prequal_decision: DataFrame, card_state_event: DataFrame, p: MartParams, bucket_seconds=None, snapshot: DataFrame | None = None
) -> DataFrame:
    """C1 for every prequal decision with a guarantee: the user's card state as of the decision.

    Decisions before the lookback keep their row (the mart needs their time) with a NULL state,
    which is what joining the lookback-filtered as-of result would give; they and the ones
    without a guarantee, which nothing can join, do not enter the as-of. Of the event
    history before the window only each user's last event can be matched: the bucketed
    as-of summarises it, the plain one gets it reduced to that. With a ``snapshot`` at the lookback's
    first instant (``card_state_snapshot``) the history before it is not read at all.
    """
    floor = lookback_start(p.start, p.lookback_days)
    decisions = prequal_decision.where(F.col("guarantee_id").isNotNull())
    columns = ("decision_id", "user_id", "guarantee_id", "created")
    tie = present(card_state_event, "event_id")
    recent = since(decisions, "created", floor).select(*columns)
    options = {"tie": tie, "left_salt": ["decision_id"], "bucket_seconds": bucket_seconds}
    if snapshot is not None:
        asof = asof_from_snapshot(recent, snapshot, card_state_event, "user_id", "created", "created", {"state_to": "state_to"}, floor, **options)
    else:
        history = card_state_event if bucket_seconds else bounded_history(card_state_event, "user_id", "created", tie, floor)
        asof = asof_latest(recent, history, "user_id", "created", "created", {"state_to": "state_to"}, left_floor=floor, **options)
    asof = asof.select("decision_id", "guarantee_id", "created", "state_to")
    older = decisions.where(F.coalesce(F.col("created") < floor, F.lit(True)))
    return asof.unionByName(older.select("decision_id", "guarantee_id", "created", F.lit(None).cast("string").alias("state_to")))


def card_state_snapshot(card_state_event: DataFrame, p: MartParams, before: DataFrame | None = None) -> DataFrame:
    """Each user's last card event before the lookback: from the whole log, or from the snapshot of an earlier run
    (``before``) and the events that came in since."""
    floor = lookback_start(p.start, p.lookback_days)
    tie = present(card_state_event, "event_id")
    if before is None:
        return event_snapshot(card_state_event, "user_id", "created", tie, floor)
    return advance_snapshot(before, card_state_event, "user_id", "created", tie, floor)


SIGNAL_MAXIMA = {
    "exposure_dollars": ("exposure_cents", 100),
    "min_exposure_dollars": ("min_exposure_cents", 100),
    "annual_income_dollars": ("income_dollars", None),
}
SIGNAL_LATEST = {"metro": "metro", "student_balance": "student_balance"}


def _application_runs(app_run_bridge: DataFrame, runs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The runs of each application, and the columns that order them."""
    tie = present(runs, "line_no", "part_no")
    bridge = app_run_bridge.select("application_id", F.col("run_id").alias("__run"), F.col("decision_type").alias("__name"))
    base = bridge.join(runs, (F.col("__run") == F.col("run_id")) & (F.col("__name") == F.col("run_name")), "inner").select(
        "application_id", "created", *tie, "exposure_cents", "min_exposure_cents", "income_dollars", "metro", "student_balance"
    )
    return base, ["created", *tie]


def underwriting_signals(app_run_bridge: DataFrame, decision_run: DataFrame, p: MartParams) -> DataFrame:
    """Per application, max of each signal with NULL read as 0, the
    dollar conversion, and the latest non-NULL metro and balance. The lookback filter
    is on the run side, so the left join is an inner join (T17)."""
    base, order = _application_runs(app_run_bridge, since(decision_run, "created", lookback_start(p.start, p.lookback_days)))
    return signal_rollup(base, ["application_id"], max_zero=SIGNAL_MAXIMA, latest=SIGNAL_LATEST, order=order)


def underwriting_states(app_run_bridge: DataFrame, decision_run: DataFrame) -> DataFrame:
    """The signals' state per application and day, of the runs given: a refresh passes the runs of the days that are
    new or got new bridge rows, and puts these days into the state table (``write_days``)."""
    base, order = _application_runs(app_run_bridge, decision_run)
    return signal_state(base, ["application_id"], "created", SIGNAL_MAXIMA, SIGNAL_LATEST, order)


def signals_from_states(states: DataFrame, p: MartParams) -> DataFrame:
    """``underwriting_signals`` from the states of its days. The lookback starts at midnight, so whole days are
    in or out, and days that fall out of it need no update."""
    inside = states.where(F.col("day") >= lookback_start(p.start, p.lookback_days))
    return finish_signals(merge_states(inside, ["application_id"]), ["application_id"], SIGNAL_MAXIMA, SIGNAL_LATEST)


def reporting_window(p: MartParams) -> Column:
    return window_condition(
        p.start,
        [F.col("pq_start_date"), F.col("cf_start_date")],
        [F.col("cf_captured_dt"), F.col("cf_first_capture_dt")],
        [F.col("cf_is_checkout_applied"), F.col("pq_is_applied")],
    )


def late_may_report(p: MartParams) -> Column:
    """What the reporting window implies for a late row alone: a linked row may still get its
    early stage's start date, and its applied flag where it has none."""
    start = F.lit(p.start).cast("timestamp_ntz")
    linked = F.col("cf_prequal_id").isNotNull()
    captured = F.coalesce(F.col("cf_captured_dt"), F.col("cf_first_capture_dt"))
    applied = F.col("cf_is_checkout_applied")
    return ((F.col("cf_start_date") >= start) | (captured >= start) | linked) & ((applied > 0) | (applied.isNull() & linked))


def stitched_spine(checkout_funnel: DataFrame, prequal_funnel: DataFrame, p: MartParams, window: bool = True) -> DataFrame:
    """Both stages stitched, without any enrichment."""
    late = prefixed(checkout_funnel, "cf_")
    early = prefixed(prequal_stage(prequal_funnel, p), "pq_")
    matched, early_only = stitch_stages(late.where(late_may_report(p)) if window else late, early, late, p, window)
    return matched.unionByName(early_only, allowMissingColumns=True)


def stitch_stages(
    late: DataFrame, early: DataFrame, all_late: DataFrame, p: MartParams, window: bool = True, lookups: Iterable[Lookup] = ()
) -> tuple[DataFrame, DataFrame]:
    """Rows with a late stage and rows without one, both inside the reporting window. What a late row
    alone cannot decide is decided here, before any of its other joins."""
    matched, early_only = stitch_branches(
        late, early, "cf_prequal_id", "pq_prequal_id", late_salt=["cf_application_id"], early_salt=["pq_application_id"],
        late_keys=all_late.select("cf_prequal_id"), lookups=tuple(lookups),
    )
    if not window:
        return matched, early_only
    of_early = window_condition(p.start, [F.col("pq_start_date")], [F.lit(None).cast("timestamp_ntz")], [F.col("pq_is_applied")])
    return matched.where(reporting_window(p)), early_only.where(of_early)


#: Late columns that the stitch and the reporting window take.
STITCH_COLUMNS = ("cf_application_id", "cf_prequal_id", "cf_start_date", "cf_captured_dt", "cf_first_capture_dt", "cf_is_checkout_applied")


def late_packed(late: DataFrame) -> DataFrame:
    """The late stage with the columns that neither stitch nor reporting window takes as one struct ``__late``: most rows are
    dropped after the stitch, and it need not copy their columns one by one."""
    return late.select(*STITCH_COLUMNS, F.struct(*[c for c in late.columns if c not in STITCH_COLUMNS]).alias("__late"))


SPINE_IDS = ("cf_application_id", "pq_application_id")
# Spine columns used as join keys or salts by the enrichment.
SPINE_KEYS = (
    "cf_application_id", "pq_application_id", "pq_prequal_id", "cf_checkout_id", "cf_charge_id",
    "cf_guarantee_id", "cf_merchant_id", "pq_merchant_id", "cf_user_id", "pq_user_id",
)


def enrich_group(df, key, lookups):
    """Grouped left joins whose NULL keys are salted by the row's stage ids."""
    return _enrich_group(df, key, lookups, spread_nulls=True, salt_cols=present(df, *SPINE_IDS))


@dataclass(frozen=True)
class EnrichStep:
    """One enrichment join: ``key`` names the key group, ``expr`` computes the key
    when it is not a plain column."""

    key: str
    lookup: Lookup
    expr: Column | None = None


def enrichment_steps(
    s: dict[str, DataFrame], p: MartParams, bucket_seconds=None, need: Iterable[str] | None = None
) -> list[EnrichStep]:
    """The enrichments in the reference's join order (chains keep their order), with ``need`` only
    those that its columns take. ``s`` may hold state of earlier runs in place of history: ``card_state_snapshot``
    (the card events before the lookback are then not read) and ``signal_states`` (the runs are not read)."""
    takes = lambda *starts: need is None or any(c.startswith(starts) for c in need)
    merchant = F.coalesce(F.col("cf_merchant_id"), F.col("pq_merchant_id"))   # late first (C5)
    user = F.coalesce(F.col("pq_user_id"), F.col("cf_user_id"))               # early first (C5)
    metro = F.coalesce(F.col("uw_metro"), F.col("zip_metro"))                 # fallback key (C8)
    # Side paths of several operators are built only where they are used.
    cs = uw = None
    if takes("dec_", "cs_"):
        cs = card_state(s["prequal_decision"], s["card_state_event"], p, bucket_seconds, s.get("card_state_snapshot"))
    if takes("uw_", "risky_metro_"):
        states = s.get("signal_states")
        uw = underwriting_signals(s["app_run_bridge"], s["decision_run"], p) if states is None else signals_from_states(states, p)
    def L(role, key, columns, **options):
        return Lookup(s[role] if isinstance(role, str) else role[1], key, columns, role=role if isinstance(role, str) else role[0], **options)

    steps = [
        EnrichStep("pq_prequal_id", L("prequal", "prequal_id", {"prequal_creation_type": "creation_type"})),
        EnrichStep("cf_guarantee_id", L(("prequal_decision", cs), "guarantee_id", {"dec_created": "created", "cs_state_to": "state_to"})),
        EnrichStep("merchant", L("merchant_dim", "merchant_id", {f"md_{c}": c for c in s["merchant_dim"].columns}),
                   merchant),
        EnrichStep("md_merchant_id", L("risky_merchant", "merchant_id", {"risky_flag": "flag", "risky_status": "status"})),
        EnrichStep("md_merchant_id", L("merchant_segment", "merchant_id", {"seg_division": "division"})),
        EnrichStep("cf_checkout_id", L("checkout_session", "checkout_id", {"session_instrument_type": "instrument_type"})),
        EnrichStep("cf_checkout_id", L("checkout_mart", "checkout_id",
                                       {"checkout_mart_is_platform": "is_platform", "checkout_mart_is_adaptive": "is_adaptive"})),
        EnrichStep("cf_charge_id", L("charge_mart", "charge_id",
                                     {"charge_mart_product_platform": "product_platform", "charge_mart_product_group": "product_group"})),
        EnrichStep("cf_checkout_id", L("purchases", "checkout_id", {"purchase_member": "checkout_id"}, member=True)),
        EnrichStep("user", L("user_dim", "user_id", {f"ud_{c}": c for c in (
            "numeric_id", "person_id", "label", "is_onboarded", "first_onboarded")}), user),
        EnrichStep("ud_person_id", L("person_stats", "person_id", {
            "person_first_capture": "first_capture", "person_first_capture_at_group": "first_capture_at_group"})),
        EnrichStep("cf_checkout_id", L("offered_terms", "checkout_id", {f"terms_{c}": c for c in (
            "loan_type1", "loan_type2", "loan_type3", "down_payment1", "down_payment2", "down_payment3")})),
        EnrichStep("cf_charge_id", L(("decision_log", no_file_keys(s["decision_log"], p)), "charge_id", {"nofile_member": "charge_id"},
                                     member=True)),
        EnrichStep("cf_charge_id", L("bad_outcome", "charge_id", {"bo_indicator": "indicator"})),
        EnrichStep("cf_application_id", L(("signals", uw), "application_id", {f"uw_{c}": c for c in (
            "metro", "student_balance", "exposure_dollars", "min_exposure_dollars", "annual_income_dollars")})),
        EnrichStep("cf_application_id", L("application", "application_id",
                                          {"app_billing_address_id": "billing_address_id"})),
        EnrichStep("app_billing_address_id", L("address", "address_id",
                                               {"ua_region_code": "region_code", "ua_postal_code": "postal_code"})),
        EnrichStep("ua_postal_code", L("postal_metro", "postal_code", {"zip_metro": "metro"})),
        EnrichStep("metro", L("risky_metro", "metro", {"risky_metro_flag": "flag"}), metro),
    ]
    return needed_steps(steps, need)


# Key groups in the order the mart joins them: every key's lookups together, chains
# after the keys they depend on.
EARLY_ORDER = ("pq_prequal_id",)
LATE_ORDER = (
    "cf_checkout_id", "cf_charge_id", "cf_application_id", "app_billing_address_id", "ua_postal_code", "metro",
    "cf_guarantee_id",
)
BOTH_ORDER = ("merchant", "md_merchant_id", "user", "ud_person_id")
GROUPED_ORDER = EARLY_ORDER + LATE_ORDER + BOTH_ORDER
#: Lookup columns a computed key is made of.
KEY_SOURCES = {"metro": ("uw_metro", "zip_metro")}


def needed_steps(steps: list[EnrichStep], need: Iterable[str] | None) -> list[EnrichStep]:
    """The steps that produce the columns in ``need`` (None: all) and the ones their keys come from.

    A left join whose right side is not known to be unique cannot be dropped by Spark, so a
    caller that wants a few columns says so.
    """
    if need is None:
        return steps
    wanted, kept = set(need), []
    for st in reversed(steps):
        if wanted & set(st.lookup.columns):
            kept.append(st)
            wanted.update(KEY_SOURCES.get(st.key, (st.key,)))
    return kept[::-1]


def join_runs(df: DataFrame, steps: list[EnrichStep]) -> DataFrame:
    """Join the steps in order, lookups on one key together.

    Only the join keys travel as top-level columns; every other column is packed into one
    struct for the joins and unpacked afterwards. The joins' generated code then passes one
    value per row instead of ~70, and the rows shuffled are the same. Every shuffle of the
    frame is the one its sort-merge join requires, which is the kind AQE can split when a
    key is skewed (an explicit repartition it cannot).
    """
    if not steps:
        return df
    runs: list[list[EnrichStep]] = []
    for st in steps:
        if runs and runs[-1][0].key == st.key:
            runs[-1].append(st)
        else:
            runs.append([st])
    keys = [c for c in (*SPINE_KEYS, "uw_metro", "zip_metro") if c in df.columns]
    payload = [c for c in df.columns if c not in keys]
    out = df.select(*keys, F.struct(*payload).alias("__spine"))
    for run in runs:
        out = enrich_group(out, run[0].expr if run[0].expr is not None else run[0].key, [st.lookup for st in run])
    return out.select("*", "__spine.*").drop("__spine")


def enrich_spine(
    spine: DataFrame, s: dict[str, DataFrame], p: MartParams, bucket_seconds=None, order: str = "grouped",
    need: Iterable[str] | None = None,
) -> DataFrame:
    """The enrichment joins on an already stitched spine.

    ``order='grouped'`` joins all lookups of one key consecutively (12 key groups, one
    spine shuffle each when not broadcast); ``order='reference'`` keeps the reference's
    join order, where the key changes more often.
    """
    steps = enrichment_steps(s, p, bucket_seconds, need)
    if order == "grouped":
        steps = sorted(steps, key=lambda st: GROUPED_ORDER.index(st.key))
    elif order != "reference":
        raise ValueError(f"unknown join order {order!r}")
    return join_runs(spine, steps)


def enriched_spine(
    s: dict[str, DataFrame], p: MartParams, bucket_seconds: int | None = 3600, need: Iterable[str] | None = None,
    guard: str | None = None, colocated: Iterable[str] = (), narrow: bool = False,
) -> DataFrame:
    """The stitched, windowed spine with its enrichments (``need``: only what these columns take).

    Lookups keyed by a late-stage id are joined to the rows with a late stage that report: rows of
    the other stage could not match and rows outside the window would be dropped, and neither
    is shuffled for them. Same rows as ``enrich_spine(stitched_spine(...))``.

    ``guard`` watches every value lookup's fan-out (``Lookup``). ``colocated`` names late-stage keys (plain
    columns, at most one of which a table can be laid out by) that the checkout funnel and the lookups
    are bucketed on: these are joined at the scan, without any shuffle. Where ``s["checkout_funnel"]`` is cut to some rows,
    ``s["late_links"]`` holds the prequal ids of all late rows: an early row is early-only if none has its id.
    ``narrow`` computes the ``stage_outputs`` before the joins (``narrowed``), for ``mart_columns``.
    """
    steps = enrichment_steps(s, p, bucket_seconds, need)
    if guard:
        steps = [replace(st, lookup=replace(st.lookup, guard=guard)) for st in steps]
    of = lambda order: sorted((st for st in steps if st.key in order), key=lambda st: order.index(st.key))
    at_scan, late_steps = [], []
    for st in of(LATE_ORDER):
        (at_scan if st.key in colocated else late_steps).append(st)
    late = prefixed(s["checkout_funnel"], "cf_")
    all_late = prefixed(s["late_links"], "cf_") if "late_links" in s else late
    late = late.where(late_may_report(p))
    for key in dict.fromkeys(st.key for st in at_scan):
        late = enrich_colocated(late, key, [st.lookup for st in at_scan if st.key == key])
    if narrow:
        late = late_packed(late)
    early = prefixed(prequal_stage(s["prequal_funnel"], p), "pq_")
    matched, early_only = stitch_stages(late, early, all_late, p, lookups=[st.lookup for st in of(EARLY_ORDER)])
    if narrow:
        matched = matched.select("*", "__late.*").drop("__late")
        matched, early_only = narrowed(matched, p), narrowed(early_only, p, matched.schema)
    spine = join_runs(matched, late_steps).unionByName(early_only, allowMissingColumns=True)
    members = [name for st in of(LATE_ORDER) if st.lookup.member for name in st.lookup.columns]
    if members:  # an early-only row is in no list
        spine = spine.withColumns({m: F.coalesce(F.col(m), F.lit(0)) for m in members})
    return join_runs(spine, of(BOTH_ORDER))


def stage_outputs(p: MartParams) -> dict[str, Column]:
    """Outputs that take columns of the two stages only, and most of these columns nobody else takes."""
    cf, pq = R.cf, R.pq
    aprs = slot_coalesce([cf(f"offered_apr{i}") for i in (1, 2, 3)], [pq(f"offered_apr{i}") for i in (1, 2, 3)])
    return {
        "is_approved": R.is_approved(p),
        "is_checkout_approved": R.is_checkout_approved(p),
        "decline_reason": R.decline_reason(),
        "offered_apr1": aprs[0],
        "offered_apr2": aprs[1],
        "offered_apr3": aprs[2],
        "bureau_score": F.coalesce(cf("bureau_score"), pq("bureau_score"), F.lit(0)),
        "score_version": R.score_version(p),
        "score_v1": R.score_by_loan(p),
        "risk_score": F.coalesce(cf("risk_score"), pq("risk_score")),
    }


#: Stage columns that only ``stage_outputs`` take.
STAGE_ONLY = (
    "cf_is_approved", "cf_declined_reason", "cf_declined_reason_instalment", "cf_declined_reason_split", "cf_financing_type",
    "cf_offered_apr1", "cf_offered_apr2", "cf_offered_apr3", "cf_bureau_score", "cf_score_version", "cf_score_version_instalment",
    "cf_score_version_split", "cf_risk_score", "cf_risk_score_v1", "cf_risk_score_instalment", "cf_risk_score_instalment_v1",
    "cf_risk_score_split", "cf_risk_score_split_v1", "pq_decision_state", "pq_declined_reason", "pq_offered_apr1",
    "pq_offered_apr2", "pq_offered_apr3", "pq_bureau_score", "pq_score_version", "pq_risk_score_v1", "pq_risk_score",
)


def narrowed(spine: DataFrame, p: MartParams, missing: T.StructType | None = None) -> DataFrame:
    """A stitched spine with the ``stage_outputs`` (as ``out_<name>``) in place of the columns that only they take, so
    that the enrichment joins shuffle the former. ``missing``: a schema whose late-stage columns an early-only spine
    lacks; they are NULL."""
    if missing is not None:
        late = {f.name: F.lit(None).cast(f.dataType) for f in missing if f.name.startswith("cf_") and f.name not in spine.columns}
        spine = spine.withColumns(late)
    return spine.withColumns({f"out_{name}": x for name, x in stage_outputs(p).items()}).drop(*STAGE_ONLY)


def mart_columns(df: DataFrame, p: MartParams, row_key: tuple[str, str] | tuple[()] = ()) -> DataFrame:
    """The 94 output columns, in contract order; with ``row_key`` also the application ids of the late and the
    early stage, under these names. ``df`` may be ``narrowed``."""
    cf, pq, c = R.cf, R.pq, R.c
    stage = {name: c(f"out_{name}") if f"out_{name}" in df.columns else x for name, x in stage_outputs(p).items()}
    df = df.withColumn("_plan_kind", R.plan_kind(p))
    df = df.withColumn("_captured_category", R.captured_category(p, F.col("_plan_kind")))
    df = df.withColumn("_monthly", R.monthly_index())
    df = df.withColumn("_pattern_index", R.risk_pattern_index(p, c("risky_flag")))
    df = df.withColumn("_metro_index", flag(c("risky_metro_flag").isNotNull()))
    start_any = F.coalesce(pq("start_date"), cf("start_date"))
    aprs = [stage[f"offered_apr{i}"] for i in (1, 2, 3)]
    cols = [
        F.coalesce(cf("application_id"), pq("application_id")).alias("application_id"),
        F.coalesce(cf("charge_id"), pq("charge_id")).alias("charge_id"),
        F.coalesce(cf("prequal_id"), pq("prequal_id")).alias("prequal_id"),
        F.coalesce(cf("checkout_id"), pq("checkout_id")).alias("checkout_id"),
        F.coalesce(cf("user_id"), pq("user_id")).alias("user_id"),
        c("ud_numeric_id").alias("numeric_user_id"),
        c("ud_person_id").alias("person_id"),
        date_gate(start_any, p.start).alias("start_date"),
        pq("start_date").alias("prequal_start_date"),
        cf("start_date").alias("checkout_start_date"),
        date_gate(F.coalesce(cf("captured_dt"), cf("first_capture_dt")), p.start).alias("captured_date"),
        cf("captured_dt").alias("captured_dt"),
        cf("first_capture_dt").alias("first_capture_dt"),
        R.funnel_stage(p).alias("funnel_stage"),
        R.proactive_flag(p).alias("proactive_flag"),
        R.repeat_flag(p).alias("repeat_flag"),
        R.new_to_group_flag(p).alias("group_new_flag"),
        months_fractional(start_any, F.coalesce(c("person_first_capture"), start_any)).alias("user_tenure_months"),
        R.is_applied().alias("is_applied"),
        stage["is_approved"].alias("is_approved"),
        stage["decline_reason"].alias("decline_reason"),
        default_zero(cf("is_checkout_applied")).alias("is_checkout_applied"),
        stage["is_checkout_approved"].alias("is_checkout_approved"),
        cf("is_approved_instalment").alias("is_checkout_instalment_approved"),
        cf("is_approved_split").alias("is_checkout_split_approved"),
        default_zero(cf("is_confirmed")).alias("is_confirmed"),
        default_zero(cf("is_authed")).alias("is_authed"),
        default_zero(cf("is_merchant_captured")).alias("is_merchant_captured"),
        default_zero(cf("is_captured")).alias("is_captured"),
        R.number_of_offers(p, [c("terms_loan_type1"), c("terms_loan_type2"), c("terms_loan_type3")]).alias("number_of_offers"),
        R.application_category(p).alias("application_category"),
        c("_captured_category").alias("captured_category"),
        R.captured_subcategory(p, c("_plan_kind")).alias("captured_subcategory"),
        R.core_index(p, c("_captured_category")).alias("core_index"),
        R.merchant_category(p, c("_captured_category")).alias("captured_merchant_category"),
        cf("loan_type").alias("checkout_loan_type"),
        cf("product_type").alias("checkout_product_type"),
        cf("flow_type").alias("checkout_flow_type"),
        cf("offered_frequency1").alias("checkout_offered_frequency1"),
        cf("offered_frequency2").alias("checkout_offered_frequency2"),
        cf("offered_frequency3").alias("checkout_offered_frequency3"),
        cf("plan_frequency").alias("plan_frequency"),
        cf("plan_interval").alias("plan_interval"),
        cf("plan_length").alias("plan_length"),
        cf("term_length").alias("term_length"),
        cf("schedule_amount").alias("schedule_amount"),
        c("_monthly").alias("monthly_index"),
        (F.lit(1) - c("_monthly")).alias("biweekly_index"),
        cf("total_amount").alias("checkout_requested_amount"),
        slot_min_sentinel([c("terms_down_payment1"), c("terms_down_payment2"), c("terms_down_payment3")], p.dp_sentinel)
        .alias("min_down_payment"),
        cf("down_payment_amount").alias("checkout_down_payment"),
        R.prequal_flag(p).alias("prequal_flag"),
        pq("approved_amount").alias("prequal_approved_amount"),
        aprs[0].alias("offered_apr1"),
        aprs[1].alias("offered_apr2"),
        aprs[2].alias("offered_apr3"),
        slot_min(aprs).alias("min_offered_apr"),
        slot_max(aprs).alias("max_offered_apr"),
        cf("apr").alias("checkout_apr"),
        R.autopay_flag(p).alias("autopay_flag"),
        stage["bureau_score"].alias("bureau_score"),
        default_zero(c("nofile_member")).alias("nofile_index"),
        stage["score_version"].alias("score_version"),
        stage["score_v1"].alias("score_v1"),
        stage["risk_score"].alias("risk_score"),
        c("md_merchant_name").alias("merchant_name"),
        c("md_merchant_id").alias("merchant_id"),
        c("md_industry").alias("merchant_industry"),
        c("md_subindustry").alias("merchant_subindustry"),
        c("md_platform").alias("merchant_platform"),
        c("md_partner_id").alias("merchant_partner_id"),
        R.partner_flag(p, c("md_partner_id")).alias("merchant_partner_flag"),
        c("md_business_type").alias("merchant_business_type"),
        c("seg_division").alias("merchant_revenue_segment"),
        c("md_city").alias("merchant_city"),
        c("md_postal_code").alias("merchant_postal_code"),
        c("md_state").alias("merchant_state"),
        F.when(
            c("md_created").isNotNull(),
            month_boundaries(F.coalesce(c("md_created").cast("date"), F.lit(p.as_of)), start_any),
        ).alias("merchant_tenure_months"),
        c("md_product_type").alias("merchant_product_type"),
        c("risky_flag").alias("risk_merchant_flag"),
        c("risky_status").alias("risk_merchant_status"),
        default_zero(c("bo_indicator")).alias("bad_outcome_index"),
        R.risk_pattern_flag(p, c("risky_flag")).alias("risk_pattern_flag"),
        c("_pattern_index").alias("risk_pattern_index"),
        c("risky_metro_flag").alias("risk_metro_flag"),
        c("_metro_index").alias("risk_metro_index"),
        flag((c("_metro_index") == 1) & (c("_pattern_index") == 1)).alias("risk_merchant_and_metro_index"),
        c("ua_region_code").alias("address_region_code"),
        F.coalesce(c("uw_metro"), c("zip_metro")).alias("user_metro"),
        flag(default_zero(c("uw_student_balance")) > 0).alias("student_loan_index"),
        c("uw_annual_income_dollars").alias("annual_income_dollars"),
        c("uw_exposure_dollars").alias("exposure_dollars"),
        c("uw_min_exposure_dollars").alias("min_exposure_dollars"),
        null_safe_sum(c("uw_min_exposure_dollars"), c("uw_exposure_dollars"), c("uw_min_exposure_dollars"))
        .alias("exposure_limit_dollars"),
    ]
    return df.select(*cols, *[x.alias(name) for name, x in zip(row_key, (cf("application_id"), pq("application_id")))])


# Value lookups of the mart and the key each must be unique on (C10). Membership
# lookups (purchases, no-file charges) are de-duplicated and cannot fan out.
LOOKUP_KEYS = (
    ("prequal", "prequal_id"),
    ("prequal_decision", "guarantee_id"),
    ("merchant_dim", "merchant_id"),
    ("risky_merchant", "merchant_id"),
    ("merchant_segment", "merchant_id"),
    ("checkout_session", "checkout_id"),
    ("checkout_mart", "checkout_id"),
    ("charge_mart", "charge_id"),
    ("user_dim", "user_id"),
    ("person_stats", "person_id"),
    ("offered_terms", "checkout_id"),
    ("bad_outcome", "charge_id"),
    ("application", "application_id"),
    ("address", "address_id"),
    ("postal_metro", "postal_code"),
    ("risky_metro", "metro"),
)


def lookup_key_report(sources: dict[str, DataFrame]) -> DataFrame:
    """C10 for the whole mart: every non-NULL key that occurs more than once in a value
    lookup, with its role and count. Each such key multiplies the spine rows it joins
    (the reference does this silently); an empty report proves the mart keeps one row
    per application. One aggregation per role, unioned."""
    parts = []
    for role, key in LOOKUP_KEYS:
        keys = sources[role].select(F.col(key).cast("string").alias("key")).where(F.col("key").isNotNull())
        parts.append(key_violations(keys, ["key"]).select(F.lit(role).alias("role"), "key", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fan_out_report(sources: dict[str, DataFrame], p: MartParams | None = None, bucket_seconds: int | None = 3600) -> DataFrame:
    """C10 inside the mart: role, rows_hit, rows_added, most for every value lookup.

    The lookups are counted where the mart joins them, on the rows that report: ``rows_hit`` of
    these meet a key that occurs more than once, which would add ``rows_added`` rows; ``most`` is the
    largest number met. Unlike ``lookup_key_report`` no role is read a second time, and repeated keys that no
    reported row has do not count.
    """
    p = p or MartParams()
    spine = enriched_spine(sources, p, bucket_seconds, guard="count")
    roles = [c for c in spine.columns if c.startswith("fan_")]
    per = [F.struct(F.lit(c[4:]).alias("role"), F.count_if(F.col(c) > 1).alias("rows_hit"),
                    F.coalesce(F.sum(F.col(c) - 1), F.lit(0)).alias("rows_added"), F.coalesce(F.max(c), F.lit(0)).alias("most"))
           for c in roles]
    return spine.agg(F.array(*per).alias("all")).select(F.explode("all").alias("one")).select("one.*")


#: Enrichment columns that the first-match rules take.
RULE_NEEDS = (
    "prequal_creation_type", "person_first_capture", "person_first_capture_at_group", "purchase_member", "charge_mart_product_platform",
    "charge_mart_product_group", "session_instrument_type", "checkout_mart_is_platform", "checkout_mart_is_adaptive", "terms_loan_type1",
    "ud_label", "md_product_type", "md_merchant_id", "cs_state_to",
)


def arm_columns(df: DataFrame, p: MartParams) -> tuple[DataFrame, dict[str, list[str]]]:
    """An enriched spine with ``arm_<rule>`` for every first-match rule, and each rule's arms."""
    df = df.withColumn("_plan_kind", R.plan_kind(p))
    df = df.withColumn("_captured_category", R.captured_category(p, F.col("_plan_kind")))
    arms = R.rule_arms(p, F.col("_plan_kind"), F.col("_captured_category"))
    return df.withColumns({f"arm_{rule}": x for rule, (x, _) in arms.items()}), {rule: names for rule, (_, names) in arms.items()}


def rule_coverage(sources: dict[str, DataFrame], p: MartParams | None = None, bucket_seconds: int | None = 3600) -> DataFrame:
    """Rule, arm, rows: how many of the mart's rows each arm of each first-match rule decides, with 0 for arms that
    none reaches. One aggregation over the spine."""
    p = p or MartParams()
    spine, arms = arm_columns(enriched_spine(sources, p, bucket_seconds, need=RULE_NEEDS), p)
    counts = [
        F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("arm"), F.count_if(F.col(f"arm_{rule}") == name).alias("rows"))
        for rule, names in arms.items() for name in names
    ]
    return spine.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("one")).select("one.*")


def funnel_mart(
    sources: dict[str, DataFrame], p: MartParams | None = None, bucket_seconds: int | None = 3600, guard: str | None = None,
    colocated: Iterable[str] = (),
) -> DataFrame:
    """The mart. ``bucket_seconds`` splits the as-of work into (user, time bucket)
    partitions (None: one window partition per user). ``guard="raise"`` stops the run where a
    lookup would multiply a row; ``colocated`` as in ``enriched_spine``."""
    if guard not in (None, "raise"):
        raise ValueError(f"unknown guard {guard!r}; fan_out_report counts")
    p = p or MartParams()
    return mart_columns(enriched_spine(sources, p, bucket_seconds, guard=guard, colocated=tuple(colocated), narrow=True), p)
