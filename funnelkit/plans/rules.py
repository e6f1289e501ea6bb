"""The mart's classification rules as Column builders.

Column naming contract (what the mart and the fixture queries provide): late-stage
(checkout) columns are prefixed ``cf_``, early-stage (prequal) columns ``pq_``;
enrichment columns carry the prefix of their source: ``md_`` merchant, ``risky_`` risky
merchant, ``seg_`` revenue segment, ``session_`` checkout session, ``checkout_mart_`` checkout
mart, ``charge_mart_`` charge mart, ``terms_`` offered terms, ``ud_`` user, ``person_`` person
statistics, ``prequal_`` prequal master, ``dec_``/``cs_`` as-of card state, ``uw_``
signals, ``ua_`` address, ``zip_`` postal metro, ``risky_metro_`` risky metro, plus the 0/1
members ``purchase_member``, ``nofile_member``.

Every rule is one first-match ``CASE`` built with ``waterfall``; a rule used by
several outputs (the plan kind, the captured category) is computed once as a column
and referenced by name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelkit.functions.columns import flag
from funnelkit.functions.dates import _date_lit
from funnelkit.operators.waterfall import tracing_arms, waterfall
from funnelkit.plans.params import MartParams


def in_ids(col: Column, ids) -> Column:
    """Is an id in a parameter list? Ids of any type are compared as text."""
    return col.cast("string").isin(*[str(i) for i in ids])


def cf(name: str) -> Column:
    return F.col("cf_" + name)


def pq(name: str) -> Column:
    return F.col("pq_" + name)


def c(name: str) -> Column:
    return F.col(name)


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def tomorrow(p: MartParams) -> Column:
    return F.date_add(_date_lit(p.as_of), 1)


# --- G1, G2, G17: funnel stage -------------------------------------------------------
def early_without_late() -> Column:
    return (_zero(pq("is_applied")) > 0) & cf("prequal_id").isNull()


def funnel_stage(p: MartParams) -> Column:
    L = p.labels
    return waterfall(
        [(early_without_late(), L.early_no_late), (cf("prequal_id").isNotNull(), L.early_at_late)],
        L.late_only,
    )


def proactive_flag(p: MartParams) -> Column:
    return waterfall([(c("prequal_creation_type") == p.proactive_type, p.labels.proactive)], p.labels.other)


def prequal_flag(p: MartParams) -> Column:
    cond = (_zero(pq("is_applied")) > 0) | cf("prequal_id").isNotNull()
    return waterfall([(cond, p.labels.prequal)], p.labels.non_prequal)


# --- G3, G4: customer history flags ---------------------------------------------------
def activity_time() -> Column:
    """Event time of the customer flags: early start, else the checkout creation (T5)."""
    return F.coalesce(pq("start_date"), cf("checkout_created_dt"))


def repeat_flag(p: MartParams) -> Column:
    first = F.coalesce(c("person_first_capture"), tomorrow(p))
    return waterfall([(activity_time() > first, p.labels.repeat)], p.labels.new)


def new_to_group_flag(p: MartParams) -> Column:
    L = p.labels
    merchant = F.coalesce(pq("merchant_id"), cf("merchant_id"))
    user = F.coalesce(pq("user_id"), cf("user_id"))
    first = F.coalesce(c("person_first_capture_at_group"), tomorrow(p))
    t = activity_time()
    return waterfall(
        [
            (~in_ids(merchant, p.focus_retailer_ids), L.not_in_group),
            (user.isNotNull() & (t <= first), L.new_to_group),
            (user.isNotNull() & (t > first), L.repeat_in_group),
        ],
        L.unknown,
    )


# --- G5-G8: outcomes -----------------------------------------------------------------
def is_applied() -> Column:
    return flag(F.coalesce(cf("is_checkout_applied"), pq("is_applied"), F.lit(0)) > 0)


def _split_product(p: MartParams) -> Column:
    return cf("financing_type").ilike(p.split_pattern)


def _approval_legs(p: MartParams, start_for_split: Column) -> list[tuple[Column, Column]]:
    inst, split = _zero(cf("is_approved_instalment")), _zero(cf("is_approved_split"))
    sp = _split_product(p)
    amt = cf("total_amount")
    cut_i, cut_s = _date_lit(p.cut_instalment), _date_lit(p.cut_split)
    return [
        (sp & (amt <= p.cap_instalment) & (cf("start_date") <= cut_i), inst),
        (sp & (amt <= p.cap_split) & (start_for_split <= cut_s), split),
        (sp & (amt <= p.cap_split) & (start_for_split > cut_s), split * inst),
    ]


def is_approved(p: MartParams) -> Column:
    """G6. For the focus retailer the approval follows the product legs; otherwise
    (and when no leg applies) the late flag, else the early state, floored at 0."""
    early_ok = flag(pq("decision_state") == p.approved_state)
    fallback = F.greatest(F.coalesce(cf("is_approved"), early_ok), F.lit(0))
    focus = in_ids(F.coalesce(pq("merchant_id"), cf("merchant_id")), p.focus_retailer_ids)
    legs = _approval_legs(p, F.coalesce(pq("start_date"), cf("start_date")))
    return waterfall([(focus & cond, val) for cond, val in legs], fallback)


def is_checkout_approved(p: MartParams) -> Column:
    """As G6 on late-stage columns only; NULL when there is no late stage."""
    fallback = _zero(cf("is_approved"))
    focus = in_ids(cf("merchant_id"), p.focus_retailer_ids)
    legs = _approval_legs(p, cf("start_date"))
    return waterfall(
        [(cf("application_id").isNull(), F.lit(None).cast("int"))] + [(focus & cond, val) for cond, val in legs],
        fallback,
    )


def decline_reason() -> Column:
    return waterfall(
        [
            (_zero(cf("is_approved_instalment")) == 1, cf("declined_reason_instalment")),
            (_zero(cf("is_approved_split")) == 1, cf("declined_reason_split")),
        ],
        F.coalesce(cf("declined_reason"), pq("declined_reason")),
    )


# --- G9: offers ----------------------------------------------------------------------
def number_of_offers(p: MartParams, slots: list[Column]) -> Column:
    rules = []
    for i in range(len(slots), 0, -1):
        cond = slots[0].isNotNull()
        for s in slots[1:i]:
            cond = cond & s.isNotNull()
        rules.append((cond, str(i)))
    rules.append((early_without_late(), p.labels.early_no_late))
    return waterfall(rules, p.labels.no_offer)


# --- G11-G15: plan kind and captured categories ---------------------------------------
def _daily(n: int) -> Column:
    return (cf("plan_frequency") == "daily") & (cf("plan_interval") == n)


def _weekly_classic(p: MartParams) -> Column:
    return (cf("plan_frequency") == "weekly") & (cf("loan_type") == p.classic_loan)


def _weekly_or_go(p: MartParams) -> Column:
    return (cf("plan_frequency") == "weekly") | (cf("loan_type") == p.go_loan)


def _short(p: MartParams) -> Column:
    """Short plan: any of the four short-term rules (first-match with one label)."""
    return _daily(30) | _daily(15) | _weekly_classic(p) | _weekly_or_go(p)


def _core_short(p: MartParams) -> Column:
    flow = cf("flow_type").isin(*p.short_flow_types) | (cf("loan_type") == p.go_loan) | (cf("plan_frequency") == "weekly")
    return _daily(30) | _daily(15) | _weekly_classic(p) | flow


def plan_eligible(p: MartParams) -> Column:
    return (cf("guarantee_id").isNotNull() & (c("purchase_member") == 1)) | in_ids(cf("merchant_id"), p.direct_merchant_ids)


def plan_is_card(p: MartParams) -> Column:
    return ((c("charge_mart_product_platform") == p.card_platform) & (c("session_instrument_type") == p.card_instrument)) | c(
        "charge_mart_product_group"
    ).like(p.card_group_pattern)


def plan_kind(p: MartParams) -> Column:
    """G11 (helper, not an output): card/direct family and short/instalment/other."""
    L = p.labels

    def kinds(family: str) -> Column:
        instal = (cf("loan_type") == p.classic_loan) | (cf("plan_frequency") == "monthly")
        return waterfall(
            [(_short(p), L.kind(family, L.short)), (instal, L.kind(family, L.instalment))],
            L.kind(family, L.other),
        )

    return waterfall([(plan_eligible(p), waterfall([(plan_is_card(p), kinds(L.card))], kinds(L.direct)))], L.other)


def captured_category(p: MartParams, kind: Column) -> Column:
    """G12 on the plan kind column."""
    L = p.labels
    cd = L.card_direct
    platform = waterfall([(_short(p), L.kind(L.platform, L.short))], L.kind(L.platform, L.instalment))
    return waterfall(
        [
            (_zero(cf("is_captured")) != 1, L.not_captured),
            (kind.isin(L.kind(L.direct, L.instalment), L.kind(L.card, L.instalment)), L.kind(cd, L.instalment)),
            (kind.isin(L.kind(L.direct, L.short), L.kind(L.card, L.short)), L.kind(cd, L.short)),
            (~kind.isin(L.other), L.kind(cd, L.other)),
            (c("checkout_mart_is_platform") == 1, platform),
            (_core_short(p), L.kind(L.core, L.short)),
        ],
        L.kind(L.core, L.instalment),
    )


def captured_subcategory(p: MartParams, kind: Column) -> Column:
    """Finer plan split per family (an 'other' card/direct plan lands in
    instalment here, trap T12)."""
    L = p.labels

    def subs(family: str, go_rule: Column) -> Column:
        return waterfall(
            [
                (_daily(30), L.kind(family, L.pay_in_30)),
                (_daily(15), L.kind(family, L.pay_in_2)),
                (_weekly_classic(p), L.kind(family, L.four_biweekly)),
                (go_rule, L.kind(family, L.pay_in_4)),
            ],
            L.kind(family, L.instalment),
        )

    core_go = cf("flow_type").isin(*p.short_flow_types) | (cf("loan_type") == p.go_loan) | (cf("plan_frequency") == "weekly")
    return waterfall(
        [
            (_zero(cf("is_captured")) == 0, L.not_captured),
            (~kind.isin(L.other), subs(L.card_direct, _weekly_or_go(p))),
            (c("checkout_mart_is_platform") == 1, subs(L.platform, _weekly_or_go(p))),
        ],
        subs(L.core, core_go),
    )


def core_index(p: MartParams, category: Column) -> Column:
    """G14."""
    L = p.labels
    return flag(category.isin(L.kind(L.core, L.instalment), L.kind(L.platform, L.instalment)))


def retailer_rules(p: MartParams, merchant: Column) -> list[tuple[Column, str]]:
    return [(in_ids(merchant, ids), label) for label, ids in p.retailer_groups]


def merchant_category(p: MartParams, category: Column) -> Column:
    """Retailer groups first (even uncaptured rows, T11), then core instalment
    split by APR (NULL APR -> zero/fixed, T13), else the captured category."""
    L = p.labels
    apr_split = waterfall([(cf("apr") > p.apr_threshold, L.core_interest)], L.core_zero)
    return waterfall(
        retailer_rules(p, cf("merchant_id")) + [(category == L.kind(L.core, L.instalment), apr_split)],
        category,
    )


def application_category(p: MartParams) -> Column:
    """Retailer groups, platform checkouts, card vs direct (as-of card state or
    an earlier onboarding), else core."""
    L = p.labels
    merchant = F.coalesce(cf("merchant_id"), pq("merchant_id"))
    eligible = (cf("guarantee_id").isNotNull() & (c("ud_label") == p.own_label)) | (
        (c("md_product_type") == p.direct_product_type) | in_ids(c("md_merchant_id"), p.direct_merchant_ids)
    )
    carded = c("cs_state_to").isNotNull() | ((c("ud_is_onboarded") == 1) & (c("ud_first_onboarded") < c("dec_created")))
    return waterfall(
        retailer_rules(p, merchant)
        + [
            ((c("checkout_mart_is_platform") == 1) & (c("checkout_mart_is_adaptive") == 1), L.platform),
            (cf("flow_type") == p.platform_flow_type, L.platform),
            (eligible, waterfall([(carded, L.card)], L.direct)),
        ],
        L.core,
    )


# --- G16, G18-G24: indices and selections -----------------------------------------------
def monthly_index() -> Column:
    return waterfall([(_daily(30), 1), (cf("plan_frequency") == "monthly", 1)], 0)


def autopay_flag(p: MartParams) -> Column:
    return waterfall([(cf("is_autopay_enabled") == 1, p.labels.autopay_on)], p.labels.autopay_off)


def score_version(p: MartParams) -> Column:
    """Version by loan type; the early stage only in the fallback branch."""
    return waterfall(
        [
            (cf("loan_type") == p.classic_loan, F.coalesce(cf("score_version_instalment"), cf("score_version"))),
            (cf("loan_type").isin(*p.split_loans), F.coalesce(cf("score_version_split"), cf("score_version"))),
        ],
        F.coalesce(cf("score_version"), pq("score_version")),
    )


def score_by_loan(p: MartParams) -> Column:
    """Four-way fallback per loan type."""
    return waterfall(
        [
            (
                cf("loan_type") == p.classic_loan,
                F.coalesce(cf("risk_score_instalment_v1"), cf("risk_score_instalment"), cf("risk_score_v1"), cf("risk_score")),
            ),
            (
                cf("loan_type").isin(*p.split_loans),
                F.coalesce(cf("risk_score_split_v1"), cf("risk_score_split"), cf("risk_score_v1"), cf("risk_score")),
            ),
        ],
        F.coalesce(cf("risk_score_v1"), pq("risk_score_v1"), cf("risk_score"), pq("risk_score")),
    )


def partner_flag(p: MartParams, partner: Column) -> Column:
    return waterfall([(partner.isin(pid), label) for pid, label in p.partner_labels], p.labels.other)


def risk_pattern_flag(p: MartParams, risk_flag: Column) -> Column:
    """The flag itself when it matches the pattern, else NULL."""
    return F.when(risk_flag.like(p.risk_flag_pattern), risk_flag)


def risk_pattern_index(p: MartParams, risk_flag: Column) -> Column:
    return flag(risk_flag.like(p.risk_flag_pattern))


# --- G0: which arm fired ------------------------------------------------------------------
def rule_arms(p: MartParams, kind: Column, category: Column) -> dict[str, tuple[Column, list[str]]]:
    """For every first-match rule the name of the arm that fires, as a column, and the names of all its arms.
    ``kind`` and ``category`` are the plan kind and the captured category that later rules take."""
    with tracing_arms() as trace:
        slots = [c(f"terms_loan_type{i}") for i in (1, 2, 3)]
        built = {
            "funnel_stage": funnel_stage(p), "proactive_flag": proactive_flag(p), "prequal_flag": prequal_flag(p),
            "repeat_flag": repeat_flag(p), "group_new_flag": new_to_group_flag(p), "is_approved": is_approved(p),
            "is_checkout_approved": is_checkout_approved(p), "decline_reason": decline_reason(),
            "number_of_offers": number_of_offers(p, slots), "plan_kind": plan_kind(p),
            "captured_category": captured_category(p, kind), "captured_subcategory": captured_subcategory(p, kind),
            "captured_merchant_category": merchant_category(p, category), "application_category": application_category(p),
            "monthly_index": monthly_index(), "autopay_flag": autopay_flag(p), "score_version": score_version(p),
            "score_v1": score_by_loan(p), "merchant_partner_flag": partner_flag(p, c("md_partner_id")),
        }
        return {rule: (column, trace[id(column)][1]) for rule, column in built.items()}
