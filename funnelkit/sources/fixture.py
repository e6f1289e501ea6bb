"""Role adapters: derive every input role of the mart (S1-S23 in the survey) from the
TPC-H-style fixture tables.

Each role is one SELECT over base tables written in the SQL subset both Spark and
DuckDB accept (integer ``%``, ``nullif``, ``case``, ``coalesce``, casts, ``||``), so
the correctness oracle builds its inputs from the very same text and only the
operators under test differ between the two engines. ``{table}`` placeholders name
base tables; in Spark they are bound to DataFrames read with declared schemas.

The adapters only shape inputs; the work the operators do (stitching, as-of,
roll-ups, enrichment, rules) is done by ``funnelkit.operators`` / ``funnelkit.plans``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from funnelkit.sources.tables import read_table

# Late stage (checkout funnel, S6): orders other than the lowest priority.
CHECKOUT_FUNNEL = """
SELECT
  o_orderkey AS application_id,
  o_orderkey AS charge_id,
  o_orderkey AS checkout_id,
  CASE WHEN o_orderkey % 10 <> 5 THEN o_orderkey END AS prequal_id,
  CASE WHEN o_custkey % 11 <> 4 THEN o_custkey END AS user_id,
  nullif(o_custkey % 7, 0) AS merchant_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS guarantee_id,
  o_orderdate AS start_date,
  o_orderdate - INTERVAL 2 DAYS AS checkout_created_dt,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS captured_dt,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 7 DAYS
    WHEN o_custkey % 7 = 1 AND o_orderpriority = '2-HIGH' THEN o_orderdate + INTERVAL 2500 DAYS
  END AS first_capture_dt,
  CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 60 = 40 THEN 1 END AS is_checkout_applied,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS is_approved,
  CASE o_orderkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS is_approved_instalment,
  CASE WHEN o_orderkey % 4 < 2 THEN 1 WHEN o_orderkey % 4 = 2 THEN 0 END AS is_approved_split,
  CASE o_orderstatus WHEN 'O' THEN 'open' END AS declined_reason,
  o_orderpriority AS declined_reason_instalment,
  o_orderstatus AS declined_reason_split,
  CASE WHEN o_orderstatus <> 'O' THEN 1 END AS is_confirmed,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 END AS is_authed,
  CASE WHEN o_orderstatus = 'F' THEN 1 END AS is_merchant_captured,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS is_captured,
  CASE WHEN o_custkey % 2 = 1 THEN 1 WHEN o_custkey % 5 = 0 THEN 0 END AS is_autopay_enabled,
  o_totalprice AS total_amount,
  o_totalprice / 10 AS down_payment_amount,
  o_totalprice / 4 AS schedule_amount,
  CAST(nullif(o_orderkey % 20, 0) AS DOUBLE) / 100 AS apr,
  CAST(nullif(o_orderkey % 2, 0) AS DOUBLE) / 10 AS offered_apr1,
  CAST(nullif(o_orderkey % 3, 0) AS DOUBLE) / 10 AS offered_apr2,
  CAST(nullif(o_orderkey % 5, 0) AS DOUBLE) / 10 AS offered_apr3,
  CASE o_orderkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' END AS plan_frequency,
  CASE WHEN o_orderkey % 12 < 4 THEN 30 WHEN o_orderkey % 12 < 8 THEN 15 ELSE 7 END AS plan_interval,
  CAST(o_orderkey % 12 AS INTEGER) + 1 AS plan_length,
  CAST(o_custkey % 24 AS INTEGER) + 1 AS term_length,
  CASE o_custkey % 3 WHEN 0 THEN 'classic' WHEN 1 THEN 'go' END AS loan_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'express' WHEN '2-HIGH' THEN 'platform flow' ELSE 'standard' END AS flow_type,
  o_orderpriority AS product_type,
  o_orderpriority AS financing_type,
  CASE WHEN o_orderkey % 2 = 1 THEN 'monthly' END AS offered_frequency1,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'weekly' END AS offered_frequency2,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'daily' END AS offered_frequency3,
  'v' || CAST(o_custkey % 3 AS STRING) AS score_version,
  CASE WHEN o_custkey % 2 = 0 THEN 'vi' || CAST(o_custkey % 4 AS STRING) END AS score_version_instalment,
  CASE WHEN o_custkey % 5 = 0 THEN 'vs' || CAST(o_custkey % 2 AS STRING) END AS score_version_split,
  o_totalprice / 1000 AS risk_score,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2000 END AS risk_score_v1,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 3000 END AS risk_score_instalment,
  CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice / 6000 END AS risk_score_instalment_v1,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 5000 END AS risk_score_split,
  CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice / 10000 END AS risk_score_split_v1,
  CASE WHEN o_custkey % 6 <> 0 THEN CAST(600 + o_custkey % 250 AS INTEGER) END AS bureau_score
FROM {orders}
WHERE o_orderpriority <> '5-LOW'
"""

# Early stage (prequalification funnel, S7): returned line items grouped per order.
PREQUAL_FUNNEL = """
SELECT
  l_orderkey AS application_id,
  l_orderkey AS charge_id,
  l_orderkey AS checkout_id,
  CASE WHEN l_orderkey % 17 <> 3 THEN l_orderkey END AS prequal_id,
  CASE WHEN min(l_partkey) % 13 <> 5 THEN min(l_partkey) END AS user_id,
  min(l_suppkey) % 5 AS merchant_id,
  min(l_shipdate) AS start_date,
  CASE WHEN max(l_quantity) >= 25 THEN 'approved' WHEN max(l_quantity) >= 8 THEN 'declined' ELSE 'expired' END AS decision_state,
  CASE WHEN max(l_quantity) < 25 THEN 'low quantity' END AS declined_reason,
  max(l_extendedprice) AS approved_amount,
  CAST(nullif(min(l_suppkey) % 5, 0) AS DOUBLE) / 10 AS offered_apr1,
  CAST(nullif(count(*) % 3, 0) AS DOUBLE) / 10 AS offered_apr2,
  CAST(NULL AS DOUBLE) AS offered_apr3,
  CAST(500 + min(l_partkey) % 300 AS INTEGER) AS bureau_score,
  'pv' || CAST(min(l_linenumber) AS STRING) AS score_version,
  CASE WHEN count(*) > 1 THEN max(l_discount) END AS risk_score_v1,
  max(l_tax) AS risk_score,
  CAST(nullif(count(*), 3) - 1 AS INTEGER) AS num_deciders_run,
  CASE WHEN min(l_partkey) % 9 = 0 THEN 0 ELSE 1 END AS is_deduped
FROM {lineitem}
WHERE l_returnflag = 'A'
GROUP BY l_orderkey
"""

ROLE_SQL: dict[str, str] = {
    "checkout_funnel": CHECKOUT_FUNNEL,
    "prequal_funnel": PREQUAL_FUNNEL,
    # S1 underwriting decision log.
    "decision_log": """
SELECT l_orderkey AS charge_id, l_shipdate AS event_time,
  CASE l_linestatus WHEN 'F' THEN 'terms' ELSE 'other' END AS decision_type,
  CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS INTEGER) END AS bureau_score,
  CASE l_returnflag WHEN 'N' THEN 'none' WHEN 'A' THEN NULL ELSE 'r' || CAST(l_linenumber AS STRING) END AS report_id
FROM {lineitem}""",
    # S2 prequal decision fact: one decision per purchase event.
    "prequal_decision": """
SELECT event_id AS decision_id, user_id, event_id AS guarantee_id, ts AS created
FROM {events} WHERE event_type = 'purchase'""",
    # S3 card-state events: clicks; the state is NULL for low-value clicks.
    "card_state_event": """
SELECT event_id, user_id, ts AS created, CASE WHEN value >= 5 THEN props END AS state_to
FROM {events} WHERE event_type = 'click'""",
    # S4 application -> decision-run bridge.
    "app_run_bridge": """
SELECT o_orderkey AS application_id, o_orderkey AS run_id, o_orderstatus AS decision_type
FROM {orders}""",
    # S5 decision-run events with five signals (some negative, some NULL).
    "decision_run": """
SELECT l_orderkey AS run_id, l_linestatus AS run_name, l_shipdate AS created,
  l_linenumber AS line_no, l_partkey AS part_no,
  CASE WHEN l_tax > 0 THEN (l_tax - 0.04) * 100000 END AS exposure_cents,
  CASE WHEN l_discount > 0.02 THEN (l_discount - 0.05) * 100000 END AS min_exposure_cents,
  CASE WHEN l_quantity > 5 THEN l_quantity * 1000 END AS income_dollars,
  CASE WHEN l_returnflag = 'R' THEN 'metro ' || CAST(l_suppkey % 25 AS STRING) END AS metro,
  CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice - 20000 END AS student_balance
FROM {lineitem}""",
    # S8 prequal master.
    "prequal": """
SELECT o_orderkey AS prequal_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'proactive' ELSE 'reactive' END AS creation_type
FROM {orders}""",
    # S9 merchant dimension: one merchant per region.
    "merchant_dim": """
SELECT r_regionkey AS merchant_id, r_name AS merchant_name,
  'industry ' || CAST(r_regionkey % 2 AS STRING) AS industry,
  'subindustry ' || CAST(r_regionkey AS STRING) AS subindustry,
  CASE WHEN r_regionkey % 2 = 0 THEN 'hosted' ELSE 'api' END AS platform,
  'p' || CAST(r_regionkey AS STRING) AS partner_id,
  CASE WHEN r_regionkey < 2 THEN 'enterprise' ELSE 'small business' END AS business_type,
  'city ' || r_name AS city,
  'z' || CAST(r_regionkey AS STRING) AS postal_code,
  's' || CAST(r_regionkey AS STRING) AS state,
  CASE WHEN r_regionkey = 3 THEN 'direct' ELSE 'standard' END AS product_type,
  CASE r_regionkey WHEN 0 THEN DATE '1995-01-31' WHEN 1 THEN DATE '1996-02-29'
    WHEN 2 THEN DATE '1997-12-31' WHEN 3 THEN DATE '1999-06-15' END AS created
FROM {region}""",
    # S10 high-risk merchant list.
    "risky_merchant": """
SELECT r_regionkey AS merchant_id,
  CASE r_regionkey WHEN 1 THEN 'watch: bad outcome' ELSE 'watch: fraud' END AS flag,
  'active' AS status
FROM {region} WHERE r_regionkey IN (1, 3)""",
    # S11 merchant revenue segment (one merchant has none).
    "merchant_segment": """
SELECT r_regionkey AS merchant_id, 'division ' || r_name AS division
FROM {region} WHERE r_regionkey <> 4""",
    # S12 checkout session fact.
    "checkout_session": """
SELECT o_orderkey AS checkout_id,
  CASE WHEN o_custkey % 4 = 0 THEN 'debit' ELSE 'credit' END AS instrument_type
FROM {orders}""",
    # S13 checkout mart.
    "checkout_mart": """
SELECT o_orderkey AS checkout_id,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS is_platform,
  CASE WHEN o_custkey % 2 = 1 THEN 1 ELSE 0 END AS is_adaptive
FROM {orders}""",
    # S14 charge mart.
    "charge_mart": """
SELECT o_orderkey AS charge_id,
  CASE WHEN o_custkey % 2 = 0 THEN 'network' ELSE 'core' END AS product_platform,
  CASE WHEN o_custkey % 4 = 2 THEN 'card plus' ELSE 'standard' END AS product_group
FROM {orders}""",
    # S15 lender-initiated purchases (a list of checkout ids, may repeat).
    "purchases": """
SELECT l_orderkey AS checkout_id FROM {lineitem} WHERE l_returnflag = 'R'""",
    # S16 user dimension.
    "user_dim": """
SELECT c_custkey AS user_id, c_custkey AS numeric_id, c_custkey AS person_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'own' ELSE 'partner' END AS label,
  CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS is_onboarded,
  CASE WHEN c_acctbal > 0 THEN CAST(DATE '2024-01-01' + CAST(c_custkey % 31 AS INTEGER) AS {TS}) + INTERVAL 18 HOURS END AS first_onboarded
FROM {customer}""",
    # S17 person statistics, derived from the orders history.
    "person_stats": """
SELECT o_custkey AS person_id,
  min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS first_capture,
  min(CASE WHEN o_orderstatus = 'F' AND o_custkey % 7 = 1 THEN o_orderdate END) AS first_capture_at_group
FROM {orders} GROUP BY o_custkey""",
    # S18 offered terms (three slots).
    "offered_terms": """
SELECT o_orderkey AS checkout_id,
  CASE WHEN o_orderkey % 2 = 1 THEN 'monthly' END AS loan_type1,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'biweekly' END AS loan_type2,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'weekly' END AS loan_type3,
  CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice / 10 END AS down_payment1,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 20 END AS down_payment2,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 5 END AS down_payment3
FROM {orders}""",
    # S19 confirmed bad-outcome loans.
    "bad_outcome": """
SELECT l_orderkey AS charge_id, 1 AS indicator
FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY l_orderkey""",
    # S20 application.
    "application": """
SELECT o_orderkey AS application_id, o_custkey AS billing_address_id FROM {orders}""",
    # S21 address.
    "address": """
SELECT c_custkey AS address_id, 'r' || CAST(c_nationkey % 5 AS STRING) AS region_code,
  'z' || CAST(c_nationkey AS STRING) AS postal_code
FROM {customer}""",
    # S22 postal code -> metro area.
    "postal_metro": """
SELECT 'z' || CAST(n_nationkey AS STRING) AS postal_code, 'metro ' || CAST(n_nationkey AS STRING) AS metro
FROM {nation}""",
    # S23 high-risk metro list.
    "risky_metro": """
SELECT 'metro ' || CAST(n_nationkey AS STRING) AS metro, 'watch ' || n_name AS flag
FROM {nation} WHERE n_regionkey IN (0, 2)""",
}

# Inputs of single-operator queries that are no role of the mart.
EXTRA_SQL: dict[str, str] = {
    # A metro list that names some metros once per customer segment, for the fan-out guard.
    "risky_metro_repeated": """
SELECT 'metro ' || CAST(c_nationkey AS STRING) AS metro, c_mktsegment AS flag
FROM {customer} WHERE c_nationkey < 20 GROUP BY c_nationkey, c_mktsegment""",
    "risky_region": "SELECT r_regionkey, r_name FROM {region} WHERE r_regionkey <> 2",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")
#: Name of the zone-free timestamp type, written {TS} in the role texts.
_SPARK_TS, _ORACLE_TS = "TIMESTAMP_NTZ", "TIMESTAMP"


def base_tables(sql: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(sql)) - {"TS"})


def role_frame(spark: SparkSession, sf_dir: str, role: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One role as a Spark DataFrame over the fixture tables in ``sf_dir``."""
    sql = (ROLE_SQL | EXTRA_SQL)[role].replace("{TS}", _SPARK_TS)
    tables = tables if tables is not None else {}
    for t in base_tables(sql):
        if t not in tables:
            tables[t] = read_table(spark, sf_dir, t)
    return spark.sql(sql, **{t: tables[t] for t in base_tables(sql)})


def role_sql(role: str) -> str:
    """The same role as SQL text over the oracle's pre-registered table views."""
    sql = (ROLE_SQL | EXTRA_SQL)[role].replace("{TS}", _ORACLE_TS)
    return sql.format(**{t: t for t in base_tables(sql)})


def roles(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    """All (or the named) roles; each base table is read once and shared."""
    tables: dict[str, DataFrame] = {}
    return {r: role_frame(spark, sf_dir, r, tables) for r in (names or ROLE_SQL)}


def oracle_with(*names: str) -> str:
    """A ``WITH`` prefix defining the named roles for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({role_sql(n)})" for n in names)

