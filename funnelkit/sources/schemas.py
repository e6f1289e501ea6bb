"""Declared input contract of the mart: one schema per source role.

A deployment maps each role to a table or folder and reads it with ``read_roles``.
Columns are selected and widened to the declared types where that loses nothing; any other
type raises before a row is read. The fixture's ids are BIGINT; a deployment passes its own
declarations (``role_schemas(id_type="STRING")`` for string ids, or any DDL per role).
Tie keys may be missing: rows of equal time are then ordered by value. Logs may bring the date or month
they are partitioned by (``OPTIONAL``); lookbacks then read only the partitions they reach.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLE_SCHEMAS: dict[str, str] = {
    "checkout_funnel": (
        "application_id BIGINT, charge_id BIGINT, checkout_id BIGINT, prequal_id "
        "BIGINT, user_id BIGINT, merchant_id BIGINT, guarantee_id BIGINT, start_date "
        "TIMESTAMP_NTZ, checkout_created_dt TIMESTAMP_NTZ, captured_dt TIMESTAMP_NTZ, "
        "first_capture_dt TIMESTAMP_NTZ, is_checkout_applied INT, is_approved INT, "
        "is_approved_instalment INT, is_approved_split INT, declined_reason STRING, "
        "declined_reason_instalment STRING, declined_reason_split STRING, "
        "is_confirmed INT, is_authed INT, is_merchant_captured INT, is_captured INT, "
        "is_autopay_enabled INT, total_amount DOUBLE, down_payment_amount DOUBLE, "
        "schedule_amount DOUBLE, apr DOUBLE, offered_apr1 DOUBLE, offered_apr2 "
        "DOUBLE, offered_apr3 DOUBLE, plan_frequency STRING, plan_interval INT, "
        "plan_length INT, term_length INT, loan_type STRING, flow_type STRING, "
        "product_type STRING, financing_type STRING, offered_frequency1 STRING, "
        "offered_frequency2 STRING, offered_frequency3 STRING, score_version STRING, "
        "score_version_instalment STRING, score_version_split STRING, risk_score "
        "DOUBLE, risk_score_v1 DOUBLE, risk_score_instalment DOUBLE, "
        "risk_score_instalment_v1 DOUBLE, risk_score_split DOUBLE, "
        "risk_score_split_v1 DOUBLE, bureau_score INT"
    ),
    "prequal_funnel": (
        "application_id BIGINT, charge_id BIGINT, checkout_id BIGINT, prequal_id "
        "BIGINT, user_id BIGINT, merchant_id BIGINT, start_date TIMESTAMP_NTZ, "
        "decision_state STRING, declined_reason STRING, approved_amount DOUBLE, "
        "offered_apr1 DOUBLE, offered_apr2 DOUBLE, offered_apr3 DOUBLE, bureau_score "
        "INT, score_version STRING, risk_score_v1 DOUBLE, risk_score DOUBLE, "
        "num_deciders_run INT, is_deduped INT"
    ),
    "decision_log": (
        "charge_id BIGINT, event_time TIMESTAMP_NTZ, decision_type STRING, "
        "bureau_score INT, report_id STRING"
    ),
    "prequal_decision": (
        "decision_id BIGINT, user_id BIGINT, guarantee_id BIGINT, created "
        "TIMESTAMP_NTZ"
    ),
    "card_state_event": (
        "event_id BIGINT, user_id BIGINT, created TIMESTAMP_NTZ, state_to STRING"
    ),
    "app_run_bridge": (
        "application_id BIGINT, run_id BIGINT, decision_type STRING"
    ),
    "decision_run": (
        "run_id BIGINT, run_name STRING, created TIMESTAMP_NTZ, line_no INT, part_no "
        "BIGINT, exposure_cents DOUBLE, min_exposure_cents DOUBLE, income_dollars "
        "DOUBLE, metro STRING, student_balance DOUBLE"
    ),
    "prequal": (
        "prequal_id BIGINT, creation_type STRING"
    ),
    "merchant_dim": (
        "merchant_id INT, merchant_name STRING, industry STRING, subindustry STRING, "
        "platform STRING, partner_id STRING, business_type STRING, city STRING, "
        "postal_code STRING, state STRING, product_type STRING, created DATE"
    ),
    "risky_merchant": (
        "merchant_id INT, flag STRING, status STRING"
    ),
    "merchant_segment": (
        "merchant_id INT, division STRING"
    ),
    "checkout_session": (
        "checkout_id BIGINT, instrument_type STRING"
    ),
    "checkout_mart": (
        "checkout_id BIGINT, is_platform INT, is_adaptive INT"
    ),
    "charge_mart": (
        "charge_id BIGINT, product_platform STRING, product_group STRING"
    ),
    "purchases": (
        "checkout_id BIGINT"
    ),
    "user_dim": (
        "user_id BIGINT, numeric_id BIGINT, person_id BIGINT, label STRING, "
        "is_onboarded INT, first_onboarded TIMESTAMP_NTZ"
    ),
    "person_stats": (
        "person_id BIGINT, first_capture TIMESTAMP_NTZ, first_capture_at_group "
        "TIMESTAMP_NTZ"
    ),
    "offered_terms": (
        "checkout_id BIGINT, loan_type1 STRING, loan_type2 STRING, loan_type3 STRING, "
        "down_payment1 DOUBLE, down_payment2 DOUBLE, down_payment3 DOUBLE"
    ),
    "bad_outcome": (
        "charge_id BIGINT, indicator INT"
    ),
    "application": (
        "application_id BIGINT, billing_address_id BIGINT"
    ),
    "address": (
        "address_id BIGINT, region_code STRING, postal_code STRING"
    ),
    "postal_metro": (
        "postal_code STRING, metro STRING"
    ),
    "risky_metro": (
        "metro STRING, flag STRING"
    ),
}


#: Columns a source may lack: tie keys, which only order rows of equal time, and the date or month
#: (its first day) of the time column where a log is partitioned by it.
TIE_KEYS: dict[str, frozenset[str]] = {
    "card_state_event": frozenset({"event_id"}),
    "decision_run": frozenset({"line_no", "part_no"}),
}
LOG_TIMES = {"decision_log": "event_time", "prequal_decision": "created", "card_state_event": "created", "decision_run": "created"}
PARTITIONS = {role: (f"{ts}_date", f"{ts}_month") for role, ts in LOG_TIMES.items()}
OPTIONAL: dict[str, frozenset[str]] = {
    role: TIE_KEYS.get(role, frozenset()) | frozenset(PARTITIONS.get(role, ())) for role in (*TIE_KEYS, *PARTITIONS)
}
for _role, _columns in PARTITIONS.items():
    ROLE_SCHEMAS[_role] += "".join(f", {c} DATE" for c in _columns)


def role_schemas(id_type: str | None = None, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """The declarations with every id column of type ``id_type`` and whole roles replaced by
    ``overrides`` (role -> DDL)."""
    out = dict(ROLE_SCHEMAS)
    if id_type:
        out = {role: re.sub(r"\b(\w+_id) (?:BIGINT|INT)\b", rf"\1 {id_type}", ddl) for role, ddl in out.items()}
    return out | (overrides or {})


def role_columns(role: str) -> list[str]:
    """Column names of a role, in declared order."""
    return [part.strip().split(" ", 1)[0] for part in ROLE_SCHEMAS[role].split(",")]


def role_schema(role: str, schemas: dict[str, str] | None = None) -> T.StructType:
    return T.StructType.fromDDL((schemas or ROLE_SCHEMAS)[role])


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Decimal digits of a whole type; a double holds 15 of any, so all of an int but not of a long.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def widens(have: T.DataType, want: T.DataType) -> bool:
    """Does every value of type ``have`` keep its exact value as ``want``?"""
    if have == want or isinstance(have, T.NullType):
        return True
    if isinstance(have, (T.CharType, T.VarcharType)):
        return isinstance(want, T.StringType)
    if isinstance(have, _WHOLE):
        digits = _DIGITS[type(have)]
        if isinstance(want, _WHOLE):
            return digits < _DIGITS[type(want)]
        if isinstance(want, T.DecimalType):
            return digits <= want.precision - want.scale
        return isinstance(want, T.DoubleType) and digits <= 15
    if isinstance(have, T.FloatType):
        return isinstance(want, T.DoubleType)
    if isinstance(have, T.DecimalType):
        if isinstance(want, T.DecimalType):
            return have.scale <= want.scale and have.precision - have.scale <= want.precision - want.scale
        return False
    return isinstance(have, T.DateType) and isinstance(want, T.TimestampNTZType)


def mismatches(have: T.StructType, role: str, schemas: dict[str, str] | None = None) -> list[str]:
    """What keeps a source of this schema from being read as ``role``."""
    types = {f.name: f.dataType for f in have.fields}
    out = []
    for f in role_schema(role, schemas).fields:
        if f.name not in types:
            if f.name not in OPTIONAL.get(role, ()):
                out.append(f"{role}.{f.name} missing")
        elif not widens(types[f.name], f.dataType):
            out.append(f"{role}.{f.name} is {types[f.name].simpleString()}, declared {f.dataType.simpleString()}")
    return out


def conform(df: DataFrame, role: str, schemas: dict[str, str] | None = None) -> DataFrame:
    """The role's declared columns of ``df``, widened to the declared types; raises where a
    column is missing or a value could change."""
    problems = mismatches(df.schema, role, schemas)
    if problems:
        raise TypeError(f"source for role {role!r} does not fit: {'; '.join(problems)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in role_schema(role, schemas).fields if f.name in df.columns])


def read_roles(
    spark: SparkSession,
    locations: dict[str, str],
    fmt: str = "parquet",
    schemas: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """A1 for the mart: read every role from a path (``fmt`` parquet/orc/...) or, with
    ``fmt='table'``, a catalog table name, conformed to its declared schema (``schemas``, from
    ``role_schemas``).

    One file's schema is compared with the declaration; the files are then read with the
    schema so found, so no footer decides a type later and a file that differs fails to read.
    """
    out = {}
    for role, loc in locations.items():
        if fmt == "table":
            df = spark.table(loc)
        else:
            found = spark.read.format(fmt).load(loc).schema
            df = spark.read.format(fmt).schema(found).load(loc)
        out[role] = conform(df, role, schemas)
    return out


def check_roles(sources: dict[str, DataFrame], schemas: dict[str, str] | None = None) -> list[str]:
    """Problems with a role mapping: missing roles, missing columns, other types."""
    problems = []
    for role in ROLE_SCHEMAS:
        if role not in sources:
            problems.append(f"missing role {role}")
            continue
        have = {f.name: f.dataType for f in sources[role].schema.fields}
        for f in role_schema(role, schemas).fields:
            if f.name not in have:
                if f.name in OPTIONAL.get(role, ()):
                    continue
                problems.append(f"{role}.{f.name} missing")
            elif have[f.name] != f.dataType:
                problems.append(f"{role}.{f.name} is {have[f.name].simpleString()}, declared {f.dataType.simpleString()}")
    return problems
