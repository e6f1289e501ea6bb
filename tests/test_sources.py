"""Declared role contract: the fixture conforms, and a round trip through files gives
the same mart."""

import tempfile

from funnelkit.plans.mart import funnel_mart
from funnelkit.plans.params import MartParams
from funnelkit.sources.fixture import roles
from funnelkit.sources.schemas import ROLE_SCHEMAS, check_roles, read_roles

SF = "/root/testdata/sf0.001"


def test_fixture_roles_conform(spark):
    s = roles(spark, SF)
    assert set(s) == set(ROLE_SCHEMAS)
    assert check_roles(s) == []


def test_read_roles_round_trip(spark):
    s = roles(spark, SF)
    root = tempfile.mkdtemp(prefix="run-roles-", dir="/tmp")
    locations = {}
    for role, df in s.items():
        locations[role] = f"{root}/{role}"
        df.write.parquet(locations[role])
    again = read_roles(spark, locations)
    assert check_roles(again) == []
    a = funnel_mart(s, MartParams())
    b = funnel_mart(again, MartParams())
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_string_ids_without_tie_keys(spark):
    """All 23 roles with string ids and without the tie keys give the rows of the BIGINT mart."""
    from pyspark.sql import functions as F

    from funnelkit.plans.catalog import ID_COLUMNS
    from funnelkit.sources.schemas import OPTIONAL, role_schema, role_schemas

    s = roles(spark, SF)
    schemas = role_schemas(id_type="STRING")
    # Equal times are resolved by tie keys where there are some: compare where there are none.
    plain = {r: df.drop(*OPTIONAL.get(r, ())) for r, df in s.items()}
    root = tempfile.mkdtemp(prefix="run-roles-", dir="/tmp")
    locations = {}
    for role, df in plain.items():
        kinds = {f.name: f.dataType for f in role_schema(role, schemas).fields}
        locations[role] = f"{root}/{role}"
        df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns]).write.parquet(locations[role])
    again = read_roles(spark, locations, schemas=schemas)
    assert check_roles(again, schemas) == []
    a = funnel_mart(plain, MartParams())
    a = a.select(*[F.col(c).cast("string").alias(c) if c in ID_COLUMNS else F.col(c) for c in a.columns])
    b = funnel_mart(again, MartParams())
    assert dict(b.dtypes)["application_id"] == "string"
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_lossy_types_raise(spark):
    import pytest

    from funnelkit.sources.schemas import conform, role_schemas

    s = roles(spark, SF)
    for column, kind in (("risk_score_v1", "string"), ("bureau_score", "double"), ("start_date", "timestamp")):
        bad = s["prequal_funnel"].withColumn(column, s["prequal_funnel"][column].cast(kind))
        with pytest.raises(TypeError, match=column):
            conform(bad, "prequal_funnel")
    narrow = s["prequal_funnel"].withColumn("approved_amount", s["prequal_funnel"]["approved_amount"].cast("float"))
    assert dict(conform(narrow, "prequal_funnel").dtypes)["approved_amount"] == "double"
    money = s["prequal_funnel"].withColumn("approved_amount", s["prequal_funnel"]["approved_amount"].cast("decimal(12,2)"))
    with pytest.raises(TypeError, match="approved_amount"):
        conform(money, "prequal_funnel")
    from funnelkit.sources.schemas import ROLE_SCHEMAS

    own = role_schemas(overrides={"prequal_funnel": ROLE_SCHEMAS["prequal_funnel"].replace("approved_amount DOUBLE", "approved_amount DECIMAL(14,2)")})
    assert dict(conform(money, "prequal_funnel", own).dtypes)["approved_amount"] == "decimal(14,2)"


def test_rollup_output_type_does_not_follow_the_input(spark):
    from funnelkit.operators.latest import signal_rollup

    df = spark.createDataFrame([(1, 250)], "k int, cents int")
    for kind in ("int", "bigint", "double", "decimal(12,2)"):
        out = signal_rollup(df.withColumn("cents", df.cents.cast(kind)), ["k"], {"dollars": ("cents", 100)})
        assert dict(out.dtypes)["dollars"] == "double" and out.first().dollars == 2.5


def test_onboarding_and_decision_on_one_day(spark):
    """A user onboarded in the evening was not onboarded before that morning's decision."""
    import datetime as dt

    from pyspark.sql import functions as F

    from funnelkit.sources.schemas import conform

    day = dt.date(2024, 1, 10)
    users = spark.createDataFrame(
        [(1, dt.datetime.combine(day, dt.time(18))), (2, dt.datetime.combine(day, dt.time(8)))],
        "user_id bigint, first_onboarded timestamp_ntz",
    ).select("user_id", F.col("user_id").alias("numeric_id"), F.col("user_id").alias("person_id"), F.lit("own").alias("label"),
             F.lit(1).alias("is_onboarded"), "first_onboarded")
    decided = F.lit(dt.datetime.combine(day, dt.time(9))).cast("timestamp_ntz")
    got = {r.user_id: r.before for r in conform(users, "user_dim").select("user_id", (F.col("first_onboarded") < decided).alias("before")).collect()}
    assert got == {1: False, 2: True}


def test_mart_reproduces_stage_preference_trap(spark):
    """T4: ``user_id`` prefers the late stage, the user join the early stage, so the
    numeric id beside it can belong to another user."""
    from pyspark.sql import functions as F

    s = roles(spark, SF)
    mart = funnel_mart(s, MartParams())
    both = mart.where(F.col("numeric_user_id").isNotNull() & F.col("user_id").isNotNull())
    assert both.where(F.col("numeric_user_id") != F.col("user_id")).count() > 0
    assert both.where(F.col("numeric_user_id") == F.col("user_id")).count() > 0


def test_lookup_key_report_finds_fan_out(spark):
    from funnelkit.plans.mart import lookup_key_report

    s = roles(spark, SF)
    assert lookup_key_report(s).count() == 0
    s["merchant_dim"] = s["merchant_dim"].unionByName(s["merchant_dim"].where("merchant_id < 2"))
    got = sorted((r.role, r.key, r.n) for r in lookup_key_report(s).collect())
    assert got == [("merchant_dim", "0", 2), ("merchant_dim", "1", 2)]
