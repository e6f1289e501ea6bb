"""A refreshed mart against the mart computed anew, one changed role at a time and together."""

import pytest
from pyspark.sql import functions as F

from funnelkit.plans import catalog
from funnelkit.plans.catalog import earlier_roles
from funnelkit.plans.mart import funnel_mart
from funnelkit.plans.params import MartParams
from funnelkit.plans.refresh import CHANGE_KEYS, keyed_mart, refresh_mart, touched_stages
from funnelkit.sources.fixture import roles
from funnelkit.sources.schemas import ROLE_SCHEMAS
from funnelkit.sources.shared import shared_folder, written

SF = "/root/testdata/sf0.001"
P = MartParams()


@pytest.fixture(scope="module")
def now(spark):
    return roles(spark, SF)


@pytest.fixture(scope="module")
def full(now):
    return written(keyed_mart(now, P), "full")


def _equal(a, b):
    assert a.columns == b.columns
    a = written(a, "compared")
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def _half(df, key):
    return df.where(F.pmod(F.xxhash64(key), F.lit(2)) == 0)


@pytest.mark.parametrize("role", ["checkout_funnel", "prequal_funnel", "risky_metro", "person_stats", "purchases", "app_run_bridge"])
def test_rows_that_came_in_since(spark, now, full, role):
    """Half of a role's keys are new."""
    key = CHANGE_KEYS[role]
    before = now | {role: _half(now[role], key)}
    old = written(keyed_mart(before, P), "old")
    assert full.exceptAll(old).count() > 0
    changed = now[role].exceptAll(before[role])
    changes = {role: changed.select(key, *(["prequal_id"] if role.endswith("_funnel") else []))}
    assert _equal(refresh_mart(old, now, changes, P), full)
    if role == "checkout_funnel":  # and the other way: what is gone now was there before
        assert _equal(refresh_mart(full, before, changes, P), old)


def test_many_roles_at_once(spark, now, full):
    before, changes = earlier_roles(now)
    old = written(keyed_mart(before, P), "old")
    new = refresh_mart(old, now, changes, P)
    assert _equal(new, full)
    late, early = touched_stages(now, changes, P)
    assert 0 < late.count() < now["checkout_funnel"].count() / 2 and early.count() < now["prequal_funnel"].count() / 2
    assert _equal(full.drop("late_id", "early_id"), funnel_mart(now, P))


def test_nothing_changed_and_unknown_roles(spark, now, full):
    assert _equal(refresh_mart(full, now, {}, P), full)
    none = {"address": now["address"].limit(0), "checkout_funnel": now["checkout_funnel"].limit(0)}
    assert _equal(refresh_mart(full, now, none, P), full)
    with pytest.raises(ValueError, match="addresses"):
        refresh_mart(full, now, {"addresses": now["address"]}, P)
    assert set(CHANGE_KEYS) == set(ROLE_SCHEMAS)


def test_the_query_aggregates_the_early_stage_once(spark, monkeypatch):
    """The earlier mart, the changed keys and the refresh read it as a table, with the same rows."""
    taken = []
    monkeypatch.setattr(catalog, "keyed_mart", lambda before, p: taken.append(before) or keyed_mart(before, p))
    monkeypatch.setattr(catalog, "refresh_mart", lambda old, s, changes, p: taken.append(s) or taken.append(changes) or old)
    catalog.funnel_mart_refreshed(spark, SF)
    for s in taken:
        files = s["prequal_funnel"].inputFiles()
        assert files and not any("lineitem" in f for f in files)
    assert _equal(taken[1]["prequal_funnel"], roles(spark, SF)["prequal_funnel"])


def test_scratch_tables_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(spark, "x")
