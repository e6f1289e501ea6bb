"""Where the mart's joins stand: the window before them, the guard in them, stored layouts kept."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from funnelkit.operators.enrich import Lookup, enrich_colocated, enrich_group
from funnelkit.plans.mart import enriched_spine, fan_out_report, funnel_mart, mart_columns
from funnelkit.plans.params import MartParams
from funnelkit.sources.fixture import role_frame, roles

SF = "/root/testdata/sf0.001"
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def static(spark):
    old = {k: spark.conf.get(k) for k in (*NO_BROADCAST, "spark.sql.shuffle.partitions")}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _tree(df, kind="optimizedPlan") -> list[tuple[int, str]]:
    """(depth, text) of the plan's nodes."""
    lines = getattr(df._jdf.queryExecution(), kind)().toString().split("\n")
    return [(len(re.match(r"[\s:+\-]*", line).group()), line) for line in lines if line.strip()]


def _below(tree, at) -> list[str]:
    out = []
    for depth, line in tree[at + 1:]:
        if depth <= tree[at][0]:
            break
        out.append(line)
    return out


def test_no_late_row_outside_the_window_enters_a_key_group(spark):
    """All key groups of the late stage stand above the stitch and its window, and none of the early-only
    rows goes through them."""
    tree = _tree(enriched_spine(roles(spark, SF), MartParams()))
    stitch = [i for i, (_, line) in enumerate(tree) if "Join LeftOuter" in line and "__stitch_lk" in line and "pq_prequal_id" not in line]
    assert len(stitch) == 1
    assert not any("__gk" in line for line in _below(tree, stitch[0]))
    above = tree[stitch[0] - 1][1]
    assert "Filter" in above and "cf_captured_dt" in above and "pq_start_date" in above and "2000-01-01" in above
    groups = [i for i, (_, line) in enumerate(tree) if "Join LeftOuter" in line and "__gk" in line]
    late = [i for i in groups if any("__stitch_lk" in line for line in _below(tree, i))]
    assert len(late) == len(groups) == 18  # all lookups but the prequal master, which shares the stitch's key
    anti = [i for i in groups if any("LeftAnti" in line for line in _below(tree, i))]
    assert len(anti) == 5  # merchant, its two lists, user, person


def test_the_master_shares_the_shuffle_of_the_stitch(static):
    plan = _tree(enriched_spine(roles(static, SF), MartParams(), need=["prequal_creation_type"]), "executedPlan")
    shuffled = [line for _, line in plan if re.search(r"Exchange hashpartitioning\(__stitch_[le]k", line)]
    assert len(shuffled) == 3  # late rows, linked early rows, early rows of the anti join
    assert not any("hashpartitioning(__gk" in line for _, line in plan)


def test_guard_stops_the_run_on_a_repeated_key(spark):
    s = roles(spark, SF)
    plain, guarded = funnel_mart(s), funnel_mart(s, guard="raise")
    assert guarded.schema == plain.schema
    assert guarded.exceptAll(plain).count() == plain.exceptAll(guarded).count() == 0
    s["risky_metro"] = role_frame(spark, SF, "risky_metro_repeated")
    with pytest.raises(Exception, match="risky_metro.metro occurs more than once: metro"):
        funnel_mart(s, guard="raise").collect()
    with pytest.raises(ValueError):
        funnel_mart(s, guard="count")


def test_guard_ignores_repeats_that_no_reported_row_meets(spark):
    s = roles(spark, SF)
    absent = spark.createDataFrame([("nowhere", "x"), ("nowhere", "y"), (None, "z"), (None, "z")], s["risky_metro"].schema)
    s["risky_metro"] = s["risky_metro"].unionByName(absent)
    assert funnel_mart(s, guard="raise").count() == funnel_mart(s).count()
    assert fan_out_report(s).where("rows_hit > 0").count() == 0


def test_fan_out_report_counts_the_added_rows(spark):
    s = roles(spark, SF)
    before = funnel_mart(s).count()
    s["user_dim"] = s["user_dim"].unionByName(s["user_dim"].where("user_id % 3 = 0"))
    report = {r.role: r for r in fan_out_report(s).collect()}
    assert len(report) == 17 and [r for r in report if report[r].rows_hit] == ["user_dim"]
    assert report["user_dim"].most == 2
    assert funnel_mart(s).count() == before + report["user_dim"].rows_added


def _bucketed(spark, root, name, df, key):
    df.repartition(4, key).write.bucketBy(4, key).sortBy(key).option("path", f"{root}/{name}").saveAsTable(name)
    return spark.table(name)


def test_bucketed_roles_are_joined_without_a_shuffle(static):
    spark = static
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    root, names = tempfile.mkdtemp(prefix="run-layout-", dir="/tmp"), []
    s = roles(spark, SF)
    plain = funnel_mart(s)

    def keep(role, key):
        names.append(f"layout_{role}")
        s[role] = _bucketed(spark, root, names[-1], s[role], key)

    try:
        for role in ("checkout_funnel", "checkout_session", "checkout_mart", "offered_terms"):
            keep(role, "checkout_id")
        for role in ("charge_mart", "bad_outcome"):
            keep(role, "charge_id")
        late = s["checkout_funnel"]
        checkout = [Lookup(s[r], "checkout_id", {c: c for c in s[r].columns if c != "checkout_id"}) for r in ("checkout_session", "checkout_mart", "offered_terms")]
        joined = enrich_colocated(late, "checkout_id", checkout)
        assert not any("Exchange" in line for _, line in _tree(joined, "executedPlan"))
        # The rows are laid out by another key here: they are shuffled once, the bucketed lookups not at all.
        charge = [Lookup(s[r], "charge_id", {c: c for c in s[r].columns if c != "charge_id"}) for r in ("charge_mart", "bad_outcome")]
        by_charge = _tree(enrich_group(late, "charge_id", charge, salt_cols=["application_id"]), "executedPlan")
        assert sum("Exchange" in line for _, line in by_charge) == 1
        mart = funnel_mart(s, colocated=("cf_checkout_id",))
        assert mart.exceptAll(plain).count() == plain.exceptAll(mart).count() == 0
        shuffles = lambda df: sum("Exchange" in line for _, line in _tree(df, "executedPlan"))
        assert shuffles(mart) < shuffles(plain) - 5
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_colocated_join_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 30), (4, None)], "id int, k bigint")
    dim = spark.createDataFrame([(10, "a"), (None, "n")], "k2 bigint, v string")
    out = enrich_colocated(df, "k", [Lookup(dim, "k2", {"v": "v"}), Lookup(dim, "k2", {"m": "k2"}, member=True)])
    assert sorted((r.id, r.v, r.m) for r in out.collect()) == [(1, "a", 1), (2, None, 0), (3, None, 0), (4, None, 0)]


def test_mart_columns_of_the_guarded_spine(spark):
    """The counting guard adds its columns and changes no other."""
    s, p = roles(spark, SF), MartParams()
    counted = enriched_spine(s, p, guard="count")
    assert sum(c.startswith("fan_") for c in counted.columns) == 17
    assert mart_columns(counted, p).exceptAll(funnel_mart(s, p)).where(F.lit(True)).count() == 0
