"""Plan checks: pushdown, no Cartesian products, one spine shuffle per key group."""

import re

import pytest

from funnelkit.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookback_pushes_to_scan(spark):
    p = _plan(QUERIES["lookback_filter"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


@pytest.mark.parametrize("name", ["funnel_mart", "funnel_mart_key_window", "stitch_full_outer", "asof_latest_state"])
def test_no_cartesian_or_nested_loop(spark, name):
    p = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def _static_plan(spark, name):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _plan(QUERIES[name](spark, SF))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_grouped_joins_shuffle_spine_once_per_key(spark):
    plan = _static_plan(spark, "funnel_mart")
    # 11 key groups shuffle checkout rows: checkout, charge, application, address, postal, metro,
    # guarantee, merchant, merchant id, user, person. The prequal master joins the early stage,
    # which both branches of the split stitch read.
    assert len(re.findall(r"Exchange hashpartitioning\(__gk#", plan)) <= 11 + 2


def _joins(spark, name):
    return len(re.findall(r"SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin", _static_plan(spark, name)))


def test_rule_queries_join_only_what_they_need(spark):
    stitch = _joins(spark, "stitch_split")
    assert _joins(spark, "reason_select") == stitch
    assert _joins(spark, "label_map") == stitch + 1
    assert _joins(spark, "plan_kind") == stitch + 3


@pytest.mark.parametrize("name", ["stitch_split", "funnel_mart_incremental"])
def test_early_stage_is_computed_once_for_both_branches_of_the_stitch(spark, name):
    plan = _static_plan(spark, name)
    grouped = re.findall(r"HashAggregate\(keys=\[l_orderkey#\d+L?\], functions=\[partial_min\(l_partkey|partial_min\(l_partkey", plan)
    assert len(grouped) == 1 and "ReusedExchange" in plan


def test_mart_carries_late_columns_through_the_stitch_as_one(spark):
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        lines = _static_plan(spark, "funnel_mart").split("\n")
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(__stitch_lk" in line]
    assert shuffles and all(re.search(r"__late#|cf_total_amount", lines[i + 1])[0] == "__late#" for i in shuffles)


def test_late_window_reaches_the_late_scan(spark):
    """Rows that cannot report are dropped before the first late join."""
    plan = _static_plan(spark, "approval_rules").split("\n")
    scan = next(i for i, line in enumerate(plan) if "Scan parquet" in line and "o_totalprice" in line)
    assert any("Filter" in line and "2000-01-01" in line for line in plan[:scan][-4:])


def test_two_lookups_on_a_hot_key_are_split(spark):
    from pyspark.sql import functions as F

    from funnelkit.operators.enrich import Lookup, enrich_group

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        spine = spark.range(0, 40000, 1, 8).select("id", F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(7).alias("k"))
        dims = [spark.range(0, 40000).select(F.col("id").alias("d"), (F.col("id") * i).alias(f"v{i}")) for i in (2, 3)]
        out = enrich_group(spine, "k", [Lookup(d, "d", {f"v{i}": f"v{i}"}) for i, d in zip((2, 3), dims)], salt_cols=["id"])
        assert out.agg(F.sum(F.col("v2") + F.col("v3"))).first()[0] == spine.agg(F.sum(5 * F.col("k"))).first()[0]
        final = out.select("id", "v2", "v3")
        final.collect()
        assert _plan(final).count("skew=true") >= 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_keys_keep_their_type(spark):
    """A key that is not NULL is joined as it is, and a bucketed pair without a shuffle."""
    import tempfile

    from pyspark.sql import functions as F

    from funnelkit.operators.enrich import Lookup, enrich_group

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    root = tempfile.mkdtemp(prefix="run-buckets-", dir="/tmp")
    try:
        for name, col in (("left_b", "v"), ("right_b", "w")):
            spark.range(100).select(F.col("id").alias("k"), F.col("id").alias(col)).write.bucketBy(4, "k").option(
                "path", f"{root}/{name}").saveAsTable(f"test_{name}")
        left, right = spark.table("test_left_b"), spark.table("test_right_b")
        salted = _plan(enrich_group(left, "k", [Lookup(right, "k", {"w": "w"})], salt_cols=["v"]))
        assert "as string" not in salted
        native = _plan(enrich_group(left, "k", [Lookup(right, "k", {"w": "w"})], spread_nulls=False))
        assert "Exchange" not in native
    finally:
        for name in ("left_b", "right_b"):
            spark.sql(f"DROP TABLE IF EXISTS test_{name}")
        for k, v in old.items():
            spark.conf.set(k, v)


def test_grouped_order_shuffles_less_than_reference_order(spark):
    grouped = len(re.findall(r"Exchange hashpartitioning\(__gk#", _static_plan(spark, "funnel_mart")))
    reference = len(re.findall(r"Exchange hashpartitioning\(__gk#", _static_plan(spark, "funnel_mart_reference_order")))
    assert grouped < reference


def test_as_of_is_linear_not_range_join(spark):
    p = _plan(QUERIES["asof_latest_state"](spark, SF))
    assert "Window" in p
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_plan_kind_is_not_pasted(spark):
    """The reference pastes the plan-kind CASE 13 times; here it is one column. Catalyst
    may fold one predicate over it into its branches (PushFoldableIntoBranches), so at
    most two copies appear in the optimized plan."""
    keys = ("spark.sql.debug.maxToStringFields", "spark.sql.maxPlanStringLength")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "100000")
    spark.conf.set(keys[1], "2147483632")
    try:
        opt = QUERIES["funnel_mart"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert 1 <= opt.count("direct other") <= 2


def test_report_window_sits_on_the_stitch(spark):
    """The reporting-window filter is applied at the stitch, before the joins of both stages: above
    the late LEFT JOIN early branch, and on the early side of the early-only branch."""
    from funnelkit.plans.mart import stitched_spine
    from funnelkit.plans.params import MartParams
    from funnelkit.sources.fixture import roles

    s = roles(spark, SF)
    opt = stitched_spine(s["checkout_funnel"], s["prequal_funnel"], MartParams())._jdf.queryExecution() \
        .optimizedPlan().toString().split("\n")
    join_rows = [i for i, line in enumerate(opt) if "Join LeftOuter" in line]
    assert join_rows and "Filter" in opt[join_rows[0] - 1]
    anti = next(i for i, line in enumerate(opt) if "Join LeftAnti" in line)
    assert any("Filter" in line and "2000-01-01" in line for line in opt[anti + 1:])


def test_tasks_after_a_shuffle_are_bounded(spark):
    """On a session left at Spark's 64 MB the queries on the narrow spine take tasks of 8 MB, a smaller setting stays, and
    queries after them find the session as it was given."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    try:
        for given, kept in (("64MB", "8m"), ("67108864b", "8m"), ("67108864", "8m"), ("1g", "8m"), ("8m", "8m"), ("4096k", "4096k"), ("100", "100")):
            spark.conf.set(key, given)
            QUERIES["reason_select"](spark, SF)
            assert spark.conf.get(key) == kept
            QUERIES["stitch_split"](spark, SF)
            assert spark.conf.get(key) == kept
            QUERIES["date_gate"](spark, SF)
            assert spark.conf.get(key) == given
        spark.conf.set(key, "64MB")
        QUERIES["reason_select"](spark, SF)
        spark.conf.set(key, "16m")  # set by the user in between
        QUERIES["date_gate"](spark, SF)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.set(key, old)


def test_the_joins_carry_outputs_instead_of_the_columns_they_take(spark):
    """Stage columns that only stage outputs take enter no enrichment join of the mart, and the outputs are those that
    ``mart_columns`` computes after the joins."""
    from funnelkit.plans.mart import STAGE_ONLY, enriched_spine, funnel_mart, mart_columns, stage_outputs
    from funnelkit.plans.params import MartParams
    from funnelkit.sources.fixture import roles

    carried = enriched_spine(roles(spark, SF), MartParams(), narrow=True).columns
    assert not set(carried) & set(STAGE_ONLY) and {f"out_{x}" for x in stage_outputs(MartParams())} < set(carried)
    s = roles(spark, SF)
    early, late = funnel_mart(s), mart_columns(enriched_spine(s, MartParams(), 3600), MartParams())
    assert early.columns == late.columns and early.dtypes == late.dtypes
    assert early.exceptAll(late).count() == late.exceptAll(early).count() == 0 < early.count()
