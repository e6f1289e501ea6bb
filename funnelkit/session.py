"""Session construction with the settings the operators assume.

The operators do not depend on any setting for correctness except the session time
zone (pinned to UTC so that timestamp -> date casts agree across machines). The rest
is the execution profile for large inputs: AQE re-plans joins from runtime sizes,
splits skewed partitions and coalesces small ones.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Compressed shuffle bytes that AQE may put into one task. The mart's narrow rows (ids, flags, codes) take about 20
#: times their compressed size once they are sorted or hashed, so Spark's default of 64 MB is over 1 GB of memory a task.
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
TASK_MB = 8
_GIVEN = "spark.funnelkit.advisoryGiven"

# Execution profile. Values are ordinary Spark settings; a cluster deployment passes
# its own shuffle-partition count and file split size through ``extra``.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Several lookups on one key share the frame's shuffle. Without this, Spark does not split
    # a hot key there, as the split costs the later lookups a shuffle of their own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Broadcast only what is measured to be small. The static threshold compares plan
    # statistics (compressed file sizes, which can understate memory several times), so
    # it stays at Spark's 10 MB; AQE's runtime threshold compares the actual shuffle
    # output of the small side and may be larger.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    # The mart's rows are wide (a packed spine struct plus ~50 enrichment columns), and
    # nested fields count against this limit; above it an operator leaves whole-stage
    # codegen. Oversized generated methods still fall back automatically.
    "spark.sql.codegen.maxFields": "1000",
}


def _mb(size: str) -> float:
    """A byte size as Spark writes it ("64MB", "8m", "67108864b", "1048576"), in MB."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(number) * 1024 ** (" kmgtp".index(unit or " ") - 2)


def bound_tasks(spark: SparkSession) -> SparkSession:
    """``spark``, whose tasks after a shuffle are now of ``TASK_MB`` at most, whatever the input's size. A smaller setting stays; ``as_given`` undoes it."""
    given = spark.conf.get(ADVISORY)
    if _mb(given) > TASK_MB:
        spark.conf.set(_GIVEN, given)
        spark.conf.set(ADVISORY, f"{TASK_MB}m")
    return spark


def as_given(spark: SparkSession) -> SparkSession:
    """``spark`` with the task size it had before ``bound_tasks``, unless its user has set another since."""
    given = spark.conf.get(_GIVEN, None)
    if given:
        if spark.conf.get(ADVISORY) == f"{TASK_MB}m":
            spark.conf.set(ADVISORY, given)
        spark.conf.unset(_GIVEN)
    return spark


def build_session(
    master: str | None = None,
    app_name: str = "funnelkit",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
