"""Operator 7: mixing sources to target weights as a time-varying curriculum (DataFrame
functions only).

Each source has a weight schedule w(t) over the training time t in [0, 1], linear between
knots. Its integral is the source's weight; the weights share the word budget, and a target
stops at ``max_epochs`` times its source's size, the excess going to the others. The
documents of a source, in a hashed order and repeated as often as the target asks, lie end to
end on the source's demand line; a document's place there, divided by the target, is
the share of the source's demand met before it, and inverting the cumulative schedule at
that share gives its training position. Range-sorting by position gives the training order.

The order inside a source is a distributed prefix sum: sums per (source, hash bucket), a
running sum over the buckets, then a running sum inside each bucket, so a source that
holds a third of all documents is spread over as many tasks as there are buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import KEY, WORD, materialize, repeat_rows, row_key

Schedule = Sequence[tuple[float, float]]

#: Schedules of the sources in code-point order, repeating: knots (time, weight). Their
#: integrals are 5, 2 and 1: the first kind fades out, the others fade in.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 7.0), (1.0, 3.0)),
    ((0.0, 1.0), (1.0, 3.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
BUDGET = 1.5
MAX_EPOCHS = 2
BUCKET_DIGITS = 3  # hex digits of the document hash: 4096 buckets a source


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def inverse_demand(schedule: Schedule, share: Column) -> Column:
    """The time by which ``share`` (0 to 1) of the schedule's integral has been asked for."""
    total, before, pieces = integral(schedule), 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        slope = (w1 - w0) / (t1 - t0)
        rest = share * F.lit(total) - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest))
        span = F.lit(w0) + root
        t = F.lit(t0) + F.when(span > 0, F.lit(2.0) * rest / span).otherwise(F.lit(0.0))
        pieces.append((before + area, F.least(F.lit(t1), F.greatest(F.lit(t0), t))))
        before += area
    out = pieces[-1][1]
    for top, t in reversed(pieces[:-1]):
        out = F.when(share * F.lit(total) < F.lit(top), t).otherwise(out)
    return out


def by_class(schedules: Sequence[Schedule], k: Column, make) -> Column:
    """``make(schedule)`` of schedule number ``k``."""
    out = make(schedules[-1])
    for i, s in reversed(list(enumerate(schedules[:-1]))):
        out = F.when(k == i, make(s)).otherwise(out)
    return out


def source_targets(sized: DataFrame, schedules: Sequence[Schedule], budget: float, max_epochs: int) -> DataFrame:
    """Per source: source, k (its schedule), source_size, target; one row per source.

    A source is full if an equal rate for all that are left would exceed its cap; in order
    of cap per weight, the first that is not full settles the rate of the rest.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sums.withColumn("k", (F.row_number().over(order) - 1) % F.lit(len(schedules)))
    ranked = ranked.withColumn("weight", by_class(schedules, F.col("k"), lambda s: F.lit(integral(s))))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    rated = ranked.select(
        "source", "k", "source_size", "weight", "cap",
        (F.sum("source_size").over(everything) * F.lit(budget)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full_before"),
        F.sum("weight").over(after).alias("weight_left"),
    ).withColumn("rate", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    open_ = F.col("rate") * F.col("weight") <= F.col("cap")
    rated = rated.withColumn("final", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "rate"))).over(everything)["rate"])
    return rated.select(
        "source", "k", "source_size",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target"),
    )


def curriculum_mix(
    spark: SparkSession,
    docs: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    whole_documents: bool = False,
    bucket_digits: int = BUCKET_DIGITS,
    keys: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies,
    positions (training time of each copy) and with ``keys`` the row's key (which reads all columns).

    A size is the text's number of words; null and empty texts have size 0 and are never
    taken. A null source is a source of its own, the last. Each source takes its target
    to the word: its last document counts with its first words only. With
    ``whole_documents`` that last one is taken whole if at least half of it fits, else not,
    so a source ends within half a document of its target. Rows with equal ids or texts are
    ordered by hash, id and the text's hash, or with ``keys`` the row's; rows equal in these are
    interchangeable, and their order does not change the result. An empty table gives an empty result.
    """
    sized = materialize(
        spark,
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("hash"),
            *(row_key(docs) if keys else [F.xxhash64(F.col(text_col).cast("string")).alias("text_hash")]),
        ).withColumn("bucket", F.substring("hash", 1, bucket_digits)),
        "sized",
    )
    targets = source_targets(sized, schedules, budget, max_epochs)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).drop("bucket_size")
    starts = starts.join(targets, starts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("hash", "doc_id", *(KEY if keys else ("text_hash",)))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sized.withColumn("local_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(
        starts,
        local["source"].eqNullSafe(starts["source"]) & (local["bucket"] == starts["bucket"]),
    ).drop(starts["source"]).drop(starts["bucket"])
    begin = F.col("bucket_start") + F.col("local_start")
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    placed = placed.withColumn("starts", F.transform(epochs, lambda e: begin + e * F.col("source_size")))
    words = F.round("target").cast("long")
    if whole_documents:
        # Taken if the middle of the document lies before the target.
        takes = F.transform("starts", lambda s: F.when(2 * s + F.col("size") <= 2 * F.col("target"), F.col("size")).otherwise(F.lit(0)))
    else:
        takes = F.transform("starts", lambda s: F.greatest(F.lit(0), F.least(F.col("size"), words - s)))
    placed = placed.withColumn("takes", takes)
    placed = placed.withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda x, y: x + y))
    placed = placed.withColumn("copies", F.size(F.filter("takes", lambda x: x > 0)))
    share = lambda s: F.least(F.lit(1.0), s / F.col("target"))
    positions = F.transform(
        F.slice("starts", 1, F.col("copies")),
        lambda s: by_class(schedules, F.col("k"), lambda w: inverse_demand(w, share(s))),
    )
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copies",
        positions.alias("positions"), *(KEY if keys else ()),
    )


def training_order(mix: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position."""
    return mix.select("doc_id", "source", "size", F.explode("positions").alias("position")).orderBy("position", "doc_id")


def mix_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, repeated as the mix repeats them, in
    training order; whole documents only."""
    mix = curriculum_mix(spark, docs, whole_documents=True, keys=True, **options)
    plan = mix.filter("copies > 0").groupBy("__key_a", "__key_b").agg(F.flatten(F.collect_list("positions")).alias("__at"))
    return repeat_rows(docs, plan).orderBy("__at").drop("__at")
