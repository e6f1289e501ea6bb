"""Connected components of a link table, as repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import materialize

#: Odd multiplier that gives each round another order of the node numbers (2^64 / golden ratio).
_STEP = 0x9E3779B97F4A7C15


def _flip(round_: int) -> int:
    bits = (round_ * _STEP) % (1 << 64)
    return bits - (1 << 64) if bits >> 63 else bits


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges``: long columns a, b. Returns node, root for every node of an edge; nodes have
    one root exactly if a path links them.

    Each round maps every node to the least of itself and its neighbours, in an order that
    changes from round to round (numbers are compared after flipping some bits), and
    replaces the ends of each edge by what they map to. Equal ends are dropped, so each
    component shrinks to one node, in a number of rounds that grows with the logarithm
    of its size. Edges and maps of a round are tables in the shared folder; a node's
    minimum is combined before the shuffle, so a node with very many edges is no hot group.
    """
    edges = materialize(spark, edges.filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not maps or not edges.isEmpty():
        flip = F.lit(_flip(len(maps) + 1)).cast("long")
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.col("b").bitwiseXOR(flip)).alias("to"))
        step = materialize(
            spark,
            least.select("node", F.least("to", F.col("node").bitwiseXOR(flip)).bitwiseXOR(flip).alias("to")),
            "map",
        )
        maps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").filter("to_a <> to_b")
        edges = materialize(
            spark,
            moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            "edges",
        )
    labels = maps[0].select("node", F.col("to").alias("root"))
    for step in maps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("to").alias("later"))
        labels = labels.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return labels
