"""Operator 10: exact top-k search by inner product with paged M-trees.

An M-tree needs a metric. With R at least every vector's length, the vectors x extended by
sqrt(R^2 - |x|^2) and the queries q extended by 0 have the squared Euclidean distance
|q|^2 + R^2 - 2 q.x, so a larger inner product is a smaller distance. The vectors are dealt by
a hash into shards of about ``shard_rows``; each becomes one M-tree of fixed-size pages.
A page entry is a routing vector with the covering radius of its subtree and its
distance to the page's own routing vector (its parent). Search is best first: the page
whose ball may come closest is opened next; an entry whose stored parent distance
already rules its ball out costs no distance computation; search ends when no page left
can hold a closer vector than the k-th. Bounds are floating-point with a margin, the scores
themselves are integers and exact.

Queries are a stated set: they go to all shards in blocks of ``query_block``, one
broadcast of bounded size at a time, and each task returns its k best per query.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import materialize

K = 5
SHARD_ROWS = 4096
QUERY_BLOCK = 8192
PAGE = 256
SCALE = 256
LARGEST = (1 << 63) - 1


@dataclass
class Page:
    """A node: entries' vectors, their distance to this page's routing vector, and either the
    entries' child pages with covering radii or, in a leaf, the row numbers."""

    centre: np.ndarray
    vectors: np.ndarray
    to_parent: np.ndarray
    radii: np.ndarray
    rows: np.ndarray | None = None
    children: list[Page] = field(default_factory=list)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - to) ** 2).sum(axis=1), 0.0))


def build(points: np.ndarray, rows: np.ndarray, centre: np.ndarray, page: int = PAGE) -> Page:
    """Bulk load: up to ``page`` rows make a leaf; otherwise up to ``page`` routing vectors are chosen,
    each the point farthest from those before it, every point goes to the nearest, and the
    groups become child pages. Equal points beyond a page are cut into equal runs."""
    if len(rows) <= page:
        return Page(centre, points, distances(points, centre), np.zeros(len(rows)), rows=rows)
    want = min(page, -(-len(rows) // (page // 2)))
    near = distances(points, points[0])
    owner = np.zeros(len(rows), dtype=np.int64)
    chosen = [0]
    while len(chosen) < want and near.max() > 0:
        at = int(np.argmax(near))
        d = distances(points, points[at])
        closer = d < near
        owner[closer], near[closer] = len(chosen), d[closer]
        chosen.append(at)
    groups = [np.nonzero(owner == g)[0] for g in range(len(chosen))]
    if max(map(len, groups)) > len(rows) - max(1, len(rows) // 8):  # (nearly) all points alike: cut by position
        groups = np.array_split(np.concatenate(groups), want)
        chosen = [int(g[0]) for g in groups]
    routing = points[chosen]
    children = [build(points[g], rows[g], routing[i], page) for i, g in enumerate(groups)]
    radii = np.array([distances(points[g], routing[i]).max() for i, g in enumerate(groups)])
    return Page(centre, routing, distances(routing, centre), radii, children=children)


def search(root: Page, query: np.ndarray, k: int, far: float, slack: float, score, counts) -> list[tuple[int, int]]:
    """The k best (-score, row) of a tree. ``score(page)`` gives the exact scores of a leaf's entries,
    ``counts(row)`` says whether a row is a candidate. ``far`` turns a score into the distance
    at which it lies (by squared distance = far - 2 score)."""
    best: list[tuple[int, int]] = []
    reach = np.inf  # distance of the k-th best
    queue = [(0.0, 0, root, float(distances(root.centre[None], query)[0]))]
    tie = 0
    while queue:
        least, _, page, to_centre = heapq.heappop(queue)
        if least > reach:
            break
        # |d(q, centre) - d(entry, centre)| - radius bounds the distance to an entry's ball from below.
        may = np.abs(to_centre - page.to_parent) - page.radii <= reach
        if page.rows is not None:
            scores = score(page)
            near = np.flatnonzero(may & (scores >= -best[-1][0]) if len(best) == k else may)
            if not len(near):
                continue
            found = [(-s, r) for s, r in zip(scores[near].tolist(), page.rows[near].tolist()) if counts(r)]
            best = heapq.nsmallest(k, best + found)
            if len(best) == k:
                reach = float(np.sqrt(max(0.0, far + 2.0 * best[-1][0]))) + slack if best[-1][0] < LARGEST else np.inf
            continue
        some = np.flatnonzero(may)
        d = distances(page.vectors[some], query)
        for i, di, bound in zip(some.tolist(), d.tolist(), (d - page.radii[some]).tolist()):
            if bound <= reach:
                tie += 1
                heapq.heappush(queue, (max(least, bound), tie, page.children[i], di))
    return best


def shard_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, page: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best of one shard for every query but its own id."""
    order = np.argsort(ids, kind="stable")  # rows by vec_id: ties go to the smaller row
    ids, vectors = ids[order], vectors[order]
    x = vectors.astype(np.float64)
    square = (x * x).sum(axis=1)
    radius2 = float(square.max())
    points = np.concatenate([x, np.sqrt(np.maximum(radius2 - square, 0.0))[:, None]], axis=1)
    tree = build(points, np.arange(len(ids)), points.mean(axis=0), page)
    # Products summed in floating point are whole numbers and exact below 2^53, in 64-bit integers below 2^63;
    # beyond that Python's integers count.
    largest = float(np.abs(x).max()) * float(np.abs(queries.astype(np.float64)).max() if len(queries) else 0) * (x.shape[1] + 1)
    exact = largest < 2**53
    if largest >= 2**62:
        vectors, queries = vectors.astype(object), queries.astype(object)
    out = []
    for query_id, q in zip(query_ids.tolist(), queries):
        extended = np.append(q.astype(np.float64), 0.0)
        far = float((extended**2).sum()) + radius2
        # Rounding of squared distances: a relative 1e-9 of the largest, seen through the square root.
        slack = np.sqrt(1e-9 * max(far, 1.0))
        if exact:
            score = lambda leaf: (leaf.vectors @ extended).astype(np.int64)
        elif largest < 2**62:
            score = lambda leaf: vectors[leaf.rows] @ q
        else:
            score = lambda leaf: np.clip(vectors[leaf.rows] @ q, -LARGEST, LARGEST).astype(np.int64)
        best = search(tree, extended, k, far, slack, score, lambda r: ids[r] != query_id)
        out += [(query_id, int(ids[r]), -s) for s, r in best]
    return out


def shard_task(sent, k: int, page: int):
    """Search of one shard for the queries in the broadcast ``sent``: {dims: (ids, vectors)}."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        if key[0] in sent.value:
            vectors = np.array(pdf["v"].tolist(), dtype=np.int64)
            query_ids, queries = sent.value[key[0]]
            if not vectors.shape[1]:  # empty vectors: all products are zero
                vectors, queries = np.zeros((len(vectors), 1), dtype=np.int64), np.zeros((len(queries), 1), dtype=np.int64)
            found = shard_search(pdf["vec_id"].to_numpy(), vectors, query_ids, queries, k, page)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype=np.int64)

    return run


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component) as longs; rows that take no part are left out."""
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    # In Spark NaN is greater than infinity.
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.col(vector_col).isNotNull() & finite & F.col(id_col).isNotNull()
    return rows.filter(whole).select(F.col(id_col).cast("long").alias("vec_id"), scaled.cast("array<long>").alias("v"))


def top_k(
    spark: SparkSession,
    rows: DataFrame,
    is_query,
    k: int = K,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    query_block: int = QUERY_BLOCK,
    page: int = PAGE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for every query the k rows of the largest integer inner product,
    all rows if there are fewer; ties to the smaller vec_id.

    Queries are the rows for which ``is_query(vec_id)`` holds. Rows with a null id, and vectors
    that are null or hold null or non-finite components, take no part. A scaled component beyond 64 bits counts as
    the largest or smallest long, and so does a score. Vectors meet only
    those of their own length, empty ones too (their products are 0). Of repeated ids each row is a candidate, but never for a
    query of that id; the query of a repeated id is its smallest vector. An empty table, or
    one without queries, gives an empty result.
    """
    usable = quantised(rows, id_col, vector_col, scale).withColumn("row_id", F.monotonically_increasing_id())
    usable = materialize(spark, usable, "vectors")
    n_shards = max(1, -(-usable.count() // shard_rows))
    sharded = usable.withColumn("dims", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(n_shards)))
    queries = materialize(
        spark,
        usable.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))),
        "queries",
    )
    n_blocks = max(1, -(-queries.count() // query_block))
    found = None
    for block in range(n_blocks):
        part = queries.filter(F.pmod(F.col("block"), F.lit(n_blocks)) == block).select("vec_id", "v").toPandas().sort_values("vec_id")
        by_dims = {d: (g["vec_id"].to_numpy(), np.array(g["v"].tolist(), dtype=np.int64)) for d, g in part.groupby(part["v"].map(len))}
        sent = spark.sparkContext.broadcast(by_dims)
        hits = materialize(
            spark, sharded.groupBy("dims", "shard").applyInPandas(shard_task(sent, k, page), "query_id long, vec_id long, score long"), "hits"
        )
        found = hits if found is None else found.union(hits)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
