"""Operator 9: SimHash near-duplicates with BK-trees.

Fingerprints are made per document in one pass over the texts; from there on only
distinct fingerprints count. Two fingerprints that differ in at most two bits agree in at
least two of any four blocks of bits, so every link lies inside a shard of
fingerprints that share two of the four 16-bit blocks (six shards per fingerprint). A
shard of more than ``shard_cap`` members is cut the same way by the bits it does not
share yet (32 left: four blocks of 8; 16 left: four blocks of 4), so that after three levels
a shard has 2^8 members at most and the cap holds for every input without dropping any.

Each shard is one BK-tree: a node's children are keyed by their Hamming distance to it, and
a search with radius 2 follows only edges within 2 of the distance found. The tree
travels with its bounded shard to one task; all trees together grow with the corpus, so they
are not broadcast as one. A task returns a spanning forest of the shard's links, and
the components of all of them are found by distributed contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import KEY, id_and_text, materialize, parts_of, repeat_rows, row_key
from funnelkit.llm.graph import components

SHINGLE = 3
MAX_BITS = 2
SHARD_CAP = 1024
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if over half the shingles' hashes have it."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[s:e], SEED) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(octets), 8192):
        counts += np.unpackbits(octets[i : i + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and with ``keys`` the row's key, one row per input row."""
    key = KEY if keys else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps), *[batch.column(k) for k in key]], names=["doc_id", "fp", *key]
            )

    rows = docs.select(*id_and_text(docs, id_col, text_col), *(row_key(docs) if keys else []))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *key)))


def shard_masks(levels: int = 3) -> list[list[int]]:
    """Masks of the shards' shared bits, by level; mask 6 * i + j of a level refines mask i of
    the level before it."""
    out: list[list[int]] = []
    level = [0]
    for _ in range(levels):
        refined = []
        for mask in level:
            free = [i for i in range(64) if not mask >> i & 1]
            blocks = [free[i::4] for i in range(4)]
            refined += [mask | sum(1 << i for i in (*x, *y)) for x, y in combinations(blocks, 2)]
        out.append(level := refined)
    return out


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        if not new:
            return
        while True:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                return
            at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for distance, child in self.children[at].items():
                if d - radius <= distance <= d + radius:
                    stack.append(child)
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Pairs that link what the links within ``radius`` link, at most len(values) - 1 of them.

    Each value is searched among those already in the tree, then added.
    """
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    tree, pairs = BKTree(), []
    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            if (x := root(i)) != (y := root(j)):
                parent[x] = y
                pairs.append((value, values[j]))
        tree.add(value)
    return pairs


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [p for members in batch.column("members").to_pylist() for p in forest([m & (1 << 64) - 1 for m in sorted(members)], radius)]
        ends = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def near_links(spark: SparkSession, distinct: DataFrame, radius: int = MAX_BITS, shard_cap: int = SHARD_CAP) -> DataFrame:
    """Links (a, b) between the distinct values of column fp that connect all that lie at most
    ``radius`` (2 or less) bits apart."""
    if not 0 <= radius <= 2:
        raise ValueError("the shards hold all links of up to 2 bits; a larger radius needs other shards")
    found = None
    members = distinct.select("fp", F.lit(0).alias("path"))
    levels = shard_masks()
    for level, masks in enumerate(levels):
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        table = F.array(*[F.lit(m).cast("long") for m in signed])
        paths = members.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: 6 * F.col("path") + j)).alias("path"))
        shards = paths.withColumn("shared", F.col("fp").bitwiseAND(F.get(table, F.col("path"))))
        sizes = shards.groupBy("path", "shared").agg(F.count("*").alias("n")).filter("n > 1")
        last = level == len(levels) - 1
        if not last:
            sizes = materialize(spark, sizes, "shards")
        small = sizes if last else sizes.filter(F.col("n") <= shard_cap)
        sets = shards.join(small, ["path", "shared"]).groupBy("path", "shared").agg(F.collect_list("fp").alias("members"))
        links = sets.select("members").mapInArrow(lambda it: _links(it, radius), "a long, b long")
        found = links if found is None else found.union(links)
        if last:
            break
        large = sizes.filter(F.col("n") > shard_cap).select("path", "shared")
        if large.isEmpty():
            break
        members = materialize(spark, shards.join(large, ["path", "shared"]).select("fp", "path"), "large")
    return found


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    shingle: int = SHINGLE,
    radius: int = MAX_BITS,
    shard_cap: int = SHARD_CAP,
    keys: bool = False,
    **columns,
) -> DataFrame:
    """One row per input row: doc_id, fp, component_id, root (a fingerprint that stands for the
    component) and with ``keys`` the row's key (which reads all columns).

    component_id is the smallest doc_id whose fingerprint can be reached; null only if
    all ids of the component are. Null, empty and blank texts have fingerprint 0, which links
    like any other. Repeated rows and ids do no harm. An empty table gives an empty result.
    """
    made = materialize(spark, fingerprints(docs, shingle, keys=keys, **columns), "fingerprints")
    distinct = materialize(spark, made.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    labels = components(spark, near_links(spark, distinct, radius, shard_cap))
    linked = materialize(spark, distinct.join(labels.withColumnRenamed("node", "fp"), "fp"), "linked")
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(firsts, "root").select("fp", "root", "component_id")
    per_value = distinct.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return made.join(per_value, "fp").select("doc_id", "fp", "component_id", "root", *(KEY if keys else ()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id (null
    ids last; equal ids by row key)."""
    groups = near_duplicates(spark, docs, keys=True, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key_a", "__key_b"))
    plan = groups.groupBy("root").agg(first.alias("first")).select(
        "first.__key_a", "first.__key_b", F.array(F.lit(1)).alias("__at")
    )
    return repeat_rows(docs, plan).drop("__at")
