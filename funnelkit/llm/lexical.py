"""Operator 12: ranked lexical search with hashed max-sketches.

One pass over the texts builds the index. A document's sketch has 2^16 coordinates; every
term falls on one by its hash, and a coordinate keeps the maximum over its terms (only those above zero are
stored). What is kept is the term frequency, which the impact of a term grows with for a given document,
so the impact of the maximum is the maximum of the impacts and can be taken when the corpus
totals are known. The same pass counts in how many documents each term occurs.

Queries go out in blocks. A lookup batch is one matrix product: impacts of the sketches at the coordinates
the block uses, times the block's term weights there. It gives, for every document and query, an upper bound of
the score, as a coordinate holds at least the impact of any term on it. The ``first`` documents of a query
by falling bound are scored exactly from their texts; if the next bound cannot reach the k-th
score, that is the answer. For other queries every document whose bound does reach it
is scored too, whatever their number.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, materialize, parts_of

K = 10
FIRST = 40  # documents scored before the threshold is known
ITEM_BLOCK = 256
WIDTH = 1 << 16  # coordinates of a sketch
PEAK = 255  # a stored frequency of PEAK stands for any from there on
TOP_IMPACT = 1_000_000  # no frequency reaches a larger impact
VOCABULARY = 400_000  # terms a task counts before it sends its counts
CELLS = 4_000_000  # numbers in one lookup matrix
LAST = (1 << 63) - 1  # order of a null doc_id

#: ASCII: digits and small letters stay, capitals become small, all else parts terms; other bytes stay.
_FOLD = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + 75 * n * n_docs // n_terms


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def coordinate(term: bytes, width: int) -> int:
    return xxhash.xxh64_intdigest(term) % width


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per document from the concatenation; ``ends`` counts entries."""
    offsets = np.concatenate(([0], ends)) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (term null) and rows of term counts (the others null)."""
    names = ["doc_id", "mark", "n", "coordinates", "peaks", "term", "df"]
    at: dict[bytes, int] = {}
    counts: Counter[bytes] = Counter()

    def vocabulary() -> pa.RecordBatch:
        none = [pa.nulls(len(counts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=names)

    for part in parts_of(batches):
        rows, lengths, keys, tfs = [], [], [], []
        for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
            words = terms(text)
            if not words:
                continue
            tf = Counter(words)
            counts.update(tf.keys())
            base = len(rows) * width
            for term in tf:
                if term not in at:
                    at[term] = coordinate(term, width)
            keys += [base + at[term] for term in tf]
            tfs += tf.values()
            rows.append(i)
            lengths.append(len(words))
            if len(at) > VOCABULARY:
                at.clear()
        if not rows:
            continue
        key, tf = np.array(keys, dtype=np.int64), np.minimum(np.array(tfs, dtype=np.int64), PEAK)
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        peaks, key = np.maximum.reduceat(tf, starts).astype(np.uint8), key[starts]
        ends = np.searchsorted(key // width, np.arange(len(rows)), side="right")
        taken = part.take(pa.array(rows))
        none = pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [taken.column("doc_id"), taken.column("mark"), pa.array(lengths, pa.int64()),
             _binary((key % width).astype(np.uint16), ends), _binary(peaks, ends), *none], names=names)
        if len(counts) > VOCABULARY:
            yield vocabulary()
            counts.clear()
    if counts:
        yield vocabulary()


@dataclass
class Index:
    """Sketches of all documents with a term, document counts of all terms, and the totals."""

    docs: DataFrame
    sketches: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int
    width: int


def build_index(spark: SparkSession, docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """``width``: coordinates of a sketch, at most 2^16. ``docs`` must give the same rows each time it is read. A document is known by its id and
    the hash of its text; rows equal in both are scored one by one."""
    rows = docs.select(*id_and_text(docs, id_col, text_col)).withColumn("mark", F.xxhash64("text"))
    made = materialize(
        spark, rows.mapInArrow(lambda it: _sketches(it, width), "doc_id long, mark long, n long, coordinates binary, peaks binary, term binary, df long"), "sketches"
    )
    sketches = made.filter("term is null").select("doc_id", "mark", "n", "coordinates", "peaks")
    totals = sketches.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(rows, sketches, made.filter("term is not null").select("term", "df"), totals.docs, totals.terms, width)


@dataclass
class Block:
    """Queries by number: their item ids, exact term weights (times repeats in the query), and
    the weights folded to coordinates."""

    items: list[int | None]
    weights: list[dict[bytes, int]]
    n_docs: int
    n_terms: int
    width: int

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Column of each coordinate (-1: not used) and the weights, columns by queries."""
        column = np.full(self.width, -1, dtype=np.int64)
        at = {t: coordinate(t, self.width) for w in self.weights for t in w}
        used = sorted(set(at.values()))
        column[used] = np.arange(len(used))
        table = np.zeros((len(used), len(self.items)))
        for q, w in enumerate(self.weights):
            for t, value in w.items():
                table[column[at[t]], q] += value
        return column, table


def bounds(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sketches by ascending doc_id (null last), with the upper bounds of each row's scores for each query."""
    column, table = block.folded()
    slack = 1.0 if table.sum(axis=0).max(initial=0) * TOP_IMPACT < 2**53 else 1 + 1e-9  # sums are whole and exact below 2^53
    step = max(1, CELLS // max(1, *table.shape))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            ids = order_of(batch.column("doc_id"))
            batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
            peaks = batch.column("peaks").to_pylist()
            flat = np.frombuffer(b"".join(batch.column("coordinates").to_pylist()), dtype=np.uint16)
            tf = np.frombuffer(b"".join(peaks), dtype=np.uint8)
            at = column[flat]
            hit = np.flatnonzero(at >= 0)
            row = np.repeat(np.arange(batch.num_rows), list(map(len, peaks)))[hit]
            m = np.array([min(length_factor(n, block.n_docs, block.n_terms), 1 << 50) for n in batch.column("n").to_pylist()], dtype=np.int64)
            value = tf[hit].astype(np.int64)
            value = np.where(value == PEAK, TOP_IMPACT, impact(value, m[row]))
            impacts = np.zeros((batch.num_rows, len(table)))
            impacts[row, at[hit]] = value
            yield batch, (impacts @ table) * slack


def order_of(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(LAST).to_numpy(zero_copy_only=False)


def _candidates(rows: list[tuple[int, int | None, int, float]]) -> pa.RecordBatch:
    q, ids, marks, bound = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(bound, pa.float64())],
        names=["query", "doc_id", "mark", "bound"],
    )


CANDIDATE = "query int, doc_id long, mark long, bound double"


def _first(sent, first: int):
    """Of a task's documents the ``first`` of each query by (bound falling, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[float, int, int]]] = [[] for _ in sent.value.items]
        for batch, bound in bounds(sent.value, batches):
            ids, marks = order_of(batch.column("doc_id")), batch.column("mark").to_numpy(zero_copy_only=False)
            best = np.argsort(-bound, axis=0, kind="stable")[:first]
            for q, heap in enumerate(heaps):
                for i in best[:, q].tolist():
                    entry = (bound[i, q], -int(ids[i]), int(marks[i]))
                    if entry[0] <= 0 or len(heap) == first and entry < heap[0]:
                        break
                    if len(heap) < first:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heapreplace(heap, entry)
        yield _candidates([(q, None if o == -LAST else -o, mark, b) for q, heap in enumerate(heaps) for b, o, mark in heap])

    return run


def _reaching(sent, limits: dict[int, tuple[int, int]]):
    """Documents whose bound reaches their query's limit (score, doc_id of the k-th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sorted(limits)
        score = np.array([limits[q][0] for q in queries], dtype=np.float64)
        last = np.array([limits[q][1] for q in queries], dtype=np.int64)
        for batch, bound in bounds(sent.value, batches):
            ids, b = order_of(batch.column("doc_id")), bound[:, queries]
            row, q = np.nonzero((b > 0) & ((b > score) | (b == score) & (ids[:, None] <= last)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(queries, dtype=np.int32)[q]), batch.column("doc_id").take(pa.array(row)),
                 batch.column("mark").take(pa.array(row)), pa.array(b[row, q])], names=["query", "doc_id", "mark", "bound"])

    return run


def _scores(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in parts_of(batches):
            out: list[tuple[int, int | None, int]] = []
            for doc_id, text, queries in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("queries").to_pylist()
            ):
                words = terms(text)
                tf = Counter(words)
                m = length_factor(len(words), block.n_docs, block.n_terms)
                for q in queries:
                    score = sum(w * impact(tf[t], m) for t, w in block.weights[q].items() if t in tf)
                    if score > 0:
                        out.append((q, doc_id, score))
            q, ids, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["query", "doc_id", "score"]
            )

    return run


def exact_scores(index: Index, sent, candidates: DataFrame, k: int) -> DataFrame:
    """query, rank, doc_id, score: the k best of the candidates, scored from their texts."""
    wanted = candidates.groupBy(F.col("doc_id").alias("c_id"), F.col("mark").alias("c_mark")).agg(F.collect_set("query").alias("queries"))
    texts = index.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("mark") == F.col("c_mark")))
    scored = texts.select("doc_id", "text", "queries").mapInArrow(_scores(sent), "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def search_block(spark: SparkSession, index: Index, block: Block, k: int, first: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)
    order = Window.partitionBy("query").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
    leading = materialize(
        spark,
        index.sketches.mapInArrow(_first(sent, first), CANDIDATE).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= first),
        "leading",
    )
    found = materialize(spark, exact_scores(index, sent, leading, k), "scored")
    place = lambda doc_id: LAST if doc_id is None else doc_id
    kth = {r.query: (r.score, place(r.doc_id)) for r in found.filter(F.col("rank") == k).collect()}
    next_best = {r.query: (r.bound, place(r.doc_id)) for r in leading.filter(F.col("place") == first).collect()}
    # A query is done if the last bound looked at comes at or after its k-th score: later ones do, too.
    open_ = {
        q: kth.get(q, (0, LAST)) for q, (b, i) in next_best.items() if q not in kth or b > kth[q][0] or b == kth[q][0] and i < kth[q][1]
    }
    if open_:
        reaching = materialize(spark, index.sketches.mapInArrow(_reaching(sent, open_), CANDIDATE), "reaching")
        done = found.filter(~F.col("query").isin(*open_)) if len(open_) < len(block.items) else found.limit(0)
        found = done.union(materialize(spark, exact_scores(index, sent, reaching, k), "scored"))
    ids = spark.createDataFrame(list(enumerate(block.items)), "query int, item_id long")
    return found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    first: int = FIRST,
    item_block: int = ITEM_BLOCK,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0, all if fewer.

    Null texts have no terms, like empty ones; documents and items without terms appear nowhere. Equal
    scores come by ascending doc_id, a null doc_id last, rows of the same id in any order. Each row
    of ``docs`` is a document, repeated ones too, so an id can fill several ranks. Of rows
    of one item_id (null is one as well) the smallest text that is not null counts. Long texts are
    read whole. Other columns are not read. No documents or no items give an empty result.
    """
    index = build_index(spark, docs, width, id_col, text_col)
    asked = materialize(
        spark, items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text")), "items"
    )
    n_blocks = -(-asked.count() // item_block)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(n_blocks):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()
        repeats = [Counter(terms(r.text.encode())) for r in part]
        words = spark.createDataFrame([(bytearray(t),) for t in sorted({t for c in repeats for t in c})], "term binary")
        df = {bytes(r.term): r.df for r in index.vocabulary.join(words, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weights = [{t: n * weight(df[t], index.n_docs) for t, n in c.items() if t in df} for c in repeats]
        if df:
            found = found.union(search_block(spark, index, Block([r.item_id for r in part], weights, index.n_docs, index.n_terms, width), k, first))
    return found
