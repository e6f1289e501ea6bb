"""Operator 8: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of whole texts are made in the tasks. The trees are fitted on the driver from the
statistics of at most ``max_rows`` labelled rows, the ones whose hashed id comes first,
so the sample and with it the model are the same on every run. The fitted trees are flattened
into arrays (bounded: trees x 2^depth nodes) that every task traverses with numpy, all
documents of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, parts_of

MAX_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "log_lines", "mean_word", "longest_word", "words_per_line", "distinct_words",
    "top_word", "top3_words", "repeated_next", "distinct_pairs", "distinct_lines", "top_line", "line_ends",
    "word_ends", "upper_starts", "upper", "digits", "spaces", "marks", "sentence_marks", "symbols", "top_symbol",
    "beyond_ascii", "entropy", "lone_marks",
)

_UPPER = np.arange(65, 91)
_DIGITS = np.arange(48, 58)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_SENTENCE = np.array([ord(c) for c in ".,;:!?'\"()-"])
_SYMBOLS = np.array([c for c in _MARKS if c not in set(_SENTENCE.tolist())])
_LETTER = frozenset([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_CLOSED = frozenset(b".,;:!?)\"'")


def statistics(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for a UTF-8 text; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, k = len(text), len(words)
    octets = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = lambda where: float(octets[where].sum()) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    p = octets[octets > 0] / n
    lasts = Counter(w[-1] for w in words)
    firsts = Counter(w[0] for w in words)
    line_counts = Counter(lines)
    lone = sum(c for w, c in counts.items() if len(w) <= 2 and not any(b in _LETTER for b in w))
    return [
        np.log1p(n), np.log1p(k), np.log1p(len(lines)), sum(map(len, words)) / k, max(map(len, counts)),
        k / len(lines), len(counts) / k, top[0] / k, sum(top) / k,
        sum(map(bytes.__eq__, words, words[1:])) / k, len(set(zip(words, words[1:]))) / k,
        len(line_counts) / len(lines), max(line_counts.values()) / len(lines),
        sum(x.rstrip()[-1] in _CLOSED for x in lines) / len(lines),
        sum(c for b, c in lasts.items() if b in _LETTER or b in _CLOSED) / k,
        sum(c for b, c in firsts.items() if 65 <= b <= 90) / k,
        share(_UPPER), share(_DIGITS), float(octets[32]) / n, share(_MARKS), share(_SENTENCE), share(_SYMBOLS),
        float(octets[_SYMBOLS].max()) / n, float(octets[128:].sum()) / n, float(-(p * np.log2(p)).sum()), lone / k,
    ]


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Flattened boosted trees: one row per tree, one column per node."""

    feature: np.ndarray  # feature tested at a node
    threshold: np.ndarray  # left if value <= threshold
    left: np.ndarray  # child positions; a leaf is its own child
    right: np.ndarray
    value: np.ndarray  # leaf value
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[t, at]] <= self.threshold[t, at]
                at = np.where(goes_left, self.left[t, at], self.right[t, at])
            out += self.value[t, at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 120,
    depth: int = 4,
    rate: float = 0.1,
    bins: int = 64,
    l2: float = 1.0,
    min_rows: int = 8,
) -> Trees:
    """Boost ``n_trees`` trees on the logistic loss; splits are sought on histograms of at most
    ``bins`` quantile bins per feature. Without rows, or with one label only, no tree splits
    and the score is the smoothed share of label 1 (0.5 without rows)."""
    n, n_features = x.shape
    share = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
    base = float(np.log(share / (1 - share)))
    nodes = 2 ** (depth + 1) - 1
    shape = (n_trees, nodes)
    own = np.broadcast_to(np.arange(nodes), shape)
    out = Trees(np.zeros(shape, np.int64), np.full(shape, np.inf), own.copy(), own.copy(), np.zeros(shape), base, depth)
    if not n or len(np.unique(y)) < 2:
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(n_features) * bins
    margin = np.full(n, base)
    for t in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        groups = {0: np.arange(n)}
        for _ in range(depth):
            below: dict[int, np.ndarray] = {}
            for node, rows in groups.items():
                cells = flat[rows].ravel()
                hist = lambda w: np.bincount(cells, None if w is None else np.repeat(w[rows], n_features), n_features * bins).reshape(n_features, bins)
                gl, hl, nl = (np.cumsum(hist(w), axis=1)[:, :-1] for w in (grad, hess, None))
                g, h, m = grad[rows].sum(), hess[rows].sum(), len(rows)
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(nl < min_rows) | (m - nl < min_rows)] = -np.inf
                f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[f, b] <= 1e-9:
                    continue
                out.feature[t, node], out.threshold[t, node] = f, cuts[f][b]
                out.left[t, node], out.right[t, node] = 2 * node + 1, 2 * node + 2
                goes = binned[rows, f] <= b
                below[2 * node + 1], below[2 * node + 2] = rows[goes], rows[~goes]
                for child in (2 * node + 1, 2 * node + 2):
                    r = below[child]
                    out.value[t, child] = -rate * grad[r].sum() / (hess[r].sum() + l2)
            groups = below
        at = np.zeros(n, dtype=np.int64)
        for _ in range(depth):
            at = np.where(x[np.arange(n), out.feature[t, at]] <= out.threshold[t, at], out.left[t, at], out.right[t, at])
        margin += out.value[t, at]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, max_rows: int, columns: dict) -> list:
    """(text, label) of at most ``max_rows`` labelled documents outside the held-out fold, the
    ones whose hashed id comes first; repeated or contradicting labels of an id count as its
    largest. The ids taken are bounded by ``max_rows``, so they are broadcast."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    )
    return docs.select(*id_and_text(docs, **columns)).join(F.broadcast(ids), "doc_id")


def fold_of(modulus: int, rest: int):
    """Column function: is an id (as text, by CRC-32) in the fold ``rest``?"""
    return lambda doc_id: F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == rest


HELD_OUT = fold_of(3, 1)


def fit_quality(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out=HELD_OUT, max_rows: int = MAX_ROWS, **columns
) -> Trees:
    sample = labelled_sample(docs, labels, "quality", held_out, max_rows, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            x = feature_matrix(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"]
            )

    # One row per id, whatever the number of documents that have it: the driver gets at most ``max_rows``.
    rows = sample.mapInArrow(run, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["y"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, trees: Trees, held_out=HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``' id and score: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            scores = trees.score(feature_matrix(batch.column("text").cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(*id_and_text(docs, id_col, text_col), held_out(F.col(id_col)).alias("held_out"))
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Empty and null texts have all statistics 0 and are scored like any other. Rows that repeat an id are scored each;
    of a labelled id one row is learned from (the one with the least statistics, in order). Labels that are null
    or neither 0 nor 1, or have no document, are not learned from. Without usable
    labels every score is 0.5. An empty table gives an empty result.
    """
    columns = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    return score_quality(docs, fit_quality(spark, docs, labels, **options), options.get("held_out", HELD_OUT), **columns)


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` predicted 1, with all their columns; the texts are not shuffled."""
    trees = fit_quality(spark, docs, labels, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text_col):
            texts = batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
            good = trees.score(feature_matrix([t or b"" for t in texts])) >= 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
