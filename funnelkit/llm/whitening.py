"""Operator 11: embedding whitening with FEAST contour integration.

Spark does what grows with the table: it quantises, takes each distinct vector once (the fit
list), sums it per dimension, sums centred products per pair of dimensions, and projects
every row. What is left for the driver is one covariance matrix, whose size depends on
the embedding's length alone.

FEAST finds the leading eigenpairs of that matrix V interval by interval. The number of
eigenvalues above a shift is the number of positive pivots of V - shift (its inertia), so the axis
is cut into intervals that hold a few eigenvalues each, from the top down, until enough are in.
For an interval the projector on its eigenvectors is a contour integral of the resolvent
(z - V)^-1 around it; trapezoidal nodes on a circle make it a sum of complex shifted solves, applied
to a block of vectors. Rayleigh-Ritz on the filtered block gives the pairs, and filtering goes on
until their residuals are at rounding level and as many lie in the interval as the
inertia counts say; otherwise the block grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import materialize

COMPONENTS = 4
SCALE = 256
NODES = 8  # solves per filter step: half a circle, the other half is its mirror image
PER_INTERVAL = 8  # an interval with more eigenvalues is cut further
STEPS = 12  # filter steps before the block grows

_BUNCH_PARLETT = (1 + 17**0.5) / 8  # pivot threshold with the least growth


def positive_pivots(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the signs of the pivots of its
    symmetric elimination (blocks of two where no diagonal entry is large enough)."""
    a = a.copy()
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a) - np.diag(diagonal)
        p, q = divmod(int(off.argmax()), len(a))
        if diagonal[i] == 0 and off[p, q] == 0:
            break
        taken = [i] if diagonal[i] >= _BUNCH_PARLETT * off[p, q] else [p, q]
        rest = np.setdiff1d(np.arange(len(a)), taken)
        pivot = a[np.ix_(taken, taken)]
        positive += 1 if len(taken) == 2 else int(pivot[0, 0] > 0)  # a block of two has one of each sign
        side = a[np.ix_(rest, taken)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return positive


def count_above(v: np.ndarray, shift: float) -> int:
    return positive_pivots(v - shift * np.eye(len(v)))


def top_intervals(v: np.ndarray, k: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) from the top down that hold the k largest."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    gap = 1e-10 * top  # no cut closer than this to an eigenvalue
    found: list[tuple[float, float, int]] = []
    stack = [(-top, top, len(v), 0)]
    while stack and sum(c for *_, c in found) < k:
        low, high, over_low, over_high = stack.pop()
        count = over_low - over_high
        if not count:
            continue
        cut = None
        if count > per_interval and high - low > 64 * gap:
            for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65):
                at = low + share * (high - low)
                over = count_above(v, at - gap)
                if over == count_above(v, at + gap):
                    cut = at, over
                    break
        if cut is None:
            found.append((low, high, count))
        else:
            at, over = cut
            stack += [(low, at, over_low, over), (at, high, over, over_high)]
    return found


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high) and their unit eigenvectors, as columns."""
    d = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(1j * np.pi * (np.arange(nodes) + 0.5) / nodes)
    scale = float(np.abs(v).sum(axis=1).max())
    size = min(d, 2 * count + 4)
    while True:
        block = np.random.default_rng(size).standard_normal((d, size))
        for _ in range(STEPS):
            filtered = np.zeros((d, size))
            for turn in turns:
                filtered += (radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(d) - v, block)).real / nodes
            basis, _ = np.linalg.qr(filtered)
            values, small = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ small
            inside = np.flatnonzero((values > low) & (values < high))
            residual = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if len(inside) == count and (size == d or residual.max(initial=0) <= 4e-15 * scale * d**0.5):
                return values[inside], block[:, inside]
        if size == d:
            raise ArithmeticError(f"{len(inside)} of {count} eigenvalues found between {low} and {high}")
        size = min(d, 2 * size)


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns, each with
    its largest entry positive."""
    k = min(k, len(v))
    if not np.abs(v).max(initial=0) > 0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    found = [feast(v, *interval) for interval in top_intervals(v, k)]
    values = np.concatenate([x for x, _ in found])
    vectors = np.concatenate([x for _, x in found], axis=1)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return values[order], vectors


@dataclass(frozen=True)
class Whitening:
    """The transform for vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: list[float | None]
    error: float | None = None


def centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional part of the mean."""
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x - mean; the whole parts are taken off as integers where that cannot overflow."""
    if np.abs(x.astype(np.float64)).max(initial=0) < 2.0**61 and np.abs(whole.astype(np.float64)).max(initial=0) < 2.0**61:
        return (x - whole).astype(np.float64) - part
    return x.astype(np.float64) - (whole.astype(np.float64) + part)


def project(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened coordinates, NaN for components without spread."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(w.values > 0, 1 / np.sqrt(w.values), np.nan)
    return (centred(x, *centre(w.sums, w.n)) @ w.vectors) * scale


def deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    largest = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * w.n, max((abs(s) for s in w.sums), default=0))
    if (2 * largest) ** 2 * x.shape[1] < 2.0**62:
        y = x * w.n - np.array(w.sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((w.n * a - s) ** 2 for a, s in zip(row, w.sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in the column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        part = column if len(at) == len(lengths) else column.take(pa.array(at))
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), length)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dims, i, n, high, low: per dimension the task's sum as high * 2^32 + low."""
    totals: dict[int, list] = {}
    for batch in batches:
        for at, x in by_length(batch.column(0)):
            t = totals.setdefault(x.shape[1], [0, 0, 0])
            t[0] += len(at)
            t[1] = t[1] + (x >> 32).sum(axis=0)
            t[2] = t[2] + (x & 0xFFFFFFFF).sum(axis=0)
    for d, (n, high, low) in totals.items():
        whole = [pa.array(np.full(d, c, dtype=np.int64)) for c in (d, n)]
        yield pa.RecordBatch.from_arrays(
            [whole[0], pa.array(np.arange(d, dtype=np.int64)), whole[1], pa.array(high), pa.array(low)], names=["dims", "i", "n", "high", "low"]
        )


def _entries(dims: int, product: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(product))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(i), dims, dtype=np.int64)), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(product[i, j])],
        names=["dims", "i", "j", "v"],
    )


def product_sums(fit: DataFrame, centred_rows) -> dict[int, np.ndarray]:
    """Sum over the fit list of z z', z = ``centred_rows(x)``, by vector length. A task sends one value
    per pair of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                z = centred_rows(x)
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + z.T @ z
        for dims, product in totals.items():
            yield _entries(dims, product)

    rows = fit.mapInArrow(run, "dims long, i long, j long, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for dims, part in rows.groupby("dims"):
        product = np.zeros((part["i"].max() + 1,) * 2)
        product[part["i"], part["j"]] = product[part["j"], part["i"]] = part["v"]
        out[int(dims)] = product
    return out


def fit_whitening(fit: DataFrame, k: int = COMPONENTS) -> dict[int, Whitening]:
    """Transforms by vector length, fitted on every row of ``fit`` (one column of long arrays)."""
    sums: dict[int, list[tuple[int, int, int]]] = {}
    exact = fit.mapInArrow(_sums, "dims long, i long, n long, high long, low long").groupBy("dims", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
    )
    for r in exact.collect():
        sums.setdefault(r.dims, []).append((r.i, r.n, int(r.high) * (1 << 32) + int(r.low)))
    means = {d: (rows[0][1], [s for _, _, s in sorted(rows)]) for d, rows in sums.items()}
    centres = {d: centre(s, n) for d, (n, s) in means.items()}
    models = {}
    for d, product in product_sums(fit, lambda x: centred(x, *centres[x.shape[1]])).items():
        n, s = means[d]
        v = product / n
        values, vectors = leading_pairs(v, k)
        trace = float(np.trace(v))
        values = np.where(values > len(v) * np.finfo(float).eps * trace, values, 0.0)  # rounding is no spread
        models[d] = Whitening(n, s, values, vectors, [e / trace if trace > 0 else None for e in values.tolist()])
    # The covariance of the whitened fit list; its mean is zero up to rounding, and taken off.
    checks = product_sums(fit, lambda x: np.column_stack([np.nan_to_num(project(x, models[x.shape[1]])), np.ones(len(x))]))
    for d, m in models.items():
        covariance = checks[d] / m.n
        live = np.flatnonzero(m.values > 0)
        mean = covariance[live, -1]
        off = covariance[np.ix_(live, live)] - np.outer(mean, mean) - np.eye(len(live))
        models[d] = Whitening(m.n, m.sums, m.values, m.vectors, m.explained, float(np.abs(off).max()) if len(live) else None)
    return models


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, x: floor(scale * component) as longs, for the rows that take part."""
    whole = F.forall(F.col(vector_col), lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return rows.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def whiten(
    spark: SparkSession, rows: DataFrame, k: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, component (1 to k), n, deviation, whitened, explained, identity_error: k rows per vector.

    Null vectors and ones with null or non-finite components take no part; an empty vector has no
    components and gives no row. Vectors of one length are whitened by themselves, so n and all
    else are those of a row's own length. Null and repeated ids stay as they are; a repeated
    vector counts once in the fit and is returned as often as it occurs. Vectors shorter than
    k have as many components as entries. A component without spread (all vectors agree in it) has
    explained 0 and whitened null; explained is null where nothing varies at all, and
    identity_error where no component has spread. Components whose scaled value does not fit 64 bits count as
    the largest or smallest long; a deviation beyond 64 bits is null. Other columns are not read.
    An empty table gives an empty result.
    """
    usable = quantised(rows, id_col, vector_col, scale)
    fit = materialize(spark, usable.select("x").distinct(), "fit")
    models = spark.sparkContext.broadcast(fit_whitening(fit, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, x in by_length(batch.column(1)):
                w = models.value[x.shape[1]]
                c, rows_of = len(w.values), np.repeat(at, len(w.values))
                values = project(x, w).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows_of)),
                        pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(rows_of), w.n, dtype=np.int64)),
                        pa.array(deviations(x, w), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), c))),
                        pa.array(values, mask=np.isnan(values)),
                        pa.array(w.explained * len(at), pa.float64()),
                        pa.array([w.error] * len(rows_of), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return usable.mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
