"""Embedding whitening against numpy's eigenvectors and exact integer arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelkit.llm import whitening as W

SF = "/root/testdata/sf0.001"


def _spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


SPECTRA = [
    np.linspace(900, 1100, 62).tolist() + [1665.0, 1704.0],
    [5.0, 5.0, 5.0, 5.0, 5.0, 1.0, 0.0, 0.0],
    [7.0] * 30,
    [1e-9, 1.0, 1.0 + 1e-7, 1e6],
    [3.0] + [0.0] * 19,
    [2.0],
    [4.0, 4.0, 0.0],
]


@pytest.mark.parametrize("values", SPECTRA)
def test_pivots_count_eigenvalues(values):
    v = _spectrum(values)
    for shift in (-1.0, 0.5, 950.3, 1000.7, 1700.0, 6.0, 1e7):
        assert W.count_above(v, shift) == sum(x > shift for x in values)


def test_pivots_of_a_zero_diagonal():
    assert W.positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert W.positive_pivots(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", SPECTRA)
def test_feast_finds_the_leading_pairs(values):
    v = _spectrum(values, 3)
    found, vectors = W.leading_pairs(v, 4)
    k = min(4, len(values))
    assert np.allclose(found, sorted(values, reverse=True)[:k], rtol=1e-12, atol=1e-12 * max(values))
    assert np.allclose(v @ vectors, vectors * found, atol=1e-12 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-9)


def test_intervals_hold_what_they_say():
    v = _spectrum(SPECTRA[0], 5)
    intervals = W.top_intervals(v, 4, per_interval=3)
    assert len(intervals) > 1 and sum(c for *_, c in intervals) >= 4
    for low, high, count in intervals:
        assert sum(low < x < high for x in SPECTRA[0]) == count


def _brute(vectors, k=4):
    x = np.floor(256 * np.array(vectors, dtype=np.float32).astype(np.float64))
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, ((x - s / n) @ u) / np.sqrt(e), e / np.trace(v)


def _check(out, ids, vectors):
    n, deviation, whitened, explained = _brute(vectors)
    k = whitened.shape[1]
    got = {(r.vec_id, r.component): r for r in out}
    assert len(got) == len(out) == len(ids) * k
    signs = np.array([np.sign(got[ids[0], c + 1].whitened * whitened[0, c]) for c in range(k)])
    for i, vec_id in enumerate(ids):
        for c in range(k):
            r = got[vec_id, c + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert abs(r.whitened - signs[c] * whitened[i, c]) < 1e-9 and abs(r.explained / explained[c] - 1) < 1e-9
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


def test_whole_table_matches_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in rows.collect()]
    _check(W.whiten(spark, rows.repartition(3)).collect(), [i for i, _ in table], [v for _, v in table])


SCHEMA = "vec_id bigint, embedding array<float>, x string, n string, component int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", None, 1) for i, v in rows], SCHEMA).repartition(3)


def test_repeats_and_unusable_rows(spark):
    r = np.random.default_rng(1)
    good = [(i, r.standard_normal(6).astype(np.float32).tolist()) for i in range(40)]
    good += [(100 + i, good[0][1]) for i in range(30)]  # one vector with a third of the rows counts once in the fit
    bad = [(200, None), (201, [1.0] * 5 + [None]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [])]
    out = W.whiten(spark, _frame(spark, good + bad)).collect()
    _check(out, [i for i, _ in good], [v for _, v in good])
    nameless = W.whiten(spark, _frame(spark, [(None, v) for _, v in good])).collect()
    assert len(nameless) == len(good) * 4 and {x.vec_id for x in nameless} == {None}


def test_degenerate_tables(spark):
    assert W.whiten(spark, _frame(spark, [])).collect() == []
    same = W.whiten(spark, _frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(same)] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    line = W.whiten(spark, _frame(spark, [(i, [float(i), 1.0, 2.0]) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 12)) for r in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    mixed = W.whiten(spark, _frame(spark, [(i, [float(i)] * (1 + i % 2)) for i in range(10)])).collect()
    assert {r.n for r in mixed} == {5}


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**40 + i), float(-(2**62)), 3.0]) for i in range(4)]
    out = W.whiten(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    x = [[(2**40 + i) * 256, -(2**63), 768] for i in range(4)]  # beyond 64 bits: the smallest long
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - b) ** 2 for a, b in zip(x[i], s)) for i in range(4)}
    assert {r.vec_id: r.deviation for r in out} == want
    wide = W.whiten(spark, spark.createDataFrame([(1, [1e30]), (2, [-1e30])], "vec_id bigint, embedding array<double>")).collect()
    assert {r.deviation for r in wide} == {None}
