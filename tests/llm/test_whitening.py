"""Whitening against whole numbers of any size, numpy's eigenvalues and graded matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from anisoframe.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """(n, S, covariance as fractions, deviations) of lists of doubles, in Python's whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    centred = [[n * r[k] - s[k] for k in range(d)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in centred), n**3) for j in range(d)] for i in range(d)]
    return n, s, cov, [sum(v * v for v in r) for r in centred]


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = {r.vec_id: list(map(float, r.embedding)) for r in rows}
    n, s, cov, deviations = brute(list(want.values()))
    got = queries.op13_whitening(spark, SF).collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    assert all(by[i, 1].deviation == x for i, x in zip(want, deviations))
    v = np.array(cov, float)
    values = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose([by[rows[0].vec_id, k].explained for k in range(1, 33)], values[:32] / np.trace(v), rtol=1e-9)
    w = np.array([[by[i, k].whitened for k in range(1, 33)] for i in want])
    w = w - w.mean(axis=0)
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    # Projections on unit eigenvectors: whitened times the root of the eigenvalue has the eigenvalue as variance and V's span.
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in e] for e in want.values()]) - np.array([float(Fraction(t, n)) for t in s])
    axes = np.linalg.lstsq(x, w * np.sqrt(values[:32]), rcond=None)[0]
    assert np.allclose(axes.T @ axes, np.eye(32), atol=1e-8) and np.allclose(v @ axes, axes * values[:32], atol=1e-6 * values[0])


def test_small_eigenvalues_are_accurate():
    """A graded matrix: eigenvalues over 24 powers of ten, each to twelve digits, which numpy's solver misses."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    scale = np.array([1e12, 1e8, 1e3, 1.0])
    core = np.array([[2, 0.5, 0.25, 0.5], [0.5, 2, 0.5, 0.25], [0.25, 0.5, 2, 0.5], [0.5, 0.25, 0.5, 2]])
    m = core * np.outer(scale, scale)
    values, axes = whitening.jacobi(m)
    product = Decimal(1)
    for v in values:
        product *= Decimal(float(v))
    exact = Decimal(float(np.linalg.det(core))) * Decimal(10) ** 46
    assert abs(product / exact - 1) < Decimal("1e-12")
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-14) and (np.diff(values) < 0).all()
    assert abs(values[-1] / (float(np.linalg.det(core)) / float(np.linalg.det(core[:3, :3]))) - 1) < 1e-6


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 16])
def test_jacobi_sizes(n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n + 2))
    m = b @ b.T
    values, axes = whitening.jacobi(m)
    assert np.allclose(np.sort(values), np.linalg.eigvalsh(m) if n else [], rtol=1e-10)
    assert np.allclose((axes * values) @ axes.T, m, atol=1e-10)


def test_exact_scatter_of_any_size():
    rng = np.random.default_rng(5)
    for bits in (3, 19, 20, 21, 39, 45, 62):
        x = rng.integers(-(1 << bits), 1 << bits, size=(9000 if bits == 20 else 50, 3))
        o = x.astype(object)
        assert (whitening.exact_scatter(x) == o.T @ o).all(), bits


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, 7.0]), (1, [0.5, 1.0, 7.0]), (None, [-0.25, 2.0, 7.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 2.0]),
        (7, [inf, 1.0, 2.0]), (8, [1.0]), (9, [3.0, -4.0, 7.0]), (10, [1e300, 0.0, 0.0]), (11, [40000.015, 1.0, 7.0]),
    ]
    docs = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "n long, embedding array<double>, component int, whitened double")
    got = whitening.whiten(docs, "n").collect()
    kept = [v for i, v in rows if v and len(v) == 3 and all(c is not None and abs(c) < 1e200 for c in v)]
    n, _, cov, deviations = brute(kept)
    assert len(got) == 3 * n == 15 and sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    assert {r.n for r in got if r.n is not None} == {1, 9, 11} and {r["n_"] for r in got} == {n}
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component == 3)  # the third dimension is the same everywhere
    assert got[0].identity_error < 1e-9
    one = sorted((r.component, r.whitened) for r in got if r.n == 1)
    assert one[0] == one[1] and one[2] == one[3]


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [None])]):
        docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        out = whitening.whiten(docs)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []
    alone = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]


def test_deviation_beyond_long(spark):
    rows = [(i, [1e12 * i, 0.0]) for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    want = brute([v for _, v in rows])[3]
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id)] == [w if w < 1 << 63 else None for w in want]
