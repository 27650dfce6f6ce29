"""Embedding whitening: against numpy's own eigen solver, and on odd input."""

from __future__ import annotations

import math

import numpy as np
import pytest

from textrisk.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def _brute(vectors):
    """Components, n and deviations from the contract, with numpy's eigh."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=float)
    fit = np.unique(x, axis=0)
    n = len(fit)
    sums = fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    return n, sums, values[order], axes[:, order].T, np.trace(cov), x


def _check(spark, vectors, got):
    n, sums, values, axes, trace, x = _brute(vectors)
    k = min(whitening.COMPONENTS, len(values))
    assert {r.component for r in got} == set(range(1, k + 1))
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    for i, row in enumerate(x):
        mine = by_row[i]
        dev = sum(int(n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))
        for c in range(1, k + 1):
            r = mine[c]
            assert r.n == n and r.deviation == dev
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-6)
            expected = (row - sums / n) @ axes[c - 1] / math.sqrt(values[c - 1])
            assert abs(r.whitened) == pytest.approx(abs(expected), rel=1e-6, abs=1e-9)
            assert r.identity_error <= 1e-4


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    scale = np.array([1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02])
    vectors = (rng.standard_normal((200, 8)) * scale).astype(np.float32)
    vectors[10] = vectors[11]  # a copy counts once in the fit list but is projected twice
    got = whitening.whiten(_frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])).collect()
    assert len(got) == 200 * 4
    _check(spark, vectors.tolist(), got)
    # Components are unit vectors of V: the whitened fit list has the identity as covariance.
    assert max(r.identity_error for r in got) < 1e-9


def test_close_eigenvalues_give_orthogonal_components(spark):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    vectors = (rng.standard_normal((400, 6)) @ q).astype(np.float32) * 0.5
    got = whitening.whiten(_frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)])).collect()
    assert max(r.identity_error for r in got) <= 1e-4


def test_tridiagonal_pieces():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((7, 7))
    a = a @ a.T
    diag, off, q = whitening.tridiagonal(a)
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(q @ t @ q.T, a) and np.allclose(q.T @ q, np.eye(7))
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    assert np.allclose(whitening.largest_eigenvalues(diag, off, 7), want, rtol=1e-12)
    assert whitening.count_below(diag, off, float(want[2] + want[3]) / 2) == 4


def test_whitening_odd_rows(spark):
    rows = [
        (0, [0.5, 0.25, 0.0], 1),
        (1, [0.1, -0.3, 0.2], 1),
        (2, None, 1),
        (3, [0.1, None, 0.2], 1),
        (4, [float("nan"), 0.1, 0.1], 1),
        (5, [float("inf"), 0.1, 0.1], 1),
        (6, [0.3, 0.3], 1),
        (None, [0.2, 0.9, -0.4], 1),
        (7, [0.5, 0.25, 0.0], 1),
        (8, [-0.7, 0.1, 0.6], 1),
    ]
    df = _frame(spark, rows).selectExpr("*", "1 as x", "2 as component", "3 as n")
    got = whitening.whiten(df).collect()
    kept = {r.vec_id for r in got}
    assert kept == {0, 1, None, 7, 8}
    assert len(got) == 5 * 3 and all(r.n == 4 for r in got)  # rows 0 and 7 are one vector of the fit list
    assert whitening.whiten(df.limit(0)).count() == 0
    one = _frame(spark, [(1, [0.1, 0.2], 0), (2, [0.1, 0.2], 0)])
    assert whitening.whiten(one).count() == 0  # no variance, no component
