"""Embedding whitening: principal components of a distributed, exact covariance.

Each entry c of a vector becomes the integer x = floor(256 c).  The fit list is
every distinct x vector once: n vectors with per-dimension sums S.  Spark adds up
n, S and the Gram matrix G = sum x x^T over the fit list in exact integers (each
partition in numpy, the partial sums by dimension pair in Spark), so the centred
covariance V = (n G - S S^T) / n^2 is exact up to its last rounding to doubles.

V has the vectors' dimension d on each side, so the eigen work is on the driver:
Householder reflections make V tridiagonal, Sturm counts bracket the largest
eigenvalues by bisection, and inverse iteration on the tridiagonal matrix, with
Gram-Schmidt against the vectors found before in the same cluster of close
eigenvalues, gives the components, which the reflections carry back.  Each
component's sign puts its entry of largest size (the first such) above zero.
The components are then part of the plan (d * ``COMPONENTS`` numbers) and every
row is projected where it lies.

Defined results: rows whose vector is null or holds a null, NaN or infinite
entry are left out, and so are vectors whose length is not the most common one
(ties: the longer); a fit list of one vector or of equal vectors has no variance
and gives no rows; components whose eigenvalue is not above 1e-12 of the trace are
left out, so there may be fewer than ``COMPONENTS``; repeated rows are each
projected; a null ``vec_id`` stays null; other columns are ignored; an empty table
gives an empty result.  Entries whose x exceeds 2^53 in size lose exactness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import compact

#: Fixed values of the contract: the scale of the integer grid and how many components.
SCALE = 256
COMPONENTS = 4
#: Relative size of an eigenvalue below which it counts as zero.
RANK_TOL = 1e-12


def finite_rows(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows with a whole, finite vector, entries on the integer grid."""
    values = F.col(vector).cast("array<double>")
    whole = values.isNotNull() & F.forall(
        values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    )
    return embeddings.where(whole).select(
        F.col(id_col).alias("vec_id"), F.transform(values, lambda c: F.floor(c * SCALE) + 0).alias("x")
    )


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of one partition: (i, j, value) for G (i <= j), (i, -1) for S
    and (-1, -1) for the count; values as decimal text, exact."""
    gram, sums, count = None, None, 0
    for batch in batches:
        if batch.empty:
            continue
        x = np.stack(batch["x"].to_numpy()).astype(np.int64)
        top = int(np.abs(x).max()) if x.size else 0
        # Rows per product so that no int64 sum can overflow.
        step = max(1, (1 << 62) // max(1, top * top * x.shape[1]))
        for start in range(0, len(x), step):
            part = x[start : start + step]
            g = (part.T @ part).astype(object)
            s = part.sum(axis=0, dtype=np.int64).astype(object)
            gram = g if gram is None else gram + g
            sums = s if sums is None else sums + s
        count += len(x)
    if gram is None:
        return
    d = gram.shape[0]
    i, j = np.triu_indices(d)
    rows = [pd.DataFrame({"i": i, "j": j, "v": [str(v) for v in gram[i, j]]})]
    rows.append(pd.DataFrame({"i": np.arange(d), "j": -1, "v": [str(v) for v in sums]}))
    rows.append(pd.DataFrame({"i": [-1], "j": [-1], "v": [str(count)]}))
    yield pd.concat(rows, ignore_index=True)


@dataclass(frozen=True)
class Moments:
    n: int
    sums: list[int]
    gram: list[list[int]]

    def covariance(self) -> np.ndarray:
        """(n G - S S^T) / n^2, from exact integers."""
        n, d = self.n, len(self.sums)
        out = np.empty((d, d))
        for a in range(d):
            for b in range(a, d):
                value = (n * self.gram[a][b] - self.sums[a] * self.sums[b]) / (n * n)
                out[a, b] = out[b, a] = value
        return out


def moments(fit: DataFrame, d: int) -> Moments:
    """n, S and G of the fit list (column ``x``), summed by Spark by dimension pair."""
    parts = fit.select("x").mapInPandas(_gram, "i int, j int, v string")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    n, sums, gram = 0, [0] * d, [[0] * d for _ in range(d)]
    for row in summed:
        value = int(row.v)
        if row.i < 0:
            n = value
        elif row.j < 0:
            sums[row.i] = value
        else:
            gram[row.i][row.j] = gram[row.j][row.i] = value
    return Moments(n, sums, gram)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections: a = q t q^T with t tridiagonal; returns its
    diagonal, its off-diagonal and q."""
    t = np.array(a, dtype=float)
    d = len(t)
    q = np.eye(d)
    for k in range(d - 2):
        x = t[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0.0:
            continue
        alpha = -norm if x[0] >= 0 else norm
        v = x.copy()
        v[0] -= alpha
        length = np.linalg.norm(v)
        if length == 0.0:
            continue
        v /= length
        t[k + 1 :, :] -= 2.0 * np.outer(v, v @ t[k + 1 :, :])
        t[:, k + 1 :] -= 2.0 * np.outer(t[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(t).copy(), np.diag(t, 1).copy(), q


def count_below(diag: np.ndarray, off: np.ndarray, x: float) -> int:
    """Sturm count: eigenvalues of the tridiagonal matrix below ``x``."""
    tiny = np.finfo(float).tiny
    count, pivot = 0, diag[0] - x
    if pivot < 0:
        count += 1
    for i in range(1, len(diag)):
        pivot = diag[i] - x - off[i - 1] ** 2 / (pivot if pivot != 0 else tiny)
        if pivot < 0:
            count += 1
    return count


def largest_eigenvalues(diag: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The ``k`` largest eigenvalues, by bisection on Sturm counts."""
    d = len(diag)
    radius = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = float(np.min(diag - radius)), float(np.max(diag + radius))
    values = []
    for j in range(1, min(k, d) + 1):
        lo, hi = low, high  # the j-th largest is the (d - j + 1)-th smallest
        for _ in range(200):
            mid = 0.5 * (lo + hi)
            if mid in (lo, hi):
                break
            if count_below(diag, off, mid) >= d - j + 1:
                hi = mid
            else:
                lo = mid
        values.append(0.5 * (lo + hi))
    return values


def eigenvectors(diag: np.ndarray, off: np.ndarray, values: list[float], cluster: float) -> list[np.ndarray]:
    """Inverse iteration on the tridiagonal matrix; vectors of eigenvalues closer
    than ``cluster`` are made orthogonal to those found before them."""
    d = len(diag)
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    scale = max(float(np.abs(t).max()), np.finfo(float).tiny)
    found: list[tuple[float, np.ndarray]] = []
    rng = np.random.default_rng(0)
    for value in values:
        shift = value + scale * 1e-14
        y = rng.standard_normal(d)
        near = [v for w, v in found if abs(w - value) <= cluster]
        for _ in range(8):
            try:
                y = np.linalg.solve(t - shift * np.eye(d), y)
            except np.linalg.LinAlgError:
                shift += scale * 1e-12
                continue
            for v in near:
                y -= (v @ y) * v
            y /= np.linalg.norm(y)
        found.append((value, y))
    return [v for _, v in found]


def components(cov: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (rows) of ``cov``, at most ``k``,
    only those above ``RANK_TOL`` of the trace; signs fixed."""
    trace = float(np.trace(cov))
    if trace <= 0:
        return np.zeros(0), np.zeros((0, len(cov)))
    if len(cov) == 1:
        return np.array([trace]), np.ones((1, 1))
    diag, off, q = tridiagonal(cov)
    values = [v for v in largest_eigenvalues(diag, off, k) if v > RANK_TOL * trace]
    vectors = [q @ y for y in eigenvectors(diag, off, values, cluster=1e-8 * trace)]
    fixed = []
    for v in vectors:
        v = v / np.linalg.norm(v)
        fixed.append(v if v[int(np.argmax(np.abs(v)))] > 0 else -v)
    return np.array(values), np.array(fixed).reshape(len(values), len(cov))


def _dot(x: Column, mean: np.ndarray, axis: np.ndarray) -> Column:
    """(x - mean) . axis, with both numbers part of the plan."""
    centred = F.zip_with(x, F.array(*[F.lit(float(m)) for m in mean]), lambda xi, mi: xi - mi)
    terms = F.zip_with(centred, F.array(*[F.lit(float(a)) for a in axis]), lambda ci, ai: ci * ai)
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error)
    for every kept row and component."""
    rows = finite_rows(embeddings, id_col, vector)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths.d == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    d = int(lengths.d)
    rows = rows.where(F.size("x") == d)
    fit = compact(rows.select("x").distinct(), "whitening-fit")
    m = moments(fit.table, d)
    values, axes = components(m.covariance(), k)
    if len(values) == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    mean = np.array([s / m.n for s in m.sums])
    trace = float(np.trace(m.covariance()))
    white = [(_dot(F.col("x"), mean, axes[c]) / float(np.sqrt(values[c]))).alias(f"w{c}") for c in range(len(values))]

    # The covariance of the whitened fit list, against the identity.
    projected = fit.table.select(*white)
    sums = [F.sum(f"w{a}").alias(f"s{a}") for a in range(len(values))]
    products = [
        F.sum(F.col(f"w{a}") * F.col(f"w{b}")).alias(f"p{a}_{b}") for a in range(len(values)) for b in range(a, len(values))
    ]
    got = projected.agg(*sums, *products).first()
    error = 0.0
    for a in range(len(values)):
        for b in range(a, len(values)):
            cov_ab = got[f"p{a}_{b}"] / m.n - (got[f"s{a}"] / m.n) * (got[f"s{b}"] / m.n)
            error = max(error, abs(cov_ab - (1.0 if a == b else 0.0)))

    sums_lit = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in m.sums])
    deviation = F.aggregate(
        F.zip_with(F.col("x"), sums_lit, lambda xi, si: (xi.cast("decimal(38,0)") * F.lit(m.n) - si) * (xi.cast("decimal(38,0)") * F.lit(m.n) - si)),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, t: acc + t,
    )
    per_component = F.array(
        *[
            F.struct(F.lit(c + 1).alias("component"), white[c].alias("whitened"), F.lit(float(values[c] / trace)).alias("explained"))
            for c in range(len(values))
        ]
    )
    return rows.select(
        "vec_id", deviation.cast("long").alias("deviation"), F.explode(per_component).alias("c")
    ).select(
        "vec_id",
        F.col("c.component").cast("int").alias("component"),
        F.lit(m.n).cast("long").alias("n"),
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
