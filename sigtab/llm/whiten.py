"""Embedding whitening: eigenvectors of an exact distributed covariance, refined from single precision by matrix products."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common

#: Scaled entries saturate here, so that sums of a batch fit 64 bits and sums of squares 38 decimal digits.
LARGEST = 1 << 48


# Matrices of about 32 digits: pairs of float64 arrays (high, low) whose sum is meant.

def _two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _add(x, y):
    s, e = _two_sum(x[0], y[0])
    return _two_sum(s, e + x[1] + y[1])


def _slices(x, axis: int, bits: int, count: int) -> list[np.ndarray]:
    """Cut (high, low) into addends of at most ``bits`` bits below the largest entry of each row (axis 1) or column (axis 0)."""
    out, (high, low) = [], x
    for _ in range(count):
        top = np.abs(high).max(axis=axis, keepdims=True)
        anchor = np.where(top > 0, np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 53 - bits), 0.0)
        piece = (high + anchor) - anchor
        out.append(piece)
        high, low = _two_sum(high - piece, low)
    return out


def multiply(x, y):
    """The product of two pairs: all products of slices are free of rounding in float64, their sum is kept as a pair."""
    inner = x[0].shape[1]
    bits = int((53 - np.ceil(np.log2(max(2, inner)))) // 2)
    count = -(-106 // bits) + 1
    left, right = _slices(x, 1, bits, count), _slices(y, 0, bits, count)
    total = (np.zeros((x[0].shape[0], y[0].shape[1])), np.zeros((x[0].shape[0], y[0].shape[1])))
    for rank in reversed(range(count)):  # small ones first
        for i in range(rank + 1):
            total = _add(total, (left[i] @ right[rank - i], 0.0))
    return total


def _turned(x):
    return x[0].T, x[1].T


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of values that lie at most ``apart`` from a neighbour, in groups of two and more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigen(matrix) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric pair (high, low), to double precision.

    Starts with the vectors of the float32 matrix. Ogita-Aishima steps correct them: with R = I - X'X and S = X'AX the correction is
    E[i, j] = (S[i, j] + l[j] R[i, j]) / (l[j] - l[i]), and R[i, j] / 2 where the step cannot tell two eigenvalues apart. Vectors of such
    a cluster are turned by the eigenvectors of their own block, less its mean, which shows differences that the whole hides.
    Steps repeat while the correction falls. Each vector's largest entry is positive.
    """
    size = matrix[0].shape[0]
    top = float(np.abs(matrix[0]).max(initial=0.0))
    if not size or not top:
        return np.zeros(size), np.eye(size)
    scale = float(np.exp2(np.ceil(np.log2(top))))  # a power of two divides without rounding
    a = (matrix[0] / scale, matrix[1] / scale)
    x = (np.linalg.eigh(a[0].astype(np.float32))[1].astype(np.float64), np.zeros((size, size)))
    unit, best, kept = (np.eye(size), np.zeros((size, size))), np.inf, None
    while True:
        ax = multiply(a, x)
        s, g = multiply(_turned(x), ax), multiply(_turned(x), x)
        r = np.add(*_add(unit, (-g[0], -g[1])))
        values = np.diag(s[0]) / (1 - np.diag(r))
        off = np.add(*s) - np.diag(np.diag(np.add(*s)))
        apart = 64 * (np.linalg.norm(off) + np.abs(values).max() * np.linalg.norm(r))  # a pair further apart turns by under 1/64
        error = np.linalg.norm(off) + np.linalg.norm(r)
        if not error <= best / 2 or not error:  # no further gain
            x = x if error <= best else kept
            break
        best, kept = error, x
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > apart
        e = np.where(far, (np.add(*s) + values[None, :] * r) / np.where(far, gap, 1.0), r / 2)
        e[np.diag_indices(size)] = np.diag(r) / 2
        x = _add(x, multiply(x, (e, np.zeros_like(e))))
        for group in _clusters(values, apart):
            own = (x[0][:, group], x[1][:, group])
            block = multiply(_turned(own), multiply(a, own))
            mean, within = float(np.diag(block[0]).mean()), multiply(_turned(own), own)
            shifted = np.add(*_add(block, multiply((-mean * np.eye(len(group)), np.zeros((len(group),) * 2)), within)))
            turn = np.linalg.eigh((shifted + shifted.T) / 2)[1]
            turn = turn @ (1.5 * np.eye(len(group)) - 0.5 * turn.T @ turn)
            own = multiply(own, (turn, np.zeros_like(turn)))
            x[0][:, group], x[1][:, group] = own
    ax = multiply(a, x)
    values = np.diag(np.add(*multiply(_turned(x), ax))) / np.diag(np.add(*multiply(_turned(x), x)))
    order = np.argsort(-values, kind="stable")
    vectors = x[0][:, order]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0) < 0, -1.0, 1.0)
    return values[order] * scale, vectors


# The distributed part.

def scaled(vectors: DataFrame, vector: str, key: str, scale: int, shift: int) -> DataFrame:
    """key and x (array<long>): floor(scale * c) + shift of each entry, of vectors without null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))

    def one(c: Column) -> Column:
        far = F.least(F.lit(float(LARGEST)), F.greatest(F.lit(-float(LARGEST)), F.floor(c.cast("double") * scale).cast("double")))
        return far.cast("long") + shift

    return kept.select(F.col(key).alias("key"), F.transform(vector, one).alias("x"))


def _matrix(batch, name: str, size: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exact: through float64 where no sum can exceed 2^53, else with whole Python numbers."""
    if not len(y) or float(np.abs(y).max()) ** 2 * len(y) < 2.0**53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(y) > 64:
        half = len(y) // 2
        return _products(y[:half]) + _products(y[half:])
    whole = y.astype(object)
    return whole.T @ whole


@dataclass
class Whitening:
    """What the fit found: n vectors of ``size`` entries, sums S, covariance eigenvalues (falling) and eigenvectors (rows), shares of the trace."""

    n: int
    size: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def fit(x: DataFrame, size: int, most: int = 32, least: float = 1e-20) -> Whitening:
    """Fit on all rows of ``x`` (key, x: arrays of ``size`` longs).

    Sums and products are exact integers: each task adds up its own, Spark adds those up by place. Entries are centred on the whole numbers
    next to their means before they are multiplied, and what is left of the means is taken off exactly. Only d + d(d+1)/2 numbers
    reach the driver, whatever the number of rows. Components of an eigenvalue up to ``least`` times the largest have no variance
    and are left out.
    """
    def sums(batches):
        total, rows = np.zeros(size, object), 0
        for batch in batches:
            total, rows = total + _matrix(batch, "x", size).sum(axis=0).astype(object), rows + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(v) for v in (rows, *total)])], names=["i", "v"])

    def added(parts: DataFrame, *by: str) -> dict:
        return {tuple(r[:-1]): int(r[-1]) for r in parts.groupBy(*by).agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}

    first = added(x.mapInArrow(sums, "i int, v string"), "i")
    n, total = first.get((-1,), 0), [first.get((i,), 0) for i in range(size)]
    if not n or not size:
        return Whitening(0, size, [], np.zeros(0), np.zeros((0, size)), np.zeros(0))
    middle = [(2 * s + n) // (2 * n) for s in total]
    centre = np.array(middle, np.int64)
    at = [(i, j) for i in range(size) for j in range(i, size)]

    def products(batches):
        held = np.zeros((size, size), object)
        for batch in batches:
            held = held + _products(_matrix(batch, "x", size) - centre)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([str(held[i, j]) for i, j in at])], names=["i", "j", "v"])

    second = added(x.mapInArrow(products, "i int, j int, v string"), "i", "j")
    rest = [s - n * m for s, m in zip(total, middle)]
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for i, j in at:
        exact = Fraction(n * second[i, j] - rest[i] * rest[j], n * n)
        high[i, j] = high[j, i] = float(exact)
        low[i, j] = low[j, i] = float(exact - Fraction(float(exact)))
    values, vectors = eigen((high, low))
    trace = float(Fraction(sum(n * second[i, i] - rest[i] ** 2 for i in range(size)), n * n))
    kept = [k for k in range(min(most, size)) if trace > 0 and values[k] > least * values[0]]
    return Whitening(n, size, total, values[kept], vectors[:, kept].T, values[kept] / (trace or 1.0))


def project(x: DataFrame, model: Whitening) -> DataFrame:
    """key, deviation (the exact sum over dimensions of (n*x - S)^2) and w (one whitened number for each component)."""
    n, size, middle = model.n, model.size, [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    centre, rest = np.array(middle, np.int64), [s - model.n * m for s, m in zip(model.sums, middle)]
    past, onto = np.array([r / n for r in rest]), (model.vectors / np.sqrt(model.values)[:, None]).T

    def mapped(batches):
        for batch in batches:
            y = _matrix(batch, "x", size) - centre
            if not len(y):
                continue
            reach = n * int(np.abs(y).max()) + n
            exact = y if reach * reach * size < 2**62 else y.astype(object)
            moved = exact * n - np.array(rest, exact.dtype)
            w = (y - past) @ onto
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([str(v) for v in (moved * moved).sum(axis=1)]), pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))], names=["key", "deviation", "w"])

    return x.mapInArrow(mapped, common.with_columns(x, ["key"], {"deviation": "string", "w": "array<double>"})).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(projected: DataFrame, n: int, count: int) -> float:
    """The largest entry, by absolute value, of the covariance of ``w`` less the identity, over all rows."""
    def sums(batches):
        held = np.zeros((count, count + 1))
        for batch in batches:
            w = _matrix(batch, "w", count)
            held += w.T @ np.column_stack([w, np.ones(len(w))])
        i, j = np.indices(held.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(held.ravel())], names=["i", "j", "v"])

    held = np.zeros((count, count + 1))
    for r in projected.select("w").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        held[r["i"], r["j"]] = r["v"]
    mean = held[:, -1] / n
    return float(np.abs(held[:, :-1] / n - np.outer(mean, mean) - np.eye(count)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", *, scale: int = 64, shift: int = 1_000_000, most: int = 32) -> DataFrame:
    """One row for each remaining row and component: key, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    A vector that is null or holds a null or non-finite entry is left out; so is one whose length is not the most frequent (of equally
    frequent ones the greatest). Each entry c becomes x = floor(scale * c) + shift; scaled entries beyond 2^48 saturate. The fit takes all
    remaining rows, repeated ones as often as they stand; see ``fit`` for components without variance: with fewer than two distinct
    vectors there is no component and no row. ``whitened`` is the projection of x less the mean on a unit eigenvector of the
    covariance, over the root of its eigenvalue; ``deviation`` the sum over dimensions of (n*x - S)^2, exact (null beyond 38 digits);
    ``explained`` the eigenvalue over the trace; ``identity_error`` is measured on the whitened numbers of all rows. Keys may be null or repeat.
    """
    x = scaled(vectors, vector, key, scale, shift)
    lengths = sorted(((r["n"], r["s"]) for r in x.groupBy(F.size("x").alias("s")).agg(F.count("*").alias("n")).where("s > 0").orderBy(F.desc("n"), F.desc("s")).limit(1).collect()))
    size = lengths[0][1] if lengths else 0
    x = x.where(F.size("x") == size)
    model = fit(x, size, most)
    count, kind = len(model.values), vectors.schema[key].dataType
    if not count:
        spark = vectors.sparkSession
        return spark.createDataFrame([], "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").select(F.lit(None).cast(kind).alias(key), "*")
    projected = common.stored(project(x, model), "whitened")
    error = identity_error(projected, model.n, count)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    rows = projected.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
