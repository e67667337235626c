"""Whitening and hard negatives against plain arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.llm import negatives, queries, whiten

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       *[T.StructField(c, T.StringType()) for c in ("key", "x", "row", "group", "score", "w", "rank", "_anchor")]])


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *["y"] * 8) for r in rows], SCHEMA).repartition(parts)


def odd_rows(seed=3, n=400, d=12):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in np.float32(draw.normal(size=d) * 0.2)], int(draw.integers(0, 4))) for i in range(n)]
    hot = rows[7][1]
    rows += [(n + i, hot, int(i % 4)) for i in range(150)]  # a very common vector: ties
    rows += [rows[100], rows[100], rows[7]]  # repeated rows
    rows += [(901, None, 1), (902, [None] + hot[1:], 1), (903, [float("nan")] + hot[1:], 1), (904, [float("inf")] + hot[1:], 1), (905, [-math.inf] + hot[1:], 2), (906, [], 1)]
    return rows


# Double-length matrices and eigenvectors

def pair(m):
    high = np.array([[float(v) for v in r] for r in m])
    return high, np.array([[float(v - Fraction(h)) for v, h in zip(r, g)] for r, g in zip(m, high)])


def test_products_of_pairs_have_32_digits():
    draw = np.random.default_rng(1)
    a = [[Fraction(float(v)) + Fraction(float(w)) / 2**55 for v, w in zip(*draw.normal(size=(2, 17)) * 10.0 ** draw.integers(-3, 3, 17))] for _ in range(6)]
    b = [[Fraction(float(v)) for v in draw.normal(size=5)] for _ in range(17)]
    got = whiten.multiply(pair(a), pair(b))
    for i in range(6):
        for j in range(5):
            exact, size = sum(a[i][k] * b[k][j] for k in range(17)), sum(abs(a[i][k] * b[k][j]) for k in range(17))
            assert abs(Fraction(got[0][i, j]) + Fraction(got[1][i, j]) - exact) <= size / 10**29


def rotation(size, seed=2):
    """A product of exact reflections: an orthogonal matrix of fractions."""
    draw = np.random.default_rng(seed)
    q = [[Fraction(int(i == j)) for j in range(size)] for i in range(size)]
    for _ in range(3):
        v = [Fraction(int(x)) for x in draw.integers(-4, 5, size)]
        v[0] += 1
        norm = sum(x * x for x in v)
        for row in q:
            dot = sum(x * y for x, y in zip(row, v))
            row[:] = [x - 2 * dot * y / norm for x, y in zip(row, v)]
    return q


@pytest.mark.parametrize("values", [
    [Fraction(k) for k in (9, 7, 5, 4, 3, 2, 1, 1)],
    [1 + Fraction(k, 10**6) for k in range(4)] + [2 + Fraction(k, 10**9) for k in range(4)],  # clusters below single precision
    [1 + Fraction(k, 10**14) for k in range(3)] + [Fraction(k) for k in (3, 4, 5, 6, 7)],
    [Fraction(1, 10**k) for k in range(8)],  # graded
])
def test_eigenvectors_to_double_precision(values):
    n = len(values)
    q = rotation(n)
    a = [[sum(q[i][k] * values[k] * q[j][k] for k in range(n)) for j in range(n)] for i in range(n)]
    got, vectors = whiten.eigen(pair(a))
    order = sorted(range(n), key=lambda k: -values[k])
    assert np.allclose(got, [float(values[k]) for k in order], rtol=1e-15, atol=0)
    for at, k in enumerate(order):
        if values.count(values[k]) > 1:
            continue
        want = np.array([float(q[i][k]) for i in range(n)])
        want *= np.sign(want[np.abs(vectors[:, at]).argmax()])
        assert np.abs(vectors[:, at] - want).max() < 4e-16
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 2e-15


# Whitening

def brute_whitening(rows, most=32):
    kept = [(k, v) for k, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    v = [[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n**3)) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(v))
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (k, _), x in zip(kept, xs):
        w = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ u / np.sqrt(e)
        out.setdefault(k, (sum((n * c - s) ** 2 for c, s in zip(x, sums)), w[:most]))
    return n, e, out


def test_whitening(spark):
    rows = odd_rows()
    n, e, want = brute_whitening(rows)
    got = whiten.whiten(table(spark, rows)).toPandas()
    assert len(got) == n * 12 and set(got["component"]) == set(range(1, 13)) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    signs = {}
    for r in got.itertuples():
        deviation, w = want[r.vec_id]
        assert int(r.deviation) == deviation and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
        sign = signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]) if abs(r.whitened) > 1e-3 else None)
        if sign is None:
            del signs[r.component]
            continue
        assert abs(r.whitened - sign * w[r.component - 1]) < 1e-9


def test_whitening_of_odd_tables(spark):
    none, one = table(spark, []), table(spark, [(1, [0.5, 0.25], 1)] * 3)
    for t in (none, one, table(spark, [(1, None, 1), (2, [None], 1)])):
        got = whiten.whiten(t)
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    # the commonest length counts; a direction without variance is no component; a null key stays
    flat = [(k, [float(k), 1.0, -float(k)], 0) for k in range(20)] + [(None, [3.0, 1.0, 2.0], 0), (99, [1.0, 2.0], 0), (98, [], 0)]
    got = whiten.whiten(table(spark, flat)).toPandas()
    assert set(got["component"]) == {1, 2} and len(got) == 42 and got["vec_id"].isna().sum() == 2 and got["identity_error"].max() < 1e-6
    # huge entries are summed exactly; the smaller ones beside them still count
    big = [(k, [float(np.float32(10.0**6 * (k % 7))), float(k % 5)], 0) for k in range(35)]
    got = whiten.whiten(table(spark, big)).toPandas()
    assert set(got["component"]) == {1, 2} and got["identity_error"].max() < 1e-4
    x = [math.floor(64 * np.float32(10.0**6 * (k % 7)).item()) + 1_000_000 for k in range(35)], [64 * (k % 5) + 1_000_000 for k in range(35)]
    for r in got.itertuples():
        assert int(r.deviation) == sum((35 * c[r.vec_id] - sum(c)) ** 2 for c in x)
    assert whiten.whiten(table(spark, [(k, [1e38 * (-1) ** k, float(k)], 0) for k in range(9)])).count() == 9  # saturates; the other direction is below the least share


# Hard negatives

@pytest.mark.parametrize("m,k,n,leaf", [(1, 1, 1, 4), (7, 5, 9, 2), (64, 64, 64, 8), (33, 12, 50, 4), (3, 0, 2, 1)])
def test_strassen_is_exact(m, k, n, leaf):
    draw = np.random.default_rng(m)
    a, b = draw.integers(-(2**40), 2**40, (m, k)), draw.integers(-(2**15), 2**15, (k, n))
    want = [[sum(int(a[i, x]) * int(b[x, j]) for x in range(k)) for j in range(n)] for i in range(m)]
    if leaf > 1 or min(m, k, n):
        assert negatives.strassen(a, b, leaf).tolist() == want


def brute_negatives(rows, is_anchor):
    kept = sorted({(k, label, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for k, v, label in rows if k is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    out = []
    for a in kept:
        if not is_anchor(a[0]):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b is not a))
        for s, pid, _ in [t for t in scored if t[2] == a[1]][:5]:
            fits = [t for t in scored if t[2] != a[1] and -80 * s <= -100 * t[0] <= -100 * s][:5]
            out += [(a[0], pid, rank + 1, nid, -s, -t) for rank, (t, nid, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("held,candidates", [(1 << 21, 2048), (600, 16)])
def test_hard_negatives(spark, monkeypatch, held, candidates):
    monkeypatch.setattr(negatives, "HELD", held)
    monkeypatch.setattr(negatives, "CANDIDATES", candidates)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = odd_rows() + [(None, [0.5] * 12, 1), (907, [0.5] * 12, None), (908, [0.9, 0.9], 1), (5, [0.3] * 12, 2), (400, [0.2] * 12, 3)]
    got = negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda k: k % 20 == 0)


def test_hard_negatives_of_odd_tables(spark):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, None, 1), (0, [], None)], [(0, [], 1), (1, [], 1)]):
        got = negatives.mine(table(spark, rows), F.col("vec_id") == 0)
        assert got.columns == names and got.count() == 0
    assert negatives.mine(table(spark, [(0, [], 1), (1, [], 1), (2, [0.0], 2)]), F.col("vec_id") == 0).count() == 1  # scores of zero
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(table(spark, [(0, [1e30], 1)]), F.col("vec_id") == 0)


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(k, v, (label + 1) % 10 if k % 7 == 0 and label is not None else label) for k, v, label in rows]
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, sf).collect()) == brute_negatives(moved, lambda k: k % 100 == 0)
    n, e, want = brute_whitening(rows)
    got = queries.op11_whitening(spark, sf).toPandas()
    assert len(got) == 32 * n and got["identity_error"].max() < 1e-10
    for r in got[got["vec_id"] % 25 == 0].itertuples():
        assert r.deviation == want[r.vec_id][0] and abs(abs(r.whitened) - abs(want[r.vec_id][1][r.component - 1])) < 1e-8
