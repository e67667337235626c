"""Least squares from sufficient statistics: one aggregate per table, small solves on result rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.functions.numeric import add_all, all_of
from sigtab.plans.layout import with_stats, with_table

MAX_DEGREE = 12


def gram(df: DataFrame, by: list[str], features: list[Column], y: Column, weight: Column | None = None,
         extra: dict[str, Column] | None = None) -> DataFrame:
    """Per series: ``n``, ``xx`` (upper triangle by rows), ``xy``, ``yy`` over rows where all are present."""
    p = len(features)
    names = [f"_g{i}" for i in range(p)]
    rows = df.select("*", *[f.cast("double").alias(n) for f, n in zip(features, names)], y.cast("double").alias("_gy"))
    rows = rows.filter(all_of([F.col(n).isNotNull() for n in names + ["_gy"]]))
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * F.col(names[i]) * F.col(names[j])) for i in range(p) for j in range(i, p)]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*sums).alias("xx"),
        F.array(*[F.sum(w * F.col(n) * F.col("_gy")) for n in names]).alias("xy"),
        F.sum(w * F.col("_gy") * F.col("_gy")).alias("yy"),
        *[v.alias(k) for k, v in (extra or {}).items()],
    )


def unpack(xx, p: int) -> np.ndarray:
    """The symmetric matrix of an upper triangle listed by rows."""
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = xx
    return m + np.triu(m, 1).T


def map_rows(table: DataFrame, by: list[str], fn, fields: list[T.StructField], keep: list[str] = ()) -> DataFrame:
    """Apply ``fn(row) -> tuple`` to each result row; the outcome follows the ``by`` and ``keep`` columns."""
    kept = list(by) + list(keep)
    schema = T.StructType([table.schema[c] for c in kept] + fields)
    names = [f.name for f in fields]

    def run(batches):
        for pdf in batches:
            made = [fn(row) for row in pdf.to_dict("records")]
            out = pdf[kept].reset_index(drop=True)
            for i, name in enumerate(names):
                out[name] = pd.Series([m[i] for m in made], dtype=object)
            yield out

    return table.mapInPandas(run, schema)


def number(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def numbers(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.DoubleType()))


def polynomial_table(df: DataFrame, x: Column, y: Column, degree: int, by: list[str]) -> DataFrame:
    """Per series the least-squares polynomial of ``y`` on ``x``.

    ``x`` is centred and scaled to about [-1, 1] first. Columns: ``n``, ``mid``, ``half``,
    ``scaled`` (coefficients in the scaled variable), ``coefficients`` (in ``x``, constant first),
    ``r_squared``, ``rmse``. A series with too few points gets nulls.
    """
    if not 0 <= degree <= MAX_DEGREE:
        raise ValueError(f"degree must be between 0 and {MAX_DEGREE}")
    rows = df.select(*by, x.alias("_x"), y.alias("_y")).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rows = with_stats(rows, by, {
        "mid": (F.min("_x") + F.max("_x")) / 2, "half": (F.max("_x") - F.min("_x")) / 2, "y0": F.avg("_y")})
    t = (F.col("_x") - F.col("mid")) / F.when(F.col("half") > 0, F.col("half")).otherwise(F.lit(1.0))
    v = F.col("_y") - F.col("y0")
    powers = [F.lit(1.0)]
    for _ in range(2 * degree):
        powers.append(powers[-1] * F.col("_t"))
    sums = rows.withColumns({"_t": t, "_v": v}).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("mid").alias("mid"), F.first("half").alias("half"),
        F.first("y0").alias("y0"), F.array(*[F.sum(p) for p in powers]).alias("_ps"),
        F.array(*[F.sum(p * F.col("_v")) for p in powers[: degree + 1]]).alias("_pq"),
        F.sum(F.col("_v") * F.col("_v")).alias("_pyy"))

    def solve(row):
        n, d = int(row["n"]), degree + 1
        if n < d or (degree and not row["half"] > 0):
            return None, None, None, None
        s, q = np.asarray(row["_ps"]), np.asarray(row["_pq"])
        m = s[np.add.outer(np.arange(d), np.arange(d))]
        c = np.linalg.lstsq(m, q, rcond=None)[0]
        sse = max(0.0, row["_pyy"] - 2 * c @ q + c @ m @ c)
        c = c.copy()
        c[0] += row["y0"]
        half = row["half"] or 1.0
        raw = np.poly1d([0.0])
        step = np.poly1d([1 / half, -row["mid"] / half])
        for value in c[::-1]:
            raw = raw * step + value
        flat = np.zeros(d)
        flat[: len(raw.coeffs)] = raw.coeffs[::-1]
        r2 = 1.0 if row["_pyy"] == 0 else 1 - sse / row["_pyy"]
        return c.tolist(), flat.tolist(), float(r2), float(np.sqrt(sse / n))

    return map_rows(sums, by, solve, [numbers("scaled"), numbers("coefficients"), number("r_squared"), number("rmse")],
                    keep=["n", "mid", "half"])


def scaled_value(x: Column, degree: int, scaled: str = "scaled", mid: str = "mid", half: str = "half") -> Column:
    """The polynomial of ``polynomial_table`` at ``x``."""
    t = (x - F.col(mid)) / F.when(F.col(half) > 0, F.col(half)).otherwise(F.lit(1.0))
    out = F.lit(0.0)
    for k in range(degree, -1, -1):
        out = out * t + F.get(F.col(scaled), F.lit(k))
    return out


def with_polynomial(df: DataFrame, x: Column, y: Column, degree: int, by: list[str], name: str,
                    rows: Column | None = None) -> DataFrame:
    """``df`` plus the fitted polynomial on every row; ``rows`` limits which rows are fitted."""
    table = polynomial_table(df if rows is None else df.filter(rows), x, y, degree, by)
    out = with_table(df, table.select(*by, "scaled", "mid", "half"), by)
    return out.withColumn(name, scaled_value(x, degree)).drop("scaled", "mid", "half")


def quadratic_form(columns: list[Column], matrix: str) -> Column:
    """x' M x for a row-major matrix held in an array column."""
    p = len(columns)
    return add_all([columns[i] * columns[j] * F.get(F.col(matrix), F.lit(i * p + j)) for i in range(p) for j in range(p)])
