"""Fourier transforms of series of any length and any size.

Series of up to one task's rows are transformed whole. Longer ones go through the chirp transform
(three transforms of a power-of-two size), and every power-of-two transform is two rounds of short
transforms over groups of about the square root of the size, exchanged by two shuffles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.plans.batches import batch_of, numbers, series_of
from sigtab.plans.layout import join_by, rows_per_task


def _head(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)


def fft(df: DataFrame, by: list[str], index: str, re: str, im: str | None = None, inverse: bool = False,
        half: bool = False, limit: int | None = None) -> DataFrame:
    """(by, k, n, re, im): the discrete Fourier transform of the values at ``index`` 0 … n-1.

    ``half`` keeps k up to n/2. ``inverse`` divides by n.
    """
    limit = limit or rows_per_task(df.sparkSession)
    rows = df.select(*by, F.col(index).cast("bigint").alias("k"), F.col(re).cast("double").alias("re"),
                     (F.col(im).cast("double") if im else F.lit(0.0)).alias("im"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    long = sizes.filter(F.col("n") > limit)
    most, n = sizes.agg(F.max("n"), F.sum("n")).first()
    if (most or 0) <= limit:
        return _short(rows, by, inverse, half, n or 0, limit)
    far = _chirp(join_by(rows, long, by, "inner") if by else rows.withColumn("n", F.lit(long.first()["n"])), long, by, inverse)
    if half:
        far = far.filter(F.col("k") <= F.floor(F.col("n") / 2))
    if not by:
        return far
    near = join_by(rows, long.withColumn("_long", F.lit(True)), by).filter("_long IS NULL").drop("_long", "n")
    return _short(near, by, inverse, half, n, limit).unionByName(far)


def _short(rows: DataFrame, by: list[str], inverse: bool, half: bool, total: int, limit: int) -> DataFrame:
    """Each series whole, many series at a time; series of one length share a transform."""
    def run(table: pa.Table) -> pa.Table:
        code = series_of(by, table)[0]
        order = np.lexsort((numbers(table, "k"), code))
        z = (numbers(table, "re") + 1j * numbers(table, "im"))[order]
        start = np.flatnonzero(np.diff(code[order], prepend=-1))
        n = np.diff(start, append=len(z))
        kept = n // 2 + 1 if half else n
        to = np.cumsum(kept) - kept
        out = np.empty(kept.sum(), complex)
        for size in np.unique(n):
            rows_of = start[n == size][:, None] + np.arange(size)
            f = np.fft.ifft(z[rows_of], axis=1) if inverse else np.fft.fft(z[rows_of], axis=1)
            count = kept[n == size][0]
            out[to[n == size][:, None] + np.arange(count)] = f[:, :count]
        k = np.arange(len(out)) - np.repeat(to, kept)
        own = table.select(by).take(pa.array(np.repeat(order[start], kept)))
        return pa.table([*own.columns, k, np.repeat(n, kept), out.real, out.imag], names=[*by, "k", "n", "re", "im"])

    batches = rows.withColumn("_g", batch_of(by, total, limit)).groupBy("_g")
    return batches.applyInArrow(run, _head(rows, by) + "k bigint, n bigint, re double, im double")


def _two_rounds(rows: DataFrame, by: list[str], inverse: bool) -> DataFrame:
    """Transform of size ``size`` = ``rows_`` x ``cols_`` (powers of two); absent positions count as zero."""
    sign = 1.0 if inverse else -1.0

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2, j2 = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0]), int(pdf["j2"].iloc[0])
        z = np.zeros(n1, complex)
        z[(pdf["k"].to_numpy() // n2)] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        f = np.fft.ifft(z) * n1 if inverse else np.fft.fft(z)
        f = f * np.exp(sign * 2j * np.pi * j2 * np.arange(n1) / (n1 * n2))
        out = pd.DataFrame({"j2": j2, "k1": np.arange(n1), "n": pdf["n"].iloc[0], "n1": n1, "n2": n2, "re": f.real, "im": f.imag})
        for i, c in enumerate(by):
            out.insert(i, c, [pdf[c].iloc[0]] * n1)
        return out

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2, k1 = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0]), int(pdf["k1"].iloc[0])
        z = np.zeros(n2, complex)
        z[pdf["j2"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        f = np.fft.ifft(z) * n2 / (n1 * n2) if inverse else np.fft.fft(z)
        out = pd.DataFrame({"k": k1 + n1 * np.arange(n2), "n": pdf["n"].iloc[0], "n1": n1, "n2": n2, "re": f.real, "im": f.imag})
        for i, c in enumerate(by):
            out.insert(i, c, [pdf[c].iloc[0]] * n2)
        return out

    head = _head(rows, by)
    cols = rows.withColumn("j2", F.col("k") % F.col("n2")).groupBy(*by, "j2").applyInPandas(
        first, head + "j2 bigint, k1 bigint, n bigint, n1 bigint, n2 bigint, re double, im double")
    return cols.groupBy(*by, "k1").applyInPandas(second, head + "k bigint, n bigint, n1 bigint, n2 bigint, re double, im double")


def _times(a: tuple, b: tuple) -> tuple:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _chirp(rows: DataFrame, sizes: DataFrame, by: list[str], inverse: bool) -> DataFrame:
    """Transform of any size n as a convolution with exp(i pi k^2 / n), in exact integer phases."""
    bits = F.ceil(F.log2(2 * F.col("n") - 1)).cast("int")
    n1, n2 = F.pow(F.lit(2.0), F.ceil(bits / 2)).cast("bigint"), F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint")
    sized = lambda d: d.withColumns({"n1": n1, "n2": n2})
    turn = -1.0 if inverse else 1.0
    angle = lambda k: F.lit(math.pi) * ((k * k) % (2 * F.col("n"))) / F.col("n")
    w = (F.cos(angle(F.col("k"))), -turn * F.sin(angle(F.col("k"))))
    a_re, a_im = _times((F.col("re"), F.col("im")), w)
    a = sized(rows.withColumns({"_a": a_re, "_b": a_im}).drop("re", "im").withColumnsRenamed({"_a": "re", "_b": "im"}))
    block = 65_536
    seq = sized(sizes).withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))))
    seq = seq.withColumn("k", F.explode(F.sequence(F.col("_k") * block, F.least((F.col("_k") + 1) * block, F.col("n")) - 1)))
    seq = seq.withColumns({"re": F.cos(angle(F.col("k"))), "im": turn * F.sin(angle(F.col("k")))}).drop("_k")
    back = seq.filter("k > 0").withColumn("k", F.col("n1") * F.col("n2") - F.col("k"))
    fa = _two_rounds(a, by, False)
    fb = _two_rounds(seq.unionByName(back), by, False).select(*by, "k", F.col("re").alias("bre"), F.col("im").alias("bim"))
    both = join_by(fa, fb, by + ["k"], "inner")
    p_re, p_im = _times((F.col("re"), F.col("im")), (F.col("bre"), F.col("bim")))
    prod = both.select(*by, "k", "n", "n1", "n2", p_re.alias("re"), p_im.alias("im"))
    conv = _two_rounds(prod, by, True).filter(F.col("k") < F.col("n"))
    x_re, x_im = _times((F.col("re"), F.col("im")), w)
    scale = F.col("n") if inverse else F.lit(1.0)
    return conv.select(*by, "k", "n", (x_re / scale).alias("re"), (x_im / scale).alias("im"))


def lag_products(rows: DataFrame, by: list[str], index: str, a: str, b: str, reach: str) -> DataFrame:
    """(by, k, _sum): the sum of a[i] * b[i - k] for every lag k up to the column ``reach`` either way that two values share.

    Both series are transformed with as many zeros behind them as the longest lag, so nothing wraps around; no task holds
    more than about the square root of that size, however long the lags are.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.least(F.max(reach), F.count(F.lit(1)) - 1).cast("bigint").alias("_reach"))
    bits = F.greatest(F.lit(2), F.ceil(F.log2(F.col("n") + F.col("_reach"))).cast("int"))
    sizes = sizes.withColumns({"n1": F.pow(F.lit(2.0), F.ceil(bits / 2)).cast("bigint"), "n2": F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint")})
    work = rows.select(*by, F.col(index).cast("bigint").alias("k"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    work = join_by(work, sizes, by, "inner") if by else work.join(F.broadcast(sizes))  # one row of sizes
    shape = ["k", "n", "n1", "n2"]
    left = _two_rounds(work.select(*by, *shape, F.col("_a").alias("re"), F.lit(0.0).alias("im")), by, False)
    if a == b:
        product = left.select(*by, *shape, (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im"))
    else:
        right = _two_rounds(work.select(*by, *shape, F.col("_b").alias("re"), F.lit(0.0).alias("im")), by, False)
        both = join_by(left, right.select(*by, "k", F.col("re").alias("_re"), (-F.col("im")).alias("_im")), by + ["k"], "inner")
        re, im = _times((F.col("re"), F.col("im")), (F.col("_re"), F.col("_im")))
        product = both.select(*by, *shape, re.alias("_p"), im.alias("_q")).withColumnsRenamed({"_p": "re", "_q": "im"})
    back = _two_rounds(product, by, True)
    size = F.col("n1") * F.col("n2")
    reaches = sizes.select(*by, "_reach")
    out = join_by(back, reaches, by, "inner") if by else back.join(F.broadcast(reaches))
    # lags of both signs fit the size together, as it is at least the series and the longest lag
    kept = F.when(F.col("k") <= F.col("_reach"), F.col("k")).when((size - F.col("k") <= F.col("_reach")) & F.lit(a != b), F.col("k") - size)
    return out.select(*by, kept.alias("k"), F.col("re").alias("_sum")).filter("k IS NOT NULL")
