"""Filling, scaling, resampling, decimating and ordering of series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.functions.numeric import as_col, div, finite, keys, not_nan, x_number
from sigtab.operators.joins import interpolate_join
from sigtab.plans.layout import lay_out, with_index, with_stats, with_table
from sigtab.plans.quantile import medians


def fill_missing(df: DataFrame, column: str, method: str = "mean", value=None, by=None, order=None,
                 name: str | None = None) -> DataFrame:
    """Fill nulls of a column by a value, the mean or median of its series, or the neighbour row."""
    by, name = keys(by), name or f"{column}_filled"
    kind = df.schema[column].dataType.typeName()
    c = not_nan(F.col(f"`{column}`")) if kind in ("double", "float") else F.col(f"`{column}`")
    if method == "value":
        return df.withColumn(name, F.coalesce(c, F.lit(value)))
    if method == "mean":
        return with_stats(df, by, {"_m": F.avg(not_nan(c))}).withColumn(name, F.coalesce(c, "_m")).drop("_m")
    if method == "median":
        table = medians(df, by, {"_m": not_nan(c)})
        return with_table(df, table, by).withColumn(name, F.coalesce(c, "_m")).drop("_m")
    if method in ("ffill", "bfill"):
        lay = lay_out(df, by, keys(order))
        return lay.done(lay.scan({name: ("last" if method == "ffill" else "next", c)}))
    raise ValueError(f"unknown fill method: {method}")


def interpolate_missing(df: DataFrame, column: str, by=None, order=None, name: str | None = None) -> DataFrame:
    """Linear interpolation by row position; rows outside the known ones take the nearest known value."""
    by, order, name = keys(by), keys(order), name or f"{column}_interp"
    rows = with_index(df.withColumn("_v", not_nan(F.col(f"`{column}`"))), by, order, "_pos")
    entry = F.when(F.col("_v").isNotNull(), F.struct(F.col("_pos").alias("i"), F.col("_v").alias("v")))
    lay = lay_out(rows, by, order)
    out = lay.done(lay.scan({"_p": ("last", entry), "_n": ("next", entry)}))
    share = div((F.col("_pos") - F.col("_p.i")).cast("double"), F.col("_n.i") - F.col("_p.i"))
    value = (
        F.when(F.col("_v").isNotNull(), F.col("_v"))
        .when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull(), F.col("_p.v"))
        .otherwise(F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share)
    )
    return out.withColumn(name, value).drop("_v", "_pos", "_p", "_n")


def normalize(df: DataFrame, column: str, method: str = "zscore", by=None, name: str | None = None) -> DataFrame:
    """z-score (n-1), ``minmax``, ``max`` (by largest magnitude) or ``area`` (by the sum of magnitudes).

    A series without spread cannot be scaled and gets null.
    """
    by = keys(by)
    x = finite(F.col(f"`{column}`"))
    name = name or f"{column}_{method}"
    if method == "zscore":
        out = with_stats(df, by, {"_a": F.avg(x), "_b": F.stddev_samp(x)})
        value = (x - F.col("_a")) / F.when(F.col("_b") > 0, F.col("_b"))
    elif method == "minmax":
        out = with_stats(df, by, {"_a": F.min(x), "_b": F.max(x)})
        value = div(x - F.col("_a"), F.col("_b") - F.col("_a"))
    elif method in ("max", "area"):
        agg = F.max(F.abs(x)) if method == "max" else F.sum(F.abs(x))
        out = with_stats(df, by, {"_a": agg})
        value = div(x, F.col("_a"))
    else:
        raise ValueError(f"unknown scaling: {method}")
    return out.withColumn(name, value).drop("_a", "_b")


def resample_uniform(df: DataFrame, x: str, values: list[str], n_points: int | None = None, by=None) -> DataFrame:
    """Each series read on ``n_points`` equal steps of ``x`` (default: as many as it has rows), linear.

    The grid is generated per series from its bounds; a long grid is spread over many rows of work
    by exploding block numbers first.
    """
    by = keys(by)
    pos = x_number(df, x)
    n = F.lit(int(n_points)) if n_points else F.col("_n")
    block = 65_536
    bounds = df.groupBy(*by).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.count(pos).alias("_n"))
    bounds = bounds.filter(F.col("_n") >= 2).withColumn("_n", n.cast("bigint"))
    blocks = bounds.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / block))))
    grid = blocks.withColumn(
        "_i", F.explode(F.sequence(F.col("_k") * block, F.least((F.col("_k") + 1) * block, F.col("_n")) - 1)))
    at = F.when(F.col("_i") == F.col("_n") - 1, F.col("_hi")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_i") / F.greatest(F.col("_n") - 1, F.lit(1)))
    grid = grid.select(*by, F.col("_i").alias("grid_index"), at.alias("grid_x"))
    source = df.select(*by, pos.alias("_gx"), *values)
    return interpolate_join(grid, source, "grid_x", "_gx", values, by)


def sort_rows(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Globally sorted by a range shuffle."""
    c = F.col(f"`{column}`")
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())


def decimate(df: DataFrame, by, order, factor: int) -> DataFrame:
    """Every ``factor``-th row of a series with its 1-based source row number."""
    out = with_index(df, keys(by), keys(order), "_i").filter(F.col("_i") % factor == 0)
    return out.withColumn("source_row", F.col("_i") + 1).drop("_i")


def stride_downsample(df: DataFrame, by, order, max_points: int) -> DataFrame:
    """Rows at a constant stride so that a series keeps at most ``max_points``."""
    by = keys(by)
    rows = with_stats(with_index(df, by, keys(order), "_i"), by, {"_n": F.count(F.lit(1))})
    step = F.greatest(F.ceil(F.col("_n") / F.lit(max_points)), F.lit(1))
    return rows.filter(F.col("_i") % step == 0).drop("_i", "_n")


def envelope_downsample(df: DataFrame, y: str, by, order, width: int) -> DataFrame:
    """Lowest and highest row of each of ``width`` position buckets, plus the first and last row."""
    by = keys(by)
    rows = with_stats(with_index(df, by, keys(order), "row_index"), by, {"_n": F.count(F.lit(1))})
    v = finite(y)
    bucket = F.floor(F.col("row_index") * F.lit(float(width - 1)) / F.greatest(F.col("_n") - 1, F.lit(1)))
    rows = rows.withColumn("_k", bucket)
    ends = rows.groupBy(*by, "_k").agg(
        F.min_by("row_index", F.when(v.isNotNull(), F.struct(v, F.col("row_index")))).alias("lo"),
        F.min_by("row_index", F.when(v.isNotNull(), F.struct(-v, F.col("row_index")))).alias("hi"),
        F.first("_n").alias("_n"),
    )
    extra = [F.when(F.col("_k") == 0, F.lit(0).cast("bigint")),
             F.when(F.col("_k") == width - 1, F.col("_n") - 1)]
    picks = ends.select(*by, F.explode(F.array("lo", "hi", *extra)).alias("row_index")).distinct()
    picks = picks.filter(F.col("row_index").isNotNull())
    return rows.drop("_k", "_n").join(picks, by + ["row_index"], "left_semi")


def bucket_bars(df: DataFrame, y: str, by, order, budget: int, reducer: str = "mean") -> DataFrame:
    """At most ``budget`` contiguous bins of rows with their centre position and sum or mean."""
    by = keys(by)
    rows = with_stats(with_index(df, by, keys(order), "_i"), by, {"_n": F.count(F.lit(1))})
    size = F.least(F.lit(budget), F.col("_n"))
    v = finite(y)
    binned = rows.withColumn("bin", F.floor(F.col("_i") * size / F.col("_n")).cast("bigint"))
    return binned.groupBy(*by, "bin").agg(
        F.avg("_i").alias("center"), (F.sum(v) if reducer == "sum" else F.avg(v)).alias("value"),
        (F.max("_i") - F.min("_i") + F.lit(0.8)).alias("width"), F.min("_i").alias("first_row"))


def zero_pad(df: DataFrame, index: str, value: str, length: int, by=None) -> DataFrame:
    """Append zero rows so that each series of 0-based ``index`` has ``length`` rows."""
    by = keys(by)
    sizes = df.groupBy(*by).agg((F.max(index) + 1).alias("_n"))
    tail = sizes.filter(F.col("_n") < length).select(
        *by, F.explode(F.sequence(F.col("_n"), F.lit(length - 1).cast("bigint"))).alias(index))
    return df.select(*by, index, finite(value).alias(value)).unionByName(tail.withColumn(value, F.lit(0.0)))
