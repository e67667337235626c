"""Grouped aggregation and descriptive statistics."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.functions.numeric import all_of, div, finite, keys, not_nan, numeric_columns
from sigtab.plans.layout import join_by, lay_out, with_table
from sigtab.plans.quantile import medians

AGGS = {
    "mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "min": F.min, "max": F.max,
    "count": F.count,
}


def group_summary(df: DataFrame, group: str, value: str, agg: str = "mean") -> DataFrame:
    """One aggregate of ``value`` per group plus ``row_count``; the null group is kept."""
    v = not_nan(value)
    if agg == "median":
        counts = df.groupBy(group).agg(F.count(v).alias("row_count"))
        return join_by(counts, medians(df, [group], {f"{value}_median": v}), [group])
    return df.groupBy(group).agg(AGGS[agg](v).alias(f"{value}_{agg}"), F.count(v).alias("row_count"))


def aggregate_by(df: DataFrame, group: str, values: list[str], agg: str = "sum") -> DataFrame:
    """The same aggregate of several columns per id; rows without an id are dropped."""
    kept = df.filter(F.col(group).isNotNull())
    return kept.groupBy(group).agg(*[AGGS[agg](not_nan(v)).alias(v) for v in values])


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness, null below three values, 0 without spread."""
    n = F.count(x)
    g = F.skewness(x)
    fixed = g * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n > 2, F.when(F.var_pop(x) > 0, fixed).otherwise(F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis, null below four values, 0 without spread."""
    n = F.count(x)
    g = F.kurtosis(x)
    scale = (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    fixed = scale * ((n + 1) * g + 6)
    return F.when(n > 3, F.when(F.var_pop(x) > 0, fixed).otherwise(F.lit(0.0)))


def modes(df: DataFrame, by: list[str], column: Column, name: str) -> DataFrame:
    """Most frequent value per series, the smallest among equals; values are counted before they meet."""
    counts = df.groupBy(*by, column.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_v").isNotNull())
    best = counts.groupBy(*by).agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(name))
    return best


def describe(df: DataFrame, column: str, by=None) -> DataFrame:
    """Count, mean, median, mode, std, variance, corrected skewness and kurtosis, min and max."""
    by = keys(by)
    x = not_nan(F.col(f"`{column}`"))
    base = df.groupBy(*by).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("variance"), sample_skewness(x).alias("skewness"),
        sample_kurtosis(x).alias("kurtosis"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    out = with_table(base, medians(df, by, {"median": x}), by)
    out = with_table(out, modes(df, by, x, "mode"), by)
    names = ["count", "mean", "median", "mode", "std", "variance", "skewness", "kurtosis", "min", "max"]
    return out.select(*by, *names)


def unpivot_columns(df: DataFrame, columns: list[str], by=None) -> DataFrame:
    """Long form ``(by, column, value)`` of several numeric columns."""
    by = keys(by)
    return df.select(*by, *[not_nan(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(
        by, columns, "column", "value")


def descriptive_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Statistic by column table; columns without numbers are left out."""
    columns = columns or numeric_columns(df)
    long = describe(unpivot_columns(df, columns), "value", ["column"]).filter(F.col("count") > 0)
    tall = long.withColumn("count", F.col("count").cast("double")).unpivot(["column"], None, "statistic", "value")
    return tall.groupBy("statistic").pivot("column", columns).agg(F.first("value"))


def pair_matrix(df: DataFrame, columns: list[str], kind: str = "covariance") -> DataFrame:
    """Covariance or correlation of every column pair over the rows where both are present."""
    if len(columns) < 2:
        raise ValueError("need at least two columns")
    x = {c: finite(F.col(f"`{c}`")) for c in columns}
    wanted = {}
    for a, b in combinations_with_replacement(range(len(columns)), 2):
        p, q = x[columns[a]], x[columns[b]]
        both = p.isNotNull() & q.isNotNull()
        p, q = F.when(both, p), F.when(both, q)
        if kind == "covariance":
            wanted[a, b] = F.covar_samp(p, q)
        else:
            wanted[a, b] = F.when((F.var_pop(p) > 0) & (F.var_pop(q) > 0), F.corr(p, q))
    one = df.agg(*[c.alias(f"m{a}_{b}") for (a, b), c in wanted.items()])
    rows = [
        F.struct(F.lit(columns[i]).alias("column"),
                 *[F.col(f"m{min(i, j)}_{max(i, j)}").alias(columns[j]) for j in range(len(columns))])
        for i in range(len(columns))
    ]
    return one.select(F.inline(F.array(*rows)))


def dataset_summary(df: DataFrame, columns: list[str] | None = None, x: str | None = None,
                    y: str | None = None) -> DataFrame:
    """One row per column: rows, missing cells, count, mean, std, min, max and the x-y correlation."""
    columns = columns or numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    if x and y:
        both = finite(x).isNotNull() & finite(y).isNotNull()
        aggs.append(F.corr(F.when(both, finite(x)), F.when(both, finite(y))).alias("xy"))
    for i, c in enumerate(columns):
        v = finite(F.col(f"`{c}`"))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    one = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("rows").alias("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("missing"), F.col(f"n{i}").alias("count"),
            F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"),
            F.col(f"h{i}").alias("max"), (F.col("xy") if x and y else F.lit(None).cast("double")).alias("xy_correlation"),
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def kpi_table(df: DataFrame, columns: list[str] | None = None, by=None) -> DataFrame:
    """Count, mean, std, min and max of each column."""
    by = keys(by)
    long = unpivot_columns(df, columns or numeric_columns(df), by)
    v = F.col("value")
    return long.groupBy(*by, "column").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))


def rank_by_metric(df: DataFrame, metric: str, by=None, high_first: bool = True) -> DataFrame:
    """Dense rank of rows by a metric, optionally per group; ranks come from the distinct values."""
    by = keys(by)
    v = finite(metric)
    rows = df.withColumn("_key", -v if high_first else v).filter(F.col("_key").isNotNull())
    values = rows.select(*by, "_key").distinct()
    lay = lay_out(values, by, ["_key"])
    ranks = lay.done(lay.scan({"rank": ("index",)})).withColumn("rank", (F.col("rank") + 1).cast("int"))
    return join_by(rows, ranks, by + ["_key"]).drop("_key")
