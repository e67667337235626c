"""Row selection: predicates, search, missing rows, duplicates, outliers, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.functions.numeric import add_all, all_of, any_of, div, finite, keys, not_nan, numeric_columns, x_number
from sigtab.plans.layout import lay_out, order_key, with_index, with_stats, with_table
from sigtab.plans.quantile import quantiles

COMPARE = {
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
}


def _contains(column: str, text: str) -> Column:
    return F.contains(F.lower(F.col(f"`{column}`").cast("string")), F.lit(text.lower()))


def filter_rows(df: DataFrame, column: str, op: str, value=None) -> DataFrame:
    """Keep rows by ``is finite``, ``equals``, ``contains`` (any case) or a numeric comparison."""
    c = F.col(f"`{column}`")
    if op == "is finite":
        return df.filter(finite(c).isNotNull())
    if op == "equals":
        return df.filter(c.cast("string") == str(value))
    if op == "contains":
        return df.filter(_contains(column, str(value)))
    if op not in COMPARE:
        raise ValueError(f"unknown condition: {op}")
    plain = df.schema[column].dataType.typeName() in ("integer", "long", "short", "byte")
    return df.filter(COMPARE[op](c if plain else not_nan(c), float(value)))


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any of the columns, as text, holds ``text`` in any case."""
    text = text.strip()
    if not text:
        raise ValueError("nothing to search for")
    return df.filter(any_of([F.coalesce(_contains(c, text), F.lit(False)) for c in columns or df.columns]))


def drop_missing(df: DataFrame, columns: list[str] | str | None = None) -> DataFrame:
    """Drop rows with null or NaN in the given columns, in any column (None) or all ``"numeric"`` ones."""
    names = df.columns if columns is None else numeric_columns(df) if columns == "numeric" else keys(columns)
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    kept = [
        F.col(f"`{c}`").isNotNull() & (~F.isnan(F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.lit(True))
        for c in names
    ]
    return df.filter(all_of(kept))


def crop(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    lo, hi = sorted((float(lo), float(hi)))
    return df.filter(F.col(f"`{column}`").try_cast("double").between(lo, hi))


def visible_range(df: DataFrame, x: str, lo, hi) -> DataFrame:
    """Rows with ``x`` (numeric or timestamp) inside the range, bounds in either order."""
    kind = df.schema[x].dataType
    if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
        lo, hi = sorted((lo, hi))
        return df.filter(F.col(x).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind)))
    return crop(df, x, lo, hi).filter(finite(x).isNotNull())


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row of ``order`` for each value of ``subset``; nulls compare equal.

    An aggregate with map-side combine, so one value shared by most rows does not meet in one task.
    """
    key, _ = order_key(df, keys(order))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = df.groupBy(*subset).agg(F.min_by(whole, key).alias("_row"))
    return first.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def duplicate_count(df: DataFrame, subset: list[str]) -> DataFrame:
    """How many rows ``drop_duplicates`` removes."""
    groups = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg((F.sum("n") - F.count(F.lit(1))).cast("bigint").alias("n_removed"))


def flag_outliers(df: DataFrame, column: str, by=None, method: str = "zscore", threshold: float | None = None,
                  name: str = "is_outlier") -> DataFrame:
    """Add a flag: ``|x - mean| / std > 3`` or outside the quartiles by 1.5 IQR, per series."""
    by = keys(by)
    x = not_nan(F.col(f"`{column}`"))
    if method == "zscore":
        t = 3.0 if threshold is None else threshold
        out = with_stats(df, by, {"_mu": F.avg(x), "_sd": F.stddev_samp(x)})
        usable = (F.col("_sd") > 0) & finite("_sd").isNotNull()
        hit = F.when(usable, F.abs(x - F.col("_mu")) / F.when(usable, F.col("_sd")) > t)
        return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_mu", "_sd")
    if method != "iqr":
        raise ValueError(f"unknown outlier method: {method}")
    t = 1.5 if threshold is None else threshold
    out = with_table(df, quantiles(df, by, {"_q": x}, [0.25, 0.75]), by)
    q1, q3 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    hit = (x < q1 - t * (q3 - q1)) | (x > q3 + t * (q3 - q1))
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_q")


def drop_outliers(df: DataFrame, column: str, by=None, method: str = "zscore", threshold=None) -> DataFrame:
    return flag_outliers(df, column, by, method, threshold, "_out").filter(~F.col("_out")).drop("_out")


def outlier_count(df: DataFrame, column: str, by=None, method: str = "zscore", threshold=None) -> DataFrame:
    by = keys(by)
    flagged = flag_outliers(df, column, by, method, threshold, "_out")
    return flagged.groupBy(*by).agg(F.count_if("_out").alias("n_removed"))


def anomaly_summary(df: DataFrame, column: str, by=None, method: str = "zscore", threshold=None) -> DataFrame:
    """One row per series: points, flagged points, their share, mean and standard deviation."""
    by = keys(by)
    x = not_nan(F.col(f"`{column}`"))
    return flag_outliers(df, column, by, method, threshold, "_out").groupBy(*by).agg(
        F.count(x).alias("n_total"),
        F.count_if("_out").alias("n_anomalies"),
        F.coalesce(div(F.count_if("_out"), F.count(x)), F.lit(0.0)).alias("fraction"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
    )


def top_anomalies(df: DataFrame, column: str, order, by=None, method: str = "zscore", threshold=None,
                  k: int = 10) -> DataFrame:
    """The ``k`` most extreme flagged rows of each series, with their z-score."""
    by, order = keys(by), keys(order)
    x = not_nan(F.col(f"`{column}`"))
    flagged = flag_outliers(df, column, by, method, threshold, "_out")
    scored = with_stats(flagged, by, {"_mu": F.avg(x), "_sd": F.stddev_samp(x)}).filter("_out")
    scored = scored.withColumn("zscore", div(F.abs(x - F.col("_mu")), F.col("_sd"))).drop("_mu", "_sd", "_out")
    ranked = scored.withColumn("_neg", -F.col("zscore"))
    lay = lay_out(ranked, by, ["_neg"] + order)
    return lay.done(lay.scan({"_i": ("index",)})).filter(F.col("_i") < k).withColumn(
        "rank", F.col("_i") + 1).drop("_neg", "_i")


def split_rows(df: DataFrame, by, order, rows: int, name: str = "chunk_id") -> DataFrame:
    """Number consecutive blocks of ``rows`` rows; write with ``partitionBy(name)`` to get one part each."""
    out = with_index(df, keys(by), keys(order), "_i")
    return out.withColumn(name, F.floor(F.col("_i") / rows).cast("bigint")).drop("_i")
