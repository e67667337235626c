"""Exact linearly interpolated quantiles and mid-ranks, also for groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtab.functions.numeric import as_col
from sigtab.plans.layout import cut_lineage, join_by, lay_out, rows_per_task, with_table


def _has_long_group(df: DataFrame, by: list[str], limit: int) -> bool:
    if df.count() <= limit:
        return False
    if not by:
        return True
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return not sizes.filter(F.col("n") > limit).isEmpty()


def quantiles(df: DataFrame, by: list[str], values: dict[str, Column | str], probs: list[float],
              limit: int | None = None, count: Column | str | None = None) -> DataFrame:
    """One row per series: for each name an array of the quantiles of that value at ``probs``.

    ``count`` says how often a row counts.
    ``percentile`` keeps the distinct values of a group in one buffer; groups above the task limit
    go through counted distinct values and running totals instead, with the same result.
    """
    limit = limit or rows_per_task(df.sparkSession)
    cols = {n: as_col(v) for n, v in values.items()}
    if not _has_long_group(df, by, limit):
        marks = F.array(*[F.lit(float(p)) for p in probs])
        times = F.lit(1) if count is None else as_col(count)
        return df.groupBy(*by).agg(*[F.percentile(c, marks, times).alias(n) for n, c in cols.items()])
    out = None
    for name, col in cols.items():
        counts = (
            df.select(*by, col.alias("_v"), (F.lit(1) if count is None else as_col(count)).alias("_n")).filter(F.col("_v").isNotNull())
            .groupBy(*by, "_v").agg(F.sum("_n").alias("_n"))
        )
        lay = lay_out(counts, by, ["_v"], limit)
        cum = lay.done(lay.scan({"_cum": ("sum", "_n")}))
        size = cum.groupBy(*by).agg(F.max("_cum").alias("_size"))
        cum = with_table(cum, size, by)
        picks = []
        for i, p in enumerate(probs):
            at = (F.col("_size") - 1) * F.lit(float(p))
            picks += [
                F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v"))).alias(f"_lo{i}"),
                F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v"))).alias(f"_hi{i}"),
                F.min(at - F.floor(at)).alias(f"_f{i}"),
            ]
        got = cum.groupBy(*by).agg(*picks).select(
            *by,
            F.array(*[
                F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")
                for i in range(len(probs))
            ]).alias(name),
        )
        out = got if out is None else (join_by(out, got, by, "full") if by else with_table(out, got, by))
    if by:
        keys = df.select(*by).distinct()
        return join_by(keys, out, by)
    return out


def medians(df: DataFrame, by: list[str], values: dict[str, Column | str], count: Column | str | None = None) -> DataFrame:
    table = quantiles(df, by, values, [0.5], count=count)
    return table.select(*by, *[F.get(F.col(n), F.lit(0)).alias(n) for n in values])


def bracketed_medians(df: DataFrame, by: list[str], value: str, few: bool) -> DataFrame:
    """One row per series with the exact median of ``value``, by two aggregates over the rows of a long table and no sort of them.

    A sketch gives two values close around the median. What lies below them is counted, and only the distinct values between
    them are ordered. Should the sketch have missed the median of any series, all are taken by ``medians``.
    ``few`` says that a table with one row per series may be broadcast. ``df`` is read several times.
    """
    rows = df.select(*by, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    rough = cut_lineage(rows.groupBy(*by).agg(F.percentile_approx("_v", [0.4995, 0.5005], 10_000).alias("_q"), F.count(F.lit(1)).alias("_size")))
    near = with_table(rows, F.broadcast(rough) if few else rough, by)
    below, inside = F.col("_v") < F.get("_q", F.lit(0)), F.col("_v") <= F.get("_q", F.lit(1))
    near = near.groupBy(*by, F.when(~below & inside, F.col("_v")).alias("_v"), below.alias("_below")).agg(F.count(F.lit(1)).alias("_n"), F.first("_size").alias("_size"))
    near = cut_lineage(near.filter(F.col("_below") | F.col("_v").isNotNull()))  # the values below share one row
    upto = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())
    cum = near.withColumn("_cum", F.sum("_n").over(upto))
    at = (F.col("_size") - 1) * 0.5
    lo, hi = [F.min(F.when(~F.col("_below") & (F.col("_cum") > fn(at)), F.col("_v"))) for fn in (F.floor, F.ceil)]
    missed = F.coalesce(F.sum(F.when(F.col("_below"), F.col("_n"))), F.lit(0)) > F.min(F.floor(at))
    out = cum.groupBy(*by).agg(lo.alias("_lo"), hi.alias("_hi"), F.min(at - F.floor(at)).alias("_f"), missed.alias("_missed"))
    if not out.filter(F.col("_missed") | F.col("_lo").isNull() | F.col("_hi").isNull()).isEmpty():
        return medians(df, by, {value: value})
    return out.select(*by, (F.col("_lo") * (1 - F.col("_f")) + F.col("_hi") * F.col("_f")).alias(value))


def mid_ranks(df: DataFrame, by: list[str], value: Column | str, weights: dict[str, Column]) -> DataFrame:
    """Distinct values of each family with their mid-rank and tie count.

    ``weights`` are extra aggregates per distinct value (for example the count of one sample).
    Ties are counted before the shuffle by value, so a value shared by most rows stays one row.
    """
    counts = df.groupBy(*by, as_col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("ties"), *[w.alias(n) for n, w in weights.items()]
    ).filter(F.col("v").isNotNull())
    lay = lay_out(counts, by, ["v"])
    ranked = lay.done(lay.scan({"_cum": ("sum", "ties")}))
    return ranked.withColumn("rank", F.col("_cum") - (F.col("ties") - 1) / F.lit(2.0)).drop("_cum")
