"""The tables behind distribution, quality-control, relation and polar charts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtab.functions.numeric import add_all, div, finite, keys
from sigtab.functions.tails import norm_cdf, norm_ppf
from sigtab.operators.describe import unpivot_columns
from sigtab.plans.layout import frame, join_by, lay_out, with_index, with_stats, with_table
from sigtab.plans.quantile import medians, quantiles


def _positions(table: DataFrame, n: int, name: str) -> DataFrame:
    """Each row of a small bounds table once per position 0 … n-1."""
    return table.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def histogram(df: DataFrame, columns: list[str], bins: int = 20, by=None) -> DataFrame:
    """Counts on equal bins shared by all columns of a series, empty bins included.

    Columns: ``column, bin, left, right, count, density, cumulative``. The last bin is closed.
    """
    by = keys(by)
    long = df.select(*by, *[finite(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(by, columns, "column", "_v")
    long = long.filter(F.col("_v").isNotNull())
    spread = F.max("_v") > F.min("_v")
    bounds = {"_lo": F.when(spread, F.min("_v")).otherwise(F.min("_v") - 0.5),
              "_hi": F.when(spread, F.max("_v")).otherwise(F.max("_v") + 0.5)}
    rows = with_stats(long, by, bounds)
    slot = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    rows = rows.withColumn("bin", F.least(slot, F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy(*by, "column", "bin").agg(F.count(F.lit(1)).alias("_c"))
    sizes = rows.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    grid = _positions(sizes, bins, "bin")
    out = join_by(grid, counts, by + ["column", "bin"]).withColumn("count", F.coalesce("_c", F.lit(0)))
    width = (F.col("_hi") - F.col("_lo")) / bins
    # one row per bin: the running total is over `bins` rows of a column
    w = Window.partitionBy(*by, "column").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        *by, "column", "bin", (F.col("_lo") + width * F.col("bin")).alias("left"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("right"), "count",
        (F.col("count") / (F.col("_n") * width)).alias("density"), F.sum("count").over(w).alias("cumulative"))


def normal_curve(df: DataFrame, column: str, bins: int = 20, points: int = 400, by=None) -> DataFrame:
    """The normal curve of mean and population deviation, scaled to counts of a ``bins`` histogram."""
    by = keys(by)
    x = finite(column)
    table = df.groupBy(*by).agg(F.count(x).alias("_n"), F.avg(x).alias("mu"), F.stddev_pop(x).alias("_s"),
                                F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    sigma = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1)
    z = (F.col("x") - F.col("mu")) / F.col("sigma")
    out = _positions(table, points, "point").withColumns({"x": at, "sigma": sigma})
    height = F.exp(-z * z / 2) / (F.col("sigma") * math.sqrt(2 * math.pi)) * F.col("_n") * (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*by, "point", "x", "mu", "sigma", height.alias("y"))


def kernel_density(df: DataFrame, column: str, points: int = 200, by=None) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott's bandwidth.

    Equal values are counted first, and a value is only sent to the grid points within 39
    bandwidths, beyond which its kernel is zero in double precision.
    """
    by = keys(by)
    counts = df.select(*by, finite(column).alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(
        F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c")
    mean = F.sum(F.col("_v") * F.col("_c")) / n
    rows = with_stats(counts, by, {"_n": n, "_mu": mean, "_lo": F.min("_v"), "_hi": F.max("_v")})
    rows = with_stats(rows, by, {"_ss": F.sum(F.col("_c") * (F.col("_v") - F.col("_mu")) * (F.col("_v") - F.col("_mu")))})
    rows = rows.filter((F.col("_n") >= 2) & (F.col("_hi") > F.col("_lo")))
    rows = rows.withColumn("_h", F.sqrt(F.col("_ss") / (F.col("_n") - 1)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    rows = rows.withColumn("_step", (F.col("_hi") - F.col("_lo")) / (points - 1))
    near = lambda sign: (F.col("_v") + sign * 39 * F.col("_h") - F.col("_lo")) / F.col("_step")
    first = F.greatest(F.ceil(near(-1)), F.lit(0)).cast("int")
    last = F.least(F.floor(near(1)), F.lit(points - 1)).cast("int")
    hit = rows.withColumn("_a", first).withColumn("_b", last).filter("_a <= _b").withColumn(
        "point", F.explode(F.sequence("_a", "_b")))
    z = (F.col("_v") - F.col("_lo") - F.col("point") * F.col("_step")) / F.col("_h")
    dens = hit.groupBy(*by, "point").agg(
        F.sum(F.col("_c") * F.exp(-z * z / 2) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("_d"))
    grid = _positions(rows.groupBy(*by).agg(F.first("_lo").alias("_lo"), F.first("_step").alias("_step")), points, "point")
    out = join_by(grid, dens, by + ["point"])
    return out.select(*by, "point", (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
                      F.coalesce("_d", F.lit(0.0)).alias("density"))


def box_statistics(df: DataFrame, column: str, by=None) -> DataFrame:
    """Quartiles, whiskers at the outermost values within 1.5 IQR, flier count, median notch."""
    by = keys(by)
    rows = df.select(*by, finite(column).alias("_v")).filter(F.col("_v").isNotNull())
    table = quantiles(rows, by, {"_q": "_v"}, [0.25, 0.5, 0.75])
    q = [F.get("_q", F.lit(i)) for i in range(3)]
    table = table.select(*by, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"))
    full = with_table(rows, table, by)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col("_v")
    out = full.groupBy(*by).agg(
        F.count(v).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.least(F.min(F.when(v >= lo, v)), F.first("q1")).alias("whisker_low"),
        F.greatest(F.max(F.when(v <= hi, v)), F.first("q3")).alias("whisker_high"),
        F.count_if((v < lo) | (v > hi)).alias("fliers"))
    notch = F.lit(1.57) * (F.col("q3") - F.col("q1")) / F.sqrt("n")
    return out.withColumn("notch_low", F.col("median") - notch).withColumn("notch_high", F.col("median") + notch)


def dot_bins(df: DataFrame, column: str, by=None) -> DataFrame:
    """Non-empty bins of a dot plot: between 10 and 30, about the square root of the count."""
    by = keys(by)
    rows = df.select(*by, finite(column).alias("_v")).filter(F.col("_v").isNotNull())
    rows = with_stats(rows, by, {"_lo": F.min("_v"), "_hi": F.max("_v"), "_n": F.count(F.lit(1))})
    k = F.least(F.lit(30), F.greatest(F.lit(10), F.floor(F.sqrt("_n"))))
    rows = rows.filter(F.col("_hi") > F.col("_lo")).withColumn("_k", k)
    slot = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_k"))
    rows = rows.withColumn("bin", F.least(slot, F.col("_k") - 1).cast("int"))
    center = F.first(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 0.5) / F.col("_k"))
    return rows.groupBy(*by, "bin").agg(center.alias("center"), F.count(F.lit(1)).alias("count"))


def empirical_cdf(df: DataFrame, column: str, by=None) -> DataFrame:
    """Distinct values with the share of the series at or below them."""
    by = keys(by)
    counts = df.select(*by, finite(column).alias("value")).filter(F.col("value").isNotNull()).groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("_c"))
    counts = with_stats(counts, by, {"_n": F.sum("_c")})
    lay = lay_out(counts, by, ["value"])
    out = lay.done(lay.scan({"_cum": ("sum", "_c")}))
    return out.select(*by, "value", (F.col("_cum") / F.col("_n")).alias("cdf"))


def ranked_values(df: DataFrame, column: str, by=None) -> DataFrame:
    """Every value with its 1-based rank ``i`` and the series size ``n``; equal values share a run of ranks.

    Ranks come from counted distinct values; runs of one value are cut into blocks before they
    are written out, so a dominant value is spread over tasks.
    """
    by = keys(by)
    counts = df.select(*by, finite(column).alias("value")).filter(F.col("value").isNotNull()).groupBy(*by, "value").agg(
        F.count(F.lit(1)).alias("_c"))
    counts = with_stats(counts, by, {"n": F.sum("_c")})
    lay = lay_out(counts, by, ["value"])
    runs = lay.done(lay.scan({"_cum": ("sum", "_c")}))
    block = 65_536
    runs = runs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_c") - 1) / block))))
    start = F.col("_cum") - F.col("_c") + 1 + F.col("_k") * block
    runs = runs.withColumn("_from", start).withColumn("_to", F.least(start + block - 1, F.col("_cum")))
    if lay.split:
        runs = runs.repartition(*[F.col(k) for k in by], F.col("_from"))
    return runs.select(*by, "value", "n", F.explode(F.sequence("_from", "_to")).alias("i"))


def qq_points(df: DataFrame, column: str, by=None, kind: str = "filliben") -> DataFrame:
    """Sorted values against normal quantiles at Filliben's or Blom's positions."""
    by = keys(by)
    rows = ranked_values(df, column, by)
    n, i = F.col("n").cast("double"), F.col("i").cast("double")
    if kind == "filliben":
        top = F.pow(F.lit(0.5), 1 / n)
        p = F.when(i == n, top).when(i == 1, 1 - top).otherwise((i - 0.3175) / (n + 0.365))
    elif kind == "blom":
        p = (i - 0.375) / (n + 0.25)
    else:
        raise ValueError(f"unknown plotting position: {kind}")
    return rows.select(*by, "i", "value", norm_ppf(p).alias("theoretical"))


def qq_line(df: DataFrame, column: str, by=None) -> DataFrame:
    """The least-squares reference line of the Q-Q points."""
    by = keys(by)
    points = qq_points(df, column, by)
    return points.groupBy(*by).agg(
        F.regr_slope("value", "theoretical").alias("slope"), F.regr_intercept("value", "theoretical").alias("intercept"),
        F.regr_r2("value", "theoretical").alias("r_squared"))


def pp_points(df: DataFrame, column: str, by=None) -> DataFrame:
    """Fitted normal probability of each sorted value against its empirical position."""
    by = keys(by)
    x = finite(column)
    table = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    rows = with_table(ranked_values(df, column, by), table, by)
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))
    return rows.select(*by, "i", ((F.col("i") - 0.5) / F.col("n")).alias("empirical"),
                       norm_cdf((F.col("value") - F.col("_m")) / sd).alias("theoretical"))


def bland_altman(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Each complete pair with its mean and difference, and the bias and limits of agreement."""
    by = keys(by)
    rows = df.filter(finite(a).isNotNull() & finite(b).isNotNull())
    rows = rows.withColumns({"pair_mean": (finite(a) + finite(b)) / 2, "pair_diff": finite(a) - finite(b)})
    rows = with_stats(rows, by, {"bias": F.avg("pair_diff"), "_sd": F.stddev_samp("pair_diff")})
    return rows.withColumns({"limit_low": F.col("bias") - 1.96 * F.col("_sd"),
                             "limit_high": F.col("bias") + 1.96 * F.col("_sd")}).drop("_sd")


def paired_means(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    by = keys(by)
    both = finite(a).isNotNull() & finite(b).isNotNull()
    rows = df.filter(both)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(finite(a)).alias("mean_first"),
                                 F.avg(finite(b)).alias("mean_second"), F.avg(finite(b) - finite(a)).alias("mean_change"))


def run_chart(df: DataFrame, column: str, by, order) -> DataFrame:
    """Rows in sequence with the median line."""
    by = keys(by)
    rows = df.filter(finite(column).isNotNull())
    out = with_index(rows, by, keys(order), "observation")
    return with_table(out, medians(rows, by, {"center": finite(column)}), by)


def _with_limits(df: DataFrame, column: str, spread: str, factor: float) -> DataFrame:
    c = finite(column)
    out = df.withColumns({"ucl": F.col("center") + factor * F.col(spread), "lcl": F.col("center") - factor * F.col(spread)})
    return out.withColumn("out_of_control", (c > F.col("ucl")) | (c < F.col("lcl"))).drop(spread)


def xbar_chart(df: DataFrame, column: str, by=None) -> DataFrame:
    """Mean ± 3 standard deviations and the rows outside."""
    by = keys(by)
    c = finite(column)
    rows = with_stats(df.filter(c.isNotNull()), by, {"center": F.avg(c), "_s": F.stddev_samp(c)})
    return _with_limits(rows, column, "_s", 3.0)


def imr_chart(df: DataFrame, column: str, by, order) -> DataFrame:
    """Mean ± 2.66 average moving ranges and the rows outside."""
    by, order = keys(by), keys(order)
    c = finite(column)
    fr = frame(df.filter(c.isNotNull()), by, order, 1, 0)
    rows = fr.own(fr.df.withColumn("moving_range", F.abs(c - F.lag(c).over(fr.window()))))
    rows = with_stats(rows, by, {"center": F.avg(c), "_mr": F.avg("moving_range")})
    return _with_limits(rows, column, "_mr", 2.66)


def pareto(df: DataFrame, column: str, order, by=None) -> DataFrame:
    """Magnitudes from largest to smallest with the cumulative percentage and the 80 % mark."""
    by = keys(by)
    rows = df.withColumn("size", F.abs(finite(column))).filter(F.col("size").isNotNull())
    rows = with_stats(rows, by, {"_total": F.sum("size")}).filter("_total > 0").withColumn("_neg", -F.col("size"))
    lay = lay_out(rows, by, ["_neg"] + keys(order))
    out = lay.done(lay.scan({"position": ("index",), "_cum": ("sum", "size")}))
    out = out.withColumn("cumulative_percent", F.col("_cum") / F.col("_total") * 100)
    return out.withColumn("within_80", F.col("cumulative_percent") <= 80).drop("_neg", "_cum", "_total")


def main_effects(df: DataFrame, columns: list[str], by=None) -> DataFrame:
    """Mean of each column and the mean of those means."""
    by = keys(by)
    means = unpivot_columns(df, columns, by).filter(finite("value").isNotNull()).groupBy(*by, "column").agg(
        F.avg("value").alias("mean"))
    return with_stats(means, by, {"grand_mean": F.avg("mean")})


def interaction_means(df: DataFrame, factor: str, responses: list[str], by=None) -> DataFrame:
    """Mean of each response where the factor is at or below its median, and above it.

    Responses are summed per value of the factor first, so single rows meet neither the medians nor one task per group.
    """
    by = keys(by)
    g = finite(F.col(f"`{factor}`"))
    rows = df.select(*by, g.alias("_g"), *[finite(F.col(f"`{c}`")).alias(c) for c in responses]).unpivot(
        by + ["_g"], responses, "response", "_v").filter(F.col("_g").isNotNull() & F.col("_v").isNotNull())
    cell = by + ["response"]
    sums = rows.groupBy(*cell, "_g").agg(F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_n"))
    sums = with_table(sums, medians(sums, cell, {"_m": "_g"}, "_n"), cell)
    low = F.col("_g") <= F.col("_m")
    mean = lambda side: F.sum(F.when(side, F.col("_v"))) / F.sum(F.when(side, F.col("_n")))
    return sums.groupBy(*cell).agg(mean(low).alias("low_mean"), mean(~low).alias("high_mean"))


def mean_intervals(df: DataFrame, columns: list[str], by=None) -> DataFrame:
    """Mean, standard deviation and the half width 1.96·sd/√n of each column."""
    by = keys(by)
    long = unpivot_columns(df, columns, by).filter(finite("value").isNotNull())
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return long.groupBy(*by, "column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), sd.alias("sd"),
        (1.96 * sd / F.sqrt(F.count("value"))).alias("ci_half"))


def wind_rose(df: DataFrame, angle: str, weight: str, by=None, sectors: int = 16) -> DataFrame:
    """Total weight magnitude per sector; angles above 2π+0.1 anywhere in a series mean degrees."""
    by = keys(by)
    rows = df.select(*by, finite(angle).alias("_a"), finite(weight).alias("_w"))
    rows = with_stats(rows, by, {"_big": F.max(F.abs("_a"))}).filter(F.col("_a").isNotNull() & F.col("_w").isNotNull())
    turn = 2 * math.pi
    theta = F.when(F.col("_big") > turn + 0.1, F.radians("_a")).otherwise(F.col("_a"))
    slot = F.least(F.floor(F.pmod(theta, F.lit(turn)) / F.lit(turn / sectors)), F.lit(sectors - 1)).cast("int")
    sums = rows.groupBy(*by, slot.alias("sector")).agg(F.sum(F.abs("_w")).alias("_t"))
    grid = _positions(rows.select(*by).distinct() if by else rows.agg(F.lit(1).alias("_one")), sectors, "sector").drop("_one")
    out = join_by(grid, sums, by + ["sector"])
    return out.select(*by, "sector", ((F.col("sector") + 0.5) * (turn / sectors)).alias("center"),
                      F.coalesce("_t", F.lit(0.0)).alias("total"))


def hex_bins(df: DataFrame, x: str, y: str, gridsize: int = 24, by=None) -> DataFrame:
    """Point counts of hexagonal cells: each point goes to the nearer of two offset lattices."""
    by = keys(by)
    rows = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rows = with_stats(rows, by, {"_x0": F.min("_x"), "_x1": F.max("_x"), "_y0": F.min("_y"), "_y1": F.max("_y")})
    ny = int(gridsize / math.sqrt(3))
    pad = lambda lo, hi: F.lit(1e-9) * (F.col(hi) - F.col(lo))
    left, low = F.col("_x0") - pad("_x0", "_x1"), F.col("_y0") - pad("_y0", "_y1")
    sx = (F.col("_x1") + pad("_x0", "_x1") - left) / gridsize
    sy = (F.col("_y1") + pad("_y0", "_y1") - low) / ny
    rows = rows.withColumns({"_sx": sx, "_sy": sy, "_l": left, "_b": low}).filter("_sx > 0 AND _sy > 0")
    ix, iy = (F.col("_x") - F.col("_l")) / F.col("_sx"), (F.col("_y") - F.col("_b")) / F.col("_sy")
    rows = rows.withColumns({"_ix": ix, "_iy": iy})
    a = (F.bround("_ix", 0), F.bround("_iy", 0))
    b = (F.floor("_ix") + 0.5, F.floor("_iy") + 0.5)
    dist = lambda c: (F.col("_ix") - c[0]) * (F.col("_ix") - c[0]) + 3 * (F.col("_iy") - c[1]) * (F.col("_iy") - c[1])
    first = dist(a) < dist(b)
    rows = rows.withColumns({"cell_x": F.when(first, a[0]).otherwise(b[0]), "cell_y": F.when(first, a[1]).otherwise(b[1])})
    return rows.groupBy(*by, "cell_x", "cell_y").agg(
        F.first(F.col("_l") + F.col("cell_x") * F.col("_sx")).alias("x"),
        F.first(F.col("_b") + F.col("cell_y") * F.col("_sy")).alias("y"), F.count(F.lit(1)).alias("count"))


def bode_table(df: DataFrame, frequency: str, real: str | None = None, imag: str | None = None,
               magnitude: str | None = None, phase: str | None = None) -> DataFrame:
    """Gain in dB and phase in degrees for positive frequencies, from re/im or magnitude/phase."""
    f = finite(frequency)
    if real and imag:
        m, p = F.hypot(finite(real), finite(imag)), F.degrees(F.atan2(finite(imag), finite(real)))
    else:
        m, p = finite(magnitude), finite(phase)
    rows = df.withColumns({"_m": m, "phase_deg": p}).filter((f > 0) & F.col("phase_deg").isNotNull() & (F.abs("_m") > 0))
    return rows.withColumn("gain_db", 20 * F.log10(F.abs("_m"))).drop("_m")


def nyquist_table(df: DataFrame, frequency: str, real: str, imag: str) -> DataFrame:
    """Complete rows with the negated imaginary part, the modulus and the phase, sorted by frequency."""
    rows = df.filter(finite(frequency).isNotNull() & finite(real).isNotNull() & finite(imag).isNotNull())
    return rows.withColumns({"minus_imag": -finite(imag), "modulus": F.hypot(finite(real), finite(imag)),
                             "phase_deg": F.degrees(F.atan2(finite(imag), finite(real)))}).orderBy(frequency)


def phase_pairs(df: DataFrame, column: str, by, order) -> DataFrame:
    """Each value with the next one of its series."""
    c = finite(column)
    fr = frame(df.filter(c.isNotNull()), keys(by), keys(order), 0, 1)
    return fr.own(fr.df.withColumn("next_value", F.lead(c).over(fr.window()))).filter(F.col("next_value").isNotNull())


def row_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over the sum of the columns of its row (a zero sum counts as 1)."""
    total = add_all([F.col(f"`{c}`") for c in columns])
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return df.withColumns({f"{c}_share": F.col(f"`{c}`") / safe for c in columns})


def magnitude_shares(df: DataFrame, column: str, by=None) -> DataFrame:
    """|value| over the sum of magnitudes of the series."""
    v = F.abs(finite(column))
    out = with_stats(df, keys(by), {"_t": F.sum(v)})
    return out.withColumn("share", div(v, F.col("_t"))).drop("_t")


def stacked_offsets(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Long table of columns shifted apart by 1.2 times the median column range."""
    spans = unpivot_columns(df, columns).filter(finite("value").isNotNull()).groupBy("column").agg(
        (F.max("value") - F.min("value")).alias("_s"))
    step = spans.filter("_s > 0").agg((F.coalesce(F.median("_s"), F.lit(1.0)) * 1.2).alias("_step"))
    long = df.select(*order, *[finite(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(order, columns, "column", "value")
    rank = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1
    out = with_table(long, step, [])
    return out.withColumn("shifted", F.col("value") + rank * F.col("_step")).drop("_step")
