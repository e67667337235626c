"""Peaks, baselines, exposure cycles and the single-curve metrics of laboratory series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtab.functions.numeric import div, finite, keys, x_number
from sigtab.operators import derive
from sigtab.operators.joins import interpolate_join
from sigtab.plans.banded import als_baseline, reach
from sigtab.plans.crossing import nearest_crossing
from sigtab.plans.layout import (
    cut_lineage, frame, join_by, lay_out, lend_borders, rows_per_task, with_index, with_stats, with_table)
from sigtab.plans.normeq import with_polynomial
from sigtab.plans.quantile import medians, quantiles


# ---- baselines ----

def quantile_polynomial_baseline(df: DataFrame, x: str, y: str, degree: int = 2, quantile: float = 0.2, by=None,
                                 name: str = "baseline") -> DataFrame:
    """Polynomial through the points at or below a quantile of ``y``, plus the corrected value.

    A series with too few such points is fitted on all of them.
    """
    if not 0 <= degree <= 5:
        raise ValueError("degree must be between 0 and 5")
    by = keys(by)
    rows = df.filter(finite(y).isNotNull() & x_number(df, x).isNotNull())
    rows = with_table(rows, quantiles(rows, by, {"_q": finite(y)}, [quantile]), by)
    low = finite(y) <= F.get("_q", F.lit(0))
    rows = with_stats(rows.withColumn("_low", low), by, {"_k": F.count_if("_low")})
    use = F.col("_low") | (F.col("_k") <= degree)
    out = with_polynomial(rows, x_number(df, x), finite(y), degree, by, name, rows=use)
    return out.withColumn("corrected", finite(y) - F.col(name)).drop("_q", "_low", "_k")


def simple_baseline(df: DataFrame, x: str, y: str, method: str = "linear", by=None, quantile: float = 0.1,
                    name: str = "baseline") -> DataFrame:
    """``none``, ``constant`` (a quantile of y) or ``linear`` (a line through both ends of the series)."""
    by = keys(by)
    if method == "none":
        return df.withColumn(name, F.lit(0.0))
    rows = df.filter(finite(y).isNotNull() & x_number(df, x).isNotNull())
    if method == "constant":
        out = with_table(rows, quantiles(rows, by, {"_q": finite(y)}, [quantile]), by)
        return out.withColumn(name, F.get("_q", F.lit(0))).drop("_q")
    if method != "linear":
        raise ValueError(f"unknown baseline: {method}")
    indexed = with_stats(with_index(rows.withColumn("_h", F.xxhash64(*df.columns)), by, [x, "_h"], "_i"), by,
                         {"_n": F.count(F.lit(1))})
    edge = F.greatest(F.lit(3), F.least(F.floor(F.col("_n") / 5), F.greatest(F.lit(3), F.floor(F.col("_n") / 10))))
    inside = (F.col("_i") < edge) | (F.col("_i") >= F.col("_n") - edge)
    out = with_polynomial(indexed, x_number(df, x), finite(y), 1, by, name, rows=inside)
    return out.drop("_h", "_i", "_n")


def als(df: DataFrame, x: str, y: str, by=None, lam: float = 1e5, p: float = 0.01, rounds: int = 10,
        name: str = "baseline") -> DataFrame:
    """Asymmetric-least-squares baseline of each spectrum in order of ``x``.

    A spectrum of up to one task's rows is solved whole. Longer ones are solved in chunks whose
    borders overlap by the distance at which the penalty forgets them.
    """
    by = keys(by)
    limit = rows_per_task(df.sparkSession)
    rows = df.filter(finite(y).isNotNull() & x_number(df, x).isNotNull()).withColumn("_h", F.xxhash64(*df.columns))
    halo = reach(lam, p, rounds)
    fr = frame(rows, by, [x, "_h"], halo, halo, limit=limit)
    out = fr.df.withColumn(name, F.lit(0.0))
    order, target = list(fr.order), y

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        pdf[name] = als_baseline(pdf[target].to_numpy(float), lam, p, rounds)
        return pdf

    done = out.groupBy(*fr.parts).applyInPandas(solve, out.schema)
    return fr.own(done).drop("_h")


def remove_baseline(df: DataFrame, x: str, y: str, method: str = "linear", by=None, name: str = "corrected",
                    direction: str = "positive", **options) -> DataFrame:
    """``y`` minus one of the peak baselines; for negative peaks the baseline is found on the mirrored curve."""
    sign = -1.0 if direction == "negative" else 1.0
    work = df.withColumn("_s", sign * finite(y))
    made = als(work, x, "_s", by, name="_b", **options) if method == "als" else simple_baseline(
        work, x, "_s", method, by, name="_b", **options)
    return made.withColumn(name, finite(y) - sign * F.col("_b")).drop("_s", "_b")


# ---- peaks ----

def keep_spaced(cands: DataFrame, by: list[str], index: str, score: str, distance: int) -> DataFrame:
    """Highest first, drop candidates within ``distance`` positions of one already kept; ties go to the earlier.

    Every round keeps what is highest in its own neighbourhood and drops its neighbours, which is
    the same choice. Rounds look only ``2 * distance`` positions around, so no series is collected.
    """
    if distance < 1:
        return cands
    size = max(rows_per_task(cands.sparkSession), 2 * distance)
    rest, kept = cut_lineage(cands), None
    while not rest.isEmpty():
        lent = lend_borders(rest, size, 2 * distance, 2 * distance, index)
        w = Window.partitionBy(*by, "_c").orderBy(index).rangeBetween(-distance, distance)
        rank = F.struct(F.col(score), -F.col(index))
        marked = lent.withColumn("_top", F.max(rank).over(w) == rank)
        marked = marked.withColumn("_near", F.max("_top").over(w)).filter("_own").drop("_own", "_c")
        marked = cut_lineage(marked)
        top = marked.filter("_top").drop("_top", "_near")
        kept = top if kept is None else kept.unionByName(top)
        rest = marked.filter("NOT _near").drop("_top", "_near")
    return cands.limit(0) if kept is None else kept


def extrema(df: DataFrame, x: str, y: str, by=None, order=None, polarity: str = "peaks", height: float = 0.0,
            prominence: float = 0.0, min_distance: int = 1, smooth: int = 1) -> DataFrame:
    """Strict local maxima or minima (``peaks``, ``troughs``, ``both``) with row number, position, value and kind.

    ``prominence`` compares with the lowest value within ``max(min_distance, 3)`` rows.
    ``min_distance`` above 1 keeps the highest first.
    """
    by, order = keys(by), keys(order) or [x]
    rows = with_index(df.filter(finite(y).isNotNull()), by, order, "row_index")
    if smooth > 1:
        from sigtab.operators.signal import boxcar
        rows = boxcar(rows, y, smooth, by, ["row_index"], "_y")
    else:
        rows = rows.withColumn("_y", finite(y))
    win = max(min_distance, 3)
    out = None
    for kind, sign in (("peak", 1.0), ("trough", -1.0)):
        if polarity not in ("both", kind + "s"):
            continue
        fr = frame(rows.withColumn("_s", sign * F.col("_y")), by, ["row_index"], win, max(win - 1, 1))
        w = fr.window()
        s, b, a = F.col("_s"), F.lag("_s").over(w), F.lead("_s").over(w)
        marked = fr.df.withColumns({
            "_hit": (b.isNull() | (s > b)) & (a.isNull() | (s > a)),
            "_low": F.min("_s").over(w.rowsBetween(-win, win - 1))})
        found = fr.own(marked).filter("_hit").drop("_hit")
        if height > 0:
            found = found.filter(F.col("_s") >= height)
        if prominence > 0:
            found = found.filter(F.col("_s") - F.col("_low") >= prominence)
        if min_distance > 1:
            found = keep_spaced(found, by, "row_index", "_s", min_distance)
        found = found.select(*by, "row_index", F.col(x).alias("x_peak"), F.col("_y").alias("y_peak"), F.lit(kind).alias("kind"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError(f"unknown polarity: {polarity}")
    return out


def spectrum_peaks(df: DataFrame, x: str, y: str, by=None, threshold: float = 0.1, min_distance: int = 1) -> DataFrame:
    """Local maxima above a share of the range, with the width at half height and the clipped area.

    Both ends of a peak are the nearest rows at or below half its height, or the ends of the spectrum.
    """
    by = keys(by)
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = with_index(rows, by, ["x", "y"], "i")
    rows = with_stats(rows, by, {"_lo": F.min("y"), "_hi": F.max("y"), "_last": F.max("i")})
    clipped = derive.integrate(rows.withColumn("_pos", F.greatest("y", F.lit(0.0))), "_pos", "x", by, ["i"], "cum_area")
    clipped = cut_lineage(clipped.drop("_pos"))
    fr = frame(clipped, by, ["i"], 1, 1)
    w = fr.window()
    hit = (F.col("y") >= F.lag("y").over(w)) & (F.col("y") >= F.lead("y").over(w))
    peaks = fr.own(fr.df.withColumn("_hit", hit)).filter("_hit").drop("_hit").filter(
        F.col("y") >= F.col("_lo") + threshold * (F.col("_hi") - F.col("_lo")))
    if min_distance > 1:
        peaks = keep_spaced(peaks, by, "i", "y", min_distance - 1)
    asks = peaks.select(*by, "i", F.col("i").alias("at"), (-F.col("y") / 2).alias("level"))
    sink = clipped.select(*by, "i", (-F.col("y")).alias("v"))
    sides = {}
    for side in ("left", "right"):
        got = nearest_crossing(sink, by, "i", "v", asks, "i", strict=False, side=side)
        sides[side] = got.select(*by, "i", F.col("found").alias(side))
    out = join_by(join_by(peaks, sides["left"], by + ["i"]), sides["right"], by + ["i"])
    # a peak already at or below half of its height (negative values) has no width
    flat = F.col("y") <= F.col("y") / 2
    out = out.withColumns({
        "left": F.when(flat, F.col("i")).otherwise(F.coalesce("left", F.lit(0))),
        "right": F.when(flat, F.col("i")).otherwise(F.coalesce("right", F.col("_last")))})
    for side in ("left", "right"):
        ends = clipped.select(*by, F.col("i").alias(side), F.col("x").alias(f"{side}_x"), F.col("cum_area").alias(f"{side}_a"))
        out = join_by(out, ends, by + [side])
    wide = F.col("right") > F.col("left")
    return out.select(*by, F.col("x").alias("position"), F.col("y").alias("height"),
                      F.when(wide, F.col("right_x") - F.col("left_x")).alias("fwhm"),
                      F.when(wide, F.col("right_a") - F.col("left_a")).otherwise(F.lit(0.0)).alias("area"))


def default_prominence(rows: DataFrame, by: list[str], signal: str, index: str) -> DataFrame:
    """Per series the larger of three times the noise (from the median step) and 3 % of the range."""
    fr = frame(rows, by, [index], 1, 0)
    steps = fr.own(fr.df.withColumn("_d", F.col(signal) - F.lag(signal).over(fr.window())))
    steps = with_table(steps, medians(steps, by, {"_m": "_d"}), by)
    mad = medians(steps.withColumn("_a", F.abs(F.col("_d") - F.col("_m"))), by, {"_mad": "_a"})
    span = rows.groupBy(*by).agg((F.max(signal) - F.min(signal)).alias("_span"))
    out = with_table(span, mad, by)
    noise = 3 * 1.4826 * F.coalesce("_mad", F.lit(0.0)) / np.sqrt(2.0)
    eps = float(np.finfo(float).eps)
    return out.select(*by, F.greatest(noise, 0.03 * F.col("_span"), F.lit(eps)).alias("min_prominence"))


def detect_peaks(df: DataFrame, x: str, y: str, by=None, baseline: str = "linear", direction: str = "positive",
                 prominence: float | None = None, height: float | None = None, distance: int | None = None,
                 width: float | None = None, max_peaks: int | None = None, **options) -> DataFrame:
    """Peaks of the baseline-corrected curve by prominence; all of them, or the ``max_peaks`` most prominent ones.

    Flat tops count once, at their middle row. Columns: ``i`` (row in order of x), ``x``, ``y``,
    ``height`` (corrected), ``prominence``, ``width`` (rows, when asked for).
    """
    by = keys(by)
    fixed = remove_baseline(df, x, y, baseline, by, "_cor", direction, **options)
    sig = {"positive": F.col("_cor"), "negative": -F.col("_cor"), "both": F.abs("_cor")}[direction]
    rows = fixed.filter(finite("_cor").isNotNull()).select(*by, x_number(df, x).alias("x"), finite(y).alias("y"), sig.alias("_sg"))
    rows = cut_lineage(with_index(rows.withColumn("_h", F.xxhash64("x", "y", "_sg")), by, ["x", "_h"], "i").drop("_h"))
    fr = frame(rows, by, ["i"], 1, 0)
    fresh = F.when(F.col("_sg") == F.lag("_sg").over(fr.window()), F.lit(0)).otherwise(F.lit(1))
    lay = lay_out(fr.own(fr.df.withColumn("_new", fresh)), by, ["i"])
    runs = lay.done(lay.scan({"_run": ("sum", "_new")})).groupBy(*by, "_run").agg(
        F.min("i").alias("_a"), F.max("i").alias("_z"), F.first("_sg").alias("_sg"))
    fr = frame(runs, by, ["_run"], 1, 1)
    w = fr.window()
    top = (F.col("_sg") > F.lag("_sg").over(w)) & (F.col("_sg") > F.lead("_sg").over(w))
    peaks = fr.own(fr.df.withColumn("_top", top)).filter("_top").select(
        *by, F.floor((F.col("_a") + F.col("_z")) / 2).cast("bigint").alias("i"), "_a", "_z", "_sg")
    if height is not None:
        peaks = peaks.filter(F.col("_sg") >= height)
    if distance is not None:
        peaks = keep_spaced(peaks, by, "i", "_sg", distance - 1)
    asks = peaks.select(*by, "i", F.col("i").alias("at"), F.col("_sg").alias("level"))
    low = None
    for side in ("left", "right"):
        got = nearest_crossing(rows, by, "i", "_sg", asks, "i", strict=True, side=side).select(*by, "i", F.col("span_min").alias(side))
        low = got if low is None else join_by(low, got, by + ["i"])
    peaks = join_by(peaks, low, by + ["i"])
    base = F.greatest(F.least("left", "_sg"), F.least("right", "_sg"))
    peaks = peaks.withColumn("prominence", F.col("_sg") - base).drop("left", "right")
    if prominence is None:
        peaks = with_table(peaks, default_prominence(rows, by, "_sg", "i"), by).filter("prominence >= min_prominence").drop("min_prominence")
    else:
        peaks = peaks.filter(F.col("prominence") >= prominence)
    if width is not None:
        peaks = _peak_widths(rows, peaks, by).filter(F.col("width") >= width)
    if max_peaks is not None:
        ranked = lay_out(peaks.withColumn("_neg", -F.col("prominence")), by, ["_neg", "i"])
        peaks = ranked.done(ranked.scan({"_k": ("index",)})).filter(F.col("_k") < max_peaks).drop("_k", "_neg")
    out = join_by(peaks.withColumnRenamed("_sg", "height"), rows.select(*by, "i", "x", "y"), by + ["i"])
    return out.select(*by, "i", "x", "y", "height", "prominence", *(["width"] if width is not None else []))


def _peak_widths(rows: DataFrame, peaks: DataFrame, by: list[str]) -> DataFrame:
    """Width in rows at half prominence, with interpolated crossings."""
    level = F.col("_sg") - F.col("prominence") / 2
    asks = peaks.select(*by, "i", F.col("i").alias("at"), (-level).alias("level"))
    sink = rows.select(*by, "i", (-F.col("_sg")).alias("v"))
    out = peaks.withColumn("_l", level)
    for side, step in (("left", 1), ("right", -1)):
        got = nearest_crossing(sink, by, "i", "v", asks, "i", strict=False, side=side).select(*by, "i", F.col("found").alias("_f"))
        out = join_by(out, got, by + ["i"])
        at = rows.select(*by, F.col("i").alias("_f"), F.col("_sg").alias("_s0"))
        inner = rows.select(*by, (F.col("i") - step).alias("_f"), F.col("_sg").alias("_s1"))
        out = join_by(join_by(out, at, by + ["_f"]), inner, by + ["_f"])
        share = F.when(F.col("_s0") < F.col("_l"), div(F.col("_l") - F.col("_s0"), F.col("_s1") - F.col("_s0"))).otherwise(F.lit(0.0))
        out = out.withColumn(f"_{side}", F.col("_f") + step * share).drop("_f", "_s0", "_s1")
    return out.withColumn("width", F.col("_right") - F.col("_left")).drop("_left", "_right", "_l")


# ---- cycles and exposure ----

def detect_cycles(df: DataFrame, t: str, y: str, by=None, threshold: float = 0.05, min_points: int = 3) -> DataFrame:
    """Runs of at least ``min_points`` rows that leave the median by a share of it, in the direction of the
    larger excursion. Columns ``t_on, t_off, points``."""
    by = keys(by)
    rows = df.select(*by, x_number(df, t).alias("_t"), finite(y).alias("_y")).filter("_t IS NOT NULL AND _y IS NOT NULL")
    rows = with_table(rows, medians(rows, by, {"_m": "_y"}), by)
    dev = F.col("_y") - F.col("_m")
    rows = with_stats(rows, by, {"_up": F.max(dev), "_down": F.min(dev), "_big": F.max(F.abs("_y"))})
    scale = F.when(F.col("_m") != 0, F.abs("_m")).when(F.col("_big") > 0, F.col("_big")).otherwise(F.lit(1.0))
    sign = F.when(F.abs("_up") >= F.abs("_down"), F.lit(1.0)).otherwise(F.lit(-1.0))
    rows = rows.withColumn("_on", dev * sign > threshold * scale).select(*by, "_t", "_y", "_on")
    fr = frame(rows, by, ["_t", "_y"], 1, 0)
    change = F.when(F.lag("_on").over(fr.window()) == F.col("_on"), F.lit(0)).otherwise(F.lit(1))
    lay = lay_out(fr.own(fr.df.withColumn("_ch", change)), by, ["_t", "_y"])
    runs = lay.done(lay.scan({"_run": ("sum", "_ch")})).filter("_on").groupBy(*by, "_run").agg(
        F.min("_t").alias("t_on"), F.max("_t").alias("t_off"), F.count(F.lit(1)).alias("points"))
    return runs.filter(F.col("points") >= min_points).select(*by, "t_on", "t_off", "points")


def exposure_response(df: DataFrame, t: str, y: str, cycles: DataFrame, by=None,
                      baseline_window: float | None = None) -> DataFrame:
    """Baseline, steady value, response %, sensitivity and t90 times of each exposure ``(t_on, t_off)``.

    Exposures of a series must not overlap. The baseline is the median before ``t_on`` (of the last
    ``baseline_window`` when given); the steady value is the median of the last quarter of the exposure.
    """
    by = keys(by)
    rows = df.select(*by, x_number(df, t).alias("t"), finite(y).alias("y")).filter("t IS NOT NULL AND y IS NOT NULL")
    rows = cut_lineage(with_index(rows, by, ["t", "y"], "i"))
    runs = cycles.select(*by, F.col("t_on").cast("double").alias("t_on"), F.col("t_off").cast("double").alias("t_off")).filter("t_on < t_off")
    runs = cut_lineage(runs.withColumn("cycle", F.xxhash64(*by, "t_on", "t_off")))
    cell = by + ["cycle"]
    # readings meet the last exposure that began at or before them, in one ordered pass
    begin = runs.select(*by, F.col("t_on").alias("_t"), F.lit(0).alias("_side"), F.struct("cycle", "t_on", "t_off").alias("_c"),
                        F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("y"))
    read = rows.select(*by, F.col("t").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(begin.schema["_c"].dataType).alias("_c"), "i", "y")
    lay = lay_out(begin.unionByName(read), by, ["_t", "_side", "i"])
    inside = lay.done(lay.scan({"_last": ("last", "_c")})).filter((F.col("_side") == 1) & F.col("_last").isNotNull())
    inside = inside.select(*by, F.col("_last.cycle").alias("cycle"), F.col("_last.t_on").alias("t_on"),
                           F.col("_last.t_off").alias("t_off"), F.col("_t").alias("t"), "i", "y")
    exposed = with_stats(inside.filter("t <= t_off"), cell, {"_t0": F.min("t"), "_t1": F.max("t"), "_k": F.count(F.lit(1))})
    tail = exposed.filter((F.col("_k") >= 2) & (F.col("t") >= F.col("_t0") + 0.75 * (F.col("_t1") - F.col("_t0"))))
    out = join_by(runs, medians(tail, cell, {"steady": "y"}), cell, "inner")
    out = join_by(out, _baselines(rows, runs, by, baseline_window), cell, "inner").filter("baseline <> 0")
    delta = F.col("steady") - F.col("baseline")
    lo, hi = F.least("baseline", "steady"), F.greatest("baseline", "steady")
    out = out.withColumns({
        "response_percent": F.abs(delta) / F.abs("baseline") * 100,
        "sensitivity": F.when(lo > 0, hi / F.when(lo > 0, lo)).otherwise(F.lit(float("inf")))})
    at_off = interpolate_join(out.select(*cell, "t_off"), rows.select(*by, F.col("t").alias("_rt"), F.col("y").alias("_off")),
                              "t_off", "_rt", ["_off"], by).drop("t_off")
    out = cut_lineage(join_by(out, at_off, cell))
    goals = {"response_time": ("t_on", F.col("baseline") + 0.9 * delta, delta > 0),
             "recovery_time": ("t_off", F.col("_off") + 0.9 * (F.col("baseline") - F.col("_off")), F.col("baseline") > F.col("_off"))}
    for name, (start, goal, rising) in goals.items():
        out = join_by(out, _first_crossing(rows, out.select(*cell, F.col(start).alias("start"), goal.alias("goal"), rising.alias("rising")),
                                           by, name), cell)
    return out.drop("cycle", "_off")


def _baselines(rows: DataFrame, runs: DataFrame, by: list[str], window: float | None) -> DataFrame:
    """Median of the readings before each exposure.

    Readings are counted per value between exposures before they are offered to the later
    exposures of their series, so the work grows with exposures and distinct values.
    """
    cell = by + ["cycle"]
    starts = runs.select(*by, "cycle", "t_on")
    lay = lay_out(starts, by, ["t_on"])
    starts = lay.done(lay.scan({"seg": ("index",)}))
    begin = starts.select(*by, F.col("t_on").alias("_t"), F.lit(0).alias("_side"), (F.col("seg") + 1).alias("_s"), F.lit(None).cast("double").alias("y"))
    read = rows.select(*by, F.col("t").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_s"), "y")
    lay = lay_out(begin.unionByName(read).withColumn("_h", F.xxhash64("_t", "y")), by, ["_t", "_side", "_h"])
    placed = lay.done(lay.scan({"_seg": ("last", "_s")})).filter("_side = 1").withColumn("_seg", F.coalesce("_seg", F.lit(0)))
    kept = placed.select(*by, "_seg", "_t", "y")
    if window is None:
        kept = kept.groupBy(*by, "_seg", "y").agg(F.count(F.lit(1)).alias("_n"))
    else:
        kept = kept.withColumn("_n", F.lit(1))
    marks = starts.select(*[F.col(k).alias(f"_m_{k}") for k in by], "cycle", "t_on", "seg")
    cond = F.col("_seg") <= F.col("seg")
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    if window is not None:
        cond = cond & (F.col("_t") >= F.col("t_on") - window)
    met = kept.join(marks, cond).groupBy(*cell, "y").agg(F.sum("_n").alias("_n"))
    lay = lay_out(met, cell, ["y"])
    cum = lay.done(lay.scan({"_cum": ("sum", "_n")}))
    cum = with_table(cum, cum.groupBy(*cell).agg(F.max("_cum").alias("_size")), cell)
    half = (F.col("_size") - 1) / 2
    low = F.min(F.when(F.col("_cum") > F.floor(half), F.col("y")))
    high = F.min(F.when(F.col("_cum") > F.ceil(half), F.col("y")))
    return cum.groupBy(*cell).agg(((low + high) / 2).alias("baseline"))


def _first_crossing(rows: DataFrame, goals: DataFrame, by: list[str], name: str) -> DataFrame:
    """Time from ``start`` to the first interpolated crossing of ``goal``, null when it is never reached."""
    cell = by + ["cycle"]
    # position just before the first reading at or after the start
    begin = goals.select(*by, "cycle", F.col("start").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("i"))
    read = rows.select(*by, F.lit(None).cast("bigint").alias("cycle"), F.col("t").alias("_t"), F.lit(1).alias("_side"), "i")
    lay = lay_out(begin.unionByName(read), by, ["_t", "_side", "i", "cycle"])
    placed = lay.done(lay.scan({"_next": ("next", "i")})).filter("_side = 0 AND _next IS NOT NULL").select(*cell, F.col("_next").alias("first"))
    asks = join_by(goals, placed, cell, "inner").withColumn("at", F.col("first") - 1)
    found = None
    for up, sign in ((True, 1.0), (False, -1.0)):
        part = asks.filter(F.col("rising") == up).select(*by, "cycle", "at", (sign * F.col("goal")).alias("level"))
        got = nearest_crossing(rows.select(*by, "i", (sign * F.col("y")).alias("v")), by, "i", "v", part, "cycle", strict=False, side="right")
        got = got.select(*cell, F.col("found").alias("j"))
        found = got if found is None else found.unionByName(got)
    hit = join_by(asks, found, cell, "inner").filter("j IS NOT NULL")
    here = rows.select(*by, F.col("i").alias("j"), F.col("t").alias("t1"), F.col("y").alias("y1"))
    back = rows.select(*by, (F.col("i") + 1).alias("j"), F.col("t").alias("t0"), F.col("y").alias("y0"))
    hit = join_by(join_by(hit, here, by + ["j"]), back, by + ["j"])
    when = F.when((F.col("j") == F.col("first")) | (F.col("y1") == F.col("y0")), F.col("t1")).otherwise(
        F.col("t0") + div(F.col("goal") - F.col("y0"), F.col("y1") - F.col("y0")) * (F.col("t1") - F.col("t0")))
    return hit.select(*cell, F.greatest(when - F.col("start"), F.lit(0.0)).alias(name))


# ---- one-row metrics of a curve ----

def cv_metrics(df: DataFrame, potential: str, current: str, order, by=None) -> DataFrame:
    """Oxidation (highest) and reduction (lowest) current with their potentials, separation and ratio."""
    by, order = keys(by), keys(order)
    e, i = finite(potential), finite(current)
    rows = df.filter(e.isNotNull() & i.isNotNull())
    place = F.struct(*[F.col(c) for c in order])
    t = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.max(i).alias("oxidation_current"), F.min_by(e, F.struct(-i, place)).alias("oxidation_potential"),
        F.min(i).alias("reduction_current"), F.min_by(e, F.struct(i, place)).alias("reduction_potential")).filter("_n >= 3")
    ratio = F.abs(div(F.col("oxidation_current"), F.col("reduction_current")))
    return t.withColumns({"delta_ep": F.abs(F.col("oxidation_potential") - F.col("reduction_potential")),
                          "current_ratio": F.coalesce(ratio, F.lit(float("inf")))}).drop("_n")


def discharge_metrics(df: DataFrame, time: str, voltage: str, current_a: float, mass_g: float | None = None, by=None) -> DataFrame:
    """Discharge after the voltage maximum: time, drop, capacitance and, with a mass, specific values."""
    if current_a == 0:
        raise ValueError("the current must not be zero")
    by = keys(by)
    rows = df.select(*by, x_number(df, time).alias("_t"), finite(voltage).alias("_v")).filter("_t IS NOT NULL AND _v IS NOT NULL")
    rows = with_stats(rows, by, {"_peak": F.min_by("_t", F.struct(-F.col("_v"), F.col("_t"))), "_all": F.count(F.lit(1))})
    t = rows.filter("_all >= 3 AND _t >= _peak").groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("_t") - F.min("_t")).alias("discharge_time_s"),
        (F.max(F.when(F.col("_t") == F.col("_peak"), F.col("_v"))) - F.max_by("_v", "_t")).alias("voltage_window_v"))
    t = t.filter("_n >= 2 AND discharge_time_s > 0 AND voltage_window_v > 0").drop("_n")
    dt, dv = F.col("discharge_time_s"), F.col("voltage_window_v")
    t = t.withColumn("capacitance_f", abs(current_a) * dt / dv)
    if mass_g:
        t = t.withColumn("specific_capacitance_f_g", F.col("capacitance_f") / mass_g)
        t = t.withColumn("energy_wh_kg", 0.5 * F.col("specific_capacitance_f_g") * dv * dv / 3.6)
        t = t.withColumn("power_w_kg", F.col("energy_wh_kg") * 3600.0 / dt)
    return t


def impedance_metrics(df: DataFrame, frequency: str, zreal: str, zimag: str, by=None) -> DataFrame:
    """Series and charge-transfer resistance, low-frequency real part and modulus range of complete rows."""
    by = keys(by)
    f, r, i = finite(frequency), finite(zreal), finite(zimag)
    rows = df.filter(f.isNotNull() & r.isNotNull() & i.isNotNull())
    size = F.sqrt(r * r + i * i)
    t = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min(r).alias("rs_ohm"), F.min_by(r, F.struct(f, r)).alias("zreal_low_freq_ohm"),
        F.min(size).alias("zmod_min_ohm"), F.max(size).alias("zmod_max_ohm")).filter("_n >= 2").drop("_n")
    return t.withColumn("rct_ohm", F.greatest(F.lit(0.0), F.col("zreal_low_freq_ohm") - F.col("rs_ohm")))


def raman_ratio(df: DataFrame, x: str, y: str, by=None, d_range=(1200.0, 1450.0), g_range=(1500.0, 1700.0)) -> DataFrame:
    """Highest point within the D and the G window and their ratio; series without either are left out."""
    by = keys(by)
    px, py = finite(x), finite(y)
    aggs = []
    for name, (lo, hi) in (("d", d_range), ("g", g_range)):
        inside = px.between(float(lo), float(hi)) & py.isNotNull()
        aggs += [F.min_by(px, F.when(inside, F.struct(-py, px))).alias(f"{name}_position"), F.max(F.when(inside, py)).alias(f"{name}_intensity")]
    t = df.groupBy(*by).agg(*aggs).filter("d_intensity IS NOT NULL AND g_intensity <> 0")
    return t.withColumn("id_ig", F.col("d_intensity") / F.col("g_intensity"))


def thermal_transition(df: DataFrame, temperature: str, value: str, by=None, mode: str = "tga_loss",
                       onset_fraction: float = 0.05) -> DataFrame:
    """Transition peak from the steepest gradient and its onset, for TGA loss or DSC peaks."""
    by = keys(by)
    rows = df.select(*by, finite(temperature).alias("_t"), finite(value).alias("_v")).filter("_t IS NOT NULL AND _v IS NOT NULL")
    rows = derive.gradient(rows, "_v", "_t", by, ["_t", "_v"], "_g")
    at = F.struct("_t", "_v")
    score = {"tga_loss": F.col("_g"), "dsc_peak": -F.abs("_g")}.get(mode)
    if score is None:
        raise ValueError(f"unknown mode: {mode}")
    best = F.min_by(F.struct("_t", "_v", "_g"), F.when(F.col("_g").isNotNull(), F.struct(score, at)))
    rows = with_stats(rows, by, {"_n": F.count(F.lit(1)), "_best": best, "_first": F.min_by("_v", at), "_last": F.max_by("_v", at)})
    rows = rows.filter("_n >= 4")
    goal = F.col("_last") if mode == "tga_loss" else F.col("_best._v")
    level = F.col("_first") + onset_fraction * (goal - F.col("_first"))
    if mode == "tga_loss":
        hit = F.when(F.col("_last") < F.col("_first"), F.col("_v") <= level).otherwise(F.col("_v") >= level)
    else:
        hit = F.when(goal >= F.col("_first"), F.col("_v") >= level).otherwise(F.col("_v") <= level)
    return rows.groupBy(*by).agg(
        F.coalesce(F.min(F.when(hit, F.col("_t"))), F.min("_t")).alias("onset_temperature"),
        F.first("_best._t").alias("peak_temperature"), F.first("_best._g").alias("peak_rate"), F.first("_last").alias("final_value"))


def main_peak(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Points, trapezoid area, position, height and half-maximum width of the highest peak; one row per series.

    The level lies halfway between lowest and highest value; the crossing next to the peak on each
    side is interpolated. The width is null when the curve does not fall below it inside the data.
    """
    by = keys(by)
    rows = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    at = F.struct("_x", "_y")
    rows = with_stats(rows, by, {"_lo": F.min("_y"), "_hi": F.max("_y"), "_px": F.min_by("_x", F.struct(-F.col("_y"), F.col("_x")))})
    half = F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2
    rows = rows.withColumn("_half", half)
    fr = frame(rows, by, ["_x", "_y"], 1, 1)
    w = fr.window()
    near = fr.own(fr.df.withColumns({"_b": F.lag(at).over(w), "_a": F.lead(at).over(w)}))
    below = F.col("_y") < F.col("_half")
    cross = lambda other: F.col(f"{other}._x") + (F.col("_half") - F.col(f"{other}._y")) / F.when(
        F.col("_y") != F.col(f"{other}._y"), F.col("_y") - F.col(f"{other}._y")) * (F.col("_x") - F.col(f"{other}._x"))
    left = F.max_by(cross("_a"), F.when(below & (F.col("_x") < F.col("_px")), at))
    right = F.min_by(cross("_b"), F.when(below & (F.col("_x") > F.col("_px")), at))
    area = F.sum(F.coalesce((F.col("_y") + F.col("_b._y")) / 2 * (F.col("_x") - F.col("_b._x")), F.lit(0.0)))
    t = near.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), area.alias("area"), F.first("_px").alias("peak_x"),
                              F.max("_y").alias("peak_height"), left.alias("_l"), right.alias("_r"), F.min("_y").alias("_m"))
    width = F.when(F.col("peak_height") > F.col("_m"), F.abs(F.col("_r") - F.col("_l")))
    return t.filter("points >= 2").withColumn("fwhm", width).drop("_l", "_r", "_m")


def area_in_range(df: DataFrame, x: str, y: str, lo: float | None = None, hi: float | None = None, by=None) -> DataFrame:
    """Trapezoid area under y(x) of the points inside [lo, hi]."""
    by = keys(by)
    rows = df.select(*by, finite(x).alias("_x"), finite(y).alias("_y")).filter("_x IS NOT NULL AND _y IS NOT NULL")
    if lo is not None:
        rows = rows.filter(F.col("_x") >= lo)
    if hi is not None:
        rows = rows.filter(F.col("_x") <= hi)
    fr = frame(rows, by, ["_x", "_y"], 1, 0)
    w = fr.window()
    part = (F.col("_y") + F.lag("_y").over(w)) / 2 * (F.col("_x") - F.lag("_x").over(w))
    return fr.own(fr.df.withColumn("_p", part)).groupBy(*by).agg(F.sum("_p").alias("area"), F.count(F.lit(1)).alias("points")).filter("points >= 2")
