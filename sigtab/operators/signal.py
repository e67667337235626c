"""Smoothing, filtering, tapering, convolution and correlation of ordered series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtab.functions import filters
from sigtab.functions.numeric import div, finite, keys, x_number
from sigtab.plans import recursive
from sigtab.plans.batches import numbers
from sigtab.plans.fft import lag_products
from sigtab.plans.layout import BROADCAST_SERIES, cut_lineage, frame, join_by, lay_out, lend_borders, rows_per_task, with_index, with_stats, with_table
from sigtab.plans.local import apply_local, fir
from sigtab.plans.quantile import bracketed_medians, medians, mid_ranks


def moving_average(df: DataFrame, y: str, window: int = 25, by=None, order=None, name: str | None = None) -> DataFrame:
    """Trailing mean; null until a third of the window holds values."""
    fr = frame(df, keys(by), keys(order), window - 1, 0)
    w = fr.window().rowsBetween(-(window - 1), 0)
    v = finite(y)
    mean = F.when(F.count(v).over(w) >= max(1, window // 3), F.avg(v).over(w))
    return fr.own(fr.df.withColumn(name or f"{y}_MA{window}", mean))


def boxcar(df: DataFrame, y: str, window: int, by=None, order=None, name: str = "smooth") -> DataFrame:
    """Centred mean over ``window`` rows, zero beyond the ends."""
    back, ahead = window // 2, (window - 1) // 2
    fr = frame(df, keys(by), keys(order), back, ahead)
    return fr.own(fr.df.withColumn(name, F.sum(finite(y)).over(fr.window().rowsBetween(-back, ahead)) / window))


def median_filter(df: DataFrame, y: str, kernel: int = 5, by=None, order=None, name: str = "smooth") -> DataFrame:
    """Running median of an odd window, zero beyond the ends; the window shrinks to fit short series."""
    by = keys(by)
    k = kernel + 1 if kernel % 2 == 0 else kernel
    h = k // 2
    rows = with_stats(df.filter(finite(y).isNotNull()), by, {"_n": F.count(F.lit(1))})
    size = F.least(F.lit(k), F.when(F.col("_n") % 2 == 1, F.col("_n")).otherwise(F.greatest(F.col("_n") - 1, F.lit(1))))
    fr = frame(rows.withColumn("_k", size.cast("int")), by, keys(order), h, h)
    w = fr.window()
    before = F.collect_list(finite(y)).over(w.rowsBetween(-h, -1)) if h else F.array().cast("array<double>")
    after = F.collect_list(finite(y)).over(w.rowsBetween(1, h)) if h else F.array().cast("array<double>")
    half = (F.col("_k") / 2).cast("int")
    picked = F.concat(
        F.slice(F.reverse("_before"), F.lit(1), F.greatest(half, F.lit(0))), F.array(finite(y)),
        F.slice(F.col("_after"), F.lit(1), F.greatest(half, F.lit(0))))
    out = fr.df.withColumns({"_before": before, "_after": after})
    padded = F.sort_array(F.concat(picked, F.array_repeat(F.lit(0.0), F.col("_k") - F.size(picked))))
    return fr.own(out.withColumn(name, F.get(padded, half))).drop("_before", "_after", "_k", "_n")


def gaussian_smooth(df: DataFrame, y: str, sigma: float = 2.0, by=None, order=None, name: str = "smooth") -> DataFrame:
    """Gaussian weights to four standard deviations, mirrored at the ends."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    taps = filters.gaussian_taps(sigma)
    return fir(df, y, keys(by), keys(order), taps, len(taps) // 2, "reflect", name)


def savitzky_golay(df: DataFrame, y: str, window: int = 11, degree: int = 3, by=None, order=None,
                   name: str = "smooth") -> DataFrame:
    """Local polynomial smoothing; the first and last half windows use the polynomial of the end window.

    The window is made odd and shrinks to fit short series.
    """
    window = window + 1 if window % 2 == 0 else window

    def smooth(v: np.ndarray, first: bool, last: bool) -> np.ndarray:
        k = min(window, len(v) if len(v) % 2 else len(v) - 1)
        if k < 3:
            return np.full(len(v), np.nan)
        m = filters.savgol_matrix(k, min(degree, k - 1))
        h, out = k // 2, np.empty(len(v))
        out[h: len(v) - h] = np.correlate(v, m[h], "valid")
        out[:h], out[len(v) - h:] = m[:h] @ v[:k], m[h + 1:] @ v[-k:]
        return out

    return apply_local(df, y, keys(by), keys(order), window, smooth, name)


def butterworth_filter(df: DataFrame, y: str, fs: float, kind: str = "lowpass", cutoff=1.0, degree: int = 4, by=None,
                       order=None, name: str = "filtered") -> DataFrame:
    """Zero-phase Butterworth low-, high-, band-pass or band-stop filter with odd extension at the ends.

    Chunks of a long series exchange filter states, no rows, however long the filter remembers.
    """
    b, a = filters.butterworth(degree, kind, cutoff, fs)
    return recursive.zero_phase(df, y, keys(by), keys(order), b, a, 3 * max(len(a), len(b)), name)


def taper(df: DataFrame, y: str, window: str = "hann", beta: float = 14.0, by=None, order=None,
          name: str = "tapered") -> DataFrame:
    """The series times a hann, hamming, blackman or kaiser window over its whole length."""
    by = keys(by)
    rows = with_stats(with_index(df, by, keys(order), "_pos"), by, {"_n": F.count(F.lit(1))})
    weight = filters.window_column(window, F.col("_pos"), F.col("_n"), beta)
    return rows.withColumn(name, finite(y) * weight).drop("_pos", "_n")


def convolve(df: DataFrame, y: str, kernel: list[float], mode: str = "full", by=None, order=None,
             name: str = "value") -> DataFrame:
    """(by, i, value): linear convolution with a short kernel, ``full``, ``same`` or ``valid``.

    Each row adds its share to the positions it reaches; partial sums are combined before the shuffle.
    """
    by = keys(by)
    m = len(kernel)
    rows = with_index(df.filter(finite(y).isNotNull()), by, keys(order), "_pos")
    spread = rows.select(*by, "_pos", finite(y).alias("_y"), F.posexplode(F.array(*[F.lit(float(c)) for c in kernel])).alias("_k", "_c"))
    full = spread.groupBy(*by, (F.col("_pos") + F.col("_k")).alias("i")).agg(F.sum(F.col("_y") * F.col("_c")).alias(name))
    if mode == "full":
        return full
    sized = with_table(full, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    short = F.least(F.col("_n"), F.lit(m))
    start = F.floor((short - 1) / 2) if mode == "same" else short - 1
    length = F.greatest(F.col("_n"), F.lit(m)) if mode == "same" else F.greatest(F.col("_n"), F.lit(m)) - short + 1
    kept = sized.filter((F.col("i") >= start) & (F.col("i") < start + length))
    return kept.select(*by, (F.col("i") - start).cast("bigint").alias("i"), name)


def autocorrelation(df: DataFrame, y: str, max_lag: int, by=None, order=None, normalize: bool = True,
                    demean: bool = True) -> DataFrame:
    """(by, lag, corr) for lags 0 … ``max_lag``.

    Lagged products are summed per chunk of rows, so only the lag table is shuffled afterwards. Lags longer than a chunk
    come from the distributed transform instead.
    """
    by = keys(by)
    limit = rows_per_task(df.sparkSession)
    rows = df.filter(finite(y).isNotNull())
    rows = with_stats(rows, by, {"_m": F.avg(finite(y)) if demean else F.lit(0.0) * F.count(F.lit(1))})
    rows = rows.select(*by, *[c for c in keys(order) if c not in by], (finite(y) - F.col("_m")).alias("_v"))
    far = None
    if max_lag > limit:
        sized = with_stats(rows, by, {"_n": F.count(F.lit(1))})
        far = with_index(sized.filter(F.col("_n") > limit).drop("_n"), by, keys(order), "_i").withColumn("_reach", F.lit(max_lag))
        far = lag_products(far, by, "_i", "_v", "_v", "_reach").withColumnsRenamed({"k": "lag", "_sum": "_s"})
        rows, max_lag = sized.filter(F.col("_n") <= limit).drop("_n"), limit  # these have no longer lag
    fr = frame(rows, by, keys(order), max_lag, 0)
    sort, split = list(fr.order), fr.split
    head = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in by)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, kind="stable")
        v = pdf["_v"].to_numpy(float)
        own = pdf["_own"].to_numpy(bool) if split else np.ones(len(v), bool)
        start = int(np.argmax(own))
        lags = min(max_lag, len(v) - 1)
        size = 1 << int(np.ceil(np.log2(2 * len(v))))
        mine = np.where(own, v, 0.0)
        c = np.fft.irfft(np.fft.rfft(mine, size) * np.conj(np.fft.rfft(v, size)), size)[: lags + 1] if lags > 64 else np.array(
            [mine[max(k, start):] @ v[max(k, start) - k: len(v) - k] for k in range(lags + 1)])
        out = pd.DataFrame({"lag": np.arange(lags + 1), "_s": c})
        for i, k in enumerate(by):
            out.insert(i, k, [pdf[k].iloc[0]] * len(out))
        return out

    part = fr.df.groupBy(*fr.parts).applyInPandas(products, head + "lag bigint, _s double")
    part = part.unionByName(far) if far is not None else part
    total = part.groupBy(*by, "lag").agg(F.sum("_s").alias("corr"))
    if not normalize:
        return total
    zero = total.filter("lag = 0").select(*by, F.col("corr").alias("_c0"))
    return with_table(total, zero, by).select(*by, "lag", F.when(F.col("_c0") > 0, F.col("corr") / F.col("_c0")).otherwise(F.col("corr")).alias("corr"))


def _segments(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, x0, y0, x1, y1): each row with the next one of its series by ``x``; the last row of a series has no next one.

    Rows of one x are ordered by ``_h``. The rows are sorted once and written; only the last rows of ranges are looked up afterwards.
    """
    lay = lay_out(df, by, ["x", "_h"])
    w = lay.window()
    rows = cut_lineage(lay.df.select(*lay.parts, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"),
                                     F.lag("x").over(w).isNull().alias("_first")))
    if not lay.split:
        return rows.drop("_first")
    of_ranges = Window.partitionBy(*by).orderBy("_b")
    heads = rows.filter("_first").select(*by, "_b", F.lead("x0").over(of_ranges).alias("x1"), F.lead("y0").over(of_ranges).alias("y1"))
    tails = join_by(rows.filter("x1 IS NULL").select(*by, "_b", "x0", "y0"), heads, by + ["_b"])
    return rows.filter("x1 IS NOT NULL").drop("_b", "_first").unionByName(tails.drop("_b"))


def common_grid(a: DataFrame, b: DataFrame, x: str, y: str, by=None, step: float | None = None) -> DataFrame:
    """(by, g, a, b, dt): two series read by linear interpolation on the even grid of their overlap.

    The step is the median of both median steps unless given; grids below 20 points are left out. Each pair of neighbouring rows
    knows the grid points between them, so pairs without any are dropped and a block of the grid meets at most one pair per point and side.
    """
    by = keys(by)
    sides = by + ["_side"]
    rows = [df.select(*by, F.lit(i).alias("_side"), x_number(df, x).alias("x"), finite(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL") for i, df in enumerate((a, b))]
    pairs = _segments(rows[0].unionByName(rows[1]).withColumn("_h", F.xxhash64(*by, "x", "y")), sides)
    table = cut_lineage(pairs.groupBy(*sides).agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"), F.count(F.lit(1)).alias("_rows")))
    series, total = table.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    few = series <= BROADCAST_SERIES
    if step is None:
        steps = pairs.select(*sides, (F.col("x1") - F.col("x0")).alias("_d"))
        found = bracketed_medians(steps, sides, "_d", few) if (total or 0) > rows_per_task(a.sparkSession) else medians(steps, sides, {"_d": "_d"})
        table = with_table(table, found.withColumnRenamed("_d", "dt"), sides)
    else:
        table = table.withColumn("dt", F.lit(float(step)))
    ta, tb = [table.filter(F.col("_side") == i).drop("_side", "_rows") for i in (0, 1)]
    tb = tb.select(*by, *[F.col(c).alias(f"{c}2") for c in ("lo", "hi", "dt")])
    both = join_by(ta, tb, by, "inner") if by else with_table(ta, tb, [])
    dt = (F.coalesce("dt", F.lit(1.0)) + F.coalesce("dt2", F.lit(1.0))) / 2 if step is None else F.lit(float(step))
    both = both.select(*by, F.greatest("lo", "lo2").alias("_s"), F.least("hi", "hi2").alias("_e"), dt.alias("dt"))
    both = both.filter("_e > _s AND dt > 0").withColumn("_n", F.ceil((F.col("_e") - F.col("_s")) / F.col("dt"))).filter("_n >= 20").drop("_e")
    both = cut_lineage(both)
    work = join_by(pairs, F.broadcast(both) if few else both, by, "inner") if by else pairs.join(F.broadcast(both))
    point = lambda g: F.col("_s") + g * F.col("dt")

    def first_at(at):
        """The first grid point at or after ``at``; depends on ``at`` alone, so neighbouring pairs neither share nor miss a point."""
        g = F.ceil(F.greatest(F.lit(-2.0), F.least((at - F.col("_s")) / F.col("dt"), F.col("_n") + 2.0)))
        g = F.when(point(g - 1) >= at, g - 1).when(point(g) < at, g + 1).otherwise(g)
        return F.least(F.greatest(g, F.lit(0)), F.col("_n"))

    block = min(65_536, rows_per_task(a.sparkSession))
    work = work.withColumns({"_from": first_at(F.col("x0")), "_to": F.coalesce(first_at(F.col("x1")), F.col("_n"))}).filter("_from < _to")
    work = work.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))

    def fill(t: pa.Table) -> pa.Table:
        c, n, s, dt = (t[k][0].as_py() for k in ("_c", "_n", "_s", "dt"))
        g = np.arange(c * block, min((c + 1) * block, n))
        at, out = s + g * dt, []
        for side in (0, 1):
            own = t.filter(pc.equal(t["_side"], side)).sort_by("_from")
            pick = np.searchsorted(numbers(own, "_from", np.int64), g, "right") - 1
            x0, y0, x1, y1 = (numbers(own, k)[pick] for k in ("x0", "y0", "x1", "y1"))
            out.append(np.where(np.isnan(x1) | (at == x0), y0, y0 + (y1 - y0) * ((at - x0) / (x1 - x0))))
        own = t.select(by).take(pa.array(np.zeros(len(g), np.int64)))
        return pa.table([*own.columns, g, *out, np.full(len(g), dt)], names=[*by, "g", "a", "b", "dt"])

    head = "".join(f"`{k}` {work.schema[k].dataType.simpleString()}, " for k in by)
    return work.select(*sides, "_c", "_n", "_s", "dt", "_from", "x0", "y0", "x1", "y1").groupBy(*by, "_c").applyInArrow(fill, head + "g bigint, a double, b double, dt double")


def cross_correlation(a: DataFrame, b: DataFrame, x: str, y: str, max_lag: float, by=None, step: float | None = None,
                      detrend: str = "none", scale: str = "none") -> DataFrame:
    """(by, lag, corr, points): Pearson correlation of two series per lag, positive when ``a`` follows.

    Lags reach ``max_lag`` in units of x. Sums are taken per chunk of grid rows. The grid is written once; trend and scale are
    aggregates of it that return as one small table each.
    """
    by = keys(by)
    grid = cut_lineage(common_grid(a, b, x, y, by, step))
    trend = {f"_{k}{c}": fn(c, "g") for c in ("a", "b") for k, fn in (("i", F.regr_intercept), ("s", F.regr_slope))} if detrend == "linear" else {}
    kmax = F.max((F.lit(abs(float(max_lag))) / F.col("dt")).cast("bigint"))
    shape = cut_lineage(grid.groupBy(*by).agg(kmax.alias("_kmax"), F.count(F.lit(1)).alias("_n"), *[e.alias(k) for k, e in trend.items()]))
    reach, series = shape.agg(F.max("_kmax"), F.count(F.lit(1))).first()
    reach, limit = int(reach or 0), rows_per_task(grid.sparkSession)
    small = F.broadcast if series <= BROADCAST_SERIES else lambda table: table
    grid = with_table(grid, small(shape), by)
    if trend:
        grid = grid.withColumns({c: F.col(c) - (F.col(f"_i{c}") + F.col(f"_s{c}") * F.col("g")) for c in ("a", "b")}).drop(*trend)
    if scale in ("zscore", "minmax"):
        low, high = (F.avg, F.stddev_pop) if scale == "zscore" else (F.min, F.max)
        ends = cut_lineage(grid.groupBy(*by).agg(*[fn(c).alias(f"_{k}{c}") for c in ("a", "b") for k, fn in (("m", low), ("w", high))]))
        grid = with_table(grid, small(ends), by)
        width = lambda c: F.col(f"_w{c}") if scale == "zscore" else F.col(f"_w{c}") - F.col(f"_m{c}")
        grid = grid.withColumns({c: (F.col(c) - F.col(f"_m{c}")) / (width(c) + 1e-12) for c in ("a", "b")}).drop("_ma", "_mb", "_wa", "_wb")
    far = None
    if reach > limit:
        far = _far_lags(grid.filter(F.col("_n") > limit), by)
        grid, reach = grid.filter(F.col("_n") <= limit), limit  # these have no longer lag
    grid = grid.drop("_n")
    lent = lend_borders(grid, max(limit, reach), reach, reach, "g")
    head = "".join(f"`{k}` {grid.schema[k].dataType.simpleString()}, " for k in by)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        own, va, vb = pdf["_own"].to_numpy(bool), pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        n, kmax = len(va), min(int(pdf["_kmax"].iloc[0]), len(va) - 1)
        start, end = (int(np.argmax(own)), n - int(np.argmax(own[::-1]))) if own.any() else (0, 0)  # a chunk of lent rows only adds nothing
        k = np.arange(-kmax, kmax + 1)
        lo = np.maximum(start, k)
        hi = np.maximum(lo, np.minimum(end, n + k))
        size = 1 << int(np.ceil(np.log2(2 * n)))
        c = np.fft.irfft(np.fft.rfft(np.where(own, va, 0.0), size) * np.conj(np.fft.rfft(vb, size)), size)
        of = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        a1, a2, b1, b2 = of(va), of(va * va), of(vb), of(vb * vb)
        res = pd.DataFrame({"k": k, "n": hi - lo, "sa": a1[hi] - a1[lo], "sb": b1[hi - k] - b1[lo - k], "saa": a2[hi] - a2[lo], "sbb": b2[hi - k] - b2[lo - k], "sab": c[k % size]})
        res.insert(0, "dt", pdf["dt"].iloc[0])
        for i, name in enumerate(by):
            res.insert(i, name, [pdf[name].iloc[0]] * len(res))
        return res

    part = lent.groupBy(*by, "_c").applyInPandas(
        sums, head + "dt double, k bigint, n bigint, sa double, sb double, saa double, sbb double, sab double")
    part = part.unionByName(far) if far is not None else part
    t = part.groupBy(*by, "k").agg(F.first("dt").alias("dt"), F.sum("n").alias("points"), *[F.sum(c).alias(c) for c in ("sa", "sb", "saa", "sbb", "sab")]).filter("points > 0")
    n = F.col("points")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    corr = F.when(n >= 5, div(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))))
    return t.select(*by, (F.col("k") * F.col("dt")).alias("lag"), corr.alias("corr"), "points")


def _far_lags(grid: DataFrame, by: list[str]) -> DataFrame:
    """The sums of ``cross_correlation`` for grids and lags of any length: products from the transform, moments from running sums.

    At lag k the overlap leaves out the first |k| values of one series and the last |k| of the other, so each moment is one running sum
    near the start or near the end.
    """
    moments = {"sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") * F.col("a"), "sbb": F.col("b") * F.col("b")}
    lay = lay_out(grid, by, ["g"])
    run = lay.done(lay.scan({c: ("sum", e) for c, e in moments.items()})).withColumn("_at", F.col("g") + 1)  # sums of the first _at values
    shape = grid.groupBy(*by).agg(F.first("dt").alias("dt"), F.first("_n").alias("_n"), *[F.sum(e).alias(f"t_{c}") for c, e in moments.items()])
    head = run.filter(F.col("_at") <= F.col("_kmax")).select(*by, F.col("_at").alias("_m"), *[F.col(c).alias(f"h_{c}") for c in moments])
    tail = run.filter(F.col("_n") - F.col("_at") <= F.col("_kmax")).select(*by, (F.col("_n") - F.col("_at")).alias("_m"), *[F.col(c).alias(f"e_{c}") for c in moments])
    lags = lag_products(grid, by, "g", "a", "b", "_kmax").withColumn("_m", F.abs("k"))
    both = join_by(join_by(with_table(lags, shape, by), tail, by + ["_m"], "inner"), head, by + ["_m"])
    later = {c: F.col(f"t_{c}") - F.coalesce(F.col(f"h_{c}"), F.lit(0.0)) for c in moments}  # all but the first |k|
    late = lambda c, first: F.when(first, later[c]).otherwise(F.col(f"e_{c}"))
    return both.select(*by, "dt", "k", (F.col("_n") - F.col("_m")).cast("bigint").alias("n"), late("sa", F.col("k") >= 0).alias("sa"), late("sb", F.col("k") < 0).alias("sb"),
                       late("saa", F.col("k") >= 0).alias("saa"), late("sbb", F.col("k") < 0).alias("sbb"), F.col("_sum").alias("sab"))


def best_lag(table: DataFrame, by=None) -> DataFrame:
    """The lag with the largest magnitude of correlation, the lowest lag among equals."""
    by = keys(by)
    rank = F.when(F.col("corr").isNotNull(), F.struct(-F.abs("corr"), F.col("lag")))
    return table.groupBy(*by).agg(F.min_by("lag", rank).alias("best_lag"), F.min_by("corr", rank).alias("best_r"))


def spearman(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Rank correlation of two columns over complete rows, with mid-ranks for ties."""
    by = keys(by)
    rows = df.select(*by, finite(a).alias("_a"), finite(b).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL")
    for c in ("_a", "_b"):
        ranks = mid_ranks(rows, by, c, {}).select(*by, F.col("v").alias(c), F.col("rank").alias(f"{c}_r"))
        rows = join_by(rows, ranks, by + [c])
    return rows.groupBy(*by).agg(F.corr("_a_r", "_b_r").alias("rho"), F.count(F.lit(1)).alias("n"))
