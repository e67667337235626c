"""Spectra: Fourier, periodogram, Welch, short-time and wavelet transforms, Hilbert envelope, harmonics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.functions import filters
from sigtab.functions.numeric import finite, keys
from sigtab.operators import derive
from sigtab.plans.fft import fft
from sigtab.plans.layout import cut_lineage, frame, lay_out, with_index, with_stats, with_table
from sigtab.plans.local import apply_local, correlate
from sigtab.plans.normeq import with_polynomial
from sigtab.plans.quantile import medians, quantiles


def _indexed(df: DataFrame, y: str, by: list[str], order: list[str], extra: list[str] = ()) -> DataFrame:
    """(by, i, y, n …): finite values with their position and the series length."""
    rows = with_index(df.filter(finite(y).isNotNull()), by, order, "i")
    rows = rows.select(*by, "i", finite(y).alias("y"), *extra)
    return with_stats(rows, by, {"n": F.count(F.lit(1))})


def _demeaned(rows: DataFrame, by: list[str]) -> DataFrame:
    return with_stats(rows, by, {"_m": F.avg("y")}).withColumn("y", F.col("y") - F.col("_m")).drop("_m")


def spectrum(df: DataFrame, x: str, y: str, by=None, order=None, detrend: bool = True, window: str = "hann") -> DataFrame:
    """(by, k, freq, amplitude, power) up to half the sampling rate, which is 1 / median step of ``x``.

    Series below four values are left out.
    """
    by = keys(by)
    rows = _indexed(df, y, by, keys(order) or [x]).filter("n >= 4")
    if detrend:
        rows = _demeaned(rows, by)
    rows = rows.withColumn("y", F.col("y") * filters.window_column(window, F.col("i"), F.col("n")))
    out = with_table(fft(rows, by, "i", "y", half=True), derive.sampling_rate(df, x, by), by)
    size = F.hypot("re", "im")
    return out.select(*by, "k", (F.col("k") * F.col("fs_hz") / F.col("n")).alias("freq"),
                      (size / (F.col("n") / 2)).alias("amplitude"), (size * size / F.col("n")).alias("power"))


def inverse_fft(df: DataFrame, k: str, re: str, im: str, by=None) -> DataFrame:
    """(by, i, re, im) of a full spectrum; ``im`` is 0 where it is rounding noise of a real signal."""
    by = keys(by)
    out = fft(df, by, k, re, im, inverse=True).select(*by, F.col("k").alias("i"), "re", "im")
    out = with_stats(out, by, {"_i": F.max(F.abs("im")), "_r": F.max(F.abs("re"))})
    real = F.col("_i") < 1e-9 * F.greatest(F.lit(1.0), F.col("_r"))
    return out.select(*by, "i", "re", F.when(real, F.lit(0.0)).otherwise(F.col("im")).alias("im"))


def periodogram(df: DataFrame, y: str, fs: float = 1.0, by=None, order=None) -> DataFrame:
    """(by, k, freq, psd): one-sided density of the demeaned series."""
    by = keys(by)
    out = fft(_demeaned(_indexed(df, y, by, keys(order)), by), by, "i", "y", half=True)
    once = (F.col("k") == 0) | (2 * F.col("k") == F.col("n"))
    psd = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.lit(fs) * F.col("n")) * F.when(once, 1.0).otherwise(2.0)
    return out.select(*by, "k", (F.col("k") * F.lit(fs) / F.col("n")).alias("freq"), psd.alias("psd"))


def _segments(df: DataFrame, y: str, by: list[str], order: list[str], nperseg: int, noverlap: int | None,
              padded: bool, prepare=None) -> DataFrame:
    """(by, seg, size, step, at, v): the rows of each overlapping segment as arrays of places and values.

    A row goes to the few segments that cover it. ``padded`` adds half a segment of zeros at both
    ends and completes the last segment with zeros; absent places count as zero.
    """
    rows = _indexed(df, y, by, order)
    if prepare:
        rows = prepare(rows)
    size = F.greatest(F.lit(2), F.least(F.lit(nperseg), F.col("n")))
    over = F.floor(size / 2) if noverlap is None else F.least(F.lit(noverlap), size - 1)
    rows = rows.withColumns({"size": size.cast("bigint"), "step": (size - over).cast("bigint")})
    half = F.floor(F.col("size") / 2) if padded else F.lit(0)
    total = F.col("n") + 2 * half
    count = F.ceil((total - F.col("size")) / F.col("step")) if padded else F.floor((total - F.col("size")) / F.col("step"))
    place = F.col("i") + half
    first = F.greatest(F.lit(0), F.ceil((place - F.col("size") + 1) / F.col("step")))
    last = F.least(F.floor(place / F.col("step")), count)
    rows = rows.withColumns({"_p": place, "_f": first.cast("bigint"), "_l": last.cast("bigint")}).filter("_f <= _l")
    rows = rows.withColumn("seg", F.explode(F.sequence("_f", "_l")))
    cell = F.struct((F.col("_p") - F.col("seg") * F.col("step")).cast("int").alias("at"), F.col("y").alias("v"))
    packed = rows.groupBy(*by, "seg", "size", "step").agg(F.collect_list(cell).alias("_c"))
    return packed.select(*by, "seg", "size", "step", F.col("_c.at").alias("at"), F.col("_c.v").alias("v"))


def _segment_spectra(segments: DataFrame, by: list[str], window: str, detrend: bool) -> DataFrame:
    """(by, seg, size, step, ww, w, re[], im[]): transforms of many segments at a time, as array columns.

    ``ww`` and ``w`` are the sums of squared and plain window weights.
    """
    schema = T.StructType([segments.schema[c] for c in by + ["seg", "size", "step"]] + [
        T.StructField("ww", T.DoubleType()), T.StructField("w", T.DoubleType()),
        T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                size = int(size)
                z = np.zeros((len(part), size))
                for r, (at, v) in enumerate(zip(part["at"], part["v"])):
                    z[r, np.asarray(at)] = np.asarray(v)
                if detrend:
                    z -= z.mean(axis=1, keepdims=True)
                w = filters.window_values(window, size, periodic=True)
                f = np.fft.rfft(z * w, axis=1)
                out = part[by + ["seg", "size", "step"]].reset_index(drop=True)
                out["ww"], out["w"] = float(w @ w), float(w.sum())
                out["re"], out["im"] = list(f.real), list(f.imag)
                yield out

    return segments.mapInPandas(run, schema)


def welch(df: DataFrame, y: str, fs: float = 1.0, nperseg: int = 256, by=None, order=None) -> DataFrame:
    """(by, k, freq, psd): mean density of half-overlapping, demeaned, hann-weighted segments."""
    by = keys(by)
    spec = _segment_spectra(_segments(df, y, by, keys(order), nperseg, None, False), by, "hann", True)
    power = F.transform(F.arrays_zip("re", "im"), lambda z: z["re"] * z["re"] + z["im"] * z["im"])
    long = spec.select(*by, "size", "ww", F.posexplode(power).alias("k", "p"))
    once = (F.col("k") == 0) | (2 * F.col("k") == F.col("size"))
    psd = F.col("p") / (F.lit(fs) * F.col("ww")) * F.when(once, 1.0).otherwise(2.0)
    return long.groupBy(*by, "k").agg((F.first("k") * F.lit(fs) / F.first("size")).alias("freq"), F.avg(psd).alias("psd"))


def stft(df: DataFrame, y: str, fs: float = 1.0, nperseg: int = 256, noverlap: int | None = None, window: str = "hann",
         by=None, order=None) -> DataFrame:
    """(by, seg, k, t, freq, re, im): short-time transform with zero-extended ends, scaled to the spectrum."""
    by = keys(by)
    spec = _segment_spectra(_segments(df, y, by, keys(order), nperseg, noverlap, True), by, window, False)
    long = spec.select(*by, "seg", "size", "step", "w", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return long.select(*by, "seg", "k", (F.col("seg") * F.col("step") / F.lit(fs)).alias("t"), (F.col("k") * F.lit(fs) / F.col("size")).alias("freq"),
                       (F.col("z.re") / F.col("w")).alias("re"), (F.col("z.im") / F.col("w")).alias("im"))


def spectrogram(df: DataFrame, y: str, fs: float = 1.0, nperseg: int = 256, noverlap: int = 128, window: str = "hann",
                scaling: str = "density", to_db: bool = True, detrend: bool = True, by=None, order=None) -> DataFrame:
    """(by, seg, k, t, freq, power) of the linearly detrended series; t is the middle of a segment."""
    by = keys(by)

    def flat(rows: DataFrame) -> DataFrame:
        fitted = with_polynomial(rows, F.col("i").cast("double"), F.col("y"), 1, by, "_b")
        return fitted.withColumn("y", F.col("y") - F.coalesce("_b", F.lit(0.0))).drop("_b")

    spec = _segment_spectra(_segments(df, y, by, keys(order), nperseg, noverlap, False, flat if detrend else None), by, window, True)
    long = spec.select(*by, "seg", "size", "step", "ww", "w", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    raw = F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")
    power = raw / (F.lit(fs) * F.col("ww")) if scaling == "density" else raw / (F.col("w") * F.col("w"))
    if to_db:
        power = 10 * F.log10(power + 1e-10)
    return long.select(*by, "seg", "k", ((F.col("seg") * F.col("step") + F.col("size") / 2) / F.lit(fs)).alias("t"),
                       (F.col("k") * F.lit(fs) / F.col("size")).alias("freq"), power.alias("power"))


def contrast_limits(table: DataFrame, by=None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Quantiles of the power, or its range where they coincide."""
    by = keys(by)
    q = quantiles(table, by, {"_q": "power"}, [low, high])
    ends = table.groupBy(*by).agg(F.min("power").alias("_lo"), F.max("power").alias("_hi"))
    a, b = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    out = with_table(ends, q, by)
    return out.select(*by, F.when(a < b, a).otherwise(F.col("_lo")).alias("vmin"), F.when(a < b, b).otherwise(F.col("_hi")).alias("vmax"))


# ---- wavelets ----
MORLET_CENTRE = 0.8125  # fixed value: centre frequency of the Morlet wavelet in cycles per sample


def morlet_taps(scale: float) -> tuple[np.ndarray, int]:
    """Weights and their offset for one scale: steps of the integrated wavelet exp(-t²/2) cos(5t) on [-8, 8]."""
    t = np.linspace(-8.0, 8.0, 1024)
    step = t[1] - t[0]
    total = np.cumsum(np.exp(-t * t / 2) * np.cos(5 * t)) * step
    at = (np.arange(scale * 16.0 + 1) / (scale * step)).astype(int)
    at = at[at < len(t)]
    taps = -math.sqrt(scale) * np.diff(np.concatenate([[0.0], total[at][::-1], [0.0]]))
    return taps, 1 + math.floor((len(at) - 2) / 2)


def log_scales(n: int, count: int = 64) -> np.ndarray:
    """Scales from 2 to a quarter of the series length on a logarithmic grid."""
    return np.logspace(math.log10(2), math.log10(max(n // 4, 2)), count)


def cwt(df: DataFrame, y: str, scales: list[float], fs: float = 1.0, by=None, order=None, to_db: bool = False) -> DataFrame:
    """(…, scale, freq, power): Morlet wavelet power of each row at each scale, zero beyond the ends.

    The reach of a scale is eight times the scale, which sets the overlap of the chunks.
    """
    by = keys(by)
    taps = [morlet_taps(float(s)) for s in scales]
    reach = max(max(o, len(g) - 1 - o) for g, o in taps)

    def run(v: np.ndarray, first: bool, last: bool) -> np.ndarray:
        out = np.empty((len(v), len(taps)))
        for c, (g, o) in enumerate(taps):
            out[:, c] = correlate(np.pad(v, (len(g) - 1 - o, o)), g[::-1]) ** 2
        return out

    rows = df.select(*by, *[c for c in keys(order) if c not in by], finite(y).alias("_y"))
    done = apply_local(rows, "_y", by, keys(order), reach, run, "_p", T.ArrayType(T.DoubleType()))
    table = F.array(*[F.lit(float(s)) for s in scales])
    long = done.drop("_y").select("*", F.posexplode("_p").alias("_k", "power")).withColumn("scale", F.get(table, F.col("_k")))
    power = 10 * F.log10(F.col("power") + 1e-10) if to_db else F.col("power")
    return long.withColumns({"freq": F.lit(MORLET_CENTRE * fs) / F.col("scale"), "power": power}).drop("_p", "_k")


# ---- Hilbert ----

def hilbert(df: DataFrame, y: str, by=None, order=None) -> DataFrame:
    """(by, i, re, im, envelope): the analytic signal and its magnitude."""
    by = keys(by)
    f = cut_lineage(fft(_indexed(df, y, by, keys(order)), by, "i", "y"))
    weight = (F.when(F.col("k") == 0, 1.0).when(2 * F.col("k") < F.col("n"), 2.0)
              .when(2 * F.col("k") == F.col("n"), 1.0).otherwise(0.0))
    f = f.withColumns({"re": F.col("re") * weight, "im": F.col("im") * weight})
    out = fft(f, by, "k", "re", "im", inverse=True)
    return out.select(*by, F.col("k").alias("i"), "re", "im", F.hypot("re", "im").alias("envelope"))


def instantaneous_frequency(df: DataFrame, y: str, fs: float = 1.0, by=None, order=None) -> DataFrame:
    """(by, i, frequency): step of the unwrapped phase; null for the first row."""
    by = keys(by)
    rows = hilbert(df, y, by, order).withColumn("_p", F.atan2("im", "re"))
    fr = frame(rows, by, ["i"], 1, 0)
    turn = 2 * math.pi
    raw = F.col("_p") - F.lag("_p").over(fr.window())
    # the smallest equivalent step; a half turn keeps its sign
    step = F.pmod(raw + math.pi, F.lit(turn)) - math.pi
    step = F.when((step == -math.pi) & (raw > 0), F.lit(math.pi)).otherwise(step)
    return fr.own(fr.df.withColumn("frequency", step * fs / turn)).select(*by, "i", "frequency")


# ---- harmonics and quality ----

def harmonics(df: DataFrame, y: str, fs: float = 1.0, top: int = 8, window: str = "hann", fundamental: float | None = None,
              by=None, order=None) -> DataFrame:
    """The strongest local maxima of the amplitude spectrum with power, period and order to the fundamental."""
    by = keys(by)
    rows = _demeaned(_indexed(df, y, by, keys(order)), by).filter("n >= 2")
    rows = rows.withColumn("y", F.col("y") * filters.window_column(window, F.col("i"), F.col("n")))
    f = cut_lineage(fft(rows, by, "i", "y", half=True)).filter("k > 0")
    f = f.select(*by, "k", "n", (F.hypot("re", "im") * 2 / F.col("n")).alias("amplitude"))
    fr = frame(f, by, ["k"], 1, 1)
    w, a = fr.window(), F.col("amplitude")
    f = fr.own(fr.df.withColumn("_peak", (a > F.lag(a).over(w)) & (a > F.lead(a).over(w))))
    f = with_stats(f, by, {"_any": F.max(F.coalesce("_peak", F.lit(False)))})
    f = f.filter("_peak OR NOT _any").withColumn("_neg", -a)
    lay = lay_out(f, by, ["_neg", "k"])
    best = lay.done(lay.scan({"_r": ("index",)})).filter(F.col("_r") < top)
    best = best.withColumns({"rank": F.col("_r") + 1, "frequency": F.col("k") * F.lit(fs) / F.col("n")})
    base = F.lit(float(fundamental)) if fundamental and fundamental > 0 else F.col("_base")
    best = with_stats(best, by, {"_base": F.max(F.when(F.col("rank") == 1, F.col("frequency")))})
    return best.select(*by, "rank", "frequency", "amplitude", (a * a).alias("power"), (F.lit(1.0) / F.col("frequency")).alias("period"),
                       (F.col("frequency") / base).alias("harmonic_order"))


def amplitude_at(df: DataFrame, y: str, frequencies: list[float], fs: float = 1.0, window: str = "none", by=None, order=None) -> DataFrame:
    """(by, frequency, amplitude) of the demeaned series at chosen frequencies, one aggregate and no transform."""
    by = keys(by)
    rows = _demeaned(_indexed(df, y, by, keys(order)), by)
    rows = rows.withColumn("y", F.col("y") * filters.window_column(window, F.col("i"), F.col("n")))
    sums = [F.first("n").alias("n")]
    for j, f in enumerate(frequencies):
        phase = F.lit(2 * math.pi * f / fs) * F.col("i")
        sums += [F.sum(F.col("y") * F.cos(phase)).alias(f"c{j}"), F.sum(F.col("y") * F.sin(phase)).alias(f"s{j}")]
    one = rows.groupBy(*by).agg(*sums)
    cells = [F.struct(F.lit(float(f)).alias("frequency"), (F.hypot(f"c{j}", f"s{j}") * 2 / F.col("n")).alias("amplitude"))
             for j, f in enumerate(frequencies)]
    return one.select(*by, F.inline(F.array(*cells)))


def signal_quality(df: DataFrame, y: str, fs: float = 1.0, by=None, order=None) -> DataFrame:
    """Noise floor (median Welch density) and signal-to-noise ratio in dB (largest over median)."""
    by = keys(by)
    psd = welch(df, y, fs, 256, by, order)
    table = with_table(psd.groupBy(*by).agg(F.max("psd").alias("_top")), medians(psd, by, {"noise_floor": "psd"}), by)
    ratio = F.col("_top") / F.when(F.col("noise_floor") > 0, F.col("noise_floor"))
    return table.select(*by, "noise_floor", (10 * F.log10(ratio)).alias("snr_db"))
