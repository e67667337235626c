"""Signal operators against NumPy on whole and on chunked series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigtab.functions import filters
from sigtab.operators import signal, spectral
from sigtab.plans.fft import fft


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(5)
    n = 331
    t = np.arange(n)
    frames = []
    for g, m in (("a", n), ("b", 57)):
        frames.append(pd.DataFrame({"g": g, "t": t[:m], "y": np.sin(t[:m] / 7.0) + 0.3 * rng.standard_normal(m)}))
    pdf = pd.concat(frames)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def both(spark, make):
    """The result with whole series and with series cut into small chunks."""
    whole = make().toPandas()
    spark.conf.set("spark.sigtab.rowsPerTask", "120")
    try:
        cut = make().toPandas()
    finally:
        spark.conf.unset("spark.sigtab.rowsPerTask")
    return whole, cut


def check(whole, cut, keys, value, tol=1e-9):
    w = whole.sort_values(keys).reset_index(drop=True)
    c = cut.sort_values(keys).reset_index(drop=True)
    np.testing.assert_array_equal(w[keys].to_numpy(), c[keys].to_numpy())
    np.testing.assert_allclose(w[value].to_numpy(float), c[value].to_numpy(float), atol=tol)
    return w


OPS = {
    "boxcar": lambda d: signal.boxcar(d, "y", 6, "g", "t", "o"),
    "moving_average": lambda d: signal.moving_average(d, "y", 9, "g", "t", "o"),
    "median": lambda d: signal.median_filter(d, "y", 7, "g", "t", "o"),
    "gaussian": lambda d: signal.gaussian_smooth(d, "y", 3.0, "g", "t", "o"),
    "savgol": lambda d: signal.savitzky_golay(d, "y", 11, 3, "g", "t", "o"),
    "butter": lambda d: signal.butterworth_filter(d, "y", 10.0, "lowpass", 3.0, 2, "g", "t", "o"),
    "taper": lambda d: signal.taper(d, "y", "kaiser", 14.0, "g", "t", "o"),
}


@pytest.mark.parametrize("name", OPS)
def test_chunks_do_not_matter(spark, curve, name):
    whole, cut = both(spark, lambda: OPS[name](curve[1]))
    check(whole, cut, ["g", "t"], "o")


def series(pdf, g="a"):
    return pdf[pdf.g == g].sort_values("t").y.to_numpy()


def result(spark, curve, name):
    return OPS[name](curve[1]).filter("g = 'a'").toPandas().sort_values("t").o.to_numpy()


def test_values(spark, curve):
    y = series(curve[0])
    np.testing.assert_allclose(result(spark, curve, "boxcar"), np.convolve(y, np.ones(6) / 6, "same"))
    padded = np.pad(y, 3)
    np.testing.assert_allclose(result(spark, curve, "median"), [np.median(padded[i:i + 7]) for i in range(len(y))])
    np.testing.assert_allclose(result(spark, curve, "taper"), y * np.kaiser(len(y), 14.0), atol=1e-12)
    got = result(spark, curve, "moving_average")
    np.testing.assert_allclose(got, pd.Series(y).rolling(9, min_periods=3).mean())
    sm = result(spark, curve, "savgol")
    p = np.polyfit(np.arange(11), y[:11], 3)
    np.testing.assert_allclose(sm[:5], np.polyval(p, np.arange(5)))
    p = np.polyfit(np.arange(-5, 6), y[95:106], 3)
    assert sm[100] == pytest.approx(np.polyval(p, 0))


def test_butterworth_coefficients():
    # closed forms of the first and second order low-pass at a quarter of the sampling rate
    b, a = filters.butterworth(1, "lowpass", 0.25, 1.0)
    np.testing.assert_allclose((b, a), ([0.5, 0.5], [1.0, 0.0]), atol=1e-12)
    b, a = filters.butterworth(2, "lowpass", 0.25, 1.0)
    np.testing.assert_allclose(b, np.array([1, 2, 1]) / (2 + np.sqrt(2)), atol=1e-12)
    np.testing.assert_allclose(a, [1, 0, (2 - np.sqrt(2)) / (2 + np.sqrt(2))], atol=1e-12)
    for kind, cut, pass_at, stop_at in (("highpass", 0.2, -1.0, 1.0), ("bandpass", (0.1, 0.3), np.exp(0.4j * np.pi), 1.0),
                                        ("bandstop", (0.1, 0.3), 1.0, None)):
        b, a = filters.butterworth(3, kind, cut, 1.0)
        assert np.all(np.abs(np.roots(a)) < 1)
        gain = lambda z: abs(np.polyval(b[::-1], 1 / z) / np.polyval(a[::-1], 1 / z))
        assert gain(pass_at) == pytest.approx(1.0, abs=2e-2)
        if stop_at is not None:
            assert gain(stop_at) == pytest.approx(0.0, abs=1e-9)
        for edge in np.atleast_1d(cut):
            assert gain(np.exp(2j * np.pi * edge)) == pytest.approx(np.sqrt(0.5), abs=1e-6)


def test_recursive_filter_matches_plain_loop():
    rng = np.random.default_rng(0)
    v = rng.standard_normal(500)
    b, a = filters.butterworth(3, "lowpass", 0.1, 1.0)
    got = filters.run_filter(b, a, v)
    x = np.concatenate([np.full(4000, v[0]), v])
    y = np.full(len(x), v[0])
    for i in range(4, len(x)):
        y[i] = b @ x[i - 3: i + 1][::-1] - a[1:] @ y[i - 3: i][::-1]
    np.testing.assert_allclose(got, y[4000:], atol=1e-9)


@pytest.mark.parametrize("by", [None, "g"])
def test_filters_that_remember_longer_than_a_chunk(spark, by):
    """The cut-off makes the response last for thousands of rows; chunks hold 120."""
    rng = np.random.default_rng(5)
    n = 700
    pdf = pd.DataFrame({"g": ["hot"] * (n - 45) + ["a"] * 30 + ["b"] * 2 + [None] * 13, "t": rng.permutation(n).astype(float), "y": rng.standard_normal(n).cumsum()})
    df = spark.createDataFrame(pdf).repartition(5)
    for kind, cut, degree in (("lowpass", 0.0008, 2), ("highpass", 0.001, 2), ("bandstop", (0.002, 0.004), 1)):
        b, a = filters.butterworth(degree, kind, cut, 1.0)
        whole, cut_ = both(spark, lambda: signal.butterworth_filter(df, "y", 1.0, kind, cut, degree, by, "t", "o"))
        assert len(cut_) == n and list(whole.columns) == list(cut_.columns)
        for _, s in ([(0, cut_)] if by is None else cut_.fillna({"g": "-"}).groupby("g")):
            s = s.sort_values("t")
            np.testing.assert_allclose(s.o, filters.zero_phase(b, a, s.y.to_numpy(), 3 * len(a)), rtol=1e-5, atol=1e-5)


def test_constant_passes_low_pass(spark):
    df = spark.range(200).withColumn("y", F.lit(3.5))
    out = signal.butterworth_filter(df, "y", 1.0, "lowpass", 0.1, 4, None, "id", "o").toPandas()
    np.testing.assert_allclose(out.o, 3.5, atol=1e-9)


@pytest.mark.parametrize("n", [331, 57])
@pytest.mark.parametrize("inverse", [False, True])
def test_long_fft(spark, n, inverse):
    rng = np.random.default_rng(n)
    z = rng.standard_normal(n) + 1j * rng.standard_normal(n)
    pdf = pd.DataFrame({"g": "a", "i": np.arange(n), "re": z.real, "im": z.imag})
    df = spark.createDataFrame(pdf).repartition(4)
    want = np.fft.ifft(z) if inverse else np.fft.fft(z)
    for by in ([], ["g"]):
        got = fft(df, by, "i", "re", "im", inverse, limit=40).toPandas().sort_values("k")
        np.testing.assert_allclose(got.re + 1j * got.im, want, atol=1e-9)
        assert (got.n == n).all()


def test_mixed_lengths_fft(spark, curve):
    got = fft(curve[1], ["g"], "t", "y", half=True, limit=100).toPandas()
    for g in ("a", "b"):
        f = np.fft.rfft(series(curve[0], g))
        part = got[got.g == g].sort_values("k")
        np.testing.assert_allclose(part.re + 1j * part.im, f, atol=1e-9)


def test_autocorrelation(spark, curve):
    for lags in (12, 90):
        whole, cut = both(spark, lambda: signal.autocorrelation(curve[1], "y", lags, "g", "t"))
        w = check(whole, cut, ["g", "lag"], "corr")
        y = series(curve[0]) - series(curve[0]).mean()
        want = np.correlate(y, y, "full")[len(y) - 1:][: lags + 1]
        np.testing.assert_allclose(w[w.g == "a"]["corr"], want / want[0], atol=1e-10)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolve(spark, curve, mode):
    k = [0.5, -1.0, 2.0, 0.25]
    got = signal.convolve(curve[1], "y", k, mode, "g", "t").filter("g = 'a'").toPandas().sort_values("i")
    np.testing.assert_allclose(got.value, np.convolve(series(curve[0]), k, mode), atol=1e-12)
    np.testing.assert_array_equal(got.i, np.arange(len(got)))


def test_welch_and_periodogram(spark, curve):
    y = series(curve[0])
    got = spectral.periodogram(curve[1], "y", 2.0, "g", "t").filter("g = 'a'").toPandas().sort_values("k")
    f = np.abs(np.fft.rfft(y - y.mean())) ** 2 / (2.0 * len(y))
    f[1:] *= 2  # odd length: only the mean is single
    np.testing.assert_allclose(got.psd, f, atol=1e-12)
    whole, cut = both(spark, lambda: spectral.welch(curve[1], "y", 2.0, 64, "g", "t"))
    w = check(whole, cut, ["g", "k"], "psd")
    win = np.hanning(65)[:64]
    segs = [y[s:s + 64] for s in range(0, len(y) - 63, 32)]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * win)) ** 2 for s in segs], axis=0) / (2.0 * (win @ win))
    p[1:-1] *= 2
    np.testing.assert_allclose(w[w.g == "a"].psd, p, atol=1e-12)


def test_stft_restores_energy(spark, curve):
    y = series(curve[0])
    got = spectral.stft(curve[1], "y", 1.0, 64, None, "hann", "g", "t").filter("g = 'a'").toPandas()
    win = np.hanning(65)[:64]
    ext = np.concatenate([np.zeros(32), y, np.zeros(32)])
    ext = np.pad(ext, (0, -(len(ext) - 64) % 32))
    assert got.seg.max() == (len(ext) - 64) // 32
    s = got[got.seg == 3].sort_values("k")
    np.testing.assert_allclose(s.re + 1j * s.im, np.fft.rfft(ext[96:160] * win) / win.sum(), atol=1e-12)


def test_hilbert(spark):
    t = np.arange(256)
    y = (1 + 0.3 * np.cos(2 * np.pi * t / 128)) * np.cos(2 * np.pi * t / 16)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "y": y}))
    whole, cut = both(spark, lambda: spectral.hilbert(df, "y", None, "t"))
    w = check(whole, cut, ["i"], "envelope")
    np.testing.assert_allclose(w.envelope, 1 + 0.3 * np.cos(2 * np.pi * t / 128), atol=1e-9)
    f = spectral.instantaneous_frequency(df, "y", 32.0, None, "t").toPandas().sort_values("i")
    assert np.isnan(f.frequency.iloc[0])
    np.testing.assert_allclose(f.frequency.iloc[1:], 2.0, atol=1e-6)


def test_harmonics_and_snr(spark):
    t = np.arange(512)
    y = 3 * np.sin(2 * np.pi * 20 * t / 512) + 1.0 * np.sin(2 * np.pi * 60 * t / 512)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "y": y}))
    top = spectral.harmonics(df, "y", 512.0, 2, "none", None, None, "t").toPandas().sort_values("rank")
    np.testing.assert_allclose(top.frequency, [20, 60])
    np.testing.assert_allclose(top.amplitude, [3, 1], atol=1e-9)
    np.testing.assert_allclose(top.harmonic_order, [1, 3])
    q = spectral.signal_quality(df, "y", 512.0, None, "t").toPandas()
    assert q.snr_db[0] > 40


def test_cwt(spark, curve):
    scales = [2.0, 5.3, 9.0]
    whole, cut = both(spark, lambda: spectral.cwt(curve[1], "y", scales, 1.0, "g", "t"))
    w = check(whole, cut, ["g", "scale", "t"], "power")
    y = series(curve[0])
    t = np.linspace(-8, 8, 1024)
    total = np.cumsum(np.exp(-t * t / 2) * np.cos(5 * t)) * (t[1] - t[0])
    for s in scales:
        j = np.floor(np.arange(s * 16 + 1) / (s * (t[1] - t[0]))).astype(int)
        j = j[j < 1024]
        coef = -np.sqrt(s) * np.diff(np.convolve(y, total[j][::-1]))
        d = (len(coef) - len(y)) / 2
        coef = coef[int(np.floor(d)): len(coef) - int(np.ceil(d))]
        got = w[(w.g == "a") & (w.scale == s)].sort_values("t").power
        np.testing.assert_allclose(got, coef ** 2, atol=1e-10)


def test_cross_correlation_finds_shift(spark):
    t = np.arange(400.0)
    rng = np.random.default_rng(1)
    base = np.convolve(rng.standard_normal(420), np.ones(5) / 5, "same")
    a = spark.createDataFrame(pd.DataFrame({"x": t, "y": base[:400]}))
    b = spark.createDataFrame(pd.DataFrame({"x": t, "y": base[7:407]}))
    whole, cut = both(spark, lambda: signal.cross_correlation(a, b, "x", "y", 20.0, None, None, "linear", "zscore"))
    w = check(whole, cut, ["lag"], "corr")
    assert len(w) == 41
    best = signal.best_lag(signal.cross_correlation(a, b, "x", "y", 20.0)).first()
    assert best.best_lag == 7.0 and best.best_r > 0.99
    k = 3
    p, q = base[:399][k:], base[7:406][:-k]
    raw = signal.cross_correlation(a, b, "x", "y", 20.0).filter("lag = 3.0").first()["corr"]
    assert raw == pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-9)


def test_common_grid_with_repeats_and_gaps(spark, monkeypatch):
    """Many rows at one time, a long gap, series of one side only and a null key, whole and in chunks of 120 rows, against NumPy."""
    rng = np.random.default_rng(3)

    def rows(s, start, n):
        x = np.round(start + np.cumsum(rng.exponential(1.0, n)), 3)
        x[n // 2:] += 400.0
        x[n // 4: n // 4 + 130] = x[n // 4]
        return pd.DataFrame({"s": s, "x": np.concatenate([x, [np.nan, 5.0]]), "y": np.concatenate([rng.standard_normal(n), [1.0, np.inf]])})

    a = pd.concat([rows("p", 0.0, 700), rows(None, -50.0, 300), rows("a only", 0.0, 40), rows("few", 0.0, 3)])
    b = pd.concat([rows("p", 20.0, 500), rows(None, 3.0, 450), rows("b only", 0.0, 40)])
    sa, sb = [spark.createDataFrame(d).repartition(3) for d in (a, b)]
    whole, cut = both(spark, lambda: signal.common_grid(sa, sb, "x", "y", "s"))
    monkeypatch.setattr(signal, "BROADCAST_SERIES", 0)
    joined = both(spark, lambda: signal.common_grid(sa, sb, "x", "y", "s"))[1]
    for got in (cut, joined):
        for c in ("g", "a", "b", "dt"):
            check(whole.fillna({"s": ""}), got.fillna({"s": ""}), ["s", "g"], c, 0)
    assert set(whole.s.fillna("")) == {"p", ""}
    for s in ("p", ""):
        got, sides = whole[whole.s.fillna("") == s].sort_values("g"), []
        for d in (a, b):
            d = d[(d.s.fillna("") == s) & np.isfinite(d.x) & np.isfinite(d.y)]
            sides.append(d.sort_values("x", kind="stable"))
        dt = np.mean([np.median(np.diff(d.x)) for d in sides])
        lo, hi = max(d.x.min() for d in sides), min(d.x.max() for d in sides)
        n = int(np.ceil((hi - lo) / dt))
        assert got.g.tolist() == list(range(n)) and got["dt"].to_numpy() == pytest.approx(dt)
        at = lo + np.arange(n) * got["dt"].iloc[0]
        for c, d in zip("ab", sides):
            many = d.x.value_counts().idxmax()  # any of the rows of one time may be the one read there
            before, after = d.x[d.x < many].max(), d.x[d.x > many].min()
            apart = (at <= before) | (at >= after)
            np.testing.assert_allclose(got[c].to_numpy()[apart], np.interp(at, d.x, d.y)[apart], atol=1e-9)


def test_cross_correlation_reads_its_input_a_few_times(spark):
    """The input is counted, sampled and then sorted once; trend, scale and lags only read what was written."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"s": ["p", "q"] * 400, "x": np.arange(800) / 2 + rng.random(800) / 4, "y": rng.standard_normal(800)})
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for d in batches:
            seen.add(len(d))
            yield d

    df = spark.createDataFrame(pdf).mapInPandas(count, "s string, x double, y double")
    whole, cut = both(spark, lambda: signal.cross_correlation(df, df.withColumn("y", F.col("y") + 1), "x", "y", 20.0, "s", None, "linear", "zscore"))
    check(whole, cut, ["s", "lag"], "corr")
    assert len(whole) > 80
    assert 0 < seen.value <= 2 * len(pdf) * (2 + 5)  # a sample that is sorted reads twice


@pytest.mark.parametrize("scale", ["none", "zscore", "minmax"])
def test_trend_and_scale_leave_the_correlation(spark, scale):
    """Scaling changes no correlation; a trend is taken off both sides before."""
    rng = np.random.default_rng(6)
    n = 300
    a, b = rng.standard_normal(n) + 0.05 * np.arange(n) + 1e6, rng.standard_normal(n) - 0.1 * np.arange(n)
    sa, sb = [spark.createDataFrame(pd.DataFrame({"x": np.arange(n, dtype=float), "y": v})) for v in (a, b)]
    whole, cut = both(spark, lambda: signal.cross_correlation(sa, sb, "x", "y", 5.0, None, None, "linear", scale))
    check(whole, cut, ["lag"], "corr", 1e-8)
    m, g = n - 1, np.arange(n - 1.0)
    p, q = [v[:m] - np.polyval(np.polyfit(g, v[:m], 1), g) for v in (a, b)]
    for k in (-4, 0, 3):
        u, v = (p[k:], q[: m - k]) if k >= 0 else (p[:k], q[-k:])
        assert whole[whole.lag == k]["corr"].iloc[0] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-8)


@pytest.mark.parametrize("by", [None, "s"])
def test_lags_longer_than_a_chunk(spark, by):
    """Chunks hold 120 rows; lags reach 500 and beyond the series."""
    rng = np.random.default_rng(8)
    n = 640
    pdf = pd.DataFrame({"s": ["hot"] * 560 + ["a"] * 70 + [None] * 10, "x": np.arange(n).astype(float), "y": rng.standard_normal(n).cumsum()})
    df = spark.createDataFrame(pdf).repartition(4)
    for lags in (500, 5000) if by is None else (500,):
        whole, cut = both(spark, lambda: signal.autocorrelation(df, "y", lags, by, "x"))
        w = check(whole, cut, [*([by] if by else []), "lag"], "corr")
        assert len(w) == (min(lags, n - 1) + 1 if by is None else min(lags, 559) + 1 + 70 + 10)
    other = df.withColumn("y", F.col("y") + F.sin("x") + 5)
    for reach in (10_000.0,) if by is None else (450.0,):
        whole, cut = both(spark, lambda: signal.cross_correlation(df.filter("s = 'hot' OR s = 'a'"), other, "x", "y", reach, by))
        w = check(whole, cut, [*([by] if by else []), "lag"], "corr", 1e-7)
        c = cut.sort_values([*([by] if by else []), "lag"]).reset_index(drop=True)
        assert (w["points"] == c["points"]).all() and w["lag"].abs().max() > 400
    one = whole if by is None else whole[whole.s == "hot"]
    m = int(one["points"].max())
    a, b = pdf.y[:m].to_numpy(), (pdf.y + np.sin(pdf.x) + 5)[:m].to_numpy()
    for k in (-300, -1, 0, 7, 411):
        p, q = (a[k:], b[: m - k]) if k >= 0 else (a[:k], b[-k:])
        got = one[one.lag == k].iloc[0]
        assert got["points"] == len(p) and got["corr"] == pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-9)
