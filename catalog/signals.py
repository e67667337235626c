"""Checks of smoothing, filters, correlation and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.common import query
from catalog.tables import SERIES
from sigtab.functions import filters
from sigtab.operators import signal, spectral

IDX = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"


@query("g1_moving_average", """
SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS ma FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)
""", floats="ma")
def g1(t):
    return signal.moving_average(t.events, "value", 9, **SERIES, name="ma").select("event_id", "ma")


@query("g1_moving_average_one_series", """
SELECT event_id, CASE WHEN count(value) OVER w >= 8 THEN avg(value) OVER w END AS ma FROM events
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)
""", floats="ma")
def g1b(t):
    return signal.moving_average(t.events, "value", 25, None, ["ts", "event_id"], "ma").select("event_id", "ma")


@query("g2_boxcar", """
SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 AS y FROM events
""", floats="y")
def g2(t):
    return signal.boxcar(t.events, "value", 6, **SERIES, name="y").select("event_id", "y")


@query("g3_median_filter", """
WITH z AS (SELECT user_id, -k AS i, 0.0::DOUBLE AS y, NULL AS event_id FROM (SELECT DISTINCT user_id FROM events), range(1, 3) AS r(k)
           UNION ALL SELECT user_id, n - 1 + k, 0.0, NULL FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), range(1, 3) AS r(k)
           UNION ALL SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, value, event_id FROM events)
SELECT event_id, m AS y FROM (SELECT event_id, quantile_cont(y, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM z) WHERE event_id IS NOT NULL
""", floats="y")
def g3(t):
    return signal.median_filter(t.events, "value", 5, **SERIES, name="y").select("event_id", "y")


def _values(taps) -> str:
    return ", ".join(f"({k}, {float(c)!r}::DOUBLE)" for k, c in enumerate(taps))


_G4 = filters.gaussian_taps(2.0)


@query("g4_gaussian_smooth", f"""
WITH i AS (SELECT event_id, user_id, value, {IDX} AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT * FROM (VALUES {_values(_G4)}) AS v(k, c)),
     p AS (SELECT event_id, user_id, n, c, ((i + k - {len(_G4) // 2}) % (2 * n) + 2 * n) % (2 * n) AS m FROM i, k)
SELECT p.event_id, sum(p.c * i.value) AS y FROM p JOIN i ON i.user_id = p.user_id AND i.i = CASE WHEN m < p.n THEN m ELSE 2 * p.n - 1 - m END GROUP BY 1
""", floats="y")
def g4(t):
    return signal.gaussian_smooth(t.events.select("event_id", "user_id", "ts", "value"), "value", 2.0, **SERIES, name="y").select("event_id", "y")


@query("g5_savitzky_golay")
def g5(t):
    return signal.savitzky_golay(t.events.select("event_id", "user_id", "ts", "value"), "value", 11, 3, **SERIES, name="y").select("event_id", "y")


def _zero_phase_sql(kind: str, cutoff, degree: int, by: str) -> str:
    """Both runs as sums with the impulse response, over the oddly extended series whose first value has lasted forever."""
    b, a = filters.butterworth(degree, kind, cutoff, 1.0)
    pad, impulse = 3 * max(len(a), len(b)), np.zeros(400)
    past = np.zeros(len(a))  # the difference equation, term by term
    for t in range(400):
        new = (b[t] if t < len(b) else 0.0) - a[1:] @ past[: len(a) - 1]
        impulse[t], past = new, np.concatenate([[new], past[:-1]])
    taps = impulse[: int(np.flatnonzero(np.abs(impulse) > 1e-13).max()) + 1]
    rest = float(b.sum() / a.sum())

    def run(source: str, out: str, at: str, sign: int) -> str:
        # {at}: where the run starts; taps that reach beyond it see the first value
        return f"""{out} AS (SELECT s.{by}, s.i, s.n, s.pad, sum(k.c * coalesce(o.v, 0)) + ({rest!r} - sum(CASE WHEN o.v IS NOT NULL THEN k.c ELSE 0 END)) * any_value(f.v) AS v
  FROM {source} s CROSS JOIN k LEFT JOIN {source} o ON o.{by} = s.{by} AND o.i = s.i - {sign} * k.k JOIN {source} f ON f.{by} = s.{by} AND f.i = {at} GROUP BY 1, 2, 3, 4)"""

    return f"""
WITH k AS (SELECT * FROM (VALUES {_values(taps)}) AS v(k, c)), e AS (SELECT *, 0 AS one FROM events),
x AS (SELECT event_id, {by}, value AS v, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM e),
p AS (SELECT *, least({pad}, n - 1) AS pad FROM x),
u AS (SELECT {by}, i, n, pad, v FROM p
  UNION ALL SELECT p.{by}, -p.i, p.n, p.pad, 2 * f.v - p.v FROM p JOIN p f ON f.{by} = p.{by} AND f.i = 0 WHERE p.i BETWEEN 1 AND p.pad
  UNION ALL SELECT p.{by}, 2 * (p.n - 1) - p.i, p.n, p.pad, 2 * f.v - p.v FROM p JOIN p f ON f.{by} = p.{by} AND f.i = p.n - 1 WHERE p.i BETWEEN p.n - 1 - p.pad AND p.n - 2),
{run("u", "y", "-s.pad", 1)},
{run("y", "z", "s.n - 1 + s.pad", -1)}
SELECT p.event_id, z.v AS y FROM p JOIN z USING ({by}, i)
"""


@query("g6_butterworth", _zero_phase_sql("lowpass", 0.2, 4, "user_id"), floats="y")
def g6(t):
    return signal.butterworth_filter(t.events.select("event_id", "user_id", "ts", "value"), "value", 1.0, "lowpass", 0.2, 4, **SERIES, name="y").select("event_id", "y")


@query("g6_butterworth_band_one_series", _zero_phase_sql("bandpass", (0.1, 0.3), 2, "one"), floats="y")
def g6b(t):
    return signal.butterworth_filter(t.events.select("event_id", "ts", "value"), "value", 1.0, "bandpass", (0.1, 0.3), 2, None,
                                     ["ts", "event_id"], "y").select("event_id", "y")


@query("g7_taper", f"""
WITH i AS (SELECT event_id, value, {IDX} AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, value * CASE WHEN n > 1 THEN 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / (n - 1)) ELSE 1 END AS hann,
       value * CASE WHEN n > 1 THEN 0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / (n - 1)) + 0.08::DOUBLE * cos(4 * pi() * i / (n - 1)) ELSE 1 END AS blackman FROM i
""", floats="hann blackman")
def g7(t):
    out = signal.taper(t.events, "value", "hann", **SERIES, name="hann")
    return signal.taper(out, "value", "blackman", **SERIES, name="blackman").select("event_id", "hann", "blackman")


@query("g7_taper_kaiser")
def g7b(t):
    return signal.taper(t.events, "value", "kaiser", 14.0, **SERIES, name="y").select("event_id", "y")


@query("g8_convolve", f"""
WITH i AS (SELECT user_id, value, {IDX} AS i FROM events), k AS (SELECT * FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, -1.0::DOUBLE)) AS v(k, c))
SELECT user_id, i + k AS i, sum(value * c) AS y FROM i, k GROUP BY 1, 2
""", floats="y")
def g8(t):
    return signal.convolve(t.events, "value", [0.25, 0.5, -1.0], "full", **SERIES, name="y")


@query("g8_convolve_same", f"""
WITH i AS (SELECT user_id, value, {IDX} AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT * FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, -1.0::DOUBLE)) AS v(k, c))
SELECT user_id, i + k - 1 AS i, sum(value * c) AS y FROM i, k WHERE i + k BETWEEN 1 AND n AND n >= 3 GROUP BY 1, 2
""", floats="y")
def g8b(t):
    return signal.convolve(t.events, "value", [0.25, 0.5, -1.0], "same", **SERIES, name="y")


@query("g9_autocorrelation", f"""
WITH i AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS v, {IDX} AS i FROM events),
     c AS (SELECT a.user_id, a.i - b.i AS lag, sum(a.v * b.v) AS c FROM i a JOIN i b ON a.user_id = b.user_id AND a.i - b.i BETWEEN 0 AND 10 GROUP BY 1, 2)
SELECT user_id, lag, c / nullif(first_value(c) OVER (PARTITION BY user_id ORDER BY lag), 0) AS corr FROM c
""", floats="corr")
def g9(t):
    return signal.autocorrelation(t.events, "value", 10, **SERIES)


@query("g9_autocorrelation_one_series", """
WITH i AS (SELECT value - avg(value) OVER () AS v, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
     k AS (SELECT * FROM range(0, 21) AS r(lag)),
     c AS (SELECT lag, sum(a.v * b.v) AS c FROM i a, k JOIN i b ON b.i = a.i - lag GROUP BY 1)
SELECT lag, c / (SELECT c FROM c WHERE lag = 0) AS corr FROM c
""", floats="corr")
def g9b(t):
    return signal.autocorrelation(t.events, "value", 20, None, ["ts", "event_id"])


def sides(t):
    e = t.events.select("event_type", "user_id", "value", "ts")
    return e.filter(F.col("user_id") % 2 == 0), e.filter(F.col("user_id") % 2 == 1)


@query("g10_cross_correlation")
def g10(t):
    a, b = sides(t)
    return signal.cross_correlation(a, b, "ts", "value", 40000.0, "event_type", None, "linear", "zscore")


@query("g10_best_lag")
def g10b(t):
    a, b = sides(t)
    return signal.best_lag(signal.cross_correlation(a, b, "ts", "value", 40000.0, "event_type"), "event_type")


@query("g10_spearman", """
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a,
                  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT l_returnflag, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY 1
""", floats="rho")
def g10c(t):
    return signal.spearman(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query("g11_spectrum")
def g11(t):
    return spectral.spectrum(t.events, "ts", "value", "user_id", ["ts", "event_id"])


@query("g11_spectrum_energy", """
SELECT user_id, sum((value - m) ** 2) AS energy FROM (SELECT user_id, value, avg(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1
""", floats="energy", digits=4)
def g11b(t):
    """By Parseval's theorem the mean power of the full spectrum is the energy of the demeaned series."""
    from sigtab.plans.fft import fft
    rows = spectral._demeaned(spectral._indexed(t.events, "value", ["user_id"], ["ts", "event_id"]), ["user_id"])
    f = fft(rows, ["user_id"], "i", "y")
    return f.groupBy("user_id").agg((F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.first("n")).alias("energy"))


@query("g12_harmonics")
def g12(t):
    return spectral.harmonics(t.events, "value", 1.0, 5, "hann", None, **SERIES)


@query("g12_amplitude_at", f"""
WITH i AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS y, {IDX} AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
     f AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE]) AS frequency)
SELECT user_id, frequency, sqrt(sum(y * cos(2 * pi() * frequency * i)) ** 2 + sum(y * sin(2 * pi() * frequency * i)) ** 2) * 2 / any_value(n) AS amplitude FROM i, f GROUP BY 1, 2
""", floats="frequency amplitude")
def g12b(t):
    return spectral.amplitude_at(t.events, "value", [0.05, 0.1, 0.25], **SERIES)


@query("g13_inverse_fft", f"SELECT user_id, {IDX} AS i, value AS re FROM events", floats="re")
def g13(t):
    from sigtab.plans.fft import fft
    rows = spectral._indexed(t.events, "value", ["user_id"], ["ts", "event_id"])
    return spectral.inverse_fft(fft(rows, ["user_id"], "i", "y"), "k", "re", "im", "user_id").select("user_id", "i", "re")


@query("g14_periodogram")
def g14(t):
    return spectral.periodogram(t.events, "value", 1.0, **SERIES)


@query("g14_periodogram_power", """
SELECT user_id, var_pop(value) AS power FROM events GROUP BY 1
""", floats="power", digits=4)
def g14b(t):
    """The one-sided density sums to the variance."""
    p = spectral.periodogram(t.events, "value", 1.0, **SERIES)
    n = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return p.groupBy("user_id").agg(F.sum("psd").alias("s")).join(n, "user_id").select("user_id", (F.col("s") / F.col("n")).alias("power"))


@query("g15_welch")
def g15(t):
    return spectral.welch(t.events, "value", 1.0, 32, **SERIES)


@query("g16_stft")
def g16(t):
    return spectral.stft(t.events, "value", 1.0, 32, None, "hann", **SERIES)


@query("g17_spectrogram")
def g17(t):
    return spectral.spectrogram(t.events, "value", 1.0, 64, 32, **SERIES)


@query("g17_contrast")
def g17b(t):
    return spectral.contrast_limits(spectral.spectrogram(t.events, "value", 1.0, 64, 32, by=None, order=["ts", "event_id"]))


@query("g18_cwt")
def g18(t):
    return spectral.cwt(t.events, "value", [2.0, 4.0, 8.0], 1.0, **SERIES)


@query("g19_hilbert")
def g19(t):
    return spectral.hilbert(t.events, "value", **SERIES)


@query("g19_hilbert_real_part", f"SELECT user_id, {IDX} AS i, value AS re FROM events", floats="re")
def g19b(t):
    return spectral.hilbert(t.events, "value", **SERIES).select("user_id", "i", "re")


@query("g19_instantaneous_frequency")
def g19c(t):
    return spectral.instantaneous_frequency(t.events, "value", 1.0, **SERIES)


@query("g20_signal_quality")
def g20(t):
    return spectral.signal_quality(t.events, "value", 1.0, **SERIES)
