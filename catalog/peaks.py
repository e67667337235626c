"""Checks of peaks, baselines, cycles and curve metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query
from catalog.tables import SERIES
from sigtab.operators import derive, peaks


def seconds(t):
    """Events with the time of day in seconds, as a curve per user."""
    return derive.seconds_from_start(t.events, "ts", "user_id", "x")


XY = "SELECT event_id, user_id, value AS y, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS x FROM events"


@query("c6_quantile_baseline")
def c6(t):
    return peaks.quantile_polynomial_baseline(seconds(t), "x", "value", 2, 0.2, "user_id").select("event_id", "baseline", "corrected")


@query("c7_constant_baseline", """
SELECT event_id, quantile_cont(value, 0.1) OVER (PARTITION BY user_id) AS baseline FROM events
""", floats="baseline")
def c7(t):
    return peaks.simple_baseline(seconds(t), "x", "value", "constant", "user_id").select("event_id", "baseline")


@query("c7_linear_baseline", f"""
WITH s AS ({XY}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s),
     e AS (SELECT *, greatest(3, least(n // 5, greatest(3, n // 10))) AS e FROM r),
     f AS (SELECT user_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM e WHERE i < e OR i >= n - e GROUP BY 1)
SELECT event_id, a * x + b AS baseline FROM s JOIN f USING (user_id)
""", floats="baseline", digits=4)
def c7b(t):
    return peaks.simple_baseline(seconds(t), "x", "value", "linear", "user_id").select("event_id", "baseline")


@query("c8_als_baseline")
def c8(t):
    return peaks.als(seconds(t), "x", "value", "user_id").select("event_id", "baseline")


EXTREMA = """
WITH r AS (SELECT event_id, user_id, value AS s, row_number() OVER w - 1 AS row_index, lag(value) OVER w AS b, lead(value) OVER w AS a,
                  min(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS lo, max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS hi
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, row_index, event_id AS x_peak, s AS y_peak, 'peak' AS kind FROM r
WHERE (b IS NULL OR s > b) AND (a IS NULL OR s > a) AND s >= 20 AND s - lo >= 30
"""


@query("k1_peaks", EXTREMA, floats="y_peak")
def k1(t):
    return peaks.extrema(t.events, "event_id", "value", "user_id", ["ts", "event_id"], "peaks", 20.0, 30.0)


@query("k1_extrema_both", EXTREMA.replace("AND s >= 20 AND s - lo >= 30", "AND s - lo >= 30") + """
UNION ALL SELECT user_id, row_index, event_id, s, 'trough' FROM r WHERE (b IS NULL OR s < b) AND (a IS NULL OR s < a) AND hi - s >= 30
""", floats="y_peak")
def k1b(t):
    return peaks.extrema(t.events, "event_id", "value", "user_id", ["ts", "event_id"], "both", 0.0, 30.0)


@query("k1_peaks_spaced")
def k1c(t):
    return peaks.extrema(t.events, "event_id", "value", "user_id", ["ts", "event_id"], "peaks", min_distance=5)


@query("k2_spectrum_peaks")
def k2(t):
    return peaks.spectrum_peaks(seconds(t), "x", "value", "user_id", 0.2, 3)


@query("k2_spectrum_peaks_all", f"""
WITH s AS ({XY}), r AS (SELECT *, row_number() OVER w - 1 AS i, lag(y) OVER w AS b, lead(y) OVER w AS a, count(*) OVER (PARTITION BY user_id) - 1 AS last,
            sum(coalesce((greatest(y, 0) + greatest(lag_y, 0)) / 2 * (x - lag_x), 0)) OVER w AS cum
            FROM (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY x, y) AS lag_y, lag(x) OVER (PARTITION BY user_id ORDER BY x, y) AS lag_x FROM s)
            WINDOW w AS (PARTITION BY user_id ORDER BY x, y)),
     g AS (SELECT user_id, min(y) AS lo, max(y) AS hi FROM s GROUP BY 1),
     p AS (SELECT r.* FROM r JOIN g USING (user_id) WHERE y >= b AND y >= a AND y >= lo + 0.2::DOUBLE * (hi - lo)),
     l AS (SELECT p.event_id, coalesce(max(q.i), 0) AS l FROM p LEFT JOIN r q ON q.user_id = p.user_id AND q.i < p.i AND q.y <= p.y / 2 GROUP BY 1),
     h AS (SELECT p.event_id, coalesce(min(q.i), any_value(p.last)) AS h FROM p LEFT JOIN r q ON q.user_id = p.user_id AND q.i > p.i AND q.y <= p.y / 2 GROUP BY 1)
SELECT p.user_id, p.x AS position, p.y AS height, b.x - a.x AS fwhm, b.cum - a.cum AS area
FROM p JOIN l USING (event_id) JOIN h USING (event_id) JOIN r a ON a.user_id = p.user_id AND a.i = l JOIN r b ON b.user_id = p.user_id AND b.i = h
""", floats="position height fwhm area", digits=2)
def k2b(t):
    return peaks.spectrum_peaks(seconds(t), "x", "value", "user_id", 0.2)


@query("k3_prominent_peaks")
def k3(t):
    return peaks.detect_peaks(seconds(t), "x", "value", "user_id", "linear", width=0.5)


@query("k3_prominences", f"""
WITH s AS ({XY}), r AS (SELECT *, row_number() OVER w - 1 AS i, lag(y) OVER w AS b, lead(y) OVER w AS a FROM s WINDOW w AS (PARTITION BY user_id ORDER BY x)),
     p AS (SELECT * FROM r WHERE y > b AND y > a),
     l AS (SELECT p.event_id, max(q.i) AS l FROM p LEFT JOIN r q ON q.user_id = p.user_id AND q.i < p.i AND q.y > p.y GROUP BY 1),
     h AS (SELECT p.event_id, min(q.i) AS h FROM p LEFT JOIN r q ON q.user_id = p.user_id AND q.i > p.i AND q.y > p.y GROUP BY 1),
     m AS (SELECT p.event_id, min(q.y) FILTER (WHERE q.i < p.i) AS lm, min(q.y) FILTER (WHERE q.i > p.i) AS hm
           FROM p JOIN l USING (event_id) JOIN h USING (event_id) JOIN r q ON q.user_id = p.user_id AND q.i > coalesce(l, -1) AND q.i < coalesce(h, 1000000) GROUP BY 1)
SELECT user_id, i, y AS height, y - greatest(lm, hm) AS prominence FROM p JOIN m USING (event_id) WHERE y - greatest(lm, hm) >= 25
""", floats="height prominence")
def k3b(t):
    return peaks.detect_peaks(seconds(t), "x", "value", "user_id", "none", prominence=25.0, max_peaks=None).select(
        "user_id", "i", "height", "prominence")


@query("k4_cycles", """
WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS m, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1),
     f AS (SELECT e.user_id, epoch_us(ts) / 1e6 AS t, (value - m) * CASE WHEN abs(hi - m) >= abs(lo - m) THEN 1 ELSE -1 END > 0.05::DOUBLE * abs(m) AS a FROM events e JOIN m USING (user_id)),
     c AS (SELECT *, CASE WHEN a = lag(a) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS ch FROM f),
     r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, min(t) AS t_on, max(t) AS t_off, count(*) AS points FROM r WHERE a GROUP BY user_id, run HAVING count(*) >= 3
""", floats="t_on t_off", digits=3)
def k4(t):
    return peaks.detect_cycles(t.events, "ts", "value", "user_id")


def cycles(t):
    return peaks.detect_cycles(t.events, "ts", "value", "user_id")


@query("k5_exposures")
def k5(t):
    return peaks.exposure_response(t.events, "ts", "value", cycles(t), "user_id")


@query("k5_exposure_levels", """
WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS m, max(value) AS hi, min(value) AS lo FROM events GROUP BY 1),
     f AS (SELECT e.user_id, value AS y, epoch_us(ts) / 1e6 AS t, (value - m) * CASE WHEN abs(hi - m) >= abs(lo - m) THEN 1 ELSE -1 END > 0.05::DOUBLE * abs(m) AS a FROM events e JOIN m USING (user_id)),
     c AS (SELECT *, CASE WHEN a = lag(a) OVER (PARTITION BY user_id ORDER BY t) THEN 0 ELSE 1 END AS ch FROM f),
     r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c),
     k AS (SELECT user_id, min(t) AS t_on, max(t) AS t_off FROM r WHERE a GROUP BY user_id, run HAVING count(*) >= 3),
     b AS (SELECT k.user_id, t_on, quantile_cont(y, 0.5) AS baseline FROM k JOIN f ON f.user_id = k.user_id AND f.t < t_on GROUP BY 1, 2),
     s AS (SELECT k.user_id, t_on, quantile_cont(y, 0.5) AS steady FROM k JOIN f ON f.user_id = k.user_id AND f.t <= t_off AND f.t >= t_on + 0.75::DOUBLE * (t_off - t_on) GROUP BY 1, 2),
     x AS (SELECT k.user_id, k.t_on, baseline, steady, baseline + 0.9::DOUBLE * (steady - baseline) AS goal, steady > baseline AS up FROM k JOIN b USING (user_id, t_on) JOIN s USING (user_id, t_on)),
     j AS (SELECT x.user_id, x.t_on, min(f.t) AS tj FROM x JOIN f ON f.user_id = x.user_id AND f.t >= x.t_on AND CASE WHEN up THEN y >= goal ELSE y <= goal END GROUP BY 1, 2),
     p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS t0, lag(y) OVER (PARTITION BY user_id ORDER BY t) AS y0 FROM f)
SELECT x.user_id, x.t_on, baseline, steady, abs(steady - baseline) / abs(baseline) * 100 AS response_percent,
       CASE WHEN tj = x.t_on THEN 0 ELSE greatest(0, t0 + (goal - y0) / (y - y0) * (t - t0) - x.t_on) END AS response_time
FROM x LEFT JOIN j USING (user_id, t_on) LEFT JOIN p ON p.user_id = x.user_id AND p.t = tj
""", floats="t_on baseline steady response_percent response_time", digits=3)
def k5b(t):
    return peaks.exposure_response(t.events, "ts", "value", cycles(t), "user_id").select(
        "user_id", "t_on", "baseline", "steady", "response_percent", "response_time")


@query("k6_cv", """
SELECT user_id, oxidation_current, oxidation_potential, reduction_current, reduction_potential, abs(oxidation_potential - reduction_potential) AS delta_ep,
       abs(oxidation_current / reduction_current) AS current_ratio FROM (
  SELECT user_id, max(value) AS oxidation_current, first(k ORDER BY value DESC, ts, event_id) AS oxidation_potential, min(value) AS reduction_current,
         first(k ORDER BY value, ts, event_id) AS reduction_potential
  FROM (SELECT *, json_extract(props, '$.k')::DOUBLE AS k FROM events) GROUP BY 1 HAVING count(*) >= 3)
""", floats="oxidation_current oxidation_potential reduction_current reduction_potential delta_ep current_ratio")
def k6(t):
    return peaks.cv_metrics(t.events.withColumn("k", F.get_json_object("props", "$.k")), "k", "value", ["ts", "event_id"], "user_id")


@query("k7_discharge", """
WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS v FROM events), p AS (SELECT user_id, v AS vp, t AS tp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, t) AS r FROM s) WHERE r = 1),
     d AS (SELECT user_id, max(t) - min(t) AS dt, any_value(vp) - arg_max(v, t) AS dv, count(*) AS n FROM s JOIN p USING (user_id) WHERE t >= tp GROUP BY 1)
SELECT user_id, dt AS discharge_time_s, dv AS voltage_window_v, 0.5 * dt / dv AS capacitance_f, 0.5 * dt / dv / 2 AS specific_capacitance_f_g FROM d WHERE n >= 2 AND dt > 0 AND dv > 0
""", floats="discharge_time_s voltage_window_v capacitance_f specific_capacitance_f_g", digits=3)
def k7(t):
    return peaks.discharge_metrics(t.events, "ts", "value", 0.5, 2.0, "user_id").drop("energy_wh_kg", "power_w_kg")


@query("k8_impedance", """
WITH s AS (SELECT p_brand, p_partkey::DOUBLE AS f, p_retailprice AS r, p_size - 25.0 AS i FROM part)
SELECT p_brand, min(r) AS rs_ohm, arg_min(r, f) AS zreal_low_freq_ohm, min(sqrt(r * r + i * i)) AS zmod_min_ohm, max(sqrt(r * r + i * i)) AS zmod_max_ohm,
       greatest(0, arg_min(r, f) - min(r)) AS rct_ohm FROM s GROUP BY 1 HAVING count(*) >= 2
""", floats="rs_ohm zreal_low_freq_ohm zmod_min_ohm zmod_max_ohm rct_ohm")
def k8(t):
    return peaks.impedance_metrics(t.part.withColumn("im", F.col("p_size") - 25.0), "p_partkey", "p_retailprice", "im", "p_brand")


@query("k9_raman", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_retailprice >= 945 ORDER BY p_size DESC, p_retailprice) AS i FROM part
           WHERE p_retailprice BETWEEN 910 AND 940 OR p_retailprice BETWEEN 950 AND 990)
SELECT d.p_brand, d.p_retailprice AS d_position, d.p_size::DOUBLE AS d_intensity, g.p_retailprice AS g_position, g.p_size::DOUBLE AS g_intensity, d.p_size / g.p_size AS id_ig
FROM r d JOIN r g ON d.p_brand = g.p_brand AND d.i = 1 AND g.i = 1 AND d.p_retailprice < 945 AND g.p_retailprice >= 945
""", floats="d_position d_intensity g_position g_intensity id_ig")
def k9(t):
    return peaks.raman_ratio(t.part, "p_retailprice", "p_size", "p_brand", (910, 940), (950, 990))


@query("k10_thermal", """
WITH w AS (SELECT user_id, event_id::DOUBLE AS t, value AS v, event_id - lag(event_id) OVER u AS hs, lead(event_id) OVER u - event_id AS hd, lag(value) OVER u AS b, lead(value) OVER u AS a,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
     g AS (SELECT *, CASE WHEN hs IS NOT NULL AND hd IS NOT NULL THEN (hs*hs*a + (hd*hd - hs*hs)*v - hd*hd*b) / (hs*hd*(hs+hd)) WHEN hd IS NOT NULL THEN (a - v) / hd ELSE (v - b) / hs END AS g FROM w WHERE n >= 4),
     s AS (SELECT user_id, arg_min(v, t) AS v0, arg_max(v, t) AS v1, arg_min(t, g) AS tp, min(g) AS gp, min(t) AS t0 FROM g GROUP BY 1)
SELECT s.user_id, coalesce(min(t) FILTER (WHERE CASE WHEN v1 < v0 THEN v <= v0 + 0.05::DOUBLE * (v1 - v0) ELSE v >= v0 + 0.05::DOUBLE * (v1 - v0) END), any_value(t0)) AS onset_temperature,
       any_value(tp) AS peak_temperature, any_value(gp) AS peak_rate, any_value(v1) AS final_value FROM g JOIN s USING (user_id) GROUP BY 1
""", floats="onset_temperature peak_temperature peak_rate final_value")
def k10(t):
    return peaks.thermal_transition(t.events, "event_id", "value", "user_id")


@query("g21_main_peak", """
WITH s AS (SELECT user_id, event_id::DOUBLE AS x, value AS y, lag(event_id::DOUBLE) OVER u AS xb, lag(value) OVER u AS yb, lead(event_id::DOUBLE) OVER u AS xa, lead(value) OVER u AS ya
           FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
     m AS (SELECT user_id, min(y) AS lo, max(y) AS hi, (min(y) + max(y)) / 2 AS half FROM s GROUP BY 1),
     p AS (SELECT user_id, min(x) AS px FROM s JOIN m USING (user_id) WHERE y = hi GROUP BY 1),
     l AS (SELECT user_id, arg_max(xa + (half - ya) / (y - ya) * (x - xa), x) AS l FROM s JOIN m USING (user_id) JOIN p USING (user_id) WHERE y < half AND x < px GROUP BY 1),
     r AS (SELECT user_id, arg_min(xb + (half - yb) / (y - yb) * (x - xb), x) AS r FROM s JOIN m USING (user_id) JOIN p USING (user_id) WHERE y < half AND x > px GROUP BY 1)
SELECT s.user_id, count(*) AS points, sum(coalesce((y + yb) / 2 * (x - xb), 0)) AS area, any_value(px) AS peak_x, max(y) AS peak_height, abs(any_value(r) - any_value(l)) AS fwhm
FROM s JOIN p USING (user_id) LEFT JOIN l USING (user_id) LEFT JOIN r USING (user_id) GROUP BY 1 HAVING count(*) >= 2
""", floats="area peak_x peak_height fwhm", digits=3)
def g21(t):
    return peaks.main_peak(t.events, "event_id", "value", "user_id")


@query("g21_area_in_range", """
WITH s AS (SELECT user_id, event_id::DOUBLE AS x, value AS y, lag(event_id::DOUBLE) OVER u AS xb, lag(value) OVER u AS yb FROM events WHERE event_id BETWEEN 100 AND 5000
           WINDOW u AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, sum((y + yb) / 2 * (x - xb)) AS area, count(*) AS points FROM s GROUP BY 1 HAVING count(*) >= 2
""", floats="area", digits=3)
def g21b(t):
    return peaks.area_in_range(t.events, "event_id", "value", 100, 5000, "user_id")
