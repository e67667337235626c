"""Checks of the tables behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query
from catalog.tables import SERIES
from sigtab.operators import distributions as dist


@query("d1_histogram", """
WITH u AS (UNPIVOT (SELECT l_linestatus, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME "column" VALUE v),
     b AS (SELECT l_linestatus, min(v) AS lo, max(v) AS hi FROM u GROUP BY 1),
     c AS (SELECT u.l_linestatus, "column", least(floor((v - lo) / (hi - lo) * 20), 19)::INT AS bin, count(*) AS c FROM u JOIN b USING (l_linestatus) GROUP BY 1, 2, 3),
     n AS (SELECT l_linestatus, "column", count(*) AS n FROM u GROUP BY 1, 2),
     g AS (SELECT l_linestatus, "column", n, lo, hi, r.bin::INT AS bin FROM n JOIN b USING (l_linestatus), range(20) AS r(bin))
SELECT g.l_linestatus, g."column", g.bin, lo + (hi - lo) / 20 * g.bin AS left, lo + (hi - lo) / 20 * (g.bin + 1) AS right, coalesce(c, 0) AS count,
       coalesce(c, 0) / (n * (hi - lo) / 20) AS density,
       sum(coalesce(c, 0)) OVER (PARTITION BY g.l_linestatus, g."column" ORDER BY g.bin)::BIGINT AS cumulative
FROM g LEFT JOIN c ON g.l_linestatus = c.l_linestatus AND g."column" = c."column" AND g.bin = c.bin
""", floats="left right density")
def d1(t):
    return dist.histogram(t.lineitem, ["l_discount", "l_tax"], 20, "l_linestatus")


@query("d2_normal_curve", """
WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sigma, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
     g AS (SELECT *, r.point::INT AS point, lo + (hi - lo) * r.point / 399 AS x FROM s, range(400) AS r(point))
SELECT event_type, point, x, mu, sigma, exp(-0.5::DOUBLE * ((x - mu) / sigma) ** 2) / (sigma * sqrt(2 * pi())) * n * (hi - lo) / 20 AS y FROM g
""", floats="x mu sigma y")
def d2(t):
    return dist.normal_curve(t.events, "value", by="event_type")


@query("d3_kernel_density", """
WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) * power(count(*), -0.2::DOUBLE) AS h, min(value) AS lo, (max(value) - min(value)) / 199 AS step FROM events GROUP BY 1),
     g AS (SELECT *, r.point::INT AS point, lo + step * r.point AS x FROM s, range(200) AS r(point))
SELECT g.event_type, point, x, sum(exp(-0.5::DOUBLE * ((value - x) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
FROM g JOIN events e ON e.event_type = g.event_type GROUP BY 1, 2, 3
""", floats="x density")
def d3(t):
    return dist.kernel_density(t.events, "value", 200, "event_type")


@query("d4_box", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, q1, median, q3, least(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), q1) AS whisker_low,
       greatest(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), q3) AS whisker_high,
       count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers,
       median - 1.57 * (q3 - q1) / sqrt(count(*)) AS notch_low, median + 1.57 * (q3 - q1) / sqrt(count(*)) AS notch_high
FROM events JOIN q USING (event_type) GROUP BY 1, q1, median, q3
""", floats="q1 median q3 whisker_low whisker_high notch_low notch_high")
def d4(t):
    return dist.box_statistics(t.events, "value", "event_type")


@query("d5_dot_bins", """
WITH s AS (SELECT user_id, min(value) AS lo, max(value) AS hi, least(30, greatest(10, floor(sqrt(count(*))))) AS k FROM events GROUP BY 1)
SELECT user_id, least(floor((value - lo) / (hi - lo) * k), k - 1)::INT AS bin, any_value(lo + (hi - lo) * (least(floor((value - lo) / (hi - lo) * k), k - 1) + 0.5::DOUBLE) / k) AS center, count(*) AS count
FROM events JOIN s USING (user_id) WHERE hi > lo GROUP BY 1, 2
""", floats="center")
def d5(t):
    return dist.dot_bins(t.events, "value", "user_id")


@query("d6_ecdf", """
SELECT DISTINCT event_type, value, cume_dist() OVER (PARTITION BY event_type ORDER BY value) AS cdf FROM events
""", floats="value cdf")
def d6(t):
    return dist.empirical_cdf(t.events, "value", "event_type")


@query("d6_ecdf_one_series", "SELECT DISTINCT l_extendedprice AS value, cume_dist() OVER (ORDER BY l_extendedprice) AS cdf FROM lineitem", floats="value cdf", digits=9)
def d6b(t):
    return dist.empirical_cdf(t.lineitem, "l_extendedprice")


@query("d7_qq_points")
def d7(t):
    return dist.qq_points(t.events, "value", "event_type")


@query("d7_qq_line")
def d7b(t):
    return dist.qq_line(t.events, "value", "event_type")


@query("d7_probability_plot")
def d7c(t):
    return dist.qq_points(t.events, "value", None, "blom")


@query("d7_pp_points")
def d7d(t):
    return dist.pp_points(t.events, "value", "event_type")


@query("d7_ranks", """
SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events
""", floats="value")
def d7e(t):
    return dist.ranked_values(t.events, "value", "event_type")


@query("d8_bland_altman", """
SELECT l_orderkey, l_linenumber, l_shipdate, (l_discount + l_tax) / 2 AS pair_mean, l_discount - l_tax AS pair_diff, avg(l_discount - l_tax) OVER () AS bias,
       avg(l_discount - l_tax) OVER () - 1.96::DOUBLE * stddev_samp(l_discount - l_tax) OVER () AS limit_low,
       avg(l_discount - l_tax) OVER () + 1.96::DOUBLE * stddev_samp(l_discount - l_tax) OVER () AS limit_high FROM lineitem
""", floats="pair_mean pair_diff bias limit_low limit_high", digits=9)
def d8(t):
    return dist.bland_altman(t.lineitem, "l_discount", "l_tax").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "pair_mean", "pair_diff", "bias", "limit_low", "limit_high")


@query("d9_paired_means", """
SELECT l_returnflag, count(*) AS n, avg(l_discount) AS mean_first, avg(l_tax) AS mean_second, avg(l_tax - l_discount) AS mean_change FROM lineitem GROUP BY 1
""", floats="mean_first mean_second mean_change")
def d9(t):
    return dist.paired_means(t.lineitem, "l_discount", "l_tax", "l_returnflag")


@query("d10_run_chart", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS observation, (SELECT quantile_cont(value, 0.5) FROM events) AS center FROM events
""", floats="center")
def d10(t):
    return dist.run_chart(t.events, "value", [], ["ts", "event_id"]).select("event_id", "observation", "center")


@query("d10_xbar", """
SELECT event_id, avg(value) OVER u AS center, avg(value) OVER u + 3 * stddev_samp(value) OVER u AS ucl, avg(value) OVER u - 3 * stddev_samp(value) OVER u AS lcl,
       value > avg(value) OVER u + 3 * stddev_samp(value) OVER u OR value < avg(value) OVER u - 3 * stddev_samp(value) OVER u AS out_of_control
FROM events WINDOW u AS (PARTITION BY event_type)
""", floats="center ucl lcl")
def d10b(t):
    return dist.xbar_chart(t.events, "value", "event_type").select("event_id", "center", "ucl", "lcl", "out_of_control")


@query("d11_imr", """
WITH m AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS moving_range FROM events)
SELECT event_id, moving_range, avg(value) OVER u AS center, avg(value) OVER u + 2.66::DOUBLE * avg(moving_range) OVER u AS ucl,
       avg(value) OVER u - 2.66::DOUBLE * avg(moving_range) OVER u AS lcl FROM m WINDOW u AS (PARTITION BY user_id)
""", floats="moving_range center ucl lcl")
def d11(t):
    return dist.imr_chart(t.events, "value", **SERIES).select("event_id", "moving_range", "center", "ucl", "lcl")


@query("d12_pareto", """
SELECT c_custkey, row_number() OVER w - 1 AS position, sum(abs(c_acctbal)) OVER w / (SELECT sum(abs(c_acctbal)) FROM customer) * 100 AS cumulative_percent
FROM customer WINDOW w AS (ORDER BY abs(c_acctbal) DESC, c_custkey ROWS UNBOUNDED PRECEDING)
""", floats="cumulative_percent")
def d12(t):
    return dist.pareto(t.customer, "c_acctbal", ["c_custkey"]).select("c_custkey", "position", "cumulative_percent")


@query("d13_main_effects", """
WITH u AS (UNPIVOT (SELECT l_linestatus, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME "column" VALUE v),
     m AS (SELECT l_linestatus, "column", avg(v) AS mean FROM u GROUP BY 1, 2)
SELECT l_linestatus, "column", mean, avg(mean) OVER (PARTITION BY l_linestatus) AS grand_mean FROM m
""", floats="mean grand_mean")
def d13(t):
    return dist.main_effects(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_linestatus")


@query("d13_interaction", """
WITH m AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS m FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'l_extendedprice' AS response, avg(l_extendedprice) FILTER (WHERE l_quantity <= m) AS low_mean, avg(l_extendedprice) FILTER (WHERE l_quantity > m) AS high_mean
FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_tax', avg(l_tax) FILTER (WHERE l_quantity <= m), avg(l_tax) FILTER (WHERE l_quantity > m) FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1
""", floats="low_mean high_mean", digits=5)
def d13b(t):
    return dist.interaction_means(t.lineitem, "l_quantity", ["l_extendedprice", "l_tax"], "l_returnflag")


@query("d14_mean_intervals", """
WITH u AS (UNPIVOT (SELECT l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME "column" VALUE v)
SELECT "column", count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, 1.96::DOUBLE * stddev_samp(v) / sqrt(count(v)) AS ci_half FROM u GROUP BY 1
""", floats="mean sd ci_half")
def d14(t):
    return dist.mean_intervals(t.lineitem, ["l_quantity", "l_tax"])


@query("d15_wind_rose", """
WITH s AS (SELECT event_type, least(floor(radians(value % 360) / (2 * pi() / 16)), 15)::INT AS sector, abs(user_id - 70.0::DOUBLE) AS w FROM events),
     g AS (SELECT DISTINCT event_type, r.sector::INT AS sector FROM events, range(16) AS r(sector))
SELECT g.event_type, g.sector, (g.sector + 0.5::DOUBLE) * 2 * pi() / 16 AS center, coalesce(sum(w), 0) AS total
FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.sector = s.sector GROUP BY 1, 2
""", floats="center total")
def d15(t):
    e = t.events.withColumn("weight", F.col("user_id") - F.lit(70.0))
    return dist.wind_rose(e, "value", "weight", "event_type")


@query("d16_hex_bins", """
WITH b AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem),
     p AS (SELECT x0 - 1e-9 * (x1 - x0) AS l, y0 - 1e-9 * (y1 - y0) AS c, (x1 - x0) * (1 + 2e-9) / 24 AS sx, (y1 - y0) * (1 + 2e-9) / 13 AS sy FROM b),
     i AS (SELECT (l_quantity - l) / sx AS ix, (l_extendedprice - c) / sy AS iy FROM lineitem, p),
     d AS (SELECT *, (ix - round_even(ix, 0)) ** 2 + 3 * (iy - round_even(iy, 0)) ** 2 < (ix - floor(ix) - 0.5::DOUBLE) ** 2 + 3 * (iy - floor(iy) - 0.5::DOUBLE) ** 2 AS a FROM i)
SELECT CASE WHEN a THEN round_even(ix, 0) ELSE floor(ix) + 0.5::DOUBLE END AS cell_x, CASE WHEN a THEN round_even(iy, 0) ELSE floor(iy) + 0.5::DOUBLE END AS cell_y, count(*) AS count
FROM d GROUP BY 1, 2
""", floats="cell_x cell_y")
def d16(t):
    return dist.hex_bins(t.lineitem, "l_quantity", "l_extendedprice").select("cell_x", "cell_y", "count")


@query("d17_bode", """
SELECT l_orderkey, l_linenumber, l_shipdate, 20 * log10(sqrt(l_discount ** 2 + (l_tax - 0.04::DOUBLE) ** 2)) AS gain_db,
       degrees(atan2(l_tax - 0.04::DOUBLE, l_discount)) AS phase_deg FROM lineitem WHERE sqrt(l_discount ** 2 + (l_tax - 0.04::DOUBLE) ** 2) > 0
""", floats="gain_db phase_deg")
def d17(t):
    li = t.lineitem.withColumn("im", F.col("l_tax") - F.lit(0.04))
    return dist.bode_table(li, "l_quantity", "l_discount", "im").select("l_orderkey", "l_linenumber", "l_shipdate", "gain_db", "phase_deg")


@query("d17_nyquist", """
SELECT p_partkey, p_size, -(p_retailprice - 1400) AS minus_imag, sqrt(p_size ** 2 + (p_retailprice - 1400) ** 2) AS modulus, degrees(atan2(p_retailprice - 1400, p_size)) AS phase_deg FROM part
""", floats="minus_imag modulus phase_deg")
def d17b(t):
    p = t.part.withColumn("im", F.col("p_retailprice") - 1400)
    return dist.nyquist_table(p, "p_partkey", "p_size", "im").select("p_partkey", "p_size", "minus_imag", "modulus", "phase_deg")


@query("d18_phase_pairs", """
SELECT * FROM (SELECT event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events) WHERE next_value IS NOT NULL
""", floats="value next_value")
def d18(t):
    return dist.phase_pairs(t.events, "value", **SERIES).select("event_id", "value", "next_value")


@query("d19_row_shares", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_discount / CASE WHEN l_discount + l_tax = 0 THEN 1 ELSE l_discount + l_tax END AS l_discount_share,
       l_tax / CASE WHEN l_discount + l_tax = 0 THEN 1 ELSE l_discount + l_tax END AS l_tax_share FROM lineitem
""", floats="l_discount_share l_tax_share")
def d19(t):
    return dist.row_shares(t.lineitem, ["l_discount", "l_tax"]).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_discount_share", "l_tax_share")


@query("d19_magnitude_shares", "SELECT c_custkey, abs(c_acctbal) / sum(abs(c_acctbal)) OVER (PARTITION BY c_mktsegment) AS share FROM customer", floats="share", digits=9)
def d19b(t):
    return dist.magnitude_shares(t.customer, "c_acctbal", "c_mktsegment").select("c_custkey", "share")


@query("d20_stacked_offsets", """
WITH s AS (SELECT quantile_cont(r, 0.5) * 1.2 AS step FROM (SELECT unnest([max(l_quantity) - min(l_quantity), max(l_discount) - min(l_discount), max(l_tax) - min(l_tax)]) AS r FROM lineitem)),
     u AS (SELECT l_orderkey, l_linenumber, l_shipdate, 'l_quantity' AS "column", l_quantity AS value, 0 AS k FROM lineitem
           UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, 'l_discount', l_discount, 1 FROM lineitem
           UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, 'l_tax', l_tax, 2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_shipdate, "column", value, value + k * step AS shifted FROM u, s
""", floats="value shifted")
def d20(t):
    return dist.stacked_offsets(t.lineitem, ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_shipdate"])
