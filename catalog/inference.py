"""Checks of fits and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query
from sigtab.operators import fit, hypothesis as hyp, rows


@query("flagship", """
WITH z AS (SELECT *, avg(value) OVER u AS mu, stddev_samp(value) OVER u AS sd FROM events WINDOW u AS (PARTITION BY event_type)),
     k AS (SELECT event_type, value FROM z WHERE NOT coalesce(abs(value - mu) / nullif(sd, 0) > 3, false)),
     g AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, var_pop(value) AS v FROM k GROUP BY 1),
     a AS (SELECT sum(n * (mean - gm) ** 2) AS ssb, sum(n * v) AS ssw, count(*) AS c, sum(n) AS nn
           FROM g, (SELECT avg(value) AS gm FROM k))
SELECT event_type, n, mean, std, (ssb / (c - 1)) / (ssw / (nn - c)) AS f_statistic, ssb / (ssb + ssw) AS eta_squared FROM g, a
""", floats="mean std f_statistic eta_squared")
def flagship(t):
    kept = rows.drop_outliers(t.events.select("event_type", "value"), "value", "event_type")
    groups = kept.groupBy("event_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    from sigtab.plans.layout import with_table
    return with_table(groups, hyp.one_way_anova(kept, "value", "event_type").select("f_statistic", "eta_squared"), [])




@query("f1_line_fit", """
WITH s AS (SELECT l_returnflag, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy,
                  avg(x) AS mx, avg(y) AS my FROM (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem) GROUP BY 1)
SELECT l_returnflag, n, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept, sxy * sxy / sxx / syy AS r_squared,
       sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS slope_std,
       sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + mx * mx / sxx)) AS intercept_std FROM s
""", floats="slope intercept r_squared slope_std intercept_std", digits=4)
def f1(t):
    return fit.line_fit(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query("f2_ohm", """
SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS resistance, 1 / regr_slope(l_extendedprice, l_quantity) AS conductance,
       regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r_squared FROM lineitem GROUP BY 1
""", floats="resistance conductance intercept r_squared", digits=4)
def f2ohm(t):
    return fit.ohms_law(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query("f2_pendulum", """
WITH s AS (SELECT p_size AS x, (2 * sqrt(p_size) + p_retailprice / 1e5) ** 2 AS y FROM part)
SELECT 4 * pi() ** 2 / regr_slope(y, x) AS g, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r_squared FROM s
""", floats="g slope intercept r_squared")
def f2pendulum(t):
    p = t.part.select(F.col("p_size").alias("length"), (2 * F.sqrt("p_size") + F.col("p_retailprice") / F.lit(1e5)).alias("period"))
    return fit.pendulum_gravity(p, "length", "period")


@query("f2_randles_sevcik", """
SELECT p_brand, regr_slope(p_retailprice, sqrt(p_size)) AS slope, regr_intercept(p_retailprice, sqrt(p_size)) AS intercept,
       regr_r2(p_retailprice, sqrt(p_size)) AS r_squared FROM part GROUP BY 1
""", floats="slope intercept r_squared")
def f2randles(t):
    return fit.randles_sevcik(t.part, "p_size", "p_retailprice", "p_brand")


@query("f2_tafel", """
WITH s AS (SELECT o_orderpriority, log10(o_totalprice) AS x, o_custkey / 1000 AS y FROM orders)
SELECT o_orderpriority, regr_slope(y, x) AS slope_v_dec, regr_slope(y, x) * 1000 AS slope_mv_dec, regr_intercept(y, x) AS intercept_v,
       regr_r2(y, x) AS r_squared FROM s GROUP BY 1
""", floats="slope_v_dec slope_mv_dec intercept_v r_squared", digits=5)
def f2tafel(t):
    o = t.orders.withColumn("eta", F.col("o_custkey") / 1000)
    return fit.tafel(o, "eta", "o_totalprice", "o_orderpriority").drop("exchange_current_a")


@query("f2_arrhenius", """
WITH s AS (SELECT p_brand, 1.0::DOUBLE / (p_size + 250) AS x, ln(p_retailprice) AS y FROM part)
SELECT p_brand, -regr_slope(y, x) * 8.617333262145e-5 AS activation_energy_ev, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
       regr_r2(y, x) AS r_squared FROM s GROUP BY 1
""", floats="activation_energy_ev slope intercept r_squared", digits=5)
def f2arrhenius(t):
    p = t.part.withColumn("kelvin", F.col("p_size") + 250)
    return fit.arrhenius(p, "kelvin", "p_retailprice", "p_brand").drop("prefactor")


@query("f2_conductivity", """
WITH s AS (SELECT l_linestatus, abs(regr_slope(l_extendedprice, l_quantity)) AS r, regr_r2(l_extendedprice, l_quantity) AS r_squared FROM lineitem GROUP BY 1)
SELECT l_linestatus, r AS resistance, r * 2e-6 / 0.01::DOUBLE AS resistivity, 1 / (r * 2e-6 / 0.01::DOUBLE) AS conductivity,
       r * 2e-6 / 0.01::DOUBLE / 0.001::DOUBLE AS sheet_resistance, r_squared FROM s
""", floats="resistance resistivity conductivity sheet_resistance r_squared", digits=5)
def f2conductivity(t):
    return fit.conductivity_from_iv(t.lineitem, "l_extendedprice", "l_quantity", 0.01, 2e-6, 0.001, "l_linestatus")


@query("f2_calibration_power", """
WITH s AS (SELECT p_brand, p_size AS c, p_retailprice AS r FROM part),
     f AS (SELECT p_brand, exp(regr_intercept(ln(r), ln(c))) AS a, regr_slope(ln(r), ln(c)) AS b FROM s GROUP BY 1)
SELECT p_brand, a, b, 1 - sum((r - a * power(c, b)) ** 2) / (var_pop(r) * count(*)) AS r_squared FROM s JOIN f USING (p_brand) GROUP BY 1, 2, 3
""", floats="a b r_squared", digits=5)
def f2power(t):
    return fit.calibration_curve(t.part, "p_size", "p_retailprice", "power", "p_brand")


@query("f2_calibration_linear", """
SELECT p_brand, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept,
       regr_r2(p_retailprice, p_size) AS r_squared FROM part GROUP BY 1
""", floats="slope intercept r_squared", digits=5)
def f2linear(t):
    return fit.calibration_curve(t.part, "p_size", "p_retailprice", "linear", "p_brand")


@query("f2_tauc", """
WITH s AS (SELECT p_brand, 1 + p_retailprice / 1000 AS e, (p_size / 50 * (1 + p_retailprice / 1000)) ** 2 AS y FROM part),
     k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY y DESC, e) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM s WHERE y > 0),
     c AS (SELECT * FROM k WHERE i <= greatest(round_even(n * 0.35::DOUBLE, 0), 4))
SELECT p_brand, -regr_intercept(y, e) / regr_slope(y, e) AS band_gap_ev, regr_slope(y, e) AS slope, regr_intercept(y, e) AS intercept,
       regr_r2(y, e) AS r_squared FROM c GROUP BY 1
""", floats="band_gap_ev slope intercept r_squared", digits=5)
def f2tauc(t):
    p = t.part.withColumn("energy", 1 + F.col("p_retailprice") / 1000).withColumn("absorbance", F.col("p_size") / 50)
    return fit.tauc_band_gap(p, "energy", "absorbance", "p_brand")


@query("f3_polynomial_degree1", """
SELECT user_id, count(*) AS n, regr_intercept(y, x) AS c0, regr_slope(y, x) AS c1, regr_r2(y, x) AS r_squared FROM (
  SELECT user_id, value AS y, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS x FROM events) GROUP BY 1
""", floats="c0 c1 r_squared", digits=5)
def f3(t):
    return fit.polynomial_fit(t.events, "ts", "value", 1, "user_id").select(
        "user_id", "n", F.get("coefficients", F.lit(0)).alias("c0"), F.get("coefficients", F.lit(1)).alias("c1"), "r_squared")


@query("f3_polynomial_degree4")
def f3b(t):
    return fit.polynomial_fit(t.lineitem, "l_quantity", "l_extendedprice", 4, "l_returnflag")


@query("c5_detrend", """
WITH s AS (SELECT event_id, user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS i FROM events),
     f AS (SELECT user_id, regr_slope(value, i) AS a, regr_intercept(value, i) AS b FROM s GROUP BY 1 HAVING count(*) > 1)
SELECT event_id, value - (a * i + b) AS y FROM s LEFT JOIN f USING (user_id)
""", floats="y")
def c5(t):
    return fit.detrend(t.events, "value", 1, None, "user_id", ["ts", "event_id"], "y").select("event_id", "y")


@query("d9_residuals", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_shipdate, a * l_quantity + b AS fitted, l_extendedprice - (a * l_quantity + b) AS residual FROM lineitem, f
""", floats="fitted residual", digits=4)
def d9(t):
    out = fit.polynomial_predict(t.lineitem, "l_quantity", "l_extendedprice", 1)
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "fitted", (F.col("l_extendedprice") - F.col("fitted")).alias("residual"))


PREDICTORS = ["l_quantity", "l_discount", "l_tax"]


@query("f8_regression_one_predictor", """
WITH s AS (SELECT l_linestatus, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT l_linestatus, 'Intercept' AS term, b AS estimate FROM s UNION ALL SELECT l_linestatus, 'l_quantity', a FROM s
""", floats="estimate", digits=5)
def f8(t):
    return fit.linear_regression(t.lineitem, ["l_quantity"], "l_extendedprice", "l_linestatus").select("l_linestatus", "term", "estimate")


@query("f8_regression")
def f8b(t):
    return fit.linear_regression(t.lineitem, PREDICTORS, "l_extendedprice", "l_returnflag")


@query("f8_regression_summary")
def f8c(t):
    return fit.regression_summary(t.lineitem, PREDICTORS, "l_extendedprice", "l_returnflag")


@query("f9_row_diagnostics")
def f9(t):
    return fit.row_diagnostics(t.lineitem, PREDICTORS, "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "fitted", "residual", "leverage", "std_residual", "cooks_distance")


@query("f9_residual_tests")
def f9b(t):
    return fit.residual_tests(t.lineitem, PREDICTORS, "l_extendedprice", ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"])


# ---- hypothesis tests ----
@query("t1_one_sample_t", """
SELECT event_type, count(*) AS n, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS statistic, count(*) - 1.0::DOUBLE AS df,
       avg(value) AS estimate, (avg(value) - 50) / stddev_samp(value) AS cohen_d,
       (avg(value) - 50) / stddev_samp(value) * (1 - 3.0::DOUBLE / (4 * (count(*) - 1) - 1)) AS hedges_g FROM events GROUP BY 1
""", floats="statistic df estimate cohen_d hedges_g")
def t1(t):
    return hyp.one_sample_t(t.events, "value", 50.0, "event_type").select(
        "event_type", "n", "statistic", "df", "estimate", "cohen_d", "hedges_g")


Z = "1.959963984540054::DOUBLE"  # the 97.5 % point of the normal law


@query("t1_one_sample_t_full", f"""
WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s, count(*) - 1.0::DOUBLE AS v FROM events GROUP BY 1),
     t AS (SELECT *, (m - 50) / (s / sqrt(n)) AS t FROM m),
     p AS (SELECT event_type, 2 * sum(CASE WHEN k IN (0, 8000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5::DOUBLE * (v + 1) * ln(1 + (abs(t) + k * 0.005) ** 2 / v))) * 0.005 / 3
                  * exp(any_value(lgamma((v + 1) / 2) - lgamma(v / 2))) / sqrt(any_value(v) * pi()) AS p_value FROM t, generate_series(0, 8000) g(k) GROUP BY 1),
     q AS (SELECT *, {Z} + ({Z} ** 3 + {Z}) / (4 * v) + (5 * {Z} ** 5 + 16 * {Z} ** 3 + 3 * {Z}) / (96 * v * v)
                  + (3 * {Z} ** 7 + 19 * {Z} ** 5 + 17 * {Z} ** 3 - 15 * {Z}) / (384 * v ** 3) AS q FROM t JOIN p USING (event_type))
SELECT event_type, n, m AS estimate, s / sqrt(n) AS standard_error, v AS df, t AS statistic, p_value, m - q * s / sqrt(n) AS ci_low, m + q * s / sqrt(n) AS ci_high,
       (m - 50) / s AS cohen_d, (m - 50) / s * (1 - 3.0::DOUBLE / (4 * v - 1)) AS hedges_g FROM q
""", floats="estimate standard_error df statistic p_value ci_low ci_high cohen_d hedges_g")
def t1b(t):
    return hyp.one_sample_t(t.events, "value", 50.0, "event_type")


TWO = """
SELECT count(*) FILTER (WHERE g = 'click') AS n1, count(*) FILTER (WHERE g = 'view') AS n2, avg(x) FILTER (WHERE g = 'click') AS m1,
       avg(x) FILTER (WHERE g = 'view') AS m2, var_samp(x) FILTER (WHERE g = 'click') AS v1, var_samp(x) FILTER (WHERE g = 'view') AS v2
FROM (SELECT event_type AS g, value AS x FROM events)
"""


@query("t2_welch_t", f"""
SELECT n1 AS n_first, n2 AS n_second, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS statistic,
       (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS df,
       (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS cohen_d FROM ({TWO})
""", floats="statistic df cohen_d")
def t2(t):
    return hyp.independent_t(t.events, "value", "event_type", "click", "view").select(
        "n_first", "n_second", "statistic", "df", "cohen_d")


@query("t2_pooled_t", f"""
SELECT n1 AS n_first, n2 AS n_second, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS statistic,
       n1 + n2 - 2.0::DOUBLE AS df FROM ({TWO})
""", floats="statistic df")
def t2b(t):
    return hyp.independent_t(t.events, "value", "event_type", "click", "view", equal_var=True).select(
        "n_first", "n_second", "statistic", "df")


@query("t3_paired_t", """
SELECT l_returnflag, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS statistic FROM (
  SELECT l_returnflag, l_discount - l_tax AS d FROM lineitem) GROUP BY 1
""", floats="statistic", digits=5)
def t3(t):
    return hyp.paired_t(t.lineitem, "l_discount", "l_tax", "l_returnflag").select("l_returnflag", "n", "statistic")


@query("t4_one_way_anova", """
WITH g AS (SELECT l_linestatus, l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
     s AS (SELECT *, sum(n * m) OVER u / sum(n) OVER u AS gm FROM g WINDOW u AS (PARTITION BY l_linestatus)),
     a AS (SELECT l_linestatus, sum(n) AS n, count(*) AS k, sum(n * (m - gm) ** 2) AS ssb, sum(n * v) AS ssw FROM s GROUP BY 1)
SELECT l_linestatus, n::BIGINT AS n, k AS groups, (ssb / (k - 1)) / (ssw / (n - k)) AS f_statistic, ssb / (ssb + ssw) AS eta_squared,
       greatest(0.0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k))) AS omega_squared FROM a
""", floats="f_statistic eta_squared omega_squared")
def t4(t):
    return hyp.one_way_anova(t.lineitem, "l_extendedprice", "l_returnflag", "l_linestatus").select(
        "l_linestatus", "n", "groups", "f_statistic", "eta_squared", "omega_squared")


@query("t5_anova_cells", """
SELECT l_returnflag AS level_a, l_linestatus AS level_b, count(*) AS n, avg(l_extendedprice) AS mean, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2
""", floats="mean ss", digits=0)
def t5(t):
    return hyp.anova_cells(t.lineitem, "l_extendedprice", "l_returnflag", "l_linestatus")


@query("t5_two_way_anova")
def t5b(t):
    return hyp.two_way_anova(t.lineitem, "l_extendedprice", "l_returnflag", "l_linestatus", interaction=False)


@query("t5_two_way_anova_type3")
def t5c(t):
    big = t.lineitem.withColumn("late", F.month("l_shipdate") > 6)
    return hyp.two_way_anova(big, "l_quantity", "l_returnflag", "late", "l_linestatus", ss_type=3)


RANKS = """
WITH x AS (SELECT * FROM ({src})),
     r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x)
"""


@query("t6_mann_whitney", RANKS.format(src="SELECT event_type AS g, value AS v FROM events WHERE event_type IN ('click', 'view')") + """
SELECT count(*) FILTER (WHERE g = 'click') AS n_first, count(*) FILTER (WHERE g = 'view') AS n_second,
       sum(r) FILTER (WHERE g = 'click') - count(*) FILTER (WHERE g = 'click') * (count(*) FILTER (WHERE g = 'click') + 1) / 2 AS statistic,
       quantile_cont(v, 0.5) FILTER (WHERE g = 'click') AS first_median FROM r
""", floats="statistic first_median")
def t6(t):
    return hyp.mann_whitney(t.events, "value", "event_type", "click", "view").select(
        "n_first", "n_second", "statistic", "first_median")


@query("t6_mann_whitney_full", """
WITH x AS (SELECT event_type, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS g, value AS v FROM events),
     r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2 AS r FROM x),
     t AS (SELECT event_type, sum(c * c * c - c) AS tt FROM (SELECT event_type, count(*)::DOUBLE AS c FROM x GROUP BY event_type, v) GROUP BY 1),
     m AS (SELECT event_type, count(*) FILTER (WHERE g = 'am') AS n1, count(*) FILTER (WHERE g = 'pm') AS n2, sum(r) FILTER (WHERE g = 'am') AS s,
                  quantile_cont(v, 0.5) FILTER (WHERE g = 'am') AS first_median, quantile_cont(v, 0.5) FILTER (WHERE g = 'pm') AS second_median FROM r GROUP BY 1),
     u AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u, n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - tt / ((n1 + n2)::DOUBLE * (n1 + n2 - 1))) AS v FROM m JOIN t USING (event_type)),
     z AS (SELECT *, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(v) AS z FROM u),
     p AS (SELECT event_type, least(1, 2 * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5::DOUBLE * (z + k * 0.0025) ** 2)) * 0.0025 / 3 / sqrt(2 * pi())) AS p_value
           FROM z, generate_series(0, 4000) g(k) GROUP BY 1)
SELECT event_type, n1 AS n_first, n2 AS n_second, u AS statistic, p_value, 2 * u / (n1::DOUBLE * n2) - 1 AS rank_biserial, first_median, second_median FROM z JOIN p USING (event_type)
""", floats="statistic p_value rank_biserial first_median second_median")
def t6b(t):
    e = t.events.withColumn("half", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    return hyp.mann_whitney(e, "value", "half", "am", "pm", "event_type")


@query("t7_wilcoxon", RANKS.format(src="SELECT abs(l_discount - l_tax) AS v, sign(round(l_discount - l_tax, 9)) AS s FROM (SELECT round(l_discount, 2) AS l_discount, round(l_tax, 2) AS l_tax FROM lineitem) WHERE l_discount <> l_tax").replace("abs(l_discount - l_tax)", "abs(round(l_discount - l_tax, 6))") + """
SELECT count(*) AS nonzero_pairs, least(sum(r) FILTER (WHERE s > 0), sum(r) FILTER (WHERE s < 0)) AS statistic,
       (coalesce(sum(r) FILTER (WHERE s > 0), 0) - coalesce(sum(r) FILTER (WHERE s < 0), 0)) / sum(r) AS rank_biserial FROM r
""", floats="statistic rank_biserial")
def t7(t):
    d = t.lineitem.withColumn("d", F.round(F.round("l_discount", 2) - F.round("l_tax", 2), 6))
    return hyp.wilcoxon(d, "d").select("nonzero_pairs", "statistic", "rank_biserial")


@query("t7_wilcoxon_full", """
WITH d AS (SELECT l_returnflag AS f, round(round(l_discount, 2) - round(l_tax, 2), 6) AS d FROM lineitem),
     r AS (SELECT *, rank() OVER (PARTITION BY f ORDER BY abs(d)) + (count(*) OVER (PARTITION BY f, abs(d)) - 1) / 2 AS r FROM d),
     w AS (SELECT f, abs(d) AS a, rank() OVER (PARTITION BY f ORDER BY abs(d)) + (count(*) OVER (PARTITION BY f, abs(d)) - 1) / 2 AS r, d FROM d WHERE d <> 0),
     e AS (SELECT f, (sum(r) FILTER (WHERE d > 0) - sum(r) FILTER (WHERE d < 0)) / sum(r) AS rank_biserial FROM w GROUP BY 1),
     t AS (SELECT f, sum(c * c * c - c) AS tt FROM (SELECT f, count(*)::DOUBLE AS c FROM d WHERE d <> 0 GROUP BY f, abs(d)) GROUP BY 1),
     m AS (SELECT f, count(*) AS pairs, count(*)::DOUBLE AS n, count(*) FILTER (WHERE d = 0)::DOUBLE AS z0, sum(r) FILTER (WHERE d > 0) AS plus, sum(r) FILTER (WHERE d < 0) AS minus,
                  quantile_cont(d, 0.5) AS median_difference FROM r GROUP BY 1),
     z AS (SELECT *, abs(plus - (n * (n + 1) / 4 - z0 * (z0 + 1) / 4)) / sqrt((n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - tt / 2) / 24) AS z FROM m JOIN t USING (f)),
     p AS (SELECT f, least(1, 2 * sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5::DOUBLE * (z + k * 0.0025) ** 2)) * 0.0025 / 3 / sqrt(2 * pi())) AS p_value
           FROM z, generate_series(0, 4000) g(k) GROUP BY 1)
SELECT f AS l_returnflag, pairs, pairs - z0::BIGINT AS nonzero_pairs, least(plus, minus) AS statistic, p_value, rank_biserial, median_difference FROM z JOIN p USING (f) JOIN e USING (f)
""", floats="statistic p_value rank_biserial median_difference")
def t7b(t):
    d = t.lineitem.withColumn("d", F.round(F.round("l_discount", 2) - F.round("l_tax", 2), 6))
    return hyp.wilcoxon(d, "d", None, "l_returnflag", zero_method="pratt")


@query("t8_kruskal", RANKS.format(src="SELECT c_mktsegment AS g, c_acctbal AS v FROM customer") + """
, g AS (SELECT g, count(*) AS n, sum(r) AS s FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS tt FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v))
SELECT sum(n)::BIGINT AS n, count(*) AS groups,
       (12.0::DOUBLE / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - any_value(tt) / (sum(n)::DOUBLE ** 3 - sum(n))) AS statistic FROM g, t
""", floats="statistic")
def t8(t):
    return hyp.kruskal_wallis(t.customer, "c_acctbal", "c_mktsegment").select("n", "groups", "statistic")


@query("t9_levene", """
WITH c AS (SELECT event_type AS g, quantile_cont(value, 0.5) AS c FROM events GROUP BY 1),
     d AS (SELECT g, abs(value - c) AS z FROM events JOIN c ON g = event_type),
     s AS (SELECT g, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM d GROUP BY 1)
SELECT sum(n)::BIGINT AS n, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS statistic
FROM s, (SELECT avg(z) AS gm FROM d)
""", floats="statistic")
def t9(t):
    return hyp.levene(t.events, "value", "event_type").select("n", "statistic")


@query("t9_levene_trimmed")
def t9b(t):
    return hyp.levene(t.events, "value", "event_type", center="trimmed")


@query("t10_shapiro")
def t10(t):
    return hyp.shapiro_wilk(t.events, "value", "event_type")


P_SQL = """
WITH p AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value / 1000 END AS p FROM events),
     k AS (SELECT *, count(p) OVER (PARTITION BY user_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY p NULLS LAST, event_id) AS i FROM p)
SELECT event_id, CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, {f}) END AS p_adjusted FROM k
"""


@query("t11_holm", P_SQL.format(f="max((k - i + 1) * p) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING)"), floats="p_adjusted")
def t11(t):
    return p_adjusted(t, "holm")


@query("t11_bh", P_SQL.format(f="min(p * k / i) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"), floats="p_adjusted", digits=12)
def t11b(t):
    return p_adjusted(t, "fdr_bh")


@query("t11_bonferroni", P_SQL.format(f="p * k"), floats="p_adjusted")
def t11c(t):
    return p_adjusted(t, "bonferroni")


@query("t11_by_one_family", """
WITH k AS (SELECT event_id, value / 1000 AS p, count(*) OVER () AS k, row_number() OVER (ORDER BY value / 1000, event_id) AS i FROM events),
     h AS (SELECT sum(1.0::DOUBLE / g) AS h FROM range(1, (SELECT count(*) + 1 FROM events)) AS r(g))
SELECT event_id, least(1.0::DOUBLE, min(p * k * h / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adjusted FROM k, h
""", floats="p_adjusted")
def t11d(t):
    e = t.events.withColumn("p", F.col("value") / 1000)
    return hyp.adjust_p_values(e, "p", ["event_id"], None, "fdr_by").select("event_id", "p_adjusted")


def p_adjusted(t, method):
    e = t.events.withColumn("p", F.when(F.col("event_type") != "error", F.col("value") / 1000))
    return hyp.adjust_p_values(e, "p", ["event_id"], "user_id", method).select("event_id", "p_adjusted")


@query("t12_assumptions")
def t12(t):
    return hyp.assumption_rows(t.events, "value", "event_type")


@query("t12_effect_label", """
SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_discount < 0.01 THEN 'negligible' WHEN l_discount < 0.06 THEN 'small' WHEN l_discount < 0.14 THEN 'medium' ELSE 'large' END AS label FROM lineitem
""")
def t12b(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", hyp.effect_label(F.col("l_discount"), "variance").alias("label"))
