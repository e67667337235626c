"""Checks of formulas, nonlinear fits, recipes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.common import query
from catalog.tables import HOLES, holes, scratch
from sigtab.functions import models
from sigtab.operators import describe, distributions, laboratory as lab, nonlinear as nl, recipes
from sigtab.streaming import sensor


@query("p15_dilution_limits", """
SELECT l_orderkey, l_linenumber, l_shipdate, CASE WHEN l_quantity > 10 THEN l_extendedprice * 10 / l_quantity ELSE CASE WHEN l_quantity = 10 THEN l_extendedprice END END AS ppm,
       3 * l_discount / nullif(abs(l_tax), 0) AS lod, 10 * l_discount / nullif(abs(l_tax), 0) AS loq FROM lineitem
""", floats="ppm lod loq")
def p15(t):
    lod, loq = lab.detection_limits("l_tax", "l_discount")
    li = t.lineitem.withColumn("gas", F.lit(10.0))
    return li.select("l_orderkey", "l_linenumber", "l_shipdate", lab.dilution_ppm("l_extendedprice", "gas", "l_quantity").alias("ppm"), lod.alias("lod"), loq.alias("loq"))


@query("p16_scherrer_area", """
SELECT p_partkey, 0.9::DOUBLE * 1.5406::DOUBLE / (radians(p_size / 100.0::DOUBLE) * cos(radians(p_retailprice / 30 / 2))) AS size,
       abs(p_retailprice) / (2.69e5 * sqrt(1e-5) * 1e-6) AS area FROM part
""", floats="size area", digits=3)
def p16(t):
    p = t.part.withColumns({"angle": F.col("p_retailprice") / 30, "width": F.col("p_size") / 100})
    return p.select("p_partkey", lab.scherrer_size("angle", "width").alias("size"), lab.active_area("p_retailprice").alias("area"))


@query("p16_propagation", """
SELECT o_orderkey % 500 AS g, 2 * exp(sum(p * ln(v))) AS value, 2 * exp(sum(p * ln(v))) * sqrt(sum((p * u / v) ** 2)) AS uncertainty, sqrt(sum((p * u / v) ** 2)) AS relative
FROM (SELECT o_orderkey, o_totalprice / 100000 AS v, o_totalprice / 5000000 AS u, (o_custkey % 3 - 1) / 4 AS p FROM orders) GROUP BY 1
""", floats="value uncertainty relative")
def p16b(t):
    o = t.orders.select((F.col("o_orderkey") % 500).alias("g"), (F.col("o_totalprice") / 100000).alias("v"),
                        (F.col("o_totalprice") / 5000000).alias("u"), ((F.col("o_custkey") % 3 - 1) / 4).alias("p"))
    return lab.propagate_product(o, "v", "u", "p", "g", 2.0)


@query("p17_models", """
SELECT event_id, 3 * exp(-0.5::DOUBLE * ((value - 40) / 12) ** 2) + 1 AS gaussian, 3 / (1 + ((value - 40) / 12) ** 2) + 1 AS lorentzian,
       5 / (1 + exp(-0.1::DOUBLE * (value - 50))) AS logistic, 2 * exp(-value / 30) + 0.5 AS decay, 2 * sin(0.3::DOUBLE * value + 1) AS sine, 2 * power(value, 0.5::DOUBLE) - 1 AS power FROM events
""", floats="gaussian lorentzian logistic decay sine power")
def p17(t):
    return t.events.select(
        "event_id", models.gaussian("value", 3, 40, 12, 1).alias("gaussian"), models.lorentzian("value", 3, 40, 12, 1).alias("lorentzian"),
        models.logistic("value", 5, 0.1, 50).alias("logistic"), models.decay("value", 2, 30, 0.5).alias("decay"),
        models.sine("value", 2, 0.3, 1).alias("sine"), models.power_law("value", 2, 0.5, -1).alias("power"))


# ---- nonlinear fits ----
@query("f4_formula_fit", """
SELECT p_brand, count(*) AS n, regr_intercept(p_retailprice, p_size) AS a, regr_slope(p_retailprice, p_size) AS b, regr_r2(p_retailprice, p_size) AS r_squared FROM part GROUP BY 1
""", floats="a b r_squared", digits=4)
def f4(t):
    got = nl.fit_model(t.part, "p_size", "p_retailprice", "a + b * x", "p_brand", ["a", "b"], {"a": 0.0, "b": 0.0})
    return got.select("p_brand", "n", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"), "r_squared")


def survival(t):
    cdf = distributions.empirical_cdf(t.events, "value", "event_type")
    return cdf.withColumn("left_over", 1 - F.col("cdf"))


@query("f4_decay_fit")
def f4b(t):
    got = nl.fit_model(survival(t), "value", "left_over", "exp1", "event_type")
    return nl.parameter_rows(got, ["amplitude", "tau", "offset"], "event_type")


@query("f4_one_large_series")
def f4c(t):
    got = nl.fit_model(t.lineitem, "l_quantity", "l_extendedprice", "a + b * x + c * sin(x / 8)", None, ["a", "b", "c"], {"a": 1, "b": 1, "c": 1})
    return got.select("n", "params", "errors", "r_squared", "rmse", "chi2_reduced", "aic", "bic")


@query("f5_shared_slope", """
WITH s AS (SELECT p_brand, avg(p_size) AS mx, avg(p_retailprice) AS my, regr_sxx(p_retailprice, p_size) AS sxx, regr_sxy(p_retailprice, p_size) AS sxy FROM part GROUP BY 1),
     b AS (SELECT sum(sxy) / sum(sxx) AS b FROM s)
SELECT p_brand, my - b * mx AS a, b FROM s, b
""", floats="a b", digits=4)
def f5(t):
    got = nl.global_fit(t.part, "p_brand", "p_size", "p_retailprice", "a + b * x", ["b"], {"a": 0.0, "b": 0.0}, ["a", "b"])
    return got.select("p_brand", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"))


@query("f5_shared_decay")
def f5b(t):
    return nl.global_fit(survival(t), "event_type", "value", "left_over", "exp1", ["tau"], {"amplitude": 1.0, "tau": 40.0, "offset": 0.0})


@query("f6_rc_constant")
def f6(t):
    return nl.rc_time_constant(distributions.empirical_cdf(t.events, "value", "event_type"), "value", "cdf", "charge", "event_type")


def hourly(t):
    """Mean value per two-hour slot, one curve per event type."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(7.2e9)).cast("double")
    return t.events.groupBy("event_type", slot.alias("x")).agg(F.avg("value").alias("y"), F.stddev_pop("value").alias("spread"))


@query("f7_peak_fit")
def f7(t):
    return nl.fit_peaks(hourly(t), "x", "y", "event_type")


@query("f7_peak_fit_columns")
def f7b(t):
    return nl.fit_peaks_columns(hourly(t), "x", ["y", "spread"], "event_type")


@query("u1_formula_predict", """
WITH f AS (SELECT p_brand, regr_intercept(p_retailprice, p_size) AS a, regr_slope(p_retailprice, p_size) AS b FROM part GROUP BY 1)
SELECT p_partkey, a + b * p_size AS fitted FROM part JOIN f USING (p_brand)
""", floats="fitted", digits=4)
def u1(t):
    got = nl.fit_model(t.part, "p_size", "p_retailprice", "a + b * x", "p_brand", ["a", "b"], {"a": 0.0, "b": 0.0})
    return nl.predict(t.part, got, "p_size", "a + b * x", "p_brand", ["a", "b"]).select("p_partkey", "fitted")


# ---- recipes ----
@query("u2_replay", f"""
WITH e AS (SELECT event_id, user_id, ts, {HOLES} AS y FROM events),
     f AS (SELECT *, coalesce(y, avg(y) OVER (PARTITION BY user_id)) AS v FROM e),
     o AS (SELECT *, avg(v) OVER (PARTITION BY user_id) AS m, stddev_samp(v) OVER (PARTITION BY user_id) AS s FROM f),
     k AS (SELECT event_id, user_id, ts, v FROM o WHERE NOT coalesce(abs(v - m) / nullif(s, 0) > 3, false) AND v BETWEEN 0 AND 200),
     z AS (SELECT event_id, user_id, ts, (v - avg(v) OVER u) / nullif(stddev_samp(v) OVER u, 0) AS y FROM k WINDOW u AS (PARTITION BY user_id))
SELECT event_id, y, CASE WHEN count(y) OVER w >= 3 THEN avg(y) OVER w END AS ma FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 8 PRECEDING)
""", floats="y ma")
def u2(t):
    steps = """[{"op": "fill_missing", "params": {"col": "y", "method": "mean"}}, {"op": "remove_outliers", "params": {"col": "y"}},
                {"op": "crop_range", "params": {"col": "y", "min_value": 0, "max_value": 200}}, {"op": "not a step"},
                {"op": "normalize_column", "params": {"col": "y"}}, {"op": "add_moving_average", "params": {"col": "y", "window": 9, "new_col": "ma"}}]"""
    return recipes.replay(holes(t), steps, "user_id", ["ts", "event_id"], strict=False).select("event_id", "y", "ma")


@query("u3_sources", """
SELECT user_id, CASE WHEN count(*) >= 60 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN count(*) >= 60 THEN count(*) END AS "metric.n",
       CASE WHEN count(*) >= 60 THEN avg(value) END AS "metric.mean" FROM events GROUP BY 1
""", floats="metric.mean")
def u3(t):
    def analysis(df, by):
        return df.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean")).filter("n >= 60")
    return recipes.analyse_sources(t.events, "user_id", analysis)


@query("u3_source_files", "SELECT count(*) AS ok, 0::BIGINT AS failed, count(*) AS total FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def u3b(t):
    path = scratch(t, "files")
    t.orders.repartition("o_orderpriority").write.mode("overwrite").partitionBy("o_orderpriority").csv(path)
    files = recipes.with_source(t.spark.read.schema("k bigint, c bigint, s string, y double, d string").csv(path))
    return recipes.count_status(recipes.analyse_sources(files, "source", lambda df, by: describe.kpi_table(df, ["y"], by).drop("column")))


@query("u4_user_operation", "SELECT p_partkey, p_retailprice * 3 AS y FROM part", floats="y")
def u4(t):
    if "triple" not in recipes._USER:
        recipes.register("triple", lambda df, column: df.withColumn("y", F.col(column) * 3), {"column": str})
    return recipes.run("triple", t.part, column="p_retailprice").select("p_partkey", "y")


# ---- streams: the events table written as files, streamed to the end and read back ----
def drained(t, stream, name):
    base = scratch(t, name)
    sensor.append_to(stream, f"{base}/out", f"{base}/check", every=None).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def streamed(t, df, name):
    path = scratch(t, name)
    df.write.mode("overwrite").parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


def lines(t):
    """Events as text lines of three kinds: records, records with one more field, and broken ones."""
    body = F.concat(F.lit('{"value": '), F.col("value").cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"'))
    line = F.when(F.col("event_id") % 10 == 3, F.concat(body, F.lit(', "extra": 1}'))).when(F.col("event_id") % 10 == 7, F.concat(body, F.lit(", oops"))).when(
        F.col("event_id") % 10 == 9, F.lit('{"kind": "none"}')).otherwise(F.concat(body, F.lit("}")))
    return t.events.select(F.col("user_id").cast("string").alias("device"), F.col("event_id").alias("seq"), line.alias("value"))


RECORD = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("kind", T.StringType())])


@query("x1_parse_json", """
SELECT user_id::VARCHAR AS device, event_id AS seq, value, event_type AS kind FROM events WHERE event_id % 10 NOT IN (7, 9)
""", floats="value")
def x1(t):
    return drained(t, sensor.accepted(sensor.parse_lines(streamed(t, lines(t), "x1"), RECORD)), "x1o")


@query("x1_rejected", """
SELECT user_id::VARCHAR AS device, event_id AS seq, CASE event_id % 10 WHEN 7 THEN 'Invalid JSON' WHEN 9 THEN 'record needs at least one numeric field' ELSE 'ignored field(s): extra' END AS reason
FROM events WHERE event_id % 10 IN (3, 7, 9)
""")
def x1b(t):
    return drained(t, sensor.rejected(sensor.parse_lines(streamed(t, lines(t), "x1r"), RECORD)), "x1s").drop("line")


@query("x1_parse_csv", "SELECT event_id AS seq, value, event_type AS kind FROM events WHERE event_id % 10 <> 7", floats="value")
def x1c(t):
    line = F.when(F.col("event_id") % 10 == 7, F.lit("1,2,3")).otherwise(F.concat_ws(",", F.col("value").cast("string"), "event_type"))
    text = t.events.select(F.col("event_id").alias("seq"), line.alias("value"))
    head = t.events.limit(1).select(F.lit(-1).cast("bigint").alias("seq"), F.lit("value,kind").alias("value"))
    return drained(t, sensor.accepted(sensor.parse_lines(streamed(t, text.unionByName(head), "x1c"), RECORD, "csv")), "x1d")


@query("x3_channels", """
SELECT event_id, value AS level, CASE WHEN value > 0 AND value < 100 THEN 1000 * value / (100 - value) END AS resistance FROM events
""", floats="level resistance", digits=4)
def x3(t):
    stream = streamed(t, t.events.select("event_id", "value"), "x3")
    made = sensor.channel_values(stream, {"level": {"source": ["volt", "VALUE"]}, "resistance": {"source": "value", "divider": {"supply": 100.0, "reference": 1000.0, "topology": "sensor_low"}}})
    return drained(t, made.select("event_id", "level", "resistance"), "x3o")


def channels(t):
    e = holes(t).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return sensor.to_channels(e, "user_id", "ts", "event_id", ["y", "k"])


@query("x4_moving_average", f"""
WITH e AS (SELECT event_id, user_id, ts, {HOLES} AS y, json_extract(props, '$.k')::DOUBLE AS k FROM events),
     l AS (SELECT event_id, user_id, ts, 'y' AS channel, y AS value FROM e UNION ALL SELECT event_id, user_id, ts, 'k', k FROM e),
     a AS (SELECT *, avg(value) OVER (PARTITION BY user_id, channel ORDER BY ts, event_id ROWS 4 PRECEDING) AS average FROM l WHERE value IS NOT NULL)
SELECT l.user_id::VARCHAR AS device, l.channel, l.event_id AS seq, l.value, average FROM l LEFT JOIN a ON a.event_id = l.event_id AND a.channel = l.channel
""", floats="value average")
def x4(t):
    return drained(t, sensor.moving_average(streamed(t, channels(t), "x4"), 5), "x4o").drop("ts")


@query("x4_moving_average_table", f"""
WITH e AS (SELECT event_id, user_id, ts, {HOLES} AS y, json_extract(props, '$.k')::DOUBLE AS k FROM events),
     l AS (SELECT event_id, user_id, ts, 'y' AS channel, y AS value FROM e UNION ALL SELECT event_id, user_id, ts, 'k', k FROM e)
SELECT user_id::VARCHAR AS device, channel, event_id AS seq, avg(value) OVER (PARTITION BY user_id, channel ORDER BY ts, event_id ROWS 4 PRECEDING) AS average FROM l WHERE value IS NOT NULL
UNION ALL SELECT user_id::VARCHAR, channel, event_id, NULL FROM l WHERE value IS NULL
""", floats="average")
def x4b(t):
    return sensor.moving_average_table(channels(t), 5).select("device", "channel", "seq", "average")


@query("x5_exposure_states", """
WITH e AS (SELECT event_id, user_id, ts, value, CASE event_type WHEN 'signup' THEN 'on' WHEN 'error' THEN 'off' END AS mark FROM events),
     s AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS state, count(*) FILTER (WHERE mark IS NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
           FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
     n AS (SELECT user_id, coalesce(g, 0) AS g, string_agg('gas_' || mark, ';' ORDER BY ts, event_id) FILTER (WHERE mark IS NOT NULL) AS event FROM s GROUP BY 1, 2)
SELECT s.user_id::VARCHAR AS device, event_id AS seq, value, coalesce(state, 'off') AS gas_state, coalesce(event, '') AS event
FROM s LEFT JOIN n ON n.user_id = s.user_id AND n.g = coalesce(s.g, 0) WHERE mark IS NULL
""", floats="value")
def x5(t):
    e = t.events.select(F.col("user_id").cast("string").alias("device"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value", "event_type")
    stream = streamed(t, e, "x5")
    state = F.when(F.col("event_type") == "signup", "on").when(F.col("event_type") == "error", "off")
    marks = stream.withColumn("state", state).filter("state IS NOT NULL").select("device", "ts", "seq", "state", F.lit("").alias("label"))
    reads = stream.filter("event_type NOT IN ('signup', 'error')").select("device", "ts", "seq", "value")
    return drained(t, sensor.exposure_states(reads, marks), "x5o").drop("ts")


@query("x6_live_rate", """
WITH w AS (SELECT user_id AS device, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS samples FROM events GROUP BY 1, 2)
SELECT device, start, samples, samples / 86400 AS rate_hz FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
""", floats="rate_hz", digits=9)
def x6(t):
    return drained(t, sensor.live_rate(streamed(t, t.events.select("user_id", "ts"), "x6"), "user_id", "ts", "1 day"), "x6o").withColumn(
        "start", F.col("start").cast("timestamp_ntz"))


@query("x7_append_once", "SELECT count(*) AS n, sum(event_id)::BIGINT AS s FROM events")
def x7(t):
    """The same checkpoint is drained twice; nothing is written again."""
    stream, base = streamed(t, t.events.select("event_id", "value"), "x7"), scratch(t, "x7o")
    for _ in range(2):
        sensor.append_to(stream, f"{base}/out", f"{base}/check", every=None).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))
