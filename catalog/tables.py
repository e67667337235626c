"""Checks of sources, derived columns, row selection and joins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from catalog.common import query
from sigtab.operators import clean, derive, describe, joins, rows
from sigtab.plans.layout import shared_folder
from sigtab.sources import tables as src

SERIES = {"by": ["user_id"], "order": ["ts", "event_id"]}


def scratch(t, name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir=shared_folder(t.spark)) + "/data" \
        if os.path.isdir(shared_folder(t.spark)) else f"{shared_folder(t.spark)}/{name}"


# ---- sources and sinks ----
@query("s1_csv", """
SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_brand, p_type, p_size::DOUBLE AS p_size, p_retailprice FROM part
""", floats="p_partkey p_size p_retailprice")
def s1(t):
    path = scratch(t, "csv")
    t.part.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return src.read_table(t.spark, path)


@query("s2_json_records", """
SELECT event_id, event_type, ts, json_extract(props, '$.k')::BIGINT AS "props.k", value AS "measure.value" FROM events
""", floats="measure.value")
def s2(t):
    path = scratch(t, "json")
    nested = t.events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                             F.from_json("props", "k bigint").alias("props"), F.struct("value").alias("measure"))
    nested.write.mode("overwrite").json(path)
    return src.set_column_types(src.read_json(t.spark, path, multi_line=False), {"ts": "Datetime"})


@query("s2_json_columns", """
SELECT o_orderkey, o_totalprice FROM orders
""", floats="o_totalprice")
def s2b(t):
    path = scratch(t, "jsoncols")
    blocks = t.orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("s"))
    blocks.select("s.o_orderkey", "s.o_totalprice").write.mode("overwrite").json(path)
    return src.read_json(t.spark, path, multi_line=False)


@query("s3_xml", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM nation")
def s3(t):
    path = scratch(t, "xml")
    t.nation.write.mode("overwrite").format("xml").option("rowTag", "row").save(path)
    return src.read_xml(t.spark, path).select("n_name", "n_nationkey", "n_regionkey")


@query("s4_parquet", "SELECT r_regionkey, r_name FROM region")
def s4(t):
    return src.read_fixture(t.spark, t.folder, "region")


@query("s5_clean_header", """
SELECT n_nationkey AS column_1, n_name AS name, n_regionkey AS name_2 FROM nation
""")
def s5(t):
    return t.nation.toDF(*src.clean_header(["  ", "name", "name "]))


@query("s6_infer_types", """
SELECT CASE WHEN event_type <> 'error' THEN value END AS mostly_number, ts AS moment,
       event_type AS word, value AS grouped
FROM events
""", floats="mostly_number grouped")
def s6(t):
    e = t.events
    text = e.select(
        F.when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise("n/a?").alias("mostly_number"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), F.col("event_type").alias("word"),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("grouped"))
    return src.infer_types(text, share=0.75)


@query("s7_set_types", """
SELECT event_id::VARCHAR AS event_id, TRY_CAST(event_type AS BIGINT) AS event_type, value::DOUBLE AS value,
       ts, user_id FROM events
""", floats="value")
def s7(t):
    return src.set_column_types(t.events.drop("props"), {
        "event_id": "String", "event_type": "Integer", "value": "Float", "ts": "Datetime", "user_id": "Auto", "none": "Float"})


@query("s8_write_read", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def s8(t):
    path = scratch(t, "out")
    src.write_table(t.orders, path, "parquet", ["o_orderpriority"])
    return t.spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("s9_visible_range", """
SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'
""", floats="value")
def s9(t):
    return rows.visible_range(t.events.select("event_id", "ts", "value"), "ts", "2024-01-09", "2024-01-05")


@query("s9_occurrence_join", """
WITH a AS (SELECT l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS occurrence
           FROM lineitem WHERE l_returnflag <> 'R'),
     b AS (SELECT l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS occurrence
           FROM lineitem WHERE l_returnflag = 'R')
SELECT l_shipdate, occurrence, a.l_quantity AS a, b.l_quantity AS b FROM a FULL JOIN b USING (l_shipdate, occurrence)
""", floats="a b")
def s9b(t):
    order = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    back = F.col("l_returnflag") == "R"
    return joins.outer_by_occurrence({"a": t.lineitem.filter(~back), "b": t.lineitem.filter(back)}, "l_shipdate", "l_quantity", order)


@query("s10_append", """
SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer
""", floats="s_acctbal")
def s10(t):
    other = t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("s_acctbal"))
    return joins.append_rows(t.supplier.select("s_suppkey", "s_acctbal"), other)


@query("s11_fingerprint")
def s11(t):
    return src.fingerprint(t.lineitem)


@query("s12_compare_versions", """
SELECT count(*) AS old_rows, count(*) FILTER (WHERE l_quantity > 1) AS new_rows, true AS changed FROM lineitem
""")
def s12(t):
    return src.compare_versions(t.lineitem, t.lineitem.filter("l_quantity > 1")).select("old_rows", "new_rows", "changed")


# ---- derived columns ----
@query("p1_formula", """
SELECT l_orderkey, l_linenumber, l_shipdate,
       sqrt(l_quantity) * 2 + l_extendedprice / nullif(l_quantity, 0) - power(l_tax, 2)
       + greatest(sin(l_discount), 0.03) - least(abs(0.05 - l_tax), 0.01) AS y,
       CASE WHEN l_discount > 0 THEN ln(l_discount) END AS z
FROM lineitem
""", floats="y z")
def p1(t):
    out = derive.derive(t.lineitem, "y", "sqrt(`l_quantity`) * 2 + l_extendedprice / l_quantity - l_tax ** 2"
                        " + maximum(sin(l_discount), 0.03) - minimum(abs(0.05 - l_tax), 0.01)")
    return derive.derive(out, "z", "log(l_discount)").select("l_orderkey", "l_linenumber", "l_shipdate", "y", "z")


@query("p2_formula_aggregates", """
SELECT event_id, (value - avg(value) OVER u) / stddev_pop(value) OVER u AS z,
       value / sum(value) OVER u * count(*) OVER u AS share, max(value) OVER u - min(value) OVER u AS span,
       value - g.mu AS centred
FROM events, (SELECT avg(value) AS mu FROM events) AS g WINDOW u AS (PARTITION BY user_id)
""", floats="z share span centred")
def p2(t):
    out = derive.derive(t.events, "z", "(value - mean(value)) / std(value)", by="user_id")
    out = derive.derive(out, "share", "value / sum(value) * len(value)", by="user_id")
    out = derive.derive(out, "span", "max(value) - min(value)", by="user_id")
    out = derive.derive(out, "centred", "value - mean(value)")
    return out.select("event_id", "z", "share", "span", "centred")


GRADIENT_SQL = """
WITH w AS (
  SELECT event_id, value, epoch_us(ts) / 1e6 AS x, lag(value) OVER u AS yb, lead(value) OVER u AS ya,
         epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER u AS hs, lead(epoch_us(ts) / 1e6) OVER u - epoch_us(ts) / 1e6 AS hd
  FROM events WINDOW u AS ({part} ORDER BY ts, event_id))
SELECT event_id, CASE WHEN hs IS NOT NULL AND hd IS NOT NULL
         THEN (hs*hs*ya + (hd*hd - hs*hs)*value - hd*hd*yb) / nullif(hs*hd*(hs+hd), 0)
       WHEN hd IS NOT NULL THEN (ya - value) / nullif(hd, 0) WHEN hs IS NOT NULL THEN (value - yb) / nullif(hs, 0)
       ELSE 0 END AS slope FROM w
"""


@query("p3_gradient", GRADIENT_SQL.format(part="PARTITION BY user_id"), floats="slope")
def p3(t):
    return derive.gradient(t.events, "value", "ts", **SERIES, name="slope").select("event_id", "slope")


@query("p3_gradient_one_series", GRADIENT_SQL.format(part=""), floats="slope")
def p3b(t):
    return derive.gradient(t.events, "value", "ts", [], ["ts", "event_id"], "slope").select("event_id", "slope")


INTEGRAL_SQL = """
WITH w AS (
  SELECT event_id, user_id, ts, coalesce((value + lag(value) OVER u) / 2
         * (epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER u), 0) AS part
  FROM events WINDOW u AS ({part} ORDER BY ts, event_id))
SELECT event_id, 5.0 + sum(part) OVER ({part} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS area FROM w
"""


@query("p4_integrate", INTEGRAL_SQL.format(part="PARTITION BY user_id"), digits=2, floats="area")
def p4(t):
    return derive.integrate(t.events, "value", "ts", **SERIES, name="area", initial=5.0).select("event_id", "area")


@query("p4_integrate_one_series", INTEGRAL_SQL.format(part=""), digits=2, floats="area")
def p4b(t):
    return derive.integrate(t.events, "value", "ts", [], ["ts", "event_id"], "area", 5.0).select("event_id", "area")


@query("p5_formula_extras", """
SELECT p_partkey, least(greatest(p_retailprice, 950), 1800) + pi() * p_size AS a,
       greatest(p_size, 10)::DOUBLE - least(p_retailprice, 1000) AS b, round_even(p_retailprice / 7, 2) AS c, exp(1) * p_size AS d
FROM part
""", floats="a b c d")
def p5(t):
    out = t.part
    for name, f in {"a": "clip(p_retailprice, 950, 1800) + pi * p_size", "b": "max(p_size, 10) - min(p_retailprice, 1000)",
                    "c": "round(p_retailprice / 7, 2)", "d": "e * p_size"}.items():
        out = derive.derive(out, name, f)
    return out.select("p_partkey", "a", "b", "c", "d")


@query("p6_magnitude", """
SELECT l_orderkey, l_linenumber, l_shipdate, sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax) AS m FROM lineitem
""", floats="m")
def p6(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate",
                             derive.magnitude("l_quantity", "l_discount", "l_tax").alias("m"))


@query("p7_local_time", "SELECT event_id, ts + INTERVAL 7 HOUR AS local_ts FROM events")
def p7(t):
    return t.events.select("event_id", derive.to_local_time("ts").alias("local_ts"))


@query("p8_convert_units", """
SELECT p_partkey, p_retailprice * 1e-3 / 1e3 AS kv, (p_size + 459.67) * 5.0 / 9.0 - 273.15 AS celsius,
       p_size * 0.0254 / 0.3048 AS feet FROM part
""", floats="kv celsius feet", digits=9)
def p8(t):
    out = derive.convert_units(t.part, "p_retailprice", "mV", "kV", "kv")
    out = derive.convert_units(out, "p_size", "°F", "°C", "celsius")
    return derive.convert_units(out, "p_size", "in", "ft", "feet").select("p_partkey", "kv", "celsius", "feet")


@query("p9_convert_table_units", """
SELECT p_partkey AS id, round(p_retailprice * 1e-3, 6) AS "price [V]", p_size::DOUBLE * 60 AS "size (s)", p_name AS "name [none]" FROM part
""")
def p9(t):
    named = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price [mV]"),
                          F.col("p_size").alias("size (min)"), F.col("p_name").alias("name [none]"))
    return derive.convert_table_units(named, {"voltage": "V", "time": "s"})


@query("p10_calibration", """
WITH c AS (SELECT s_suppkey, (2.0 + s_suppkey / 50.0 - 1.0) / (100.0 - 0.0) AS a FROM supplier)
SELECT l_orderkey, l_linenumber, l_shipdate, (a * l_quantity + 1.0) * 1e3 AS mv FROM lineitem JOIN c ON l_suppkey = s_suppkey
""", floats="mv")
def p10(t):
    table = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.lit(0.0).alias("raw1"), F.lit(1.0).alias("true1"),
                              F.lit(100.0).alias("raw2"), (F.lit(2.0) + F.col("s_suppkey") / 50).alias("true2"))
    return derive.calibrate(t.lineitem, "l_quantity", table, ["l_suppkey"], "V", "mV", "mv").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "mv")


@query("p11_elapsed", """
SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS elapsed_s FROM events
""", floats="elapsed_s")
def p11(t):
    return derive.seconds_from_start(t.events, "ts", "user_id").select("event_id", "elapsed_s")


@query("p12_row_index", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
       row_number() OVER (ORDER BY ts, event_id) - 1 AS g FROM events
""")
def p12(t):
    out = derive.row_index(t.events, **SERIES, name="i")
    return derive.row_index(out, [], ["ts", "event_id"], "g").select("event_id", "i", "g")


@query("p13_sampling_rate", """
WITH d AS (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS dx FROM events)
SELECT user_id, 1 / nullif(quantile_cont(dx, 0.5), 0) AS fs_hz FROM d GROUP BY user_id
""", floats="fs_hz", digits=9)
def p13(t):
    return derive.sampling_rate(t.events, "ts", "user_id")


@query("p14_divider", """
SELECT event_id, CASE WHEN value > 0 AND value < 100 THEN 10000 * (100 / value - 1) END AS high,
       CASE WHEN value > 0 AND value < 100 THEN 10000 * value / (100 - value) END AS low FROM events
""", floats="high low", digits=4)
def p14(t):
    return t.events.select("event_id", derive.divider_resistance("value", 100.0, 10000.0, "sensor_high").alias("high"),
                           derive.divider_resistance("value", 100.0, 10000.0, "sensor_low").alias("low"))


# ---- row selection ----
@query("r1_filter", """
SELECT 'equals' AS op, event_id FROM events WHERE event_type = 'click'
UNION ALL SELECT 'contains', event_id FROM events WHERE contains(lower(event_type), 'cli')
UNION ALL SELECT 'ge', event_id FROM events WHERE value >= 50
UNION ALL SELECT 'lt', event_id FROM events WHERE value < 20
UNION ALL SELECT 'finite', event_id FROM events
""")
def r1(t):
    e = t.events
    parts = [("equals", "event_type", "equals", "click"), ("contains", "event_type", "contains", "CLI"),
             ("ge", "value", ">=", 50), ("lt", "value", "<", 20), ("finite", "value", "is finite", None)]
    out = None
    for label, c, op, v in parts:
        got = rows.filter_rows(e, c, op, v).select(F.lit(label).alias("op"), "event_id")
        out = got if out is None else out.unionByName(got)
    return out


@query("r2_search", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'the whst') OR contains(lower(source), 'the whst') OR contains(lower(lang), 'the whst')
""")
def r2(t):
    return rows.search(t.documents, "The whst", ["text", "source", "lang"]).select("doc_id")


HOLES = "CASE WHEN event_type = 'error' THEN NULL ELSE value END"


def holes(t):
    return t.events.withColumn("y", F.when(F.col("event_type") != "error", F.col("value")))


@query("r3_drop_missing", "SELECT event_id FROM events WHERE event_type <> 'error'")
def r3(t):
    nan = holes(t).withColumn("y", F.coalesce("y", F.lit(float("nan"))))
    return rows.drop_missing(rows.drop_missing(nan, "y"), None).select("event_id")


@query("r4_crop", "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 60", floats="value")
def r4(t):
    return rows.crop(t.events, "value", 60, 10).select("event_id", "value")


@query("r5_drop_duplicates", """
SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1
""", floats="value")
def r5(t):
    return rows.drop_duplicates(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "event_id", "user_id", "event_type", "value")


@query("r5_duplicate_count", """
SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS n_removed
""")
def r5b(t):
    return rows.duplicate_count(t.events, ["user_id", "event_type"])


@query("r6_outlier_zscore", """
SELECT event_id, coalesce(abs(value - avg(value) OVER u) / nullif(stddev_samp(value) OVER u, 0) > 3, false) AS is_outlier
FROM events WINDOW u AS (PARTITION BY event_type)
""")
def r6(t):
    return rows.flag_outliers(t.events, "value", "event_type").select("event_id", "is_outlier")


@query("r6_outlier_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS is_outlier FROM events, q
""")
def r6b(t):
    return rows.flag_outliers(t.events, "value", method="iqr").select("event_id", "is_outlier")


@query("r7_drop_outliers", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, value FROM events JOIN q USING (event_type) WHERE NOT (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
""", floats="value")
def r7(t):
    return rows.drop_outliers(t.events, "value", "event_type", "iqr").select("event_id", "value")


@query("r7_outlier_count", """
SELECT event_type, count(*) FILTER (WHERE f) AS n_removed FROM (
  SELECT event_type, abs(value - avg(value) OVER u) / stddev_samp(value) OVER u > 3 AS f FROM events
  WINDOW u AS (PARTITION BY event_type)) GROUP BY 1
""")
def r7b(t):
    return rows.outlier_count(t.events, "value", "event_type")


@query("r8_anomaly_summary", """
WITH z AS (SELECT event_type, value, abs(value - avg(value) OVER u) / stddev_samp(value) OVER u > 2 AS f FROM events
           WINDOW u AS (PARTITION BY event_type))
SELECT event_type, count(*) AS n_total, count(*) FILTER (WHERE f) AS n_anomalies,
       count(*) FILTER (WHERE f) / count(*) AS fraction, avg(value) AS mean, stddev_samp(value) AS std
FROM z GROUP BY 1
""", floats="fraction mean std")
def r8(t):
    return rows.anomaly_summary(t.events, "value", "event_type", threshold=2.0)


@query("r8_top_anomalies", """
WITH z AS (SELECT event_type, event_id, ts, value, abs(value - avg(value) OVER u) / stddev_samp(value) OVER u AS zscore FROM events
           WINDOW u AS (PARTITION BY event_type)),
     k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY zscore DESC, ts, event_id) AS rank FROM z WHERE zscore > 2)
SELECT event_type, event_id, value, zscore, rank FROM k WHERE rank <= 10
""", floats="value zscore")
def r8b(t):
    return rows.top_anomalies(t.events, "value", ["ts", "event_id"], "event_type", threshold=2.0).select(
        "event_type", "event_id", "value", "zscore", "rank")


@query("r9_split", """
SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 25 AS chunk_id FROM events
""")
def r9(t):
    return rows.split_rows(t.events, **SERIES, rows=25).select("event_id", "chunk_id")


# ---- joins ----
@query("j1_merge_inner", """
SELECT coalesce(s_nationkey, c_nationkey) AS nation, s_suppkey, c_custkey, s_acctbal AS acctbal_left, c_acctbal AS acctbal_right
FROM supplier JOIN customer ON s_nationkey = c_nationkey
""", floats="acctbal_left acctbal_right")
def j1(t):
    left = t.supplier.select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("acctbal"))
    right = t.customer.select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("acctbal"))
    return joins.merge(left, right, "nation", "nation", "inner")


@query("j1_merge_outer_null_keys", """
WITH l AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS k, s_suppkey FROM supplier),
     r AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS n, n_name FROM nation)
SELECT k, s_suppkey, n, n_name FROM l FULL JOIN r ON k IS NOT DISTINCT FROM n
""")
def j1b(t):
    left = t.supplier.select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("k"), "s_suppkey")
    right = t.nation.select(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).alias("n"), "n_name")
    return joins.merge(left, right, "k", "n", "outer")


@query("j2_exact_time_merge", """
SELECT o_orderkey, o_orderdate, l_shipdate, l_extendedprice FROM orders
LEFT JOIN (SELECT l_shipdate, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1) ON o_orderdate = l_shipdate
""", floats="l_extendedprice")
def j2(t):
    right = t.lineitem.groupBy("l_shipdate").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    return joins.merge(t.orders.select("o_orderkey", "o_orderdate"), right, "o_orderdate", "l_shipdate", "left")


NEAREST_SQL = """
WITH l AS (SELECT event_id, {key} epoch_us(ts) / 1e6 AS x FROM events WHERE event_type <> 'purchase'),
     r AS (SELECT event_id AS rid, {key} epoch_us(ts) / 1e6 AS rx, value AS rv FROM events WHERE event_type = 'purchase'),
     b AS (SELECT l.*, rid, rx, rv FROM l ASOF LEFT JOIN r ON {on} l.x >= r.rx),
     a AS (SELECT l.event_id, rid AS rid2, rx AS rx2, rv AS rv2 FROM l ASOF LEFT JOIN r ON {on} l.x <= r.rx)
SELECT b.event_id, CASE WHEN rid IS NULL OR (rid2 IS NOT NULL AND rx2 - x < x - rx) THEN rid2 ELSE rid END AS near_id,
       CASE WHEN rid IS NULL OR (rid2 IS NOT NULL AND rx2 - x < x - rx) THEN rv2 ELSE rv END AS near_value
FROM b JOIN a ON a.event_id = b.event_id
"""


def nearest(t, by):
    left = t.events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("near_id"), "user_id", F.col("ts").alias("near_ts"), F.col("value").alias("near_value"))
    return joins.nearest_merge(left, right, "ts", "near_ts", by, ["near_id"]).select("event_id", "near_id", "near_value")


@query("j3_nearest_by_user", NEAREST_SQL.format(key="user_id,", on="l.user_id = r.user_id AND"), floats="near_value")
def j3(t):
    return nearest(t, ["user_id"])


@query("j3_nearest_one_series", NEAREST_SQL.format(key="", on=""), floats="near_value")
def j3b(t):
    return nearest(t, [])


@query("j4_interpolate_join", """
WITH l AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS x FROM events WHERE event_type <> 'purchase'),
     r AS (SELECT user_id, epoch_us(ts) / 1e6 AS rx, value AS rv FROM events WHERE event_type = 'purchase'),
     b AS (SELECT l.*, rx, rv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.x >= r.rx),
     a AS (SELECT l.event_id, rx AS rx2, rv AS rv2 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.x <= r.rx)
SELECT b.event_id, CASE WHEN rv IS NULL THEN rv2 WHEN rv2 IS NULL OR rx2 = rx THEN rv ELSE rv + (rv2 - rv) * (x - rx) / (rx2 - rx) END AS level
FROM b JOIN a ON a.event_id = b.event_id
""", floats="level")
def j4(t):
    left = t.events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("rts"), F.col("value").alias("level"))
    return joins.interpolate_join(left, right, "ts", "rts", ["level"], "user_id").select("event_id", "level")
