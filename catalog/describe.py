"""Checks of aggregation, cleaning and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query
from catalog.tables import HOLES, SERIES, holes
from sigtab.operators import clean, describe


@query("a1_group_summary", """
SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS o_totalprice_median, count(o_totalprice) AS row_count FROM orders GROUP BY 1
""", floats="o_totalprice_median")
def a1(t):
    return describe.group_summary(t.orders, "o_orderpriority", "o_totalprice", "median")


@query("a1_group_summary_null_group", f"""
SELECT CASE WHEN event_type <> 'view' THEN event_type END AS kind, avg(value) AS value_mean, count(*) AS row_count FROM events GROUP BY 1
""", floats="value_mean")
def a1b(t):
    e = t.events.withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    return describe.group_summary(e, "kind", "value", "mean")


@query("a2_aggregate", """
SELECT l_suppkey, sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1
""", floats="l_quantity l_extendedprice", digits=3)
def a2(t):
    return describe.aggregate_by(t.lineitem, "l_suppkey", ["l_quantity", "l_extendedprice"], "sum")


@query("a3_describe", """
WITH m AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS r
           FROM lineitem GROUP BY 1, 2)
SELECT l.l_returnflag, count(*) AS count, avg(l.l_quantity) AS mean, quantile_cont(l.l_quantity, 0.5) AS median,
       min(m.l_quantity) AS mode, stddev_samp(l.l_quantity) AS std, var_samp(l.l_quantity) AS variance,
       skewness(l.l_quantity) AS skewness, kurtosis(l.l_quantity) AS kurtosis, min(l.l_quantity) AS min, max(l.l_quantity) AS max
FROM lineitem l JOIN m ON m.l_returnflag = l.l_returnflag AND m.r = 1 GROUP BY 1
""", floats="mean median mode std variance skewness kurtosis min max")
def a3(t):
    return describe.describe(t.lineitem, "l_quantity", "l_returnflag")


@query("a4_descriptive_table", """
WITH u AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME c VALUE v),
     m AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS r FROM u GROUP BY 1, 2),
     s AS (SELECT c, count(v)::DOUBLE AS count, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std, var_samp(v) AS variance,
            skewness(v) AS skewness, kurtosis(v) AS kurtosis, min(v) AS min, max(v) AS max FROM u GROUP BY 1),
     w AS (SELECT s.*, m.v AS mode FROM s JOIN m ON m.c = s.c AND m.r = 1),
     l AS (UNPIVOT w ON count, mean, median, mode, std, variance, skewness, kurtosis, min, max INTO NAME statistic VALUE x)
SELECT statistic, max(x) FILTER (WHERE c = 'l_quantity') AS l_quantity, max(x) FILTER (WHERE c = 'l_discount') AS l_discount,
       max(x) FILTER (WHERE c = 'l_tax') AS l_tax FROM l GROUP BY 1
""", floats="l_quantity l_discount l_tax")
def a4(t):
    return describe.descriptive_table(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


PAIR_SQL = " UNION ALL ".join(
    "SELECT '{0}' AS \"column\", ".format(a) + ", ".join(f"{{f}}({a}, {b}) AS {b}" for b in
                                                          ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem"
    for a in ("l_quantity", "l_extendedprice", "l_discount"))


@query("a5_covariance", PAIR_SQL.format(f="covar_samp"), floats="l_quantity l_extendedprice l_discount", digits=3)
def a5(t):
    return describe.pair_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("a5_correlation", PAIR_SQL.format(f="corr"), floats="l_quantity l_extendedprice l_discount")
def a5b(t):
    return describe.pair_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "correlation")


@query("a6_dataset_summary", f"""
WITH e AS (SELECT {HOLES} AS y, value, event_id::DOUBLE AS k FROM events)
SELECT 'y' AS "column", count(*) AS rows, count(*) - count(y) AS missing, count(y) AS count, avg(y) AS mean, stddev_samp(y) AS std,
       min(y) AS min, max(y) AS max, corr(y, k) AS xy_correlation FROM e
UNION ALL SELECT 'value', count(*), count(*) - count(value), count(value), avg(value), stddev_samp(value), min(value), max(value), corr(y, k) FROM e
""", floats="mean std min max xy_correlation")
def a6(t):
    return describe.dataset_summary(holes(t), ["y", "value"], "event_id", "y")


@query("a7_kpi", """
WITH u AS (UNPIVOT (SELECT l_linestatus, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME "column" VALUE v)
SELECT l_linestatus, "column", count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM u GROUP BY 1, 2
""", floats="mean std min max")
def a7(t):
    return describe.kpi_table(t.lineitem, ["l_quantity", "l_tax"], "l_linestatus")


@query("a8_rank", """
SELECT p_partkey, p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)::INT AS rank FROM part
""")
def a8(t):
    return describe.rank_by_metric(t.part, "p_size", "p_brand").select("p_partkey", "p_brand", "p_size", "rank")


@query("a8_rank_all", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_acctbal)::INT AS rank FROM customer")
def a8b(t):
    return describe.rank_by_metric(t.customer, "c_acctbal", high_first=False).select("c_custkey", "rank")


# ---- cleaning ----
@query("c1_fill", f"""
WITH e AS (SELECT *, {HOLES} AS y FROM events)
SELECT event_id, coalesce(y, 0.0) AS v, coalesce(y, avg(y) OVER (PARTITION BY user_id)) AS m,
       coalesce(y, (SELECT quantile_cont(y, 0.5) FROM e)) AS d,
       last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f,
       first_value(y IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM e
""", floats="v m d f b")
def c1(t):
    out = clean.fill_missing(holes(t), "y", "value", 0.0, name="v")
    out = clean.fill_missing(out, "y", "mean", by="user_id", name="m")
    out = clean.fill_missing(out, "y", "median", name="d")
    out = clean.fill_missing(out, "y", "ffill", **SERIES, name="f")
    out = clean.fill_missing(out, "y", "bfill", by=[], order=["ts", "event_id"], name="b")
    return out.select("event_id", "v", "m", "d", "f", "b")


@query("c2_interpolate", f"""
WITH e AS (SELECT event_id, user_id, ts, {HOLES} AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
     w AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, last_value(y IGNORE NULLS) OVER p AS y0,
                  first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER n AS i1, first_value(y IGNORE NULLS) OVER n AS y1
           FROM e WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING),
                  n AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN y IS NOT NULL THEN y WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0
       ELSE y0 + (y1 - y0) * (i - i0) / (i1 - i0) END AS y FROM w
""", floats="y")
def c2(t):
    return clean.interpolate_missing(holes(t), "y", **SERIES, name="z").select("event_id", F.col("z").alias("y"))


@query("c3_normalize", """
SELECT event_id, (value - avg(value) OVER u) / stddev_samp(value) OVER u AS z,
       (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS m FROM events WINDOW u AS (PARTITION BY user_id)
""", floats="z m")
def c3(t):
    out = clean.normalize(t.events, "value", "zscore", "user_id", "z")
    return clean.normalize(out, "value", "minmax", None, "m").select("event_id", "z", "m")


@query("c4_normalize_spectrum", """
SELECT event_id, value / max(abs(value)) OVER u AS a, value / sum(abs(value)) OVER u AS b FROM events WINDOW u AS (PARTITION BY user_id)
""", floats="a b", digits=9)
def c4(t):
    out = clean.normalize(t.events, "value", "max", "user_id", "a")
    return clean.normalize(out, "value", "area", "user_id", "b").select("event_id", "a", "b")


@query("c9_resample", """
WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS x, value AS y FROM events),
     b AS (SELECT user_id, min(x) AS lo, max(x) AS hi FROM s GROUP BY 1 HAVING count(*) >= 2),
     g AS (SELECT user_id, i AS grid_index, CASE WHEN i = 49 THEN hi ELSE lo + (hi - lo) * i / 49 END AS grid_x FROM b, range(50) AS r(i)),
     p AS (SELECT g.*, x AS x0, y AS y0 FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.grid_x >= s.x),
     n AS (SELECT g.user_id, g.grid_index, x AS x1, y AS y1 FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.grid_x <= s.x)
SELECT p.user_id, p.grid_index, grid_x, CASE WHEN y1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (grid_x - x0) / (x1 - x0) END AS value
FROM p JOIN n ON p.user_id = n.user_id AND p.grid_index = n.grid_index
""", floats="grid_x value", digits=2)
def c9(t):
    return clean.resample_uniform(t.events, "ts", ["value"], 50, "user_id")


@query("c10_sort", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC", floats="p_retailprice")
def c10(t):
    return clean.sort_rows(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", False)


@query("c11_decimate", """
WITH i AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS source_row FROM events)
SELECT event_id, source_row FROM i WHERE (source_row - 1) % 7 = 0
""")
def c11(t):
    return clean.decimate(t.events, [], ["ts", "event_id"], 7).select("event_id", "source_row")


@query("c12_stride", """
WITH i AS (SELECT event_id, row_number() OVER u - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events
           WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM i WHERE i % greatest(ceil(n / 20)::BIGINT, 1) = 0
""")
def c12(t):
    return clean.stride_downsample(t.events, **SERIES, max_points=20).select("event_id")


@query("c13_envelope", """
WITH i AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index, count(*) OVER () AS n FROM events),
     k AS (SELECT *, floor(row_index * 79.0::DOUBLE / (n - 1)) AS k FROM i),
     r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY value, row_index) AS a, row_number() OVER (PARTITION BY k ORDER BY value DESC, row_index) AS b FROM k)
SELECT event_id, row_index FROM r WHERE a = 1 OR b = 1 OR row_index = 0 OR row_index = n - 1
""")
def c13(t):
    return clean.envelope_downsample(t.events, "value", [], ["ts", "event_id"], 80).select("event_id", "row_index")


@query("c14_bucket_bars", """
WITH i AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT floor(i * least(60, n) / n)::BIGINT AS bin, avg(i) AS center, sum(value) AS value, max(i) - min(i) + 0.8::DOUBLE AS width, min(i) AS first_row
FROM i GROUP BY 1
""", floats="center value width", digits=4)
def c14(t):
    return clean.bucket_bars(t.events, "value", [], ["ts", "event_id"], 60, "sum")


@query("c15_zero_pad", """
WITH i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events)
SELECT user_id, i, value FROM i UNION ALL
SELECT user_id, g, 0.0 FROM (SELECT user_id, max(i) + 1 AS n FROM i GROUP BY 1), range(128) AS r(g) WHERE g >= n
""", floats="value")
def c15(t):
    from sigtab.operators.derive import row_index
    return clean.zero_pad(row_index(t.events, **SERIES, name="i"), "i", "value", 128, "user_id")
