"""Checks of gridded surfaces: month of shipping by quantity, one matrix per return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import query
from sigtab.operators import matrix as mx

M = """
m AS (SELECT l_returnflag AS f, month(l_shipdate) - 1 AS i, l_quantity::BIGINT - 1 AS j, CASE WHEN (month(l_shipdate) + l_quantity::BIGINT) % 7 = 0 THEN NULL ELSE avg(l_extendedprice) / 1000 END AS z
      FROM lineitem GROUP BY 1, 2, 3, month(l_shipdate), l_quantity)
"""
FULL = M.replace("CASE WHEN (month(l_shipdate) + l_quantity::BIGINT) % 7 = 0 THEN NULL ELSE avg(l_extendedprice) / 1000 END", "avg(l_extendedprice) / 1000")


def surface(t, holes=True):
    z = F.avg("l_extendedprice") / 1000
    month, q = F.month("l_shipdate"), F.col("l_quantity").cast("bigint")
    cells = t.lineitem.groupBy(F.col("l_returnflag").alias("f"), (month - 1).alias("i"), (q - 1).alias("j")).agg(z.alias("z"))
    cells = cells.withColumn("i", F.col("i").cast("bigint"))
    return cells.withColumn("z", F.when((F.col("i") + F.col("j") + 2) % 7 != 0, F.col("z"))) if holes else cells


def points(t):
    return surface(t, False).select("f", (F.col("j") * 2.0).alias("x"), (F.col("i") * 10.0).alias("y"), "z")


@query("m1_regular_grid", f"WITH {FULL} SELECT f, i, j, j * 2.0::DOUBLE AS x, i * 10.0::DOUBLE AS y, z FROM m", floats="x y z")
def m1(t):
    return mx.regular_grid(points(t), "x", "y", "z", "f")


@query("m2_nearest_grid", """
WITH p AS (SELECT p_retailprice AS x, p_size::DOUBLE AS y, p_partkey::DOUBLE AS z FROM part),
     b AS (SELECT min(x) AS x0, (max(x) - min(x)) / 19 AS dx, min(y) AS y0, (max(y) - min(y)) / 14 AS dy FROM p),
     g AS (SELECT r.i, c.j, x0 + c.j * dx AS gx, y0 + r.i * dy AS gy FROM b, range(15) AS r(i), range(20) AS c(j)),
     d AS (SELECT i, j, gx, gy, z, row_number() OVER (PARTITION BY i, j ORDER BY (x - gx) * (x - gx) + (y - gy) * (y - gy), x, y, z) AS k FROM g, p)
SELECT i, j, gx AS x, gy AS y, z FROM d WHERE k = 1
""", floats="x y z")
def m2(t):
    return mx.nearest_grid(t.part, "p_retailprice", "p_size", "p_partkey", 20, 15)


@query("m3_to_xyz", f"WITH {M} SELECT f, j::DOUBLE AS x, i::DOUBLE AS y, z FROM m WHERE z IS NOT NULL", floats="x y z")
def m3(t):
    return mx.to_xyz(surface(t), "f")


@query("m3_wide_and_back", f"WITH {M} SELECT f, i, j, j::DOUBLE AS x, z FROM m", floats="x z")
def m3b(t):
    return mx.from_wide(mx.to_wide(surface(t), 50, "f"), [f"c{k}" for k in range(50)], "i", "f")


@query("m4_transpose", f"WITH {M} SELECT f, j AS i, i AS j, z FROM m", floats="z")
def m4(t):
    return mx.transpose(surface(t), "f")


@query("m4_flip", f"WITH {M} SELECT f, 11 - i AS i, j, z FROM m", floats="z")
def m4b(t):
    return mx.flip(surface(t), False, "f")


@query("m4_rotate", f"WITH {M} SELECT f, 49 - j AS i, i AS j, z FROM m", floats="z")
def m4c(t):
    return mx.rotate90(surface(t), 1, "f")


@query("m5_crop", f"WITH {M} SELECT f, i - 2 AS i, j - 5 AS j, z FROM m WHERE i BETWEEN 2 AND 7 AND j BETWEEN 5 AND 20", floats="z")
def m5(t):
    return mx.crop(surface(t), 2, 8, 5, 21, "f")


@query("m5_region", f"WITH {FULL} SELECT f, i - 1 AS i, j - 2 AS j, j * 2.0::DOUBLE AS x, i * 10.0::DOUBLE AS y, z FROM m WHERE j BETWEEN 2 AND 10 AND i BETWEEN 1 AND 6", floats="x y z")
def m5b(t):
    return mx.region(mx.regular_grid(points(t), "x", "y", "z", "f"), 21, 4, 10, 65, "f")


@query("m6_background_median", f"WITH {M} SELECT f, i, j, z - quantile_cont(z, 0.5) OVER (PARTITION BY f) AS z FROM m", floats="z")
def m6(t):
    return mx.subtract_background(surface(t), "median", "f")


@query("m6_background_plane", f"""
WITH {M}, c AS (SELECT *, i - avg(i) FILTER (WHERE z IS NOT NULL) OVER u AS v, j - avg(j) FILTER (WHERE z IS NOT NULL) OVER u AS u, z - avg(z) OVER u AS w FROM m WINDOW u AS (PARTITION BY f)),
     s AS (SELECT f, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*w) AS uw, sum(v*w) AS vw FROM c WHERE z IS NOT NULL GROUP BY 1)
SELECT f, i, j, w - u * (uw*vv - vw*uv) / (uu*vv - uv*uv) - v * (vw*uu - uw*uv) / (uu*vv - uv*uv) AS z FROM c JOIN s USING (f)
""", floats="z")
def m6b(t):
    return mx.subtract_background(surface(t), "plane", "f")


@query("m7_normalize", f"WITH {M} SELECT f, i, j, (z - avg(z) OVER u) / stddev_pop(z) OVER u AS z FROM m WINDOW u AS (PARTITION BY f)", floats="z")
def m7(t):
    return mx.normalize(surface(t), "zscore", "f")


@query("m7_threshold_clip_contrast", f"""
WITH {M} SELECT 'mask' AS op, f, i, j, CASE WHEN z >= 50 THEN z END AS z FROM m UNION ALL SELECT 'clip', f, i, j, CASE WHEN z IS NOT NULL THEN least(greatest(z, 40), 60) END FROM m
UNION ALL SELECT 'contrast', f, i, j, avg(z) OVER (PARTITION BY f) + 2 * (z - avg(z) OVER (PARTITION BY f)) + 1 FROM m
""", floats="z")
def m7b(t):
    s = surface(t)
    parts = {"mask": mx.threshold(s, 50, "mask", "f"), "clip": mx.clip(s, 40, 60, "f"), "contrast": mx.contrast(s, 1.0, 2.0, "f")}
    out = None
    for op, d in parts.items():
        d = d.select(F.lit(op).alias("op"), "f", "i", "j", "z")
        out = d if out is None else out.unionByName(d)
    return out


@query("m8_smooth_gaussian")
def m8(t):
    return mx.smooth_gaussian(mx.complete_cells(surface(t), "f"), 1.0, "f")


@query("m9_smooth_median", f"""
WITH {M}, o AS (SELECT a.f, a.i, a.j, b.z FROM m a, range(-1, 2) AS p(di), range(-1, 2) AS q(dj) JOIN m b ON b.f = a.f AND b.i = least(greatest(a.i + di, 0), 11) AND b.j = least(greatest(a.j + dj, 0), 49))
SELECT f, i, j, quantile_cont(z, 0.5) AS z FROM o GROUP BY 1, 2, 3
""", floats="z")
def m9(t):
    return mx.smooth_median(surface(t), 3, "f")


SHIFTED = FULL + """, n AS (SELECT a.f, a.i, a.j, di, dj, b.z FROM m a, range(-1, 2) AS p(di), range(-1, 2) AS q(dj) JOIN m b ON b.f = a.f AND b.i = least(greatest(a.i + di, 0), 11) AND b.j = least(greatest(a.j + dj, 0), 49))"""


@query("m10_sobel", f"""
WITH {SHIFTED} SELECT f, i, j, sqrt(sum(z * dj * (2 - abs(di))) ** 2 + sum(z * di * (2 - abs(dj))) ** 2) AS z FROM n GROUP BY 1, 2, 3
""", floats="z")
def m10(t):
    return mx.edges(surface(t, False), "sobel", "f")


@query("m10_laplace", f"""
WITH {SHIFTED} SELECT f, i, j, abs(sum(CASE WHEN abs(di) + abs(dj) = 1 THEN z WHEN di = 0 AND dj = 0 THEN -4 * z ELSE 0 END)) AS z FROM n GROUP BY 1, 2, 3
""", floats="z")
def m10b(t):
    return mx.edges(surface(t, False), "laplace", "f")


@query("m10_gradient", f"""
WITH {FULL}, g AS (SELECT f, i, j, lag(z) OVER r AS l, lead(z) OVER r AS q, lag(z) OVER c AS u, lead(z) OVER c AS d, z FROM m WINDOW r AS (PARTITION BY f, i ORDER BY j), c AS (PARTITION BY f, j ORDER BY i))
SELECT f, i, j, sqrt((CASE WHEN l IS NULL THEN q - z WHEN q IS NULL THEN z - l ELSE (q - l) / 2 END / 2) ** 2 + (CASE WHEN u IS NULL THEN d - z WHEN d IS NULL THEN z - u ELSE (d - u) / 2 END / 10) ** 2) AS z FROM g
""", floats="z")
def m10c(t):
    return mx.gradient_magnitude(surface(t, False), 2.0, 10.0, "f")


@query("m11_dilate", f"WITH {SHIFTED} SELECT f, i, j, max(z) AS z FROM n GROUP BY 1, 2, 3", floats="z")
def m11(t):
    return mx.morphology(surface(t, False), "dilate", 3, "f")


@query("m11_open", f"""
WITH {SHIFTED}, e AS (SELECT f, i, j, min(z) AS z FROM n GROUP BY 1, 2, 3)
SELECT a.f, a.i, a.j, max(b.z) AS z FROM m a JOIN e b ON b.f = a.f AND abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1 GROUP BY 1, 2, 3
""", floats="z")
def m11b(t):
    return mx.morphology(surface(t, False), "open", 3, "f")


@query("m12_resize", f"""
WITH {FULL}, o AS (SELECT f, a.i AS oi, b.j AS oj, a.i * 11 / 19 AS r, b.j * 49 / 29 AS c FROM (SELECT DISTINCT f FROM m), range(20) AS a(i), range(30) AS b(j))
SELECT o.f, oi AS i, oj AS j, sum(z * (1 - abs(r - m.i)) * (1 - abs(c - m.j))) AS z FROM o JOIN m ON m.f = o.f AND abs(r - m.i) < 1 AND abs(c - m.j) < 1 GROUP BY 1, 2, 3
""", floats="z")
def m12(t):
    return mx.resize(surface(t, False), 20, 30, "f")


@query("m12_line_profile", f"""
WITH {FULL}, s AS (SELECT f, k AS sample, k / 24 AS t FROM (SELECT DISTINCT f FROM m), range(25) AS r(k)),
     p AS (SELECT *, 3 + (90 - 3) * t AS x, 5 + (100 - 5) * t AS y FROM s)
SELECT p.f, sample::INT AS sample, sqrt((x - 3) ** 2 + (y - 5) ** 2) AS distance, x, y, sum(z * (1 - abs(y / 10 - m.i)) * (1 - abs(x / 2 - m.j))) AS z
FROM p JOIN m ON m.f = p.f AND abs(y / 10 - m.i) < 1 AND abs(x / 2 - m.j) < 1 GROUP BY 1, 2, 3, 4, 5
""", floats="distance x y z")
def m12b(t):
    return mx.line_profile(mx.regular_grid(points(t), "x", "y", "z", "f"), (3.0, 5.0), (90.0, 100.0), 25, "f")


@query("m13_fft2")
def m13(t):
    return mx.fft2_magnitude(surface(t), True, "f")


@query("m14_divide", f"WITH {M} SELECT a.f, a.i, a.j, a.z / nullif(b.z, 0) AS z FROM m a JOIN m b ON b.f = 'R' AND a.f <> 'R' AND a.i = b.i AND a.j = b.j", floats="z")
def m14(t):
    s = surface(t)
    flags = [F.lit(f).alias("f") for f in ("A", "N")]
    below = s.filter("f = 'R'").drop("f").withColumn("f", F.explode(F.array(*flags)))
    return mx.combine(s.filter("f <> 'R'"), below, "divide", "f")


@query("m15_statistics", f"""
WITH {M} SELECT f, max(i) + 1 AS rows, max(j) + 1 AS columns, count(z) AS finite_cells, (max(i) + 1) * (max(j) + 1) - count(z) AS empty_cells, min(z) AS min, max(z) AS max, avg(z) AS mean,
 quantile_cont(z, 0.5) AS median, stddev_pop(z) AS std, sum(z) AS sum, arg_max(j, z)::DOUBLE AS max_x, arg_max(i, z)::DOUBLE AS max_y, arg_min(j, z)::DOUBLE AS min_x, arg_min(i, z)::DOUBLE AS min_y FROM m GROUP BY 1
""", floats="min max mean median std sum max_x max_y min_x min_y")
def m15(t):
    return mx.statistics(surface(t), "f")


@query("m15_surface", f"""
WITH {FULL}, g AS (SELECT f, i, j, lag(z) OVER r AS l, lead(z) OVER r AS q, lag(z) OVER c AS u, lead(z) OVER c AS d, z FROM m WINDOW r AS (PARTITION BY f, i ORDER BY j), c AS (PARTITION BY f, j ORDER BY i)),
 s AS (SELECT *, sqrt((CASE WHEN l IS NULL THEN q - z WHEN q IS NULL THEN z - l ELSE (q - l) / 2 END / 2) ** 2 + (CASE WHEN u IS NULL THEN d - z WHEN d IS NULL THEN z - u ELSE (d - u) / 2 END / 10) ** 2) AS sl,
   avg(z) OVER (PARTITION BY f) AS mz, min(z) OVER (PARTITION BY f) AS lo FROM g)
SELECT f, avg(abs(z - mz)) AS ra, sqrt(avg((z - mz) ** 2)) AS rq, max(z) - min(z) AS peak_to_valley, avg(z) AS mean_height,
 sum((z - lo) * CASE WHEN j IN (0, 49) THEN 1 ELSE 2 END * CASE WHEN i IN (0, 11) THEN 5 ELSE 10 END) AS volume_above_min, max(sl) AS max_slope, avg(sl) AS mean_slope FROM s GROUP BY 1
""", floats="ra rq peak_to_valley mean_height volume_above_min max_slope mean_slope", digits=5)
def m15b(t):
    return mx.surface_metrics(mx.regular_grid(points(t), "x", "y", "z", "f"), "f")


@query("m16_stack", f"WITH {M} SELECT i, j, stddev_pop(z) AS z FROM m GROUP BY 1, 2", floats="z")
def m16(t):
    return mx.stack_project(surface(t), "std")
