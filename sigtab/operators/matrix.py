"""Gridded surfaces as coordinate tables: one row per cell with ``i`` (row), ``j`` (column) and ``z``.

A missing value is a row with null ``z``; ``complete_cells`` adds rows that are absent. All
neighbourhood work runs along rows and then along columns, so a matrix of any size is cut into
bounded ordered groups.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.functions.filters import gaussian_taps
from sigtab.functions.numeric import div, finite, keys
from sigtab.operators.joins import interpolate_join
from sigtab.plans.fft import fft
from sigtab.plans.layout import cut_lineage, frame, join_by, lay_out, with_stats, with_table
from sigtab.plans.local import fir
from sigtab.plans.normeq import gram, map_rows, number, unpack
from sigtab.plans.quantile import medians

BLOCK = 65_536


def _cells(df: DataFrame, by: list[str], z: str = "z") -> DataFrame:
    return df.select(*by, F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), finite(z).alias("z"))


def _grid(sizes: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """All cells (i, j) of each row of ``sizes``, generated row by row."""
    a = sizes.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), rows.cast("bigint") - 1)))
    a = a.withColumn("_jb", F.explode(F.sequence(F.lit(0), F.floor((cols - 1) / BLOCK))))
    return a.withColumn("j", F.explode(F.sequence(
        (F.col("_jb") * BLOCK).cast("bigint"), F.least((F.col("_jb") + 1) * BLOCK, cols.cast("bigint")) - 1))).drop("_jb")


def complete_cells(df: DataFrame, by=None) -> DataFrame:
    """Add a null cell wherever a position of the bounding rectangle has no row."""
    by = keys(by)
    cells = _cells(df, by)
    sizes = cells.groupBy(*by).agg((F.max("i") + 1).alias("_ny"), (F.max("j") + 1).alias("_nx"))
    full = _grid(sizes, F.col("_ny"), F.col("_nx")).select(*by, "i", "j")
    return join_by(full, cells, by + ["i", "j"])


def _along(df: DataFrame, by: list[str], axis: str, before: int, after: int):
    """Windows along rows (axis "j") or along columns (axis "i")."""
    other = "i" if axis == "j" else "j"
    return frame(df, by + [other], [axis], before, after)


# ---- gridding and reshaping ----

def regular_grid(df: DataFrame, x: str, y: str, z: str, by=None) -> DataFrame:
    """(by, i, j, x, y, z) of points that form a complete rectangle; other point sets are left out."""
    by = keys(by)
    pts = df.select(*by, finite(x).alias("x"), finite(y).alias("y"), finite(z).alias("z")).filter(
        "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    out, sizes = pts, pts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    for c, index in (("x", "j"), ("y", "i")):
        values = pts.select(*by, c).distinct()
        lay = lay_out(values, by, [c])
        out = join_by(out, lay.done(lay.scan({index: ("index",)})), by + [c])
        sizes = with_table(sizes, values.groupBy(*by).agg(F.count(F.lit(1)).alias(f"_n{c}")), by)
    unique = out.select(*by, "i", "j").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_u"))
    sizes = with_table(sizes, unique, by)
    good = sizes.withColumn("_ok", (F.col("_nx") >= 2) & (F.col("_ny") >= 2) & (F.col("_nx") * F.col("_ny") == F.col("_n")) & (F.col("_u") == F.col("_n")))
    return with_table(out, good.select(*by, "_ok"), by).filter("_ok").select(*by, "i", "j", "x", "y", "z")


def nearest_grid(df: DataFrame, x: str, y: str, z: str, nx: int = 50, ny: int = 50, by=None) -> DataFrame:
    """(by, i, j, x, y, z) on an even ``ny`` by ``nx`` grid, each cell with the value of the nearest point.

    Points offer themselves to the cells around them; best offers are combined before the shuffle.
    Cells for which something closer could lie outside that ring look up the points of wider rings,
    twice as wide each round, until every cell is certain. Ties go to the smaller x, then y, then z.
    """
    if nx < 2 or ny < 2:
        raise ValueError("a grid needs two positions per axis")
    by = keys(by)
    pts = df.select(*by, finite(x).alias("px"), finite(y).alias("py"), finite(z).alias("pz")).filter(
        "px IS NOT NULL AND py IS NOT NULL AND pz IS NOT NULL")
    box = pts.groupBy(*by).agg(F.min("px").alias("_x0"), F.max("px").alias("_x1"), F.min("py").alias("_y0"), F.max("py").alias("_y1"))
    box = box.filter("_x1 > _x0 AND _y1 > _y0").select(
        *by, "_x0", "_y0", ((F.col("_x1") - F.col("_x0")) / (nx - 1)).alias("_dx"), ((F.col("_y1") - F.col("_y0")) / (ny - 1)).alias("_dy"))
    pts = join_by(pts, box, by, "inner") if by else with_table(pts, box, []).filter("_dx IS NOT NULL")
    # equal positions keep one value, so copies of a point do not multiply
    pts = pts.groupBy(*by, "px", "py").agg(F.min("pz").alias("pz"), *[F.first(c).alias(c) for c in ("_x0", "_y0", "_dx", "_dy")])
    tile = lambda v, o, d, n: F.least(F.floor((F.col(v) - F.col(o)) / F.col(d) + 0.5), F.lit(n - 1)).cast("bigint")
    pts = cut_lineage(pts.withColumns({"tj": tile("px", "_x0", "_dx", nx), "ti": tile("py", "_y0", "_dy", ny)}))
    cx, cy = F.col("_x0") + F.col("j") * F.col("_dx"), F.col("_y0") + F.col("i") * F.col("_dy")
    d2 = (F.col("px") - cx) * (F.col("px") - cx) + (F.col("py") - cy) * (F.col("py") - cy)
    best = F.min(F.struct(d2.alias("d2"), "px", "py", "pz")).alias("best")
    around = lambda c, n, r: F.explode(F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(n - 1))))
    offers = pts.withColumn("i", around("ti", ny, 1)).withColumn("j", around("tj", nx, 1)).groupBy(*by, "i", "j").agg(best)
    cells = join_by(_grid(box, F.lit(ny), F.lit(nx)), offers, by + ["i", "j"])
    sure = lambda r: F.sqrt(F.col("best.d2")) <= (r + 0.5) * F.least("_dx", "_dy")
    cells = cut_lineage(cells)
    done, open_, r = cells.filter(sure(1)), cut_lineage(cells.filter(~F.coalesce(sure(1), F.lit(False)))), 1
    tiles = cut_lineage(pts.groupBy(*by, "ti", "tj").agg(F.count(F.lit(1)).alias("_n")).drop("_n"))
    while not open_.isEmpty():
        r = min(2 * r, max(nx, ny))
        ring = open_.select(*by, "i", "j", "_x0", "_y0", "_dx", "_dy", around("i", ny, r).alias("ti")).withColumn("tj", around("j", nx, r))
        ring = join_by(ring, tiles, by + ["ti", "tj"], "inner")
        met = join_by(ring, pts.select(*by, "ti", "tj", "px", "py", "pz"), by + ["ti", "tj"], "inner").groupBy(*by, "i", "j").agg(best)
        cells = cut_lineage(join_by(open_.drop("best"), met, by + ["i", "j"]))
        certain = F.lit(True) if r >= max(nx, ny) else F.coalesce(sure(r), F.lit(False))
        done, open_ = done.unionByName(cells.filter(certain)), cells.filter(~certain)
    return done.select(*by, "i", "j", cx.alias("x"), cy.alias("y"), F.col("best.pz").alias("z"))


def to_xyz(df: DataFrame, by=None) -> DataFrame:
    """Points of the non-null cells; positions stand in where the table has no ``x`` and ``y``."""
    by = keys(by)
    x = F.col("x") if "x" in df.columns else F.col("j").cast("double")
    y = F.col("y") if "y" in df.columns else F.col("i").cast("double")
    return df.select(*by, x.alias("x"), y.alias("y"), finite("z").alias("z")).filter("z IS NOT NULL")


def to_wide(df: DataFrame, columns: int, by=None) -> DataFrame:
    """One row per matrix row with a column ``c0 … c{columns-1}`` per matrix column."""
    by = keys(by)
    return df.groupBy(*by, "i").agg(*[F.max(F.when(F.col("j") == k, finite("z"))).alias(f"c{k}") for k in range(columns)])


def from_wide(df: DataFrame, columns: list[str], i: str = "i", by=None) -> DataFrame:
    """Cells of a wide table; numeric column labels become ``x``, positions otherwise."""
    by = keys(by)
    try:
        xs = [float(c) for c in columns]
    except ValueError:
        xs = [float(k) for k in range(len(columns))]
    cells = [F.struct(F.lit(k).cast("bigint").alias("j"), F.lit(v).alias("x"), finite(F.col(f"`{c}`")).alias("z"))
             for k, (c, v) in enumerate(zip(columns, xs))]
    return df.select(*by, F.col(i).cast("bigint").alias("i"), F.inline(F.array(*cells)))


def _sized(df: DataFrame, by: list[str]) -> DataFrame:
    return with_stats(_cells(df, by), by, {"_ny": F.max("i") + 1, "_nx": F.max("j") + 1})


def transpose(df: DataFrame, by=None) -> DataFrame:
    by = keys(by)
    return _cells(df, by).select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "z")


def flip(df: DataFrame, horizontal: bool = True, by=None) -> DataFrame:
    by = keys(by)
    i = F.col("i") if horizontal else F.col("_ny") - 1 - F.col("i")
    j = F.col("_nx") - 1 - F.col("j") if horizontal else F.col("j")
    return _sized(df, by).select(*by, i.alias("i"), j.alias("j"), "z")


def rotate90(df: DataFrame, k: int = 1, by=None) -> DataFrame:
    """Quarter turns against the clock."""
    by = keys(by)
    i, j, ny, nx = (F.col(c) for c in ("i", "j", "_ny", "_nx"))
    new = [(i, j), (nx - 1 - j, i), (ny - 1 - i, nx - 1 - j), (j, ny - 1 - i)][k % 4]
    return _sized(df, by).select(*by, new[0].alias("i"), new[1].alias("j"), "z")


def crop(df: DataFrame, row0: int, row1: int, col0: int, col1: int, by=None) -> DataFrame:
    """Rows row0 … row1-1 and columns col0 … col1-1, renumbered from 0."""
    if not (0 <= row0 < row1 and 0 <= col0 < col1):
        raise ValueError("empty or negative crop window")
    by = keys(by)
    kept = _cells(df, by).filter(F.col("i").between(row0, row1 - 1) & F.col("j").between(col0, col1 - 1))
    return kept.select(*by, (F.col("i") - row0).alias("i"), (F.col("j") - col0).alias("j"), "z")


def region(df: DataFrame, x0: float, x1: float, y0: float, y1: float, by=None) -> DataFrame:
    """Cells inside a rectangle of coordinates, renumbered from 0; regions below 2 x 2 are left out."""
    by = keys(by)
    (x0, x1), (y0, y1) = sorted((x0, x1)), sorted((y0, y1))
    kept = df.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    kept = with_stats(kept, by, {"_i0": F.min("i"), "_i1": F.max("i"), "_j0": F.min("j"), "_j1": F.max("j")}).filter("_i1 > _i0 AND _j1 > _j0")
    return kept.select(*by, (F.col("i") - F.col("_i0")).alias("i"), (F.col("j") - F.col("_j0")).alias("j"), "x", "y", finite("z").alias("z"))


# ---- cell values ----

def subtract_background(df: DataFrame, mode: str = "min", by=None) -> DataFrame:
    """Remove the minimum, mean, median or best plane of each matrix."""
    by = keys(by)
    cells = _cells(df, by)
    if mode in ("min", "mean"):
        out = with_stats(cells, by, {"_b": (F.min if mode == "min" else F.avg)("z")})
        return out.withColumn("z", F.col("z") - F.col("_b")).drop("_b")
    if mode == "median":
        return with_table(cells, medians(cells, by, {"_b": "z"}), by).withColumn("z", F.col("z") - F.col("_b")).drop("_b")
    if mode != "plane":
        raise ValueError(f"unknown background: {mode}")
    have = cells.filter("z IS NOT NULL")
    means = have.groupBy(*by).agg(F.avg("i").alias("_mi"), F.avg("j").alias("_mj"), F.avg("z").alias("_mz"))
    u, v = F.col("j") - F.col("_mj"), F.col("i") - F.col("_mi")
    sums = gram(with_table(have, means, by), by, [u, v], F.col("z") - F.col("_mz"))
    plane = map_rows(sums, by, lambda r: tuple(float(c) for c in np.linalg.lstsq(unpack(r["xx"], 2), np.asarray(r["xy"]), rcond=None)[0]),
                     [number("_a"), number("_c")])
    out = with_table(with_table(cells, means, by), plane, by)
    return out.withColumn("z", F.col("z") - F.col("_mz") - F.col("_a") * u - F.col("_c") * v).select(*by, "i", "j", "z")


def normalize(df: DataFrame, mode: str = "minmax", by=None) -> DataFrame:
    """Min-max or z-score (population) scaling; a constant matrix gets nulls."""
    by = keys(by)
    lo, hi = (F.min("z"), F.max("z") - F.min("z")) if mode == "minmax" else (F.avg("z"), F.stddev_pop("z"))
    out = with_stats(_cells(df, by), by, {"_a": lo, "_b": hi})
    return out.withColumn("z", div(F.col("z") - F.col("_a"), F.col("_b"))).drop("_a", "_b")


def clip(df: DataFrame, lower: float | None = None, upper: float | None = None, by=None) -> DataFrame:
    if lower is None and upper is None:
        raise ValueError("give a lower or an upper limit")
    z = F.col("z")
    if lower is not None:
        z = F.greatest(z, F.lit(float(lower)))
    if upper is not None:
        z = F.least(z, F.lit(float(upper)))
    return _cells(df, keys(by)).withColumn("z", F.when(F.col("z").isNotNull(), z))


def threshold(df: DataFrame, level: float, mode: str = "binary", by=None) -> DataFrame:
    """``binary`` 0/1, ``mask`` (null below) or ``to_zero``; holes stay holes."""
    z = F.col("z")
    above = z >= level
    value = {"binary": F.when(above, 1.0).otherwise(0.0), "mask": F.when(above, z), "to_zero": F.when(above, z).otherwise(0.0)}[mode]
    return _cells(df, keys(by)).withColumn("z", F.when(z.isNotNull(), value))


def contrast(df: DataFrame, brightness: float = 0.0, factor: float = 1.0, by=None) -> DataFrame:
    """mean + factor · (z − mean) + brightness."""
    out = with_stats(_cells(df, keys(by)), keys(by), {"_m": F.avg("z")})
    return out.withColumn("z", F.col("_m") + factor * (F.col("z") - F.col("_m")) + brightness).drop("_m")


def combine(a: DataFrame, b: DataFrame, op: str = "subtract", by=None) -> DataFrame:
    """Cell by cell arithmetic of two matrices of one shape; a division by zero is a hole."""
    by = keys(by)
    other = _cells(b, by).withColumnRenamed("z", "_z2")
    both = join_by(_cells(a, by).withColumn("_l", F.lit(1)), other.withColumn("_r", F.lit(1)), by + ["i", "j"], "full")
    if not both.filter("_l IS NULL OR _r IS NULL").isEmpty():
        raise ValueError("the matrices differ in shape")
    p, q = F.col("z"), F.col("_z2")
    value = {"add": p + q, "subtract": p - q, "multiply": p * q, "divide": div(p, q)}[op]
    return both.withColumn("z", finite(value)).select(*by, "i", "j", "z")


def stack_project(df: DataFrame, mode: str = "max", by=None) -> DataFrame:
    """Mean, max, min, sum or population deviation over all frames of a cell, nulls ignored."""
    agg = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": F.stddev_pop}[mode]
    return df.groupBy(*keys(by), "i", "j").agg(agg(finite("z")).alias("z"))


# ---- neighbourhoods ----

def _filled(df: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """Cells with holes replaced by the mean, lowest or highest value; ``_hole`` marks them."""
    agg = {"mean": F.avg("z"), "min": F.min("z"), "max": F.max("z")}[value]
    out = with_stats(_cells(df, by), by, {"_f": agg})
    return out.select(*by, "i", "j", F.col("z").isNull().alias("_hole"), F.coalesce("z", "_f").alias("z"))


def smooth_gaussian(df: DataFrame, sigma: float = 1.0, by=None) -> DataFrame:
    """Gaussian smoothing that ignores holes; large holes stay."""
    by = keys(by)
    taps = gaussian_taps(sigma)
    r = len(taps) // 2
    cells = _cells(df, by).withColumns({"_hole": F.col("z").isNull(), "_v": F.coalesce("z", F.lit(0.0)), "_w": F.col("z").isNotNull().cast("double")})
    for axis, other in (("j", "i"), ("i", "j")):
        for c in ("_v", "_w"):
            cells = fir(cells, c, by + [other], [axis], taps, r, "reflect", "_o").drop(c).withColumnRenamed("_o", c)
    weak = (F.col("_w") < 1e-12) | (F.col("_hole") & (F.col("_w") < 0.5))
    return cells.select(*by, "i", "j", F.when(~weak, F.col("_v") / F.when(F.col("_w") > 0, F.col("_w"))).alias("z"))


def smooth_median(df: DataFrame, size: int = 3, by=None) -> DataFrame:
    """Median of the non-null values in a square window; border cells repeat outwards."""
    if size % 2 == 0 or size < 3:
        raise ValueError("the window must be odd and at least 3")
    by = keys(by)
    h = size // 2
    cells = _cells(df, by).withColumn("_a", F.array("z"))
    for axis in ("j", "i"):
        fr = _along(cells, by, axis, h, h)
        w = fr.window()
        box = F.collect_list("_a").over(w.rowsBetween(-h, h))
        before = F.count(F.lit(1)).over(w.rowsBetween(-h, -1))
        after = F.count(F.lit(1)).over(w.rowsBetween(1, h))
        cells = fr.own(fr.df.withColumns({"_b": box, "_n0": before, "_n1": after}))
        padded = F.concat(F.array_repeat(F.element_at("_b", 1), (h - F.col("_n0")).cast("int")), F.col("_b"),
                          F.array_repeat(F.element_at("_b", -1), (h - F.col("_n1")).cast("int")))
        cells = cells.withColumn("_a", F.flatten(padded)).drop("_b", "_n0", "_n1")
    values = F.sort_array(F.filter("_a", lambda v: v.isNotNull()))
    out = cells.withColumn("_s", values).withColumn("_k", F.size("_s"))
    mid = (F.get("_s", F.floor((F.col("_k") - 1) / 2).cast("int")) + F.get("_s", F.floor(F.col("_k") / 2).cast("int"))) / 2
    return out.select(*by, "i", "j", F.when(F.col("_k") > 0, mid).alias("z"))


def edges(df: DataFrame, method: str = "sobel", by=None) -> DataFrame:
    """Sobel or Prewitt gradient magnitude, or the magnitude of the Laplacian; holes count as the mean."""
    by = keys(by)
    cells = _filled(df, by)
    if method not in ("sobel", "prewitt", "laplace"):
        raise ValueError(f"unknown edge method: {method}")
    centre = {"sobel": 2.0, "prewitt": 1.0, "laplace": -2.0}[method]

    def three(df, axis, made):
        fr = _along(df, by, axis, 1, 1)
        w = fr.window()
        side = lambda c: (F.coalesce(F.lag(c).over(w), F.col(c)), F.col(c), F.coalesce(F.lead(c).over(w), F.col(c)))
        return fr.own(fr.df.withColumns({n: fn(*side(c)) for n, (c, fn) in made.items()}))

    diff, smooth = (lambda b, c, a: a - b), (lambda b, c, a: b + centre * c + a)
    if method == "laplace":
        cells = three(cells, "j", {"_p": ("z", smooth)})
        cells = three(cells, "i", {"_q": ("z", smooth)})
        return cells.select(*by, "i", "j", F.abs(F.col("_p") + F.col("_q")).alias("z"))
    cells = three(cells, "j", {"_d": ("z", diff), "_s": ("z", smooth)})
    cells = three(cells, "i", {"_gx": ("_d", smooth), "_gy": ("_s", diff)})
    return cells.select(*by, "i", "j", F.hypot("_gx", "_gy").alias("z"))


def _slopes(cells: DataFrame, by: list[str], dx: Column, dy: Column) -> DataFrame:
    """Central differences along both axes (one-sided at borders) as ``_sx`` and ``_sy``."""
    for axis, step, name in (("j", dx, "_sx"), ("i", dy, "_sy")):
        fr = _along(cells, by, axis, 1, 1)
        w = fr.window()
        b, a = F.lag("z").over(w), F.lead("z").over(w)
        rise = F.when(b.isNotNull() & a.isNotNull(), (a - b) / 2).when(a.isNotNull(), a - F.col("z")).otherwise(F.col("z") - b)
        cells = fr.own(fr.df.withColumn(name, rise / step))
    return cells


def gradient_magnitude(df: DataFrame, dx: float = 1.0, dy: float = 1.0, by=None) -> DataFrame:
    """Slope of the surface at the given cell spacing; holes stay holes."""
    by = keys(by)
    out = _slopes(_filled(df, by), by, F.lit(float(dx)), F.lit(float(dy)))
    return out.select(*by, "i", "j", F.when(~F.col("_hole"), F.hypot("_sx", "_sy")).alias("z"))


def morphology(df: DataFrame, op: str = "dilate", size: int = 3, by=None) -> DataFrame:
    """Grey erosion, dilation, opening or closing with a square element; holes stay holes."""
    by = keys(by)
    steps = {"erode": ["min"], "dilate": ["max"], "open": ["min", "max"], "close": ["max", "min"]}[op]
    cells = _filled(df, by, "min" if op in ("dilate", "close") else "max")
    for step in steps:
        lo = size // 2 if step == "min" else (size - 1) // 2
        hi = size - 1 - lo
        for axis in ("j", "i"):
            fr = _along(cells, by, axis, lo, hi)
            agg = (F.min if step == "min" else F.max)("z").over(fr.window().rowsBetween(-lo, hi))
            cells = fr.own(fr.df.withColumn("_o", agg)).drop("z").withColumnRenamed("_o", "z")
    return cells.select(*by, "i", "j", F.when(~F.col("_hole"), F.col("z")).alias("z"))


# ---- sampling ----

def _bilinear(cells: DataFrame, samples: DataFrame, by: list[str], sample_keys: list[str]) -> DataFrame:
    """Weighted sums of value and coverage at fractional positions ``r``, ``c`` of the samples."""
    ri, ci = F.floor("r").cast("bigint"), F.floor("c").cast("bigint")
    corners = F.array(*[F.struct((ri + a).alias("i"), (ci + b).alias("j"), ((F.col("r") - ri if a else 1 - (F.col("r") - ri))
                                 * (F.col("c") - ci if b else 1 - (F.col("c") - ci))).alias("wt")) for a in (0, 1) for b in (0, 1)])
    near = samples.withColumn("_n", F.explode(F.filter(corners, lambda s: s["wt"] > 0)))
    near = near.select(*by, *sample_keys, F.col("_n.i").alias("i"), F.col("_n.j").alias("j"), F.col("_n.wt").alias("wt"))
    met = join_by(near, cells, by + ["i", "j"])
    return met.groupBy(*by, *sample_keys).agg(F.sum(F.col("z") * F.col("wt")).alias("_v"), F.sum(F.when(F.col("z").isNotNull(), F.col("wt")).otherwise(0.0)).alias("_w"))


def resize(df: DataFrame, ny: int, nx: int, by=None) -> DataFrame:
    """Bilinear resampling to a new shape; holes count as the mean but large ones stay holes."""
    if ny < 2 or nx < 2:
        raise ValueError("the new size needs two positions per axis")
    by = keys(by)
    cells = with_stats(_cells(df, by), by, {"_m": F.avg("z")})
    sizes = cells.groupBy(*by).agg((F.max("i") + 1).alias("_ny"), (F.max("j") + 1).alias("_nx"), F.first("_m").alias("_m"))
    out = _grid(sizes, F.lit(ny), F.lit(nx)).withColumnsRenamed({"i": "oi", "j": "oj"})
    out = out.withColumns({"r": F.col("oi") * (F.col("_ny") - 1) / F.lit(ny - 1), "c": F.col("oj") * (F.col("_nx") - 1) / F.lit(nx - 1)})
    got = _bilinear(cells.drop("_m"), out, by, ["oi", "oj", "_m"])
    value = F.when(F.col("_w") >= 0.5 - 1e-12, F.coalesce("_v", F.lit(0.0)) + (1 - F.col("_w")) * F.col("_m"))
    return got.select(*by, F.col("oi").alias("i"), F.col("oj").alias("j"), value.alias("z"))


def line_profile(df: DataFrame, start: tuple[float, float], end: tuple[float, float], samples: int = 200, by=None) -> DataFrame:
    """(by, sample, distance, x, y, z) along a segment in data coordinates; null on holes.

    Positions between coordinates are found on the evenly or unevenly spaced axes of the table.
    """
    by = keys(by)
    if start == end:
        raise ValueError("the end points must differ")
    (x0, y0), (x1, y1) = start, end
    t = F.col("sample") / F.lit(float(samples - 1))
    base = df.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
    pts = base.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    pts = pts.withColumns({"px": F.lit(float(x0)) + F.lit(float(x1 - x0)) * t, "py": F.lit(float(y0)) + F.lit(float(y1 - y0)) * t})
    for axis, at, index, pos in (("x", "px", "j", "c"), ("y", "py", "i", "r")):
        ruler = df.select(*by, F.col(axis).alias("_a"), F.col(index).cast("double").alias(pos)).distinct()
        pts = interpolate_join(pts, ruler, at, "_a", [pos], by)
    got = _bilinear(_cells(df, by), pts, by, ["sample", "px", "py"])
    dist = F.hypot(F.col("px") - x0, F.col("py") - y0)
    return got.select(*by, "sample", dist.alias("distance"), F.col("px").alias("x"), F.col("py").alias("y"),
                      F.when(F.col("_w") > 0.5, F.col("_v")).alias("z"))


def fft2_magnitude(df: DataFrame, log: bool = True, by=None) -> DataFrame:
    """Magnitude of the two-dimensional transform with the mean in the middle; holes count as the mean."""
    by = keys(by)
    rows = fft(_filled(df, by), by + ["i"], "j", "z").select(*by, "i", F.col("k").alias("j"), F.col("n").alias("_nx"), "re", "im")
    cols = fft(rows, by + ["j", "_nx"], "i", "re", "im")
    shift = lambda c, n: (F.col(c) + F.floor(F.col(n) / 2)) % F.col(n)
    size = F.hypot("re", "im")
    return cols.select(*by, shift("k", "n").cast("bigint").alias("i"), shift("j", "_nx").cast("bigint").alias("j"), (F.log1p(size) if log else size).alias("z"))


# ---- summaries ----

def statistics(df: DataFrame, by=None) -> DataFrame:
    """Size, finite cells, min, max, mean, median, population deviation, sum and where the extremes lie.

    Among equal extremes the first in row order counts.
    """
    by = keys(by)
    x = F.col("x") if "x" in df.columns else F.col("j").cast("double")
    y = F.col("y") if "y" in df.columns else F.col("i").cast("double")
    cells = df.select(*by, "i", "j", x.alias("x"), y.alias("y"), finite("z").alias("z"))
    at = F.struct("i", "j")
    top = F.min_by(F.struct("x", "y"), F.when(F.col("z").isNotNull(), F.struct(-F.col("z"), at)))
    low = F.min_by(F.struct("x", "y"), F.when(F.col("z").isNotNull(), F.struct(F.col("z"), at)))
    t = cells.groupBy(*by).agg(
        (F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("columns"), F.count("z").alias("finite_cells"),
        F.min("z").alias("min"), F.max("z").alias("max"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.sum("z").alias("sum"),
        top.alias("_t"), low.alias("_l"))
    t = with_table(t, medians(cells, by, {"median": "z"}), by)
    return t.select(*by, "rows", "columns", "finite_cells", (F.col("rows") * F.col("columns") - F.col("finite_cells")).alias("empty_cells"),
                    "min", "max", "mean", "median", "std", "sum", F.col("_t.x").alias("max_x"), F.col("_t.y").alias("max_y"),
                    F.col("_l.x").alias("min_x"), F.col("_l.y").alias("min_y"))


def _axis_weights(df: DataFrame, by: list[str], index: str, axis: str) -> DataFrame:
    """Trapezoid weight of every axis position, and the mean step of the axis."""
    ruler = df.groupBy(*by, index).agg(F.min(F.col(axis).cast("double")).alias("_p"))
    fr = frame(ruler, by, [index], 1, 1)
    w = fr.window()
    p = F.col("_p")
    weight = (F.coalesce(F.lead(p).over(w), p) - F.coalesce(F.lag(p).over(w), p)) / 2
    ruler = fr.own(fr.df.withColumn(f"_w{index}", weight))
    ends = {f"_d{index}": (F.max_by("_p", index) - F.min_by("_p", index)) / F.when(F.count("_p") > 1, F.count("_p") - 1)}
    return with_stats(ruler, by, ends).drop("_p")


def surface_metrics(df: DataFrame, by=None) -> DataFrame:
    """Roughness Ra and Rq, peak to valley, mean height, volume above the minimum, largest and mean slope."""
    by = keys(by)
    x = "x" if "x" in df.columns else "j"
    y = "y" if "y" in df.columns else "i"
    filled = cut_lineage(_filled(df, by))
    cells = join_by(filled, _axis_weights(df, by, "j", x), by + ["j"])
    cells = join_by(cells, _axis_weights(df, by, "i", y), by + ["i"])
    cells = with_stats(cells, by, {"_m": F.avg(F.when(~F.col("_hole"), F.col("z"))), "_lo": F.min(F.when(~F.col("_hole"), F.col("z")))})
    cells = _slopes(cut_lineage(cells), by, F.coalesce("_dj", F.lit(1.0)), F.coalesce("_di", F.lit(1.0)))
    z = F.when(~F.col("_hole"), F.col("z"))
    slope = F.hypot("_sx", "_sy")
    return cells.groupBy(*by).agg(
        F.avg(F.abs(z - F.col("_m"))).alias("ra"), F.sqrt(F.avg((z - F.col("_m")) * (z - F.col("_m")))).alias("rq"),
        (F.max(z) - F.min(z)).alias("peak_to_valley"), F.avg(z).alias("mean_height"),
        F.sum((F.col("z") - F.col("_lo")) * F.col("_wj") * F.col("_wi")).alias("volume_above_min"),
        F.max(slope).alias("max_slope"), F.avg(slope).alias("mean_slope"))
