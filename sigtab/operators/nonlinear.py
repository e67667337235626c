"""Nonlinear fits: one model per series, shared parameters over datasets, time constants, several peaks at once."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.functions.models import ARRAY_MODELS, LEAST_WIDTH, MODELS, array_formula, from_formula
from sigtab.functions.numeric import finite, keys, x_number
from sigtab.functions.tails import t_point, t_ppf
from sigtab.operators import peaks as pk
from sigtab.plans import lm
from sigtab.plans.layout import cut_lineage, join_by, with_stats, with_table
from sigtab.plans.normeq import map_rows, number, numbers, quadratic_form, unpack



def _model(model: str, parameters: list[str] | None):
    if model in MODELS:
        return MODELS[model]
    if not parameters:
        raise ValueError("a formula needs its parameter names")
    return from_formula(model, "x", parameters), parameters


def _curve(model: str, names: list[str]):
    """Values and derivatives of a model over arrays."""
    return lm.by_differences(ARRAY_MODELS[model] if model in ARRAY_MODELS else array_formula(model, "x", names))


def _bounds(names: list[str], lower: dict | None, upper: dict | None):
    low = np.array([(lower or {}).get(c, -np.inf) for c in names], float)
    high = np.array([(upper or {}).get(c, np.inf) for c in names], float)
    return lambda size: (low, high)


def start_table(rows: DataFrame, by: list[str], model: str) -> DataFrame:
    """Rough start values per series from extremes and positions of ``x`` and ``y``."""
    s = F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("my"), \
        F.min_by("x", F.struct(-F.col("y"), F.col("x"))).alias("xt"), F.min_by("y", "x").alias("yf"), F.max_by("y", "x").alias("yl")
    t = rows.groupBy(*by).agg(*s)
    span, rise = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9)), F.col("hi") - F.col("lo")
    falls = F.col("yf") >= F.col("yl")
    guess = {
        "gaussian": [rise, F.col("xt"), span / 8, F.col("lo")],
        "lorentzian": [rise, F.col("xt"), span / 8, F.col("lo")],
        "voigt": [rise, F.col("xt"), span / 8, span / 16, F.col("lo")],
        "logistic": [rise, F.when(falls, -8 / span).otherwise(8 / span), (F.col("x0") + F.col("x1")) / 2, F.col("lo")],
        "exponential": [F.when(falls, rise * F.exp(2 * F.col("x0") / span)).otherwise(rise * F.exp(-2 * F.col("x1") / span)),
                        F.when(falls, -2 / span).otherwise(2 / span), F.col("lo")],
        "exp1": [F.when(falls, rise).otherwise(-rise), span / 3, F.when(falls, F.col("lo")).otherwise(F.col("hi"))],
        "exp2": [rise / 2, span / 10, rise / 2, span, F.col("lo")],
        "power": [rise / F.greatest(F.abs("x1"), F.lit(1e-9)), F.lit(1.0), F.col("lo")],
        "sine": [rise / 2, 2 * math.pi / span, F.lit(0.0), F.col("my")],
    }
    if model not in guess:
        raise ValueError("a formula needs start values")
    return t.select(*by, F.array(*[c.cast("double") for c in guess[model]]).alias("p"))


def _rows(df: DataFrame, x: str, y: str, by: list[str], sigma: str | None) -> DataFrame:
    rows = df.select(*by, x_number(df, x).alias("x"), finite(y).alias("y"), *([finite(sigma).alias("sigma")] if sigma else []))
    rows = rows.filter("x IS NOT NULL AND y IS NOT NULL")
    return cut_lineage(rows.filter("sigma > 0") if sigma else rows)  # read several times, so the input is computed once


def _start(rows, by, model, names, start):
    if isinstance(start, DataFrame):
        return start
    if start is None:
        return start_table(rows, by, model)
    values = F.array(*[F.lit(float(start[c])) for c in names])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, values.alias("p"))


def fit_model(df: DataFrame, x: str, y: str, model: str, by=None, parameters: list[str] | None = None, start=None,
              lower: dict | None = None, upper: dict | None = None, sigma: str | None = None, loss: str = "linear",
              loss_scale: float = 1.0, iterations: int = 1000) -> DataFrame:
    """One row per series: ``params``, ``errors``, ``cov`` arrays in parameter order, r², rmse, reduced chi², AIC, BIC.

    ``model`` is a name of ``MODELS`` or a formula of ``x`` and ``parameters``. ``start`` is a
    dict, or a table with an array ``p`` per series. ``converged`` is false where the fit had not
    settled after ``iterations`` steps; ``params`` is null where the model has no value at the start.
    """
    by = keys(by)
    build, names = _model(model, parameters)
    rows = _rows(df, x, y, by, sigma)
    totals = rows.groupBy(*by).agg((F.var_pop("y") * F.count("y")).alias("tss"))
    got = lm.fit(rows, by, _curve(model, names), _bounds(names, lower, upper), _start(rows, by, model, names, start), loss, loss_scale,
                 iterations)
    return lm.finish(got, by, totals)


def parameter_rows(table: DataFrame, names: list[str], by=None) -> DataFrame:
    """One row per series and parameter of a fit: value and standard error."""
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("name"), F.col("params"), F.col("errors"))
    return table.select(*keys(by), F.explode(zipped).alias("z")).select(
        *keys(by), F.col("z.name").alias("parameter"), F.col("z.params").alias("value"), F.col("z.errors").alias("standard_error"))


def predict(df: DataFrame, table: DataFrame, x: str, model: str, by=None, parameters: list[str] | None = None,
            confidence: float = 0.95) -> DataFrame:
    """Rows with ``fitted`` and the confidence band of the fitted curve."""
    by = keys(by)
    build, names = _model(model, parameters)
    p = len(names)
    crit = t_ppf(F.lit((1 + confidence) / 2), F.col("dof"))
    small = cut_lineage(table.select(*by, "params", "cov", crit.alias("_crit")))
    out = with_table(df, small, by)
    at = [F.get("params", F.lit(i)) for i in range(p)]
    px = x_number(df, x)
    cols = {"fitted": build(px, *at)}
    for i in range(p):
        h = F.greatest(F.abs(at[i]), F.lit(1e-3)) * 6e-6
        up, down = list(at), list(at)
        up[i], down[i] = at[i] + h, at[i] - h
        cols[f"_g{i}"] = (build(px, *up) - build(px, *down)) / (2 * h)
    out = out.withColumns(cols)
    half = F.col("_crit") * F.sqrt(F.greatest(quadratic_form([F.col(f"_g{i}") for i in range(p)], "cov"), F.lit(0.0)))
    out = out.withColumns({"band_low": F.col("fitted") - half, "band_high": F.col("fitted") + half})
    return out.drop("params", "cov", "_crit", *[f"_g{i}" for i in range(p)])


def rc_time_constant(df: DataFrame, time: str, value: str, mode: str = "charge", by=None) -> DataFrame:
    """Time constant, first value, final value and r² of an exponential charge or discharge."""
    if mode not in ("charge", "discharge"):
        raise ValueError(f"unknown mode: {mode}")
    by = keys(by)
    rows = _rows(df, time, value, by, None)
    rows = with_stats(rows, by, {"_t0": F.min("x"), "_n": F.count(F.lit(1))}).filter("_n >= 4")
    rows = rows.withColumn("x", F.col("x") - F.col("_t0")).drop("_t0", "_n")
    sign = -1.0 if mode == "charge" else 1.0
    t = rows.groupBy(*by).agg(F.max("x").alias("span"), F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("y1"))
    eps = float(np.finfo(float).eps)
    most = F.abs(F.col("y") - F.col("y0")) >= (1 - math.exp(-1)) * F.abs(F.col("y1") - F.col("y0"))
    first = with_table(rows, t, by).groupBy(*by).agg(F.min(F.when(most & (F.col("x") > 0), F.col("x"))).alias("_t1"))
    start = with_table(t, first, by).select(*by, F.array(
        "y1", F.greatest(F.abs(F.col("y1") - F.col("y0")), F.lit(eps)), F.greatest(F.coalesce("_t1", F.col("span") / 3), F.lit(eps))).alias("p"))
    totals = rows.groupBy(*by).agg((F.var_pop("y") * F.count("y")).alias("tss"))
    curve = lm.by_differences(lambda at, final, amp, tau: final + sign * amp * np.exp(np.clip(-at / max(abs(tau), LEAST_WIDTH), -700.0, 700.0)))
    got = lm.fit(rows, by, curve, _bounds(["yinf", "amp", "tau"], {"amp": 0.0, "tau": eps}, None), start)
    done = lm.finish(got, by, totals)
    out = with_table(done, t.select(*by, F.col("y0").alias("initial")), by)
    return out.select(*by, F.get("params", F.lit(2)).alias("tau"), "initial", F.get("params", F.lit(0)).alias("final"), "r_squared")


# ---- shared parameters ----

def global_fit(df: DataFrame, dataset: str, x: str, y: str, model: str, shared: list[str], start: dict,
               parameters: list[str] | None = None, fixed: dict | None = None, lower: dict | None = None, upper: dict | None = None,
               sigma: str | None = None, loss: str = "linear", loss_scale: float = 1.0, iterations: int = 1000) -> DataFrame:
    """Fit all datasets at once with ``shared`` parameters in common and the others per dataset.

    One row per dataset: ``params``, ``errors`` and ``cov`` in model order (the dataset's block of the
    covariance of the whole fit), ``dof`` of the whole fit, n, sse, r², rmse, and ``converged``, false
    where the fit had not settled after ``iterations`` steps. ``predict`` gives the bands. Each iteration
    sums one block of normal equations per dataset; local parameters are eliminated block by block
    and only the small shared system, summed over datasets, is solved in one place.
    """
    build, order = _model(model, parameters)
    fixed = fixed or {}
    free_shared = [c for c in order if c in shared and c not in fixed]
    local = [c for c in order if c not in shared and c not in fixed]
    names = free_shared + local
    k, p = len(free_shared), len(free_shared) + len(local)
    by = [dataset]
    rows = _rows(df, x, y, by, sigma)
    scale = 1 / F.col("sigma") if sigma else F.lit(1.0)
    low = np.array([(lower or {}).get(c, -np.inf) for c in names], float)
    high = np.array([(upper or {}).get(c, np.inf) for c in names], float)

    def curve(values: list[Column]) -> Column:
        known = dict(zip(names, values))
        return build(F.col("x"), *[known.get(c, F.lit(float(fixed[c])) if c in fixed else None) for c in order])

    first = np.clip(np.array([float(start[c]) for c in names]), low, high)
    trial = cut_lineage(rows.select(*by).distinct().withColumn("_t", F.array(*[F.lit(float(v)) for v in first])))
    few = trial.count() <= lm.BROADCAST_SERIES
    best, total, lam = None, math.inf, 1e-3

    def blocks(r):
        """Shared system after eliminating the local block: (matrix, vector) flattened."""
        a, g = unpack(r["xx"], p), np.asarray(r["xy"])
        a = a + lam * np.diag(np.maximum(np.diag(a), 1e-12))
        at = np.asarray(r["_t"])
        g_use = np.where(((at <= low) & (g < 0)) | ((at >= high) & (g > 0)), 0.0, g)
        all_, agl = a[k:, k:], a[:k, k:]
        if p > k:
            sol = np.linalg.solve(all_, np.column_stack([agl.T, g_use[k:]]))
            s, v = a[:k, :k] - agl @ sol[:, :k], g_use[:k] - agl @ sol[:, k]
        else:
            s, v = a, g_use
        return (s.ravel().tolist(), v.tolist())

    converged = False
    for _ in range(iterations):
        got = lm.evaluate(rows, by, trial, p, curve, F.col("y"), scale, loss, loss_scale, few)
        got = cut_lineage(join_by(trial, got, by))
        tot = got.agg(F.sum("cost").alias("c"), F.sum(F.col("n") - F.col("valid")).alias("bad")).first()
        cost = tot["c"] if tot["c"] is not None and math.isfinite(tot["c"]) and not tot["bad"] else math.inf
        settled = best is not None and abs(total - cost) <= 1e-10 * total
        better = cost <= total
        if better:
            best, total = got, cost
        lam = max(lam * 0.1, 1e-12) if better else lam * 8
        if settled or total == 0 or lam > 1e12:
            converged = best is not None
            break
        if best is None:
            raise ValueError("the model cannot be evaluated at the start values")
        delta = np.zeros(k)
        if k:
            parts = map_rows(best, by, blocks, [numbers("s"), numbers("v")])
            sums = parts.agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(k * k)],
                             *[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(k)]).first()
            s = np.array([sums[f"s{i}"] for i in range(k * k)]).reshape(k, k)
            v = np.array([sums[f"v{i}"] for i in range(k)])
            delta = np.linalg.lstsq(s, v, rcond=None)[0]

        def move(r, delta=delta, lam=lam):
            a, g, at = unpack(r["xx"], p), np.asarray(r["xy"]), np.asarray(r["_t"])
            a = a + lam * np.diag(np.maximum(np.diag(a), 1e-12))
            g = np.where(((at <= low) & (g < 0)) | ((at >= high) & (g > 0)), 0.0, g)
            d = np.concatenate([delta, np.linalg.solve(a[k:, k:], g[k:] - a[k:, :k] @ delta)]) if p > k else delta
            return (np.clip(at + d, low, high).tolist(),)

        trial = cut_lineage(map_rows(best, by, move, [numbers("_t")]))
    lam = 0.0
    counts = best.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).first()
    dof = counts["n"] - k - counts["d"] * (p - k)
    s2 = total / dof if dof > 0 else math.nan
    shared_cov = np.zeros((k, k))
    if k:
        parts = map_rows(best, by, blocks, [numbers("s"), numbers("v")])
        sums = parts.agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(k * k)]).first()
        shared_cov = np.linalg.pinv(np.array(list(sums)).reshape(k, k)) * s2

    place = [(free_shared + local).index(c) if c not in fixed else -1 for c in order]

    def report(r):
        a = unpack(r["xx"], p)
        cov = np.zeros((p + 1, p + 1))  # the last row and column stand for fixed parameters
        cov[:k, :k] = shared_cov
        if p > k:
            inv = np.linalg.pinv(a[k:, k:])
            lift = inv @ a[k:, :k]
            cov[k:p, k:p] = inv * s2 + lift @ shared_cov @ lift.T
            cov[k:p, :k] = -lift @ shared_cov
            cov[:k, k:p] = cov[k:p, :k].T
        cov = cov[np.ix_(place, place)]
        known = dict(zip(names, r["_t"])) | {c: float(v) for c, v in fixed.items()}
        errors = np.sqrt(np.maximum(np.diag(cov), 0))
        return ([known[c] for c in order], errors.tolist(), cov.ravel().tolist() if np.all(np.isfinite(cov)) else None, float(dof),
                1 - r["sse"] / r["tss"] if r["tss"] > 0 else None, math.sqrt(r["sse"] / r["n"]))

    tss = rows.groupBy(*by).agg((F.var_pop("y") * F.count("y")).alias("tss"))
    fields = [numbers("params"), numbers("errors"), numbers("cov"), number("dof"), number("r_squared"), number("rmse")]
    return map_rows(join_by(best, tss, by), by, report, fields, keep=["n", "sse"]).withColumn("converged", F.lit(converged))


# ---- several peaks ----
def _gauss_slopes(z):
    """Value, and derivative by the scaled distance ``z``."""
    e = np.exp(-0.5 * z * z)
    return e, -z * e


def _lorentz_slopes(z):
    v = 1 / (1 + z * z)
    return v, -2 * z * v * v


SHAPES = {"gaussian": (_gauss_slopes, 2 * math.sqrt(2 * math.log(2)), math.sqrt(2 * math.pi)), "lorentzian": (_lorentz_slopes, 2.0, math.pi)}


def _peak_sum(shape):
    """Sum of peaks over (height, centre, width) of each, with exact derivatives."""
    def curve(x: np.ndarray, p: np.ndarray):
        h, c, w = p[0::3], p[1::3], p[2::3]
        z = (x[:, None] - c) / w
        value, slope = shape(z)
        out = np.empty((len(x), len(p)))
        out[:, 0::3] = value
        out[:, 1::3] = -h * slope / w
        out[:, 2::3] = -h * slope * z / w
        return value @ h, out

    return curve


def fit_peaks(df: DataFrame, x: str, y: str, by=None, model: str = "gaussian", baseline: str = "linear", max_peaks: int | None = None,
              confidence: float = 0.95, iterations: int = 1000, **detection) -> DataFrame:
    """Detect the peaks of each spectrum (all, or the ``max_peaks`` most prominent ones) and fit them together on the corrected curve.

    One row per peak: centre, height, full width, area with standard errors and confidence limits,
    r² of its spectrum and ``converged`` (false where the fit had not settled after ``iterations``
    steps). A peak narrower than the steps of x has no errors of centre and width. A spectrum without peaks, or whose fit has no value, gives one row whose ``status`` tells so.
    Rows of a long spectrum are spread over tasks; the equations of its peaks (9 numbers for each pair
    of peaks) are solved in one place.
    """
    by = keys(by)
    if not by:
        return fit_peaks(df.withColumn("_all", F.lit(0)), x, y, ["_all"], model, baseline, max_peaks, confidence, iterations, **detection).drop("_all")
    shape, to_fwhm, to_area = SHAPES[model]
    both = detection.get("direction", "positive") != "positive"
    found = cut_lineage(pk.detect_peaks(df, x, y, by, baseline, max_peaks=max_peaks, **detection))
    work = pk.remove_baseline(df, x, y, baseline, by, "_cor", detection.get("direction", "positive"))
    rows = cut_lineage(work.select(*by, x_number(df, x).alias("x"), finite("_cor").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"))
    # positions are fitted in units of the spectrum's span around its middle, so one set of bounds serves all
    span = cut_lineage(rows.groupBy(*by).agg((F.max("x") - F.min("x")).alias("_span"), ((F.max("x") + F.min("x")) / 2).alias("_mid")))
    unit = (F.col("x") - F.col("_mid")) / F.when(F.col("_span") > 0, F.col("_span")).otherwise(F.lit(1.0))
    width = F.lit(1.0) / F.greatest(F.lit(8.0), 3.0 * F.count(F.lit(1))) / to_fwhm
    many = with_table(found, span, by).withColumn("x", unit).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("x", "i", F.col("height").alias("h")))).alias("_k"), width.alias("_w"))
    start = many.select(*by, F.flatten(F.transform("_k", lambda k: F.array(k["h"], k["x"], F.col("_w")))).alias("p"))
    fitted_rows = with_table(rows, span, by).withColumn("x", unit).select(*by, "x", "y")

    def bounds(size):
        n = size // 3
        return np.tile([-np.inf if both else 0.0, -0.5, 1e-6], n), np.tile([np.inf, 0.5, 1.0], n)

    got = lm.fit(fitted_rows, by, _peak_sum(shape), bounds, start, iterations=iterations)
    totals = fitted_rows.groupBy(*by).agg((F.var_pop("y") * F.count("y")).alias("tss"))
    flags = with_table(lm.finish(got, by, totals), span, by)

    def measure(r):
        out = []
        if r["params"] is None:
            return ([],)
        p, dof = np.asarray(r["params"]), r["dof"]
        cov = np.full((len(p), len(p)), np.nan) if r["cov"] is None else np.asarray(r["cov"]).reshape(len(p), len(p))
        crit = float(t_point((1 + confidence) / 2, dof)) if dof > 0 else math.nan
        for i in range(len(p) // 3):
            scale = np.array([1.0, r["_span"], r["_span"]])
            h, c, w = p[3 * i: 3 * i + 3] * scale
            c = c + r["_mid"]
            sub = cov[3 * i: 3 * i + 3, 3 * i: 3 * i + 3] * np.outer(scale, scale)
            grads = ([0, 1, 0], [1, 0, 0], [0, 0, to_fwhm], [to_area * w, 0, to_area * h])
            values = (c, h, to_fwhm * w, to_area * h * w)
            out += [float(i)]
            for v, g in zip(values, np.array(grads, float)):
                own = np.flatnonzero(g)
                se = math.sqrt(max(float(g[own] @ sub[np.ix_(own, own)] @ g[own]), 0.0)) if np.all(np.isfinite(sub[np.ix_(own, own)])) else math.nan
                out += [float(v), se, v - crit * se, v + crit * se]
        return (out,)

    flat = map_rows(flags, by, measure, [numbers("m")], keep=["r_squared", "n", "converged"])
    step = 17
    cut = F.transform(F.sequence(F.lit(0), (F.size("m") / step).cast("int") - 1), lambda i: F.slice("m", i * step + 1, F.lit(step)))
    ok = flat.filter(F.size("m") > 0).select(*by, "r_squared", "converged", F.explode(cut).alias("v"))
    cols = [F.get("v", F.lit(0)).cast("int").alias("peak")]
    for j, c in enumerate(("center", "height", "fwhm", "area")):
        cols += [F.get("v", F.lit(1 + 4 * j + q)).alias(f"{c}{suffix}") for q, suffix in enumerate(("", "_se", "_low", "_high"))]
    done = ok.select(*by, *cols, "r_squared", "converged").withColumn("status", F.lit("ok"))
    states = with_table(rows.select(*by).distinct(), flat.select(*by, (F.size("m") > 0).alias("_has")), by)
    status = F.when(F.col("_has").isNull(), "no peaks").otherwise("no value at the start")
    missing = states.filter("_has IS NULL OR NOT _has").select(*by, status.alias("status"))
    return done.unionByName(missing, allowMissingColumns=True)


def fit_peaks_columns(df: DataFrame, x: str, columns: list[str], by=None, **options) -> DataFrame:
    """``fit_peaks`` of several y columns over one x, one row per column and peak.

    A series and column without a finite pair gives one row with the status ``no data``.
    """
    by = keys(by)
    long = df.select(*by, x_number(df, x).alias("x"), *[finite(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot(
        by + ["x"], columns, "column", "y")
    data = F.col("x").isNotNull() & F.col("y").isNotNull()
    empty = long.groupBy(*by, "column").agg(F.max(data).alias("_any")).filter("NOT _any").select(*by, "column", F.lit("no data").alias("status"))
    return fit_peaks(long.filter(data), "x", "y", by + ["column"], **options).unionByName(empty, allowMissingColumns=True)
