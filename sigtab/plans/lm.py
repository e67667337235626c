"""Nonlinear least squares (Levenberg-Marquardt) for many series, each of any length and number of parameters.

A series that fits one task is fitted there from start to end, so a table of short series takes one
job. A longer one is dealt into chunks once; each iteration then sums the normal equations of its
chunks in one job, only the small system is solved in one place, and a checkpoint cuts the history.
Both ways take the same steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.plans.layout import cut_lineage, join_by, rows_per_task, with_table
from sigtab.plans.normeq import map_rows, number, numbers, unpack

BROADCAST_SERIES = 50_000
CELLS = 4_000_000  # numbers of one block of derivatives held in a task
LOSSES = {
    # scaled squared residual z -> (rho, rho')
    "linear": (lambda z: z, lambda z: F.lit(1.0)),
    "soft_l1": (lambda z: 2 * (F.sqrt(1 + z) - 1), lambda z: 1 / F.sqrt(1 + z)),
    "huber": (lambda z: F.when(z <= 1, z).otherwise(2 * F.sqrt(z) - 1), lambda z: F.when(z <= 1, F.lit(1.0)).otherwise(1 / F.sqrt(F.greatest(z, F.lit(1.0))))),
    "cauchy": (lambda z: F.log1p(z), lambda z: 1 / (1 + z)),
    "arctan": (lambda z: F.atan(z), lambda z: 1 / (1 + z * z)),
}


def evaluate(rows: DataFrame, by: list[str], trial: DataFrame, p: int, model: Callable[[list[Column]], Column], y: Column,
             scale: Column, loss: str, loss_scale: float, few: bool) -> DataFrame:
    """Per series at its trial parameters: cost, sse, n, and the normal equations of the scaled residuals."""
    if by:
        data = join_by(rows, F.broadcast(trial) if few else trial, by, "inner")
    else:
        data = with_table(rows, trial, [])
    par = [F.get(F.col("_t"), F.lit(i)) for i in range(p)]
    data = data.withColumns({f"_p{i}": c for i, c in enumerate(par)})
    names = [F.col(f"_p{i}") for i in range(p)]
    step = [F.greatest(F.abs(c), F.lit(1e-3)) * 6e-6 for c in names]
    cols = {"_r": y - model(names), "_w": scale}
    for i in range(p):
        up, down = list(names), list(names)
        up[i], down[i] = names[i] + step[i], names[i] - step[i]
        cols[f"_j{i}"] = (model(up) - model(down)) / (2 * step[i]) * scale
    data = data.withColumns(cols).withColumn("_s", F.col("_r") * F.col("_w"))
    rho, slope = LOSSES[loss]
    z = F.col("_s") * F.col("_s") / (loss_scale * loss_scale)
    data = data.withColumns({"_cost": rho(z) * (loss_scale * loss_scale), "_k": slope(z)})
    j = [F.col(f"_j{i}") for i in range(p)]
    return data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.isnan("_s"), F.col("_s"))).alias("valid"), F.sum("_cost").alias("cost"),
        F.sum(F.col("_r") * F.col("_r")).alias("sse"),
        F.array(*[F.sum(F.col("_k") * j[a] * j[b]) for a in range(p) for b in range(a, p)]).alias("xx"),
        F.array(*[F.sum(F.col("_k") * j[a] * F.col("_s")) for a in range(p)]).alias("xy"))


# the same losses over arrays
ARRAY_LOSSES = {
    "linear": (lambda z: z, np.ones_like),
    "soft_l1": (lambda z: 2 * (np.sqrt(1 + z) - 1), lambda z: 1 / np.sqrt(1 + z)),
    "huber": (lambda z: np.where(z <= 1, z, 2 * np.sqrt(z) - 1), lambda z: 1 / np.sqrt(np.maximum(z, 1.0))),
    "cauchy": (np.log1p, lambda z: 1 / (1 + z)),
    "arctan": (np.arctan, lambda z: 1 / (1 + z * z)),
}


def by_differences(value: Callable) -> Callable:
    """``curve(x, p) -> (values, derivatives)`` of ``value(x, *p)``, by central differences."""
    def curve(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slopes = np.empty((len(x), len(p)))
        for i, at in enumerate(p):
            h = max(abs(at), 1e-3) * 6e-6
            up, down = p.copy(), p.copy()
            up[i], down[i] = at + h, at - h
            slopes[:, i] = (value(x, *up) - value(x, *down)) / (2 * h)
        return value(x, *p), slopes

    return curve


def normal_equations(curve: Callable, x, y, w, at: np.ndarray, loss: str, loss_scale: float) -> dict:
    """n, valid, cost, sse and the normal equations (``xx`` as upper triangle by rows) of rows held in arrays."""
    p, (rho, slope) = len(at), ARRAY_LOSSES[loss]
    xx, xy, valid, cost, sse = np.zeros((p, p)), np.zeros(p), 0, 0.0, 0.0
    block = max(256, CELLS // max(p, 1))
    with np.errstate(all="ignore"):
        for i in range(0, len(x), block):
            value, slopes = curve(x[i: i + block], at)
            r, scale = y[i: i + block] - value, w[i: i + block]
            s, slopes = r * scale, slopes * scale[:, None]
            z = s * s / (loss_scale * loss_scale)
            k = slope(z)
            valid += int(np.count_nonzero(~np.isnan(s)))
            cost += float(np.sum(rho(z))) * loss_scale * loss_scale
            sse += float(r @ r)
            xx += slopes.T @ (slopes * k[:, None])
            xy += slopes.T @ (k * s)
    return {"new_n": float(len(x)), "new_valid": float(valid), "new_cost": cost, "new_sse": sse,
            "new_xx": xx[np.triu_indices(p)], "new_xy": xy}


def damped_step(xx: np.ndarray, xy: np.ndarray, at: np.ndarray, lam: float, lower, upper, free: np.ndarray) -> np.ndarray:
    """Parameters after one damped step inside the bounds; those held at a bound or fixed stay."""
    held = ~free | ((at <= lower) & (xy < 0)) | ((at >= upper) & (xy > 0))
    use = np.flatnonzero(~held)
    out = at.copy()
    if len(use):
        a = xx[np.ix_(use, use)]
        d = np.diag(a).copy()
        d[d <= 0] = max(d.max(initial=0.0), 1.0) * 1e-12
        s = 1 / np.sqrt(d)
        m = a * np.outer(s, s) + lam * np.eye(len(use))
        try:
            np.linalg.cholesky(m)
            step = s * np.linalg.solve(m, s * xy[use])
        except np.linalg.LinAlgError:
            step = s * np.linalg.lstsq(m, s * xy[use], rcond=None)[0]
        # a bound is approached by nine tenths of the way per step, so one long step cannot land on it
        out[use] += np.clip(step, 0.9 * (lower[use] - at[use]), 0.9 * (upper[use] - at[use]))
    near = 1e-10 * (np.abs(out) + 1e-10)
    return np.where(out - lower <= near, lower, np.where(upper - out <= near, upper, out))


STATE = ("t", "free", "p", "cost", "sse", "n", "xx", "xy", "lam", "done")


def advance(r: dict, bounds: Callable, tolerance: float) -> tuple:
    """The state of one series after the outcome ``new_*`` of its trial ``t`` is known."""
    free = np.asarray(r["free"]) > 0
    at, cost, sse, n, xx, xy, lam = r["p"], r["cost"], r["sse"], r["n"], r["xx"], r["xy"], r["lam"]
    first = at is None
    new = r["new_cost"]
    ok = new is not None and np.isfinite(new) and r["new_n"] > 0 and r["new_valid"] == r["new_n"] and np.all(np.isfinite(r["new_xx"]))
    if r["done"] or (first and not ok):
        return r["t"], r["free"], at, cost, sse, n, xx, xy, lam, 1.0
    done = 0.0
    if ok and (first or new <= cost):
        done = float(new == 0)
        at, cost, sse, n, xx, xy = r["t"], new, r["new_sse"], float(r["new_n"]), r["new_xx"], r["new_xy"]
        lam = lam if first else max(lam * 0.1, 1e-12)
    else:
        lam = lam * 8
        if lam > 1e12:
            done = 1.0
    at, g = np.asarray(at, float), np.asarray(xy, float)
    full = unpack(xx, len(at))
    low, high = bounds(len(at))
    trial = damped_step(full, g, at, lam, low, high, free)
    d = trial - at
    if 2 * d @ g - d @ full @ d <= tolerance * cost:
        done, at = 1.0, trial  # the step promises no worthwhile decrease
    return trial, r["free"], at, cost, sse, n, xx, xy, lam, done


def _listed(state: tuple) -> tuple:
    return tuple(v if v is None or np.isscalar(v) else np.asarray(v, float).tolist() for v in state)


FIELDS = [numbers("t"), numbers("free"), numbers("p"), number("cost"), number("sse"), number("n"), numbers("xx"),
          numbers("xy"), number("lam"), number("done")]


def _in_tasks(rows: DataFrame, by: list[str], state: DataFrame, curve, bounds, loss, loss_scale, iterations, tolerance) -> DataFrame:
    """``state`` after the whole fit of every series, each in one task."""
    schema = T.StructType([state.schema[c] for c in by] + FIELDS)

    def run(data: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if start.empty:
            return pd.DataFrame(columns=schema.names)
        data = data.sort_values(["x", "y", "w"], kind="stable")
        x, y, w = (data[c].to_numpy(float) for c in "xyw")
        first = start.iloc[0]
        now = (np.asarray(first["t"], float), np.asarray(first["free"], float), None, None, None, None, None, None, float(first["lam"]), 0.0)
        for _ in range(iterations):
            now = advance(dict(zip(STATE, now)) | normal_equations(curve, x, y, w, np.asarray(now[0], float), loss, loss_scale), bounds, tolerance)
            if now[-1]:
                break
        out = start[by].iloc[:1].reset_index(drop=True)
        for name, value in zip(STATE, _listed(now)):
            out[name] = pd.Series([value], dtype=object)
        return out

    return rows.groupBy(*by).cogroup(state.groupBy(*by)).applyInPandas(run, schema)


def _dealt(rows: DataFrame, by: list[str], sizes: DataFrame, limit: int) -> DataFrame:
    """The rows of long series with a number ``_chunk``, at most about ``limit`` rows each, written once."""
    with_size = join_by(cut_lineage(rows), sizes.select(*by, F.ceil(F.col("_size") / limit).cast("bigint").alias("_chunks")), by, "inner")
    # the row number, of rows read from files, spreads equal rows too and is the same in every attempt
    number_ = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_chunks"))
    return cut_lineage(with_size.withColumn("_chunk", number_).drop("_chunks"))


def _chunk_sums(dealt: DataFrame, by: list[str], trial: DataFrame, curve, loss, loss_scale) -> DataFrame:
    """Per series the outcome ``new_*`` of its trial, summed over chunks (position by position, combined before the shuffle)."""
    group = by + ["_chunk"]
    tries = trial.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)).alias("_chunk")).drop("_chunks")
    schema = T.StructType([trial.schema[c] for c in by] + [numbers("_v")])

    def run(data: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if start.empty or data.empty:
            return pd.DataFrame(columns=schema.names)
        x, y, w = (data[c].to_numpy(float) for c in "xyw")
        got = normal_equations(curve, x, y, w, np.asarray(start["_t"].iloc[0], float), loss, loss_scale)
        out = start[by].iloc[:1].reset_index(drop=True)
        flat = [got[f"new_{c}"] for c in ("n", "valid", "cost", "sse")] + got["new_xx"].tolist() + got["new_xy"].tolist()
        out["_v"] = pd.Series([flat], dtype=object)
        return out

    parts = dealt.groupBy(*group).cogroup(tries.groupBy(*group)).applyInPandas(run, schema)
    sums = parts.select(*by, F.posexplode("_v").alias("_at", "_x")).groupBy(*by, "_at").agg(F.sum("_x").alias("_x"))
    whole = sums.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_x"))), lambda c: c["_x"]).alias("_v"))
    at = join_by(whole, trial.select(*by, F.size("_t").alias("_p")), by, "inner")
    cells = (F.col("_p") * (F.col("_p") + 1) / 2).cast("int")
    return at.select(*by, *[F.get("_v", F.lit(i)).alias(f"new_{c}") for i, c in enumerate(("n", "valid", "cost", "sse"))],
                     F.slice("_v", F.lit(5), cells).alias("new_xx"), F.slice("_v", cells + 5, F.col("_p")).alias("new_xy"))


def fit(rows: DataFrame, by: list[str], curve: Callable, bounds: Callable, start: DataFrame, loss: str = "linear",
        loss_scale: float = 1.0, iterations: int = 1000, tolerance: float = 1e-13) -> DataFrame:
    """Best parameters per series: ``by, p, free, n, cost, sse, xx, converged``.

    ``rows`` holds ``x``, ``y`` and optionally ``sigma``; ``curve(x, p)`` gives values and their
    derivatives, ``bounds(size)`` the limits of that many parameters. ``start`` holds one row per
    series with the array ``p``, of any length, and optionally the array ``free`` (0 keeps a
    parameter at its start). A series whose curve cannot be evaluated at the start, or without rows,
    has null ``p``. A fit that has not settled after ``iterations`` steps is not ``converged``.
    """
    if not by:
        return fit(rows.withColumn("_all", F.lit(0)), ["_all"], curve, bounds, start.withColumn("_all", F.lit(0)), loss, loss_scale,
                   iterations, tolerance).drop("_all")
    rows = rows.select(*by, "x", "y", (1 / F.col("sigma") if "sigma" in rows.columns else F.lit(1.0)).alias("w"))
    limit = rows_per_task(rows.sparkSession)
    schema = T.StructType([start.schema[c] for c in by] + FIELDS)
    free = "free" if "free" in start.columns else None

    def begin(r):
        low, high = bounds(len(r["p"]))
        at = np.clip(np.asarray(r["p"], float), low, high)
        return at.tolist(), [1.0] * len(at) if free is None else list(r["free"]), None, None, None, None, None, None, 1e-3, 0.0

    sizes = cut_lineage(join_by(map_rows(start, by, begin, FIELDS), rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")), by))
    many = F.coalesce(F.col("_size"), F.lit(0)) > limit
    short, long = sizes.filter(~many).select(schema.names), sizes.filter(many)
    if long.isEmpty():
        state = cut_lineage(_in_tasks(rows, by, short, curve, bounds, loss, loss_scale, iterations, tolerance))
    else:
        # series above the limit are at most rows / limit, and only they are dealt out and iterated over
        longs = long.select(*by, "_size")
        state = cut_lineage(_in_tasks(join_by(rows, longs.drop("_size"), by, "left_anti"), by, short, curve, bounds, loss, loss_scale, iterations, tolerance))
        dealt = _dealt(rows, by, longs, limit)
        chunks = F.ceil(F.col("_size") / limit).cast("bigint").alias("_chunks")
        now = long.select(*schema.names, chunks)
        keep = schema.names[len(by):]

        def step(r):
            return _listed(advance(r, bounds, tolerance))

        for _ in range(iterations):
            got = _chunk_sums(dealt, by, now.filter("done = 0").select(*by, F.col("t").alias("_t"), "_chunks"), curve, loss, loss_scale)
            now = cut_lineage(map_rows(join_by(now, got, by), by, step, FIELDS, keep=["_chunks"]))
            if now.filter("done = 0").isEmpty():
                break
        state = state.unionByName(now.select(*by, *keep))
    return state.select(*by, "p", "free", F.col("n").cast("bigint").alias("n"), "cost", "sse", "xx", ((F.col("done") > 0) & F.col("p").isNotNull()).alias("converged"))


def finish(table: DataFrame, by: list[str], totals: DataFrame, absolute_sigma: bool = False) -> DataFrame:
    """Standard errors, covariance and fit metrics of a ``fit`` result. ``totals`` holds ``tss`` per series.

    Errors are null (and entries of ``cov`` NaN) for parameters without influence, and all of them
    where the others cannot be told apart.
    """
    joined = join_by(table, totals, by) if by else with_table(table, totals, [])

    def solve(r):
        if r["p"] is None:
            return (None,) * 9
        p = len(r["p"])
        n, free = r["n"], np.flatnonzero(np.asarray(r["free"]) > 0)
        k = len(free)
        dof = n - k
        full = unpack(r["xx"], p)
        live = free[np.diag(full)[free] > 0]  # a parameter without any influence has no error, the others keep theirs
        a = full[np.ix_(live, live)]
        s = 1 / np.sqrt(np.diag(a))
        scaled = a * np.outer(s, s)
        cov = np.zeros((p, p))
        dead = np.setdiff1d(free, live)
        cov[dead], cov[:, dead] = np.nan, np.nan
        if len(live) and np.linalg.matrix_rank(scaled) == len(live):
            factor = 1.0 if absolute_sigma else (r["cost"] / dof if dof > 0 else np.nan)
            cov[np.ix_(live, live)] = np.linalg.inv(scaled) * np.outer(s, s) * factor
        else:
            cov[:] = np.nan
        sse, tss = r["sse"], r["tss"]
        obj = max(sse, np.finfo(float).tiny)
        se = [float(v) if np.isfinite(v) else None for v in np.sqrt(np.diag(cov))]
        cov_list = cov.ravel().tolist() if np.any(np.isfinite(cov)) else None
        return (list(r["p"]), se, cov_list, 1 - sse / tss if tss and tss > 0 else None, float(np.sqrt(sse / n)),
                r["cost"] / max(1, dof), n * np.log(obj / n) + 2 * k, n * np.log(obj / n) + k * np.log(n), float(dof))

    fields = [numbers("params"), numbers("errors"), numbers("cov"), number("r_squared"), number("rmse"), number("chi2_reduced"),
              number("aic"), number("bic"), number("dof")]
    return map_rows(joined, by, solve, fields, keep=["n", "sse", "converged"])
