"""Line, polynomial and multiple linear fits, and the formulas of the laboratory built on them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.functions.numeric import add_all, as_col, div, finite, keys, x_number
from sigtab.functions.tails import chi2_sf, t_point, t_tail, f_tail
from sigtab.operators import derive
from sigtab.plans.layout import cut_lineage, frame, lay_out, with_stats, with_table
from sigtab.plans.normeq import gram, map_rows, number, numbers, polynomial_table, quadratic_form, unpack, with_polynomial

BOLTZMANN_EV = 8.617333262145e-5  # fixed value, eV per kelvin


def line_fit(df: DataFrame, x, y, by=None) -> DataFrame:
    """Slope, intercept, r² and standard errors of a straight line per series, in one aggregate.

    A series without spread in x gets nulls.
    """
    by = keys(by)
    rows = df.select(*by, finite(as_col(x)).alias("_x"), finite(as_col(y)).alias("_y")).filter(
        F.col("_x").isNotNull() & F.col("_y").isNotNull())
    table = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"),
        F.regr_sxy("_y", "_x").alias("sxy"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"))
    slope = div(F.col("sxy"), F.col("sxx"))
    sse = F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0))
    s2 = sse / F.greatest(F.col("n") - 2, F.lit(1))
    return table.select(
        *by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.when(F.col("syy") == 0, F.lit(1.0)).otherwise(1 - sse / F.when(F.col("syy") > 0, F.col("syy"))).alias("r_squared"),
        F.sqrt(s2 / F.when(F.col("sxx") > 0, F.col("sxx"))).alias("slope_std"),
        F.sqrt(s2 * (F.lit(1.0) / F.col("n") + F.col("mx") * F.col("mx") / F.when(F.col("sxx") > 0, F.col("sxx")))).alias("intercept_std"))


def ohms_law(df: DataFrame, current: str, voltage: str, by=None) -> DataFrame:
    by = keys(by)
    return line_fit(df, current, voltage, by).select(
        *by, F.col("slope").alias("resistance"), div(F.lit(1.0), F.col("slope")).alias("conductance"), "intercept", "r_squared")


def pendulum_gravity(df: DataFrame, length: str, period: str, by=None) -> DataFrame:
    """g from period² against length; lengths and periods must be positive."""
    by = keys(by)
    rows = df.filter((finite(length) > 0) & (finite(period) > 0))
    fit = line_fit(rows, F.col(length), finite(period) * finite(period), by)
    g = F.lit(4 * math.pi ** 2) / F.when(F.col("slope") > 0, F.col("slope"))
    return fit.select(*by, g.alias("g"), "slope", "intercept", "r_squared")


def randles_sevcik(df: DataFrame, rate: str, current: str, by=None) -> DataFrame:
    """Peak current against the square root of the scan rate."""
    by = keys(by)
    fit = line_fit(df.filter(finite(rate) >= 0), F.sqrt(finite(rate)), F.col(current), by)
    return fit.select(*by, "slope", "intercept", "r_squared")


def tafel(df: DataFrame, overpotential: str, current: str, by=None) -> DataFrame:
    by = keys(by)
    size = F.abs(finite(current))
    fit = line_fit(df.filter(size > 0), F.log10(size), F.col(overpotential), by)
    i0 = F.pow(F.lit(10.0), div(-F.col("intercept"), F.col("slope")))
    return fit.select(*by, F.col("slope").alias("slope_v_dec"), (F.col("slope") * 1000).alias("slope_mv_dec"),
                      F.col("intercept").alias("intercept_v"), i0.alias("exchange_current_a"), "r_squared")


def arrhenius(df: DataFrame, temperature: str, conductivity: str, by=None) -> DataFrame:
    """Activation energy (eV) and prefactor from ln(conductivity) against 1/T."""
    by = keys(by)
    rows = df.filter((finite(temperature) > 0) & (finite(conductivity) > 0))
    fit = line_fit(rows, F.lit(1.0) / finite(temperature), F.log(finite(conductivity)), by)
    return fit.select(*by, (-F.col("slope") * BOLTZMANN_EV).alias("activation_energy_ev"),
                      F.exp("intercept").alias("prefactor"), "slope", "intercept", "r_squared")


def conductivity_from_iv(df: DataFrame, voltage: str, current: str, length_m: float, area_m2: float,
                         thickness_m: float | None = None, by=None) -> DataFrame:
    by = keys(by)
    fit = line_fit(df, current, voltage, by).withColumn("resistance", F.abs("slope"))
    rho = F.col("resistance") * F.lit(area_m2 / length_m)
    sheet = rho / thickness_m if thickness_m else F.lit(None).cast("double")
    return fit.select(*by, "resistance", rho.alias("resistivity"), div(F.lit(1.0), rho).alias("conductivity"),
                      sheet.alias("sheet_resistance"), "r_squared")


def calibration_curve(df: DataFrame, concentration: str, response: str, model: str = "linear", by=None) -> DataFrame:
    """``linear``: slope and intercept. ``power``: a and b of a·c^b from the log-log line, r² in plain units."""
    by = keys(by)
    c, r = finite(concentration), finite(response)
    if model == "linear":
        return line_fit(df, concentration, response, by).select(*by, "slope", "intercept", "r_squared")
    if model != "power":
        raise ValueError(f"unknown calibration model: {model}")
    rows = df.filter((c > 0) & (r > 0))
    fit = line_fit(rows, F.log(c), F.log(r), by).select(*by, F.exp("intercept").alias("a"), F.col("slope").alias("b"))
    scored = with_table(rows.select(*by, c.alias("_c"), r.alias("_r")), fit, by)
    miss = F.col("_r") - F.col("a") * F.pow(F.col("_c"), F.col("b"))
    return scored.groupBy(*by).agg(
        F.first("a").alias("a"), F.first("b").alias("b"),
        (1 - div(F.sum(miss * miss), F.var_pop("_r") * F.count("_r"))).alias("r_squared"))


def tauc_band_gap(df: DataFrame, energy: str, absorbance: str, by=None, exponent: float = 2.0,
                  share: float = 0.35) -> DataFrame:
    """Band gap from the line through the steepest part: the ``share`` of points with the largest (αE)^n."""
    by = keys(by)
    e = finite(energy)
    rows = df.select(*by, e.alias("_e"), F.pow(F.greatest(finite(absorbance) * e, F.lit(0.0)), F.lit(exponent)).alias("_y"))
    rows = rows.filter(F.col("_e").isNotNull() & (finite("_y") > 0)).withColumn("_neg", -F.col("_y"))
    rows = with_stats(rows, by, {"_n": F.count(F.lit(1))})
    lay = lay_out(rows, by, ["_neg", "_e"])
    ranked = lay.done(lay.scan({"_i": ("index",)}))
    keep = F.greatest(F.bround(F.col("_n") * F.lit(share), 0), F.lit(4))
    fit = line_fit(ranked.filter(F.col("_i") < keep), "_e", "_y", by)
    return fit.select(*by, div(-F.col("intercept"), F.col("slope")).alias("band_gap_ev"), "slope", "intercept", "r_squared")


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int, by=None) -> DataFrame:
    """Coefficients (constant first), r² and rmse; timestamps count in seconds from the series start."""
    by = keys(by)
    if df.schema[x].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        df = derive.seconds_from_start(df, x, by, "_sec")
        x = "_sec"
    return polynomial_table(df, finite(x), finite(y), degree, by).drop("scaled", "mid", "half")


def polynomial_predict(df: DataFrame, x: str, y: str, degree: int, by=None, name: str = "fitted") -> DataFrame:
    by = keys(by)
    return with_polynomial(df, x_number(df, x), finite(y), degree, by, name)


def detrend(df: DataFrame, y: str, degree: int = 1, x: str | None = None, by=None, order=None,
            name: str | None = None) -> DataFrame:
    """``y`` minus its fitted polynomial in ``x`` or in row position."""
    by, name = keys(by), name or f"{y}_detrend{degree}"
    if x is None:
        out = derive.row_index(df, by, keys(order), "_pos")
        out = with_polynomial(out, F.col("_pos").cast("double"), finite(y), degree, by, "_base").drop("_pos")
    else:
        out = with_polynomial(df, x_number(df, x), finite(y), degree, by, "_base")
    return out.withColumn(name, finite(y) - F.col("_base")).drop("_base")


# ---- multiple linear regression ----

def _design(df: DataFrame, predictors: list[str], response: str, by: list[str]) -> DataFrame:
    """Complete rows with predictors centred and scaled per series, as ``_z0`` …, and ``_y``."""
    x = [finite(F.col(f"`{c}`")) for c in predictors]
    y = finite(F.col(f"`{response}`"))
    complete = y.isNotNull()
    for c in x:
        complete = complete & c.isNotNull()
    rows = df.filter(complete)
    stats = {"_my": F.avg(y)}
    for i, c in enumerate(x):
        stats[f"_m{i}"], stats[f"_s{i}"] = F.avg(c), F.stddev_samp(c)
    rows = with_stats(rows, by, stats)
    return rows.withColumns({
        "_y": y - F.col("_my"),
        **{f"_z{i}": (c - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")) for i, c in enumerate(x)}})


def _regression_table(df: DataFrame, predictors: list[str], response: str, by: list[str],
                      confidence: float) -> DataFrame:
    """One row per series with everything a report or the row diagnostics need."""
    p = len(predictors)
    rows = _design(df, predictors, response, by)
    keep = {f"_m{i}": F.first(f"_m{i}") for i in range(p)} | {f"_s{i}": F.first(f"_s{i}") for i in range(p)}
    sums = gram(rows, by, [F.col(f"_z{i}") for i in range(p)], F.col("_y"), extra=keep | {"_my": F.first("_my")})

    def solve(row):
        n, zz, zy = int(row["n"]), unpack(row["xx"], p), np.asarray(row["xy"])
        df_res = n - p - 1
        if df_res <= 0 or np.linalg.matrix_rank(zz) < p or not row["yy"] > 0:
            return (None,) * 19
        inv = np.linalg.inv(zz)
        g = inv @ zy
        sse = max(0.0, row["yy"] - g @ zy)
        mse = sse / df_res
        m = np.array([row[f"_m{i}"] for i in range(p)])
        s = np.array([row[f"_s{i}"] for i in range(p)])
        beta = g / s
        cov_b = inv / np.outer(s, s)
        inv0 = np.zeros((p + 1, p + 1))
        inv0[1:, 1:] = cov_b
        inv0[0, 1:] = inv0[1:, 0] = -cov_b @ m
        inv0[0, 0] = 1 / n + m @ cov_b @ m
        coef = np.concatenate([[row["_my"] - beta @ m], beta])
        se = np.sqrt(np.maximum(0, mse * np.diag(inv0)))
        with np.errstate(divide="ignore", invalid="ignore"):
            tv = coef / se
        pv = 2 * t_tail(np.abs(tv), df_res)
        crit = float(t_point((1 + confidence) / 2, df_res))
        r2 = 1 - sse / row["yy"]
        fstat = (row["yy"] - sse) / p / mse if mse > 0 else float("inf")
        ll = -0.5 * n * (math.log(2 * math.pi) + 1 + math.log(max(sse / n, np.finfo(float).tiny)))
        corr = zz / (n - 1)
        vif = np.diag(np.linalg.inv(corr))
        eig = np.linalg.eigvalsh(np.block([[np.array([[float(n)]]), np.zeros((1, p))], [np.zeros((p, 1)), zz]]))
        return (coef.tolist(), se.tolist(), tv.tolist(), pv.tolist(), (coef - crit * se).tolist(), (coef + crit * se).tolist(),
                r2, 1 - (1 - r2) * (n - 1) / df_res, fstat, float(f_tail(fstat, p, df_res)), math.sqrt(sse / n),
                math.sqrt(mse), -2 * ll + 2 * (p + 2), -2 * ll + math.log(n) * (p + 2), vif.tolist(),
                math.sqrt(eig[-1] / eig[0]), inv0.ravel().tolist(), mse, float(df_res))

    fields = [numbers(c) for c in ("coef", "se", "t", "p", "lo", "hi")]
    fields += [number(c) for c in ("r_squared", "adj_r_squared", "f", "f_p", "rmse", "residual_std", "aic", "bic")]
    fields += [numbers("vif"), number("condition_number"), numbers("inv"), number("mse"), number("df_residual")]
    return map_rows(sums, by, solve, fields, keep=["n"])


def linear_regression(df: DataFrame, predictors: list[str], response: str, by=None,
                      confidence: float = 0.95) -> DataFrame:
    """One row per series and term: estimate, standard error, t, p and confidence limits."""
    by = keys(by)
    table = _regression_table(df, predictors, response, by, confidence)
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in ["Intercept"] + predictors]).alias("term"), F.col("coef"),
                          F.col("se"), F.col("t"), F.col("p"), F.col("lo"), F.col("hi"))
    rows = table.select(*by, F.explode(zipped).alias("z"))
    fields = {"term": "term", "estimate": "coef", "standard_error": "se", "t_statistic": "t", "p_value": "p",
              "ci_low": "lo", "ci_high": "hi"}
    return rows.select(*by, *[F.col(f"z.{v}").alias(k) for k, v in fields.items()])


def regression_summary(df: DataFrame, predictors: list[str], response: str, by=None) -> DataFrame:
    """Model rows: n, r², adjusted r², F and its p, rmse, AIC, BIC, condition number, VIF per predictor."""
    by = keys(by)
    t = _regression_table(df, predictors, response, by, 0.95)
    vif = [F.get("vif", F.lit(i)).alias(f"vif_{c}") for i, c in enumerate(predictors)]
    return t.select(*by, "n", "r_squared", "adj_r_squared", "f", "f_p", "rmse", "residual_std", "aic", "bic",
                    "condition_number", *vif)


def row_diagnostics(df: DataFrame, predictors: list[str], response: str, by=None) -> DataFrame:
    """Each complete row with fitted value, residual, leverage, standardised residual and Cook's distance."""
    by = keys(by)
    x = [finite(F.col(f"`{c}`")) for c in predictors]
    y = finite(F.col(f"`{response}`"))
    complete = y.isNotNull()
    for c in x:
        complete = complete & c.isNotNull()
    table = _regression_table(df, predictors, response, by, 0.95).select(*by, "coef", "inv", "mse")
    out = with_table(df.filter(complete), table, by)
    design = [F.lit(1.0)] + x
    k = len(design)
    fitted = add_all([F.get("coef", F.lit(i)) * c for i, c in enumerate(design)])
    lev = F.least(F.greatest(quadratic_form(design, "inv"), F.lit(0.0)), F.lit(1.0))
    out = out.withColumns({"fitted": fitted, "leverage": lev}).withColumn("residual", y - F.col("fitted"))
    tiny = np.finfo(float).tiny
    spread = F.sqrt(F.greatest(F.col("mse") * (1 - F.col("leverage")), F.lit(tiny)))
    out = out.withColumn("std_residual", F.when(F.col("mse") == 0, F.lit(0.0)).otherwise(F.col("residual") / spread))
    cook = F.col("std_residual") * F.col("std_residual") * F.col("leverage") / (k * F.greatest(1 - F.col("leverage"), F.lit(tiny)))
    return out.withColumn("cooks_distance", cook).drop("coef", "inv", "mse")


def residual_tests(df: DataFrame, predictors: list[str], response: str, order, by=None) -> DataFrame:
    """Durbin-Watson along ``order``, Breusch-Pagan with its p-value, largest leverage and Cook's distance."""
    by, order = keys(by), keys(order)
    rows = cut_lineage(row_diagnostics(df, predictors, response, by))
    fr = frame(rows, by, order, 1, 0)
    step = F.col("residual") - F.lag("residual").over(fr.window())
    rows = fr.own(fr.df.withColumn("_step", step))
    main = rows.groupBy(*by).agg(
        div(F.sum(F.col("_step") * F.col("_step")), F.sum(F.col("residual") * F.col("residual"))).alias("durbin_watson"),
        F.max("leverage").alias("max_leverage"), F.max("cooks_distance").alias("max_cooks_distance"))
    square = rows.drop("_step").withColumn("_sq", F.col("residual") * F.col("residual"))
    bp = _regression_table(square, predictors, "_sq", by, 0.95)
    lm = F.col("n") * F.greatest(F.col("r_squared"), F.lit(0.0))
    bp = bp.select(*by, lm.alias("breusch_pagan_lm"), chi2_sf(lm, F.lit(float(len(predictors)))).alias("breusch_pagan_p"))
    return with_table(main, bp, by)
