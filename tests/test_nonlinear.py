import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigtab.functions.models import ARRAY_MODELS, MODELS, array_formula, from_formula
from sigtab.operators import nonlinear as nl, peaks
from sigtab.plans import lm


def table(spark, frames):
    return spark.createDataFrame(pd.concat(frames)).repartition(4)


def test_recovers_curves_per_series(spark):
    rng = np.random.default_rng(2)
    x = np.linspace(0.1, 10, 120)
    truth = {"a": (4.0, 5.0, 0.8, 1.0), "b": (2.0, 3.0, 1.5, -1.0)}
    df = table(spark, [pd.DataFrame({"g": g, "x": x, "y": p[0] * np.exp(-0.5 * ((x - p[1]) / p[2]) ** 2) + p[3] + 0.01 * rng.standard_normal(120)})
                       for g, p in truth.items()])
    got = nl.fit_model(df, "x", "y", "gaussian", "g")
    for r in got.collect():
        np.testing.assert_allclose(np.abs(r.params), np.abs(truth[r.g]), atol=0.03)
        assert r.r_squared > 0.99 and r.converged and all(0 < e < 0.05 for e in r.errors)
    band = nl.predict(df, got, "x", "gaussian", "g").toPandas()
    assert ((band.band_low < band.fitted) & (band.fitted < band.band_high)).all()
    # linear model: errors agree with the closed form
    line = nl.fit_model(df.filter("g = 'a'"), "x", "y", "a + b * x", None, ["a", "b"], {"a": 0, "b": 0}).first()
    y = df.filter("g = 'a'").toPandas().sort_values("x").y.to_numpy()
    d = np.column_stack([np.ones(120), x])
    beta, sse = np.linalg.lstsq(d, y, rcond=None)[:2]
    np.testing.assert_allclose(line.params, beta, rtol=1e-6)
    np.testing.assert_allclose(line.errors, np.sqrt(np.diag(np.linalg.inv(d.T @ d)) * sse[0] / 118), rtol=1e-5)


def test_weights_bounds_and_loss(spark):
    x = np.linspace(0, 4, 60)
    y = 3 * np.exp(-x / 0.7) + 0.5
    y[10] += 20
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "s": np.where(np.arange(60) == 10, 1e6, 1.0)}))
    p = nl.fit_model(df, "x", "y", "exp1", sigma="s").first().params
    np.testing.assert_allclose(p, [3, 0.7, 0.5], atol=1e-4)
    p = nl.fit_model(df, "x", "y", "exp1", loss="cauchy", loss_scale=0.1, start={"amplitude": 3.2, "tau": 0.8, "offset": 0.4}).first().params
    np.testing.assert_allclose(p, [3, 0.7, 0.5], atol=1e-2)
    p = nl.fit_model(df, "x", "y", "exp1", sigma="s", upper={"tau": 0.6}).first().params
    assert p[1] == pytest.approx(0.6)


def test_rc_constant(spark):
    t = np.linspace(2, 12, 80)
    up = pd.DataFrame({"g": 1, "t": t, "v": 5 - 4 * np.exp(-(t - 2) / 1.7)})
    df = table(spark, [up, up.assign(g=2)])
    for r in nl.rc_time_constant(df, "t", "v", "charge", "g").collect():
        assert r.tau == pytest.approx(1.7, rel=1e-6) and r.final == pytest.approx(5.0) and r.initial == pytest.approx(1.0)


def test_shared_parameter(spark):
    rng = np.random.default_rng(4)
    x = np.linspace(0, 5, 50)
    frames = [pd.DataFrame({"d": d, "x": x, "y": a * np.exp(-x / 1.3) + c + 0.005 * rng.standard_normal(50)})
              for d, a, c in (("p", 2.0, 0.1), ("q", 5.0, -0.4), ("r", 1.0, 0.0))]
    got = nl.global_fit(table(spark, frames), "d", "x", "y", "exp1", ["tau"], {"amplitude": 1, "tau": 1, "offset": 0}).toPandas().set_index("d")
    taus = [p[1] for p in got.params]
    assert max(taus) - min(taus) < 1e-12 and taus[0] == pytest.approx(1.3, abs=0.02)
    assert got.params["q"][0] == pytest.approx(5.0, abs=0.02) and got.params["r"][0] == pytest.approx(1.0, abs=0.02)
    assert (got.r_squared > 0.99).all()


def test_two_peaks_on_a_baseline(spark):
    x = np.linspace(0, 10, 401)
    g = lambda a, c, s: a * np.exp(-0.5 * ((x - c) / s) ** 2)
    y = 0.1 * x + 0.5 + g(3, 3, 0.35) + g(2, 7, 0.55) + 0.01 * np.sin(37 * x)
    df = table(spark, [pd.DataFrame({"s": "a", "x": x, "y": y}), pd.DataFrame({"s": "flat", "x": x, "y": 0.0 * x})])
    found = peaks.detect_peaks(df, "x", "y", "s").toPandas().sort_values("x")
    np.testing.assert_allclose(found.x, [3, 7], atol=0.05)
    got = nl.fit_peaks(df, "x", "y", "s", max_peaks=4).toPandas()
    assert got[got.s == "flat"].status.tolist() == ["no peaks"]
    a = got[got.s == "a"].sort_values("center")
    np.testing.assert_allclose(a.center, [3, 7], atol=0.01)
    np.testing.assert_allclose(a.height, [3, 2], atol=0.05)
    np.testing.assert_allclose(a.fwhm, np.array([0.35, 0.55]) * 2.35482, atol=0.03)
    np.testing.assert_allclose(a.area, np.array([3 * 0.35, 2 * 0.55]) * np.sqrt(2 * np.pi), atol=0.08)
    assert ((a.center_low < a.center) & (a.center < a.center_high)).all()


def test_arrays_follow_the_columns(spark):
    x = np.linspace(0.2, 6, 25)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    values = {"gaussian": (2, 3, 0.7, 1), "lorentzian": (2, 3, 0.7, 1), "voigt": (2, 3, 0.7, 0.4, 1), "logistic": (2, 1.5, 3, 1),
              "exponential": (2, -0.3, 1), "exp1": (2, 1.4, 1), "exp2": (2, 1.4, 3, 0.2, 1), "power": (2, 1.4, 1), "sine": (2, 1.4, 0.3, 1)}
    for name, (build, _) in MODELS.items():
        want = df.orderBy("x").select(build(F.col("x"), *values[name]).alias("y")).toPandas().y
        np.testing.assert_allclose(ARRAY_MODELS[name](x, *values[name]), want, rtol=1e-12)
    for formula in ("a * exp(-x / b) + sqrt(abs(x - 3))", "clip(a * x, 2, b) + pi", "round(x / b, 1) + x % 2 - (x - 3) % b", "min(x, a) * max(x, b) - log(x) ** 2"):
        build = from_formula(formula, "x", ["a", "b"])
        want = df.orderBy("x").select(build(F.col("x"), 1.5, 4.0).alias("y")).toPandas().y
        np.testing.assert_allclose(array_formula(formula, "x", ["a", "b"])(x, 1.5, 4.0), want, rtol=1e-12)


def comb(peaks_, n=900):
    x = np.linspace(0, 100, n)
    y = sum(h * np.exp(-0.5 * ((x - c) / w) ** 2) for h, c, w in peaks_) + 0.004 * np.sin(91 * x)
    return pd.DataFrame({"x": x, "y": y})


def test_all_peaks_are_fitted(spark):
    """Eleven peaks, some overlapping, in one spectrum and two in another; none is left out and both fits settle."""
    truth = [(1 + (i % 4), 5 + 8.7 * i + 0.4 * (i % 3), 0.9 + 0.25 * (i % 5)) for i in range(11)]
    frames = [comb(truth).assign(s="many"), comb([(3, 30, 2), (2, 70, 4)]).assign(s="two")]
    got = nl.fit_peaks(table(spark, frames), "x", "y", "s", baseline="none").toPandas()
    assert got.converged.all() and (got.r_squared > 0.999).all() and (got.status == "ok").all()
    many = got[got.s == "many"].sort_values("center")
    np.testing.assert_allclose(many[["height", "center"]], [t[:2] for t in truth], atol=0.02)
    np.testing.assert_allclose(many.fwhm / 2.3548200450309493, [t[2] for t in truth], atol=0.02)
    assert len(got[got.s == "two"]) == 2


def test_long_series_take_the_same_steps(spark):
    frames = [comb([(2, 20, 3), (3, 55, 2), (1, 80, 5)], 300).assign(s="a"), comb([(1, 50, 8)], 30).assign(s="b")]
    df = table(spark, frames)
    rows = df.select("s", "x", "y")
    start = spark.createDataFrame([("a", [1.9, 19.0, 2.0, 2.8, 56.0, 3.0, 1.0, 79.0, 4.0]), ("b", [0.8, 47.0, 6.0])], "s string, p array<double>")
    free = lambda size: (np.full(size, -np.inf), np.full(size, np.inf))
    curve = nl._peak_sum(nl.SHAPES["gaussian"][0])
    whole = lm.fit(rows, ["s"], curve, free, start).toPandas().set_index("s")
    spark.conf.set("spark.sigtab.rowsPerTask", "40")
    try:
        cut = lm.fit(rows, ["s"], curve, free, start).toPandas().set_index("s")
        one = nl.fit_model(df.filter("s = 'a'"), "x", "y", "a + b * x", None, ["a", "b"], {"a": 0, "b": 0}).first()
    finally:
        spark.conf.unset("spark.sigtab.rowsPerTask")
    for s in "ab":
        np.testing.assert_allclose(cut.p[s], whole.p[s], rtol=1e-7)
        np.testing.assert_allclose(cut.xx[s], whole.xx[s], rtol=1e-6, atol=1e-9)
        assert cut.converged[s] and whole.converged[s] and cut.n[s] == whole.n[s] == (300 if s == "a" else 30)
    a = frames[0]
    np.testing.assert_allclose(one.params, np.polyfit(a.x, a.y, 1)[::-1], rtol=1e-6)


def test_no_data_and_no_value(spark):
    x = np.linspace(0, 100, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "good": comb([(3, 30, 4)], 200).y, "flat": 0.0 * x, "gone": np.nan * x}))
    got = nl.fit_peaks_columns(df, "x", ["good", "flat", "gone"], baseline="none").toPandas().set_index("column")
    assert got.status.to_dict() == {"good": "ok", "flat": "no peaks", "gone": "no data"}
    assert got.center["good"] == pytest.approx(30, abs=0.05)
    none = nl.fit_model(df, "x", "good", "a * log(x - b)", None, ["a", "b"], {"a": 1, "b": 500}).first()
    assert none.params is None and not none.converged
    stopped = nl.fit_model(df, "x", "good", "gaussian", iterations=2).first()
    assert not stopped.converged and stopped.params is not None


def test_shared_fit_covariance_and_bands(spark):
    """Covariance of the whole fit against the stacked problem, one fixed parameter, bands by predict."""
    rng = np.random.default_rng(9)
    x = np.linspace(0, 6, 40)
    truth = {"p": (2.0, 0.1), "q": (5.0, -0.4)}
    frames = [pd.DataFrame({"d": d, "x": x, "y": a * np.exp(-x / 1.3) + c + 0.02 * rng.standard_normal(40)}) for d, (a, c) in truth.items()]
    df = table(spark, frames)
    got = nl.global_fit(df, "d", "x", "y", "exp1", ["tau"], {"amplitude": 1, "tau": 1, "offset": 0})
    rows = {r.d: r for r in got.collect()}
    tau = rows["p"].params[1]
    jac, res = np.zeros((80, 5)), []
    for i, d in enumerate("pq"):
        a, _, c = rows[d].params
        e = np.exp(-x / tau)
        part = slice(40 * i, 40 * i + 40)
        jac[part, 0], jac[part, 1 + 2 * i], jac[part, 2 + 2 * i] = a * x / tau**2 * e, e, 1
        res.append(frames[i].y - a * e - c)
    cov = np.linalg.inv(jac.T @ jac) * np.sum(np.square(res)) / 75
    for i, d in enumerate("pq"):
        at = [1 + 2 * i, 0, 2 + 2 * i]
        assert rows[d].converged and rows[d].dof == 75
        np.testing.assert_allclose(np.reshape(rows[d].cov, (3, 3)), cov[np.ix_(at, at)], rtol=1e-3)
        np.testing.assert_allclose(rows[d].errors, np.sqrt(np.diag(cov)[at]), rtol=1e-3)
    band = nl.predict(df, got, "x", "exp1", "d").toPandas()
    assert ((band.band_low < band.fitted) & (band.fitted < band.band_high)).all()
    fixed = nl.global_fit(df, "d", "x", "y", "exp1", ["tau"], {"amplitude": 1, "tau": 1}, fixed={"offset": 0.0}).first()
    assert fixed.params[2] == 0 and fixed.errors[2] == 0 and fixed.cov[8] == 0 and fixed.converged
