import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigtab.functions import tails
from sigtab.operators import fit, hypothesis as hyp


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(3)


def integral(f, a, b, n=400_001):
    x = np.linspace(a, b, n)
    return np.trapezoid(f(x), x)


def test_tails_against_integrals():
    t_pdf = lambda v: lambda x: math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
    for v in (3.0, 10.0, 77.5):
        assert float(tails.t_tail(1.7, v)) == pytest.approx(0.5 - integral(t_pdf(v), 0, 1.7), abs=1e-9)
        assert float(tails.t_tail(-1.7, v)) == pytest.approx(0.5 + integral(t_pdf(v), 0, 1.7), abs=1e-9)
        assert float(tails.t_tail(tails.t_point(0.975, v), v)) == pytest.approx(0.025, abs=1e-12)
    assert float(tails.t_point(0.975, 10)) == pytest.approx(2.228138852, abs=1e-8)
    for k in (1.0, 4.0, 30.0):
        assert float(tails.gamma_tail(k / 2, 0.0)) == 1.0
    assert float(tails.gamma_tail(0.5, 3.841458820694124 / 2)) == pytest.approx(0.05, abs=1e-10)
    assert float(tails.gamma_tail(2.0, 3.0)) == pytest.approx(math.exp(-3) * 4, abs=1e-12)
    assert float(tails.f_tail(4.0, 2, 9)) == pytest.approx((1 + 8 / 9) ** -4.5, abs=1e-12)
    assert float(tails.f_tail(2.0, 3, 1e9)) == pytest.approx(float(tails.gamma_tail(1.5, 3.0)), abs=1e-6)


def test_normal_columns(spark):
    z = np.array([-40.0, -8.5, -3.0, -0.4, 0.0, 1.0, 2.5, 7.5])
    p = np.array([1e-9, 0.01, 0.0242, 0.3, 0.5, 0.9, 0.999, 1 - 1e-7])
    got = frame(spark, z=z, p=p).select("z", tails.norm_cdf(F.col("z")).alias("c"), "p", tails.norm_ppf(F.col("p")).alias("q")).toPandas()
    np.testing.assert_allclose(got.c, [0.5 * math.erfc(-v / math.sqrt(2)) for v in got.z], rtol=1e-7, atol=1e-300)
    np.testing.assert_allclose([0.5 * math.erfc(-v / math.sqrt(2)) for v in got.q], got.p, rtol=1e-7)


def test_t_tests(spark):
    df = frame(spark, g=["a"] * 5 + ["b"] * 4, v=[1.0, 2, 3, 4, 5, 3, 5, 7, 9], w=[2.0, 2, 5, 4, 9, 1, 1, 1, 1])
    r = hyp.independent_t(df, "v", "g", "a", "b").first()
    se = math.sqrt(2.5 / 5 + (20 / 3) / 4)
    assert r.statistic == pytest.approx(-3 / se) and r.n_first == 5
    assert r.p_value == pytest.approx(2 * float(tails.t_tail(3 / se, r.df)))
    assert r.ci_low < -3 < r.ci_high
    r = hyp.one_sample_t(df.filter("g = 'a'"), "v", 3.0, alternative="greater").first()
    assert r.statistic == 0 and r.p_value == pytest.approx(0.5) and r.ci_high is None
    r = hyp.paired_t(df.filter("g = 'a'"), "v", "w").first()
    d = np.array([-1, 0, -2, 0, -4.0])
    assert r.statistic == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(5)))
    same = hyp.one_sample_t(frame(spark, v=[2.0, 2.0, 2.0]), "v", 1.0).first()
    assert same.statistic == math.inf and same.p_value == 0.0
    with pytest.raises(ValueError):
        hyp.one_sample_t(frame(spark, v=[1.0, float("nan")]), "v", nan_policy="raise")
    void = hyp.one_sample_t(frame(spark, v=[1.0, 2.0, float("nan")]), "v", nan_policy="propagate").first()
    assert void.statistic is None and void.p_value is None


@pytest.fixture(scope="module")
def two_way(spark):
    noise = [-0.2, 0.0, 0.2]
    rows = [(m + e, a, b) for (a, b), m in {("x", "p"): 1, ("x", "q"): 3, ("y", "p"): 5, ("y", "q"): 12}.items() for e in noise]
    return spark.createDataFrame(rows, "response double, A string, B string")


def test_two_way_anova(spark, two_way):
    for kind in (2, 3):
        t = hyp.two_way_anova(two_way, "response", "A", "B", ss_type=kind).toPandas().set_index("term")
        # balanced: effects 3 * (differences of means)
        assert t.sum_squares["A"] == pytest.approx(12 * 3.25 ** 2)
        assert t.sum_squares["B"] == pytest.approx(12 * 2.25 ** 2)
        assert t.sum_squares["A:B"] == pytest.approx(12 * 1.25 ** 2)
        assert t.df["Residual"] == 8 and t.sum_squares["Residual"] == pytest.approx(4 * 0.08)
        assert (t.p_value.dropna() < 1e-6).all()
    with pytest.raises(Exception, match="rank deficient"):
        hyp.two_way_anova(two_way.filter("NOT (A = 'x' AND B = 'q')"), "response", "A", "B").collect()


def test_unbalanced_two_way_matches_row_design(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, 70), rng.integers(0, 2, 70)
    y = a * 1.5 - b + rng.standard_normal(70)
    df = frame(spark, y=y, a=a.astype(str), b=b.astype(str))
    t = hyp.two_way_anova(df, "y", "a", "b", interaction=False).toPandas().set_index("term")
    one = np.ones((70, 1))
    da, db = (a[:, None] == [1, 2]).astype(float), b[:, None].astype(float)
    sse = lambda *m: np.linalg.lstsq(np.hstack(m), y, rcond=None)[1][0]
    assert t.sum_squares["a"] == pytest.approx(sse(one, db) - sse(one, da, db))
    assert t.sum_squares["b"] == pytest.approx(sse(one, da) - sse(one, da, db))


def test_rank_tests(spark, tiny_tasks):
    a, b = [1.1, 2.2, 3.3, 4.4, 5.0], [2.0, 3.3, 6.0, 7.0, 8.0, 9.0]
    df = frame(spark, v=a + b, g=["a"] * 5 + ["b"] * 6)
    r = hyp.mann_whitney(df, "v", "g", "a", "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.statistic == u and r.rank_biserial == pytest.approx(2 * u / 30 - 1) and 0 < r.p_value < 1
    k = hyp.kruskal_wallis(df, "v", "g").first()
    ranks = pd.Series(a + b).rank()
    h = 12 / (11 * 12) * (ranks[:5].sum() ** 2 / 5 + ranks[5:].sum() ** 2 / 6) - 36
    assert k.statistic == pytest.approx(h / (1 - 6 / (11 ** 3 - 11)))
    d = frame(spark, d=[1.0, -2.0, 3.0, 4.0, 0.0, -1.0, 6.0])
    w = hyp.wilcoxon(d, "d").first()
    assert w.pairs == 7 and w.nonzero_pairs == 6 and w.statistic == 1.5 + 3
    assert w.rank_biserial == pytest.approx((21 - 4.5 - 4.5) / 21)
    zero = hyp.wilcoxon(frame(spark, d=[0.0, 0.0]), "d").first()
    assert zero.statistic == 0 and zero.p_value == 1


def test_shapiro_known_value(spark):
    # Shapiro and Wilk's own example of weights of eleven men
    w = hyp.shapiro_wilk(frame(spark, v=[148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]), "v").first()
    assert w.statistic == pytest.approx(0.79, abs=0.005) and w.p_value == pytest.approx(0.0067, abs=0.0015)


def test_p_value_adjustment(spark):
    df = frame(spark, i=[1, 2, 3], p=[0.01, 0.04, 0.03])
    want = {"bonferroni": [.03, .12, .09], "holm": [.03, .06, .06], "fdr_bh": [.03, .04, .04]}
    for method, values in want.items():
        got = hyp.adjust_p_values(df, "p", "i", None, method).orderBy("i").toPandas()
        np.testing.assert_allclose(got.p_adjusted, values)
    some = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.04)], "i int, p double")
    got = hyp.adjust_p_values(some, "p", "i", None, "bonferroni").orderBy("i").toPandas()
    assert got.p_adjusted[0] == 0.02 and np.isnan(got.p_adjusted[1]) and not got.reject_null[1]


def test_regression_report(spark):
    rng = np.random.default_rng(42)
    t, p = rng.uniform(20, 30, 80), rng.uniform(1, 2, 80)
    y = 1.5 + 2.25 * t - 0.75 * p + rng.normal(0, .08, 80)
    df = frame(spark, i=np.arange(80), t=t, p=p, y=y)
    x = np.column_stack([np.ones(80), t, p])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    res = y - x @ beta
    mse = res @ res / 77
    got = fit.linear_regression(df, ["t", "p"], "y").toPandas().set_index("term")
    np.testing.assert_allclose(got.estimate[["Intercept", "t", "p"]], beta, rtol=1e-8)
    np.testing.assert_allclose(got.standard_error[["Intercept", "t", "p"]], np.sqrt(mse * np.diag(inv)), rtol=1e-8)
    s = fit.regression_summary(df, ["t", "p"], "y").first()
    r2 = np.corrcoef(t, p)[0, 1] ** 2
    assert s.vif_t == pytest.approx(1 / (1 - r2)) and s.rmse == pytest.approx(math.sqrt(res @ res / 80))
    z = np.column_stack([np.ones(80), (t - t.mean()) / t.std(ddof=1), (p - p.mean()) / p.std(ddof=1)])
    assert s.condition_number == pytest.approx(np.linalg.cond(z))
    rows = fit.row_diagnostics(df, ["t", "p"], "y").toPandas().sort_values("i")
    lev = np.einsum("ij,jk,ik->i", x, inv, x)
    np.testing.assert_allclose(rows.leverage, lev, rtol=1e-8)
    std = res / np.sqrt(mse * (1 - lev))
    np.testing.assert_allclose(rows.std_residual, std, atol=1e-8)
    np.testing.assert_allclose(rows.cooks_distance, std ** 2 * lev / (3 * (1 - lev)), atol=1e-8)
    d = fit.residual_tests(df, ["t", "p"], "y", "i").first()
    assert d.durbin_watson == pytest.approx((np.diff(res) ** 2).sum() / (res @ res))
    g = np.linalg.lstsq(x, res ** 2, rcond=None)
    bp = 80 * (1 - g[1][0] / ((res ** 2 - (res ** 2).mean()) ** 2).sum())
    assert d.breusch_pagan_lm == pytest.approx(bp, rel=1e-6)


def test_polynomial_of_high_degree(spark):
    x = np.linspace(1000, 1010, 200)
    u = (x - 1005) / 5
    df = frame(spark, x=x, y=1 + u - 2 * u ** 3 + 0.5 * u ** 8)
    out = fit.polynomial_predict(df, "x", "y", 8).toPandas()
    np.testing.assert_allclose(out.fitted, out.y, atol=1e-8)
    with pytest.raises(ValueError):
        fit.polynomial_fit(df, "x", "y", 13)


def test_exact_rank_laws(spark):
    import itertools

    for n1, n2 in ((1, 1), (3, 4), (5, 2)):
        law = np.zeros(n1 * n2 + 1)
        for own in itertools.combinations(range(n1 + n2), n1):
            law[sum(own) - n1 * (n1 - 1) // 2] += 1
        np.testing.assert_allclose(tails.rank_sum_law(n1, n2), law / law.sum(), atol=1e-15)
    law = np.zeros(29)
    for signs in itertools.product((0, 1), repeat=7):
        law[sum(r * s for r, s in zip(range(1, 8), signs))] += 1 / 128
    np.testing.assert_allclose(tails.signed_rank_law(7), law, atol=1e-15)
    df = frame(spark, v=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.5], g=["a", "a", "b", "a", "b", "b", "b"])
    r = hyp.mann_whitney(df, "v", "g", "a", "b").first()  # U = 1; 2 of 35 arrangements reach it
    assert r.statistic == 1 and r.p_value == pytest.approx(4 / 35)
    assert hyp.mann_whitney(df, "v", "g", "a", "b", alternative="less").first().p_value == pytest.approx(2 / 35)
    assert hyp.mann_whitney(df, "v", "g", "a", "b", method="normal").first().p_value != pytest.approx(4 / 35)
    w = hyp.wilcoxon(frame(spark, d=[1.0, 2.0, 3.0, 4.0, -0.5]), "d").first()
    assert w.p_value == pytest.approx(4 / 32)


def test_tails_far_out():
    for t in (0.5, 2.0, 5.0):
        near, far = tails.t_tail(t, 9.99e5), tails.t_tail(t, 1.001e6)
        z = 0.5 * math.erfc(t / math.sqrt(2))
        first = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * t * (1 + t * t) / 4
        assert far == pytest.approx(z + first / 1.001e6, rel=1e-8) and near == pytest.approx(far, rel=1e-5)
    for d in (3, 40, 2000):
        assert tails.f_tail(1.1, d, 9.99e5) == pytest.approx(tails.f_tail(1.1, d, 1.001e6), rel=1e-4)
        assert tails.f_tail(1.1, 9.99e5, d) == pytest.approx(tails.f_tail(1.1, 1.001e6, d), rel=1e-4)


def test_two_way_anova_has_no_level_limit():
    rng = np.random.default_rng(2)
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(7), indexing="ij"))
    n, dev = rng.integers(1, 9, len(ia)).astype(float), rng.normal(size=len(ia))
    dev -= (n * dev).sum() / n.sum()
    x = np.hstack([np.eye(300)[ia], np.eye(7)[ib]]) * np.sqrt(n)[:, None]
    r = dev * np.sqrt(n) - x @ np.linalg.lstsq(x, dev * np.sqrt(n), rcond=None)[0]
    assert hyp._additive_residual(n, dev, ia, ib) == pytest.approx(float(r @ r))
    code = np.vstack([np.eye(6), -np.ones(6)])[ib]  # type III by effect coding
    ea = np.vstack([np.eye(299), -np.ones(299)])[ia]
    rest = np.hstack([np.ones((len(ia), 1)), ea, (ea[:, :, None] * code[:, None, :]).reshape(len(ia), -1)]) * np.sqrt(n)[:, None]
    r = dev * np.sqrt(n) - rest @ np.linalg.lstsq(rest, dev * np.sqrt(n), rcond=None)[0]
    assert hyp._weighted_means(n, dev, ib, 7) == pytest.approx(float(r @ r), rel=1e-6)


@pytest.mark.parametrize("limit", [1000, 5])
def test_counted_quantiles(spark, limit):
    from sigtab.plans.quantile import quantiles
    rows = [(g, float(v), n) for g in (1, 2, None) for v, n in zip(range(12), [3, 1, 1, 7, 2, 1, 1, 1, 4, 1, 9, 2])]
    df = spark.createDataFrame(rows, "g int, v double, n bigint").repartition(3)
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], {"q": "v"}, [0.1, 0.5, 0.9], limit, "n").collect()}
    for g in (1, 2, None):
        whole = np.repeat([v for k, v, _ in rows if k == g], [n for k, _, n in rows if k == g])
        np.testing.assert_allclose(got[g], np.quantile(whole, [0.1, 0.5, 0.9]))


def test_interaction_means_sum_before_they_join(spark):
    from sigtab.operators import distributions
    df = spark.range(300).selectExpr("CAST(id % 3 AS INT) AS g", "CAST(id % 11 AS DOUBLE) AS f", "IF(id % 17 = 0, NULL, id * 0.5D) AS y").repartition(4)
    means = distributions.interaction_means(df, "f", ["y"], "g")
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    side = plan[plan.index("Join"):].split("\n")[1]
    assert "Aggregate" in side and "_g" in side  # what is joined are sums
    pdf = df.toPandas().dropna()
    for r in means.collect():
        part = pdf[pdf["g"] == r["g"]]
        low = part["f"] <= part["f"].median()
        np.testing.assert_allclose([r["low_mean"], r["high_mean"]], [part["y"][low].mean(), part["y"][~low].mean()])
