import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigtab.plans import quantile
from sigtab.plans.layout import frame, lay_out, with_index, with_stats
from sigtab.plans.quantile import mid_ranks, quantiles


def data(spark, parts=7):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({
        "g": rng.choice(["hot", "a", "b", None], n, p=[0.7, 0.1, 0.1, 0.1]),
        "t": rng.permutation(n).astype(float),
        "y": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 50, n)),
    })
    df = spark.createDataFrame(pdf).repartition(parts).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    return pdf.sort_values("t"), df


@pytest.mark.parametrize("by", [[], ["g"]])
def test_scan_matches_pandas(spark, tiny_tasks, by):
    pdf, df = data(spark)
    lay = lay_out(df, by, ["t"])
    assert lay.split
    out = lay.done(lay.scan({
        "i": ("index",), "s": ("sum", "y"), "m": ("max", "y"), "l": ("last", "y"),
        "x": ("next", "y"), "r": ("rmin", "y"),
    })).toPandas().sort_values("t").reset_index(drop=True)
    key = pdf.g.fillna("-") if by else pd.Series("all", index=pdf.index)
    grp = pdf.y.groupby(key)
    np.testing.assert_array_equal(out.i, grp.cumcount())
    np.testing.assert_allclose(out.l, grp.ffill())
    np.testing.assert_allclose(out.x, grp.bfill())
    np.testing.assert_allclose(out.m, grp.cummax().groupby(key).ffill())
    np.testing.assert_allclose(out.s.fillna(0), pdf.y.fillna(0).groupby(key).cumsum())
    rmin = pdf.y[::-1].groupby(key).cummin().groupby(key[::-1]).ffill()[::-1]
    np.testing.assert_allclose(out.r, rmin)


def test_ranges_are_bounded(spark, tiny_tasks):
    _, df = data(spark)
    lay = lay_out(df, ["g"], ["t"])
    sizes = lay.df.groupBy(*lay.parts).count().toPandas()["count"]
    assert sizes.max() < 120


@pytest.mark.parametrize("by", [[], ["g"]])
def test_frame_equals_plain_window(spark, tiny_tasks, by):
    pdf, df = data(spark)
    f = frame(df, by, ["t"], 4, 2)
    assert f.split
    got = f.own(f.df.withColumn("a", F.sum("t").over(f.window().rowsBetween(-4, 2)))).toPandas()
    got = got.sort_values("t").reset_index(drop=True)
    key = (pdf.g.fillna("-") if by else pd.Series("all", index=pdf.index)).reset_index(drop=True)
    t = pdf.t.reset_index(drop=True)
    want = pd.Series(0.0, index=t.index)
    for _, s in t.groupby(key):
        v = s.to_numpy()
        for j in range(len(v)):
            want[s.index[j]] = v[max(0, j - 4): j + 3].sum()
    np.testing.assert_allclose(got.a, want)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_long_path(spark, by):
    _, df = data(spark)
    long = quantiles(df, by, {"q": "y", "u": "t"}, [0.1, 0.5, 0.9], limit=40).toPandas()
    short = quantiles(df, by, {"q": "y", "u": "t"}, [0.1, 0.5, 0.9], limit=10**6).toPandas()
    if by:
        long, short = (d.fillna({"g": "-"}).sort_values("g").reset_index(drop=True) for d in (long, short))
    for c in ("q", "u"):
        np.testing.assert_allclose(np.stack(long[c]), np.stack(short[c]))


def test_mid_ranks(spark, tiny_tasks):
    pdf, df = data(spark)
    got = mid_ranks(df, [], "y", {}).toPandas().set_index("v")["rank"].sort_index()
    want = pdf.y.dropna().rank().groupby(pdf.y).first()
    np.testing.assert_allclose(got, want)


def test_stats_and_index(spark):
    _, df = data(spark)
    out = with_stats(df, [], {"mu": F.avg("t")}).agg(F.min("mu"), F.max("mu")).first()
    assert out[0] == out[1] == pytest.approx(299.5)
    assert with_index(df, ["g"], ["t"]).filter("row_index = 0").count() == 4


@pytest.mark.parametrize("few", [True, False])
def test_bracketed_medians(spark, few, monkeypatch):
    """Odd and even counts, ties, one value, nulls and a null key; also where the sketch has missed."""
    rng = np.random.default_rng(2)
    groups = {"odd": rng.standard_normal(901), "even": rng.standard_normal(900).cumsum(), "ties": rng.integers(0, 3, 500).astype(float),
              "split": np.repeat([1.0, 4.0], 50), "one": np.array([7.5]), None: rng.exponential(1.0, 30_000)}
    pdf = pd.concat([pd.DataFrame({"s": k, "d": np.append(v, np.nan)}) for k, v in groups.items()])
    df = spark.createDataFrame(pdf).withColumn("d", F.when(~F.isnan("d"), F.col("d"))).repartition(4)
    for missed in (False, True):
        if missed:
            monkeypatch.setattr(quantile.F, "percentile_approx", lambda c, *_: F.array(F.max(c), F.max(c)))
        got = {r["s"]: r["d"] for r in quantile.bracketed_medians(df, ["s"], "d", few).collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            assert got[k] == np.median(v)
