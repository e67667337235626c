"""Sources, rows, joins, matrices, peaks and streams on small fixtures."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import common
from sigtab.functions import units
from sigtab.operators import clean, derive, joins, matrix, peaks, recipes, rows
from sigtab.plans.banded import als_baseline
from sigtab.plans.crossing import nearest_crossing
from sigtab.sources import tables as src
from sigtab.streaming import sensor


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(3)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x;y;y;\n1;2,000;อ;k\n3;4;ข;m\n".encode("utf-8"))
    df = src.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns[0] == "x" and len(set(df.columns)) == 4
    assert sorted(r[1] for r in df.collect()) == [4.0, 2000.0]
    (tmp_path / "b.tsv").write_bytes("n\tt\n1\tก\n".encode("cp874"))
    assert src.text_encoding(spark, str(tmp_path / "b.tsv")) == "cp874"
    assert src.read_table(spark, str(tmp_path / "b.tsv")).first()["t"] == "ก"
    (tmp_path / "c.csv").write_bytes("n,t\n1,\xfcber\n".encode("latin-1"))
    assert src.text_encoding(spark, str(tmp_path / "c.csv")) == "ISO-8859-1"
    (tmp_path / "d.json").write_text('[{"a": {"b": 1, "c": {"d": "q"}}, "e": 2}]')
    assert src.read_json(spark, str(tmp_path / "d.json")).columns == ["a.b", "a.c.d", "e"]


def test_headers():
    assert src.clean_header(["a", "", None, "a", "a", "a_2"]) == ["a", "column_2", "column_3", "a_2", "a_3", "a_2_2"]
    assert sensor.unique_headers(["t", "r", "r", "r"]) == ["t", "r", "r.1", "r.2"]


def test_fingerprint_sees_changes(spark):
    a = frame(spark, x=[1, 1, 2], y=["p", "p", "q"])
    assert not src.compare_versions(a, a.repartition(7)).first()["changed"]
    assert src.compare_versions(a, a.distinct()).first()["changed"]
    assert src.compare_versions(a, a.withColumn("y", F.upper("y"))).first()["changed"]


def test_temperature_units(spark):
    got = frame(spark, c=[0.0, 100.0]).select(units.convert("c", "°C", "K").alias("k"), units.convert("c", "°C", "°F").alias("f")).toPandas()
    np.testing.assert_allclose(sorted(got.k), [273.15, 373.15])
    np.testing.assert_allclose(sorted(got.f), [32, 212])
    with pytest.raises(ValueError):
        units.convert("c", "°C", "V")
    assert units.guess_unit("U [mV]") == "mV" and units.guess_unit("x (?)") is None


def test_formula_errors(spark):
    df = frame(spark, x=[1.0, 0.0])
    assert derive.derive(df, "y", "1 / x").filter("y IS NULL").count() == 1
    for bad in ("", "x +", "nope(x)", "__import__('os')", "x.y", "missing + 1"):
        with pytest.raises((ValueError, KeyError)):
            derive.derive(df, "y", bad)


def test_missing_and_gradient(spark):
    df = frame(spark, t=[0, 1, 2, 3], y=[np.nan, 2.0, np.nan, 4.0])
    assert clean.interpolate_missing(df, "y", None, "t", "z").orderBy("t").toPandas().z.tolist() == [2, 2, 3, 4]
    g = derive.gradient(frame(spark, t=[0.0, 1, 3, 4], y=[0.0, 1, 9, 16]), "y", "t", None, "t", "g").orderBy("t").toPandas().g
    np.testing.assert_allclose(g, np.gradient([0.0, 1, 9, 16], [0.0, 1, 3, 4]))
    dup = rows.drop_duplicates(frame(spark, i=range(5), a=[1, 1, 2, 2, 3], b=[9, 9, 8, 7, 6]), ["a"], ["i"])
    assert sorted(r.b for r in dup.collect()) == [6, 8, 9]
    out = rows.drop_outliers(frame(spark, y=[1.0] * 10 + [999.0]), "y")
    assert out.count() == 10


@pytest.mark.parametrize("by", [[], ["g"]])
def test_nearest_merge_matches_brute_force(spark, tiny_tasks, by):
    rng = np.random.default_rng(8)
    n, m = 150, 130
    lt = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[.8, .2]), "t": rng.integers(0, 400, n).astype(float), "i": range(n)})
    rt = pd.DataFrame({"g": rng.choice(["a", "b"], m), "u": rng.permutation(800)[:m] / 2.0, "k": range(m)})
    got = joins.nearest_merge(spark.createDataFrame(lt).repartition(5), spark.createDataFrame(rt).repartition(4), "t", "u", by, ["k"])
    got = got.toPandas().set_index("i").sort_index()
    for r in lt.itertuples():
        cand = rt[rt.g == r.g] if by else rt
        d = (cand.u - r.t).abs()
        best = cand[d == d.min()].sort_values("u").iloc[0]
        assert got.loc[r.i, "k"] == best.k


def test_crossings_over_chunks(spark):
    rng = np.random.default_rng(1)
    n = 200
    y = np.cumsum(rng.standard_normal(n))
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "i": np.arange(n), "y": y})).repartition(4)
    at = np.arange(0, n, 7)
    q = spark.createDataFrame(pd.DataFrame({"g": "a", "q": at, "at": at, "level": y[at] + 0.5}))
    for side in ("left", "right"):
        got = nearest_crossing(df, ["g"], "i", "y", q, "q", side=side, limit=25).toPandas().set_index("q")
        assert len(got) == len(at)
        for a in at:
            span = range(a - 1, -1, -1) if side == "left" else range(a + 1, n)
            hit = next((j for j in span if y[j] > y[a] + 0.5), None)
            assert (got.found[a] if not pd.isna(got.found[a]) else None) == hit
            inner = [y[j] for j in (range(hit + 1, a) if side == "left" else range(a + 1, hit)) ] if hit is not None else [y[j] for j in span]
            want = min(inner) if inner else np.nan
            assert (np.isnan(want) and pd.isna(got.span_min[a])) or got.span_min[a] == pytest.approx(want)


def test_als_matches_dense_and_chunks(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = np.arange(n)
    y = 0.01 * x + 5 * np.exp(-0.5 * ((x - 150) / 6.0) ** 2) + 0.1 * rng.standard_normal(n)
    d = np.diff(np.eye(n), 2, axis=0)
    w = np.ones(n)
    for _ in range(4):
        z = np.linalg.solve(np.diag(w) + 10.0 * d.T @ d, w * y)
        w = np.where(y > z, 0.1, np.where(y < z, 0.9, 0.5))
    np.testing.assert_allclose(als_baseline(y, 10.0, 0.1, 4), z, atol=1e-9)
    df = frame(spark, x=x, y=y)
    spark.conf.set("spark.sigtab.rowsPerTask", "300")
    try:
        got = peaks.als(df, "x", "y", None, 10.0, 0.1, 1).toPandas().sort_values("x")
    finally:
        spark.conf.unset("spark.sigtab.rowsPerTask")
    np.testing.assert_allclose(got.baseline, als_baseline(y, 10.0, 0.1, 1), atol=1e-9)


def test_spacing_is_greedy(spark):
    rng = np.random.default_rng(6)
    i = np.sort(rng.permutation(500)[:120])
    s = rng.integers(0, 30, 120).astype(float)
    kept = []
    for k in sorted(range(120), key=lambda k: (-s[k], i[k])):
        if all(abs(i[k] - o) > 6 for o in kept):
            kept.append(i[k])
    got = peaks.keep_spaced(spark.createDataFrame(pd.DataFrame({"i": i, "s": s})), [], "i", "s", 6)
    assert sorted(r.i for r in got.collect()) == sorted(kept)


def test_exposure_curve(spark):
    t = np.arange(0, 300, 0.25)
    on = np.where((t >= 50) & (t < 150), 20 + 80 * np.exp(-(t - 50) / 5), 100.0)
    y = np.where(t >= 150, 100 - (100 - on[t < 150][-1]) * np.exp(-(t - 150) / 5), on)
    df = frame(spark, t=t, y=y)
    found = peaks.detect_cycles(df, "t", "y").toPandas()
    assert len(found) == 1 and found.t_on[0] == pytest.approx(50, abs=1) and found.t_off[0] == pytest.approx(160, abs=6)
    runs = spark.createDataFrame([(50.0, 150.0)], "t_on double, t_off double")
    r = peaks.exposure_response(df, "t", "y", runs).first()
    assert r.baseline == 100 and r.steady == pytest.approx(20, abs=1e-3)
    assert r.response_percent == pytest.approx(80, abs=0.01) and r.sensitivity == pytest.approx(5, abs=0.01)
    assert r.response_time == pytest.approx(5 * np.log(10), abs=0.3) and r.recovery_time == pytest.approx(5 * np.log(10), abs=0.5)


def test_nearest_grid_with_gaps(spark):
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.uniform(0, 0.2, (60, 2)), [[1.0, 1.0]], [[0.9, 0.0]]])
    z = np.arange(62.0)
    got = matrix.nearest_grid(frame(spark, x=pts[:, 0], y=pts[:, 1], z=z), "x", "y", "z", 15, 12).toPandas()
    assert len(got) == 180
    for r in got.itertuples():
        d = np.hypot(pts[:, 0] - r.x, pts[:, 1] - r.y)
        assert d[int(r.z)] == pytest.approx(d.min(), abs=1e-12)


def test_matrix_smoothing_ignores_holes(spark):
    cells = [(i, j, None if (i, j) == (3, 3) else 2.0) for i in range(7) for j in range(7)]
    df = spark.createDataFrame(cells, "i bigint, j bigint, z double")
    assert matrix.smooth_gaussian(df, 1.0).filter("abs(z - 2) < 1e-12").count() == 49
    z = np.arange(30.0).reshape(5, 6) ** 1.3
    m = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(5) for j in range(6)], "i bigint, j bigint, z double")
    f = matrix.fft2_magnitude(m, False).toPandas().pivot(index="i", columns="j", values="z").to_numpy()
    np.testing.assert_allclose(f, np.abs(np.fft.fftshift(np.fft.fft2(z))), atol=1e-9)
    for k in range(4):
        r = matrix.rotate90(m, k).toPandas().pivot(index="i", columns="j", values="z").to_numpy()
        np.testing.assert_array_equal(r, np.rot90(z, k))


def test_replay_and_registry(spark):
    df = frame(spark, t=[1, 2, 3], y=[1.0, np.nan, 3.0])
    out = recipes.replay(df, [{"op": "fill_missing", "params": {"col": "y", "method": "ffill"}}], None, "t").orderBy("t").toPandas()
    assert out.y.tolist() == [1, 1, 3]
    with pytest.raises(ValueError):
        recipes.replay(df, [{"op": "what"}])
    recipes.register("scaled", lambda d, by: d.withColumn("y", F.col("y") * by), {"by": float})
    with pytest.raises(TypeError):
        recipes.run("scaled", df, by="2")
    assert recipes.run("scaled", df, by=2.0).filter("y = 6").count() == 1


def test_average_survives_batches(spark, tmp_path):
    schema = "device string, channel string, ts timestamp, seq bigint, value double"
    base = datetime.datetime(2024, 1, 1)
    src_dir, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    values = [1.0, 2.0, None, 4.0, 8.0, 16.0]
    for part in (slice(0, 3), slice(3, 6)):
        rows_ = [("d", "c", base + datetime.timedelta(seconds=i), i, values[i]) for i in range(6)[part]]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src_dir)
        stream = spark.readStream.schema(schema).parquet(src_dir)
        sensor.append_to(sensor.moving_average(stream, 3), out, check, every=None).awaitTermination()
    got = spark.read.parquet(out).orderBy("seq").toPandas()
    np.testing.assert_allclose(got.average, [1, 1.5, np.nan, 7 / 3, 14 / 3, 28 / 3])
    table = sensor.moving_average_table(spark.read.parquet(src_dir), 3).orderBy("seq").toPandas()
    np.testing.assert_allclose(table.average, got.average)


def test_parser_reasons(spark):
    schema = T.StructType([T.StructField("r", T.DoubleType()), T.StructField("t", T.DoubleType()), T.StructField("s", T.StringType())])
    lines = ['{"r": 100, "t": 25}', '{"r": 1, "new": 2}', "{oops", '{"s": "x"}', "  ", "[1]"]
    out = sensor.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), schema).toPandas()
    assert len(out) == 5 and out.error.isna().sum() == 2
    assert out.warning.dropna().tolist() == ["ignored field(s): new"]
    csv = ["r,t,s", "1,2,a", "1,,b", "1,2", ",,c"]
    out = sensor.parse_lines(spark.createDataFrame([(x,) for x in csv], "value string"), schema, "csv").toPandas()
    assert len(out) == 4 and out.error.isna().sum() == 2


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_merge_spreads_frequent_keys(spark, tiny_tasks, how):
    lk, rk = [1] * 60 + [2] * 3 + [None] * 30 + [4] * 2, [1] * 50 + [2] * 4 + [None] * 20 + [5] * 3
    left = spark.createDataFrame([(k, i, 1.5) for i, k in enumerate(lk)], "k bigint, a bigint, v double")
    right = spark.createDataFrame([(k, i, 2.5) for i, k in enumerate(rk)], "k bigint, b bigint, v double")
    joined = joins.merge(left, right, "k", "k", how).select("k", "a", "v_left", "b", "v_right")
    want = [(k, a, 1.5, b, 2.5) for a, k in enumerate(lk) for b, m in enumerate(rk) if k == m]
    if how != "inner":
        want += [(4, a, 1.5, None, None) for a, k in enumerate(lk) if k == 4]
    if how == "outer":
        want += [(5, None, None, b, 2.5) for b, m in enumerate(rk) if m == 5]
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(want, key=repr)
    per_task = joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in per_task) < 60 * 50 / 2  # the pairs of one key are not one task's work


def test_short_series_share_groups(spark):
    from sigtab.plans.fft import fft
    big = 2 ** 60
    keys = [None, *range(big, big + 40)]  # whole numbers that a double cannot hold, next to a null
    draw = np.random.default_rng(7)
    series = {k: draw.normal(size=draw.integers(1, 9)).round(1) for k in keys}
    df = spark.createDataFrame([(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)], "g bigint, i bigint, y double").repartition(3)
    spectra = fft(df, ["g"], "i", "y")
    asks = df.select("g", "i", F.col("i").alias("at"), F.col("y").alias("level"))
    left = nearest_crossing(df, ["g"], "i", "y", asks, "i")
    assert all("FlatMap" in p and ", _g" in p for p in (x._jdf.queryExecution().analyzed().toString() for x in (spectra, left)))
    got = {(r["g"], r["k"]): complex(r["re"], r["im"]) for r in spectra.collect()}
    assert len(got) == sum(map(len, series.values()))
    for g, y in series.items():
        np.testing.assert_allclose([got[g, k] for k in range(len(y))], np.fft.fft(y), atol=1e-12)
    found = {(r["g"], r["i"]): (r["found"], r["span_min"]) for r in left.collect()}
    for g, y in series.items():
        for i, v in enumerate(y):
            j = max((j for j in range(i) if y[j] > v), default=None)
            between = y[(-1 if j is None else j) + 1:i]
            assert found[g, i] == (j, min(between) if len(between) else None)


def test_source_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries
    spark.range(200).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "id * 1.5D AS o_totalprice", "'1995-01-01' AS o_orderdate",
                                "nullif(concat(id % 5, '-PRIO'), '3-PRIO') AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr("catalog.models.scratch", lambda t, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these tables are too small to keep tasks apart
    try:
        assert tuple(queries()["u3_source_files"](spark, str(tmp_path)).first()) == (5, 0, 5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [p.name for p in tmp_path.glob("files/*/part-*.csv")]
    assert len(files) == 5 and len({f[:10] for f in files}) > 1


@pytest.mark.parametrize("sizes", [(30, 70), (70, 30)])
def test_merge_writes_pairs_from_packs(spark, tiny_tasks, monkeypatch, sizes):
    monkeypatch.setattr(joins, "PACK", 3, raising=False)  # the side with fewer rows is packed, here the left one and then the right one
    keys = [0.0, -0.0, None, float("nan")]  # equal keys keep their own sign; rows come twice
    lt = [(keys[i % 4], i // 2, [i // 2, None], {"m": i // 2}) for i in range(sizes[0])] + [(7.5, -1, None, None)] * 2
    rt = [(keys[i % 4], None if i % 5 == 0 else i // 2, (i // 2, "s")) for i in range(sizes[1])] + [(7.5, -2, None)] * 2
    left = spark.createDataFrame(lt, "k double, `a.b` int, l array<int>, m map<string,int>").repartition(3)
    right = spark.createDataFrame(rt, "n double, `c d` int, s struct<x:int,y:string>").repartition(3)
    joined = joins.merge(left, right, "k", "n")
    assert joined.columns == ["k", "a.b", "l", "m", "n", "c d", "s"]
    equal = lambda a, b: a == b or (a != a and b != b)
    want = [Row(*a, *b) for a in left.collect() for b in right.collect() if equal(a[0], b[0])]
    assert sorted(repr(tuple(r)) for r in joined.collect()) == sorted(repr(tuple(r)) for r in want)
    assert "inline(" in joined._jdf.queryExecution().optimizedPlan().toString()  # no join makes a row for each pair


def test_rounding_without_decimals(spark, monkeypatch):
    rng = np.random.default_rng(5)
    far = rng.normal(size=4000) * 10.0 ** rng.integers(-9, 12, 4000)
    halves = (rng.integers(-(10**7), 10**7, 4000) + 0.5) / 10.0 ** rng.integers(0, 13, 4000)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -1e-9, 1.7e308, -1e18, 2.5, -0.5, 1e12, 999999.9999995, 0.285, 1.005]
    values = [*map(float, far), *map(float, halves), *map(float, np.nextafter(halves, np.inf)), *map(float, np.nextafter(halves, -np.inf)), *odd]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for d in (0, 2, 6, 9, 12):
        got, want = common.rounded(df, d), df.select((F.round("v", d) + F.lit(0.0)).alias("v"))
        assert got.schema["v"].dataType == want.schema["v"].dataType
        assert [repr(r.v) for r in got.collect()] == [repr(r.v) for r in want.collect()]
    monkeypatch.setattr(common.F, "round", lambda x, d: F.lit(None).cast("double"))
    plain = df.filter(F.abs("v") < 1e5).filter(F.abs(F.col("v") * 1e6 - F.floor(F.col("v") * 1e6) - 0.5) > 0.01)
    assert plain.count() > 1000 and common.rounded(plain, 6).filter("v IS NULL").count() == 0  # decimals only for what may lie half way
