"""Lines that do not fit their table."""

from sigtab.sources import tables as src


def test_short_and_long_lines_are_rejected(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text("a,b,c\n1,x,2\n3,y\n4,z,5,6\n7,w,8\n")
    for schema in (None, "a double, b string, c double"):
        good, bad = src.split_table(spark, path, schema=schema)
        assert sorted(r["line"] for r in bad.collect()) == ["3,y", "4,z,5,6"] and bad.count() == 2
        assert good.count() == 2
        for column, want in (("a", [1, 7]), ("b", ["w", "x"]), ("c", [2, 8])):
            assert sorted(r[0] for r in good.select(column).collect()) == want
            assert sorted(r[0] for r in src.read_table(spark, path, schema=schema).select(column).collect()) == want
    (tmp_path / "b.csv").write_text("n,t\n1,x\nq,y\n2,z\n")
    good, bad = src.split_table(spark, str(tmp_path / "b.csv"), schema="n int, t string")
    assert sorted(r["t"] for r in good.select("t").collect()) == ["x", "z"] and [r["line"] for r in bad.collect()] == ["q,y"]
