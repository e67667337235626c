import __spark_entry__ as entry


def test_flagship_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "f_statistic" in df.columns
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 200
