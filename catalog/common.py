"""Registration of the check queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, digits: int = 6, floats: str = ""):
    """Register a query. Double columns are rounded in Spark; ``floats`` names those of the SQL."""
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Tables(spark, folder)), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = wrap_sql(sql, floats.split(), digits)
        return fn

    return wrap


def half_up(x: Column, digits: int) -> Column:
    """A double as ``round`` gives it, without going through its decimal digits unless it may lie half way.

    Below 1e12 the scaled value is off by less than 0.00025, so one that is 0.499 or less from a whole number rounds to it,
    and the whole number over the power of ten is the double next to the decimal.
    """
    scaled = x * F.lit(10.0**digits)
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - whole) < 0.499)
    return F.when(clear, whole / F.lit(10.0**digits)).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int) -> DataFrame:
    way = {"double": half_up, "float": F.round}
    return df.select(*[
        (way[f.dataType.typeName()](F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() in way else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def wrap_sql(sql: str, floats: list[str], digits: int) -> str:
    if not floats:
        return sql.strip()
    parts = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in floats)
    return f"SELECT * REPLACE ({parts}) FROM (\n{sql.strip()}\n) AS q"
