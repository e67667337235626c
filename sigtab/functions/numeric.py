"""Number handling shared by every operator: coercion and the missing-value rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def finite(c) -> Column:
    """The value when it is a finite number, else null (NaN and infinities count as missing)."""
    c = as_col(c).try_cast("double")
    return F.when(F.abs(c) < F.lit(INF), c)


def not_nan(c) -> Column:
    """NaN becomes null; infinities stay (the rule of the cleaning operators)."""
    c = as_col(c).try_cast("double")
    return F.when(~F.isnan(c), c)


def div(a, b) -> Column:
    """a / b with null where b is 0, in ANSI mode too."""
    b = as_col(b) if not isinstance(b, (int, float)) else F.lit(b)
    a = as_col(a) if not isinstance(a, (int, float)) else F.lit(a)
    return a / F.when(b != 0, b)


def all_of(conditions) -> Column:
    return reduce(lambda p, q: p & q, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda p, q: p | q, conditions, F.lit(False))


def add_all(columns) -> Column:
    return reduce(lambda p, q: p + q, columns)


def seconds(c) -> Column:
    """A timestamp as seconds since the epoch; numbers pass through."""
    return F.unix_micros(as_col(c).cast("timestamp")) / F.lit(1e6)


def x_number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double: timestamps and dates in seconds, numbers as they are."""
    kind = df.schema[name].dataType.typeName()
    return seconds(name) if kind in ("timestamp", "timestamp_ntz", "date") else finite(name)


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = {"double", "float", "integer", "long", "short", "byte", "decimal"}
    return [f.name for f in df.schema.fields if f.dataType.typeName().split("(")[0] in kinds]


def keys(names) -> list[str]:
    """A column name, a sequence of names or None as a list."""
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)
