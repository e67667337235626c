"""Ordered work on tables of any size, without a window over one unbounded group.

A series (one value of the ``by`` keys, or the whole table when ``by`` is empty) is an ordinary
window partition while it has at most ``rows_per_task`` rows. Longer series are cut into
consecutive ranges of the order key; windows then run per (series, range) and what crosses a range
border is carried by a small per-range table. The cuts come from a hash sample of the order key,
so every evaluation of the plan puts a row into the same range.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.functions.numeric import all_of, as_col

ROWS_PER_TASK = 1_000_000
MAX_RANGES = 8192
SAMPLE_PER_RANGE = 64
BROADCAST_SERIES = 50_000  # a table with one row per series is broadcast up to this many series


def rows_per_task(spark: SparkSession) -> int:
    """Largest ordered group one task may hold; set ``spark.sigtab.rowsPerTask`` to change it."""
    return int(spark.conf.get("spark.sigtab.rowsPerTask", str(ROWS_PER_TASK)))


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Join on the series keys, null matching null, keeping the left keys only."""
    renamed = right.select(
        *[F.col(f"`{k}`").alias(f"_r_{k}") if k in by else F.col(f"`{k}`") for k in right.columns]
    )
    cond = all_of([F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in by])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in by])


def with_stats(df: DataFrame, by: list[str], aggs: dict[str, Column]) -> DataFrame:
    """``df`` plus per-series aggregates on every row.

    Aggregated with map-side combine and joined back, so a series that holds much of the table
    never meets in one task. Without keys the one aggregate row is joined to every row.
    """
    table = df.groupBy(*by).agg(*[v.alias(k) for k, v in aggs.items()])
    return join_by(df, table, by) if by else with_table(df, table, by)


def with_table(df: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``df`` plus the columns of a table with one row per series (without keys: with one row)."""
    if by:
        return join_by(df, table, by)
    names = list(table.columns)
    one = table.select(*[F.col(f"`{k}`").alias(f"_s_{i}") for i, k in enumerate(names)])
    kept = [F.col(f"`{c}`") for c in df.columns]
    # one row by construction, so it is broadcast; a scalar subquery instead breaks when several are stacked
    return df.join(F.broadcast(one), F.lit(True), "left").select(*kept, *[F.col(f"_s_{i}").alias(k) for i, k in enumerate(names)])


def _key_field(df: DataFrame, name: str) -> tuple[Column, str]:
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col.cast("timestamp")), "bigint"
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return col.cast("double"), "double"
    if isinstance(kind, T.IntegralType):
        return col.cast("bigint"), "bigint"
    return col.cast("string"), "string"


def order_key(df: DataFrame, order: list[str]) -> tuple[Column, str]:
    """The order columns as one comparable struct, and its DDL type."""
    parts = [_key_field(df, name) for name in order]
    key = F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(parts)])
    ddl = "struct<" + ",".join(f"k{i}:{t}" for i, (_, t) in enumerate(parts)) + ">"
    return key, ddl


def range_of(key: Column, ddl: str, cuts: list[dict]) -> Column:
    """Number of cuts at or below ``key``, by binary search in a literal array."""
    table = F.from_json(F.lit(json.dumps(cuts)), f"array<{ddl}>", {"allowNonNumericNumbers": "true"})
    n = len(cuts)
    steps = [1 << p for p in range(int(math.log2(n)), -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= n) & (F.get(table, at + s - 1) <= key), at + s
        ).otherwise(at),
    )


@dataclass
class Layout:
    """Rows with the columns windows must be partitioned by. ``parts`` is ``by`` or ``by + [_b]``."""

    df: DataFrame
    by: list[str]
    order: list[str]
    split: bool = False
    limit: int = ROWS_PER_TASK
    temp: list[str] = field(default_factory=list)

    @property
    def parts(self) -> list[str]:
        return self.by + (["_b"] if self.split else [])

    def window(self):
        return Window.partitionBy(*[F.col(f"`{c}`") for c in self.parts]).orderBy(
            *[F.col(f"`{c}`").asc_nulls_first() for c in self.order]
        )

    def scan(self, specs: dict[str, tuple]) -> DataFrame:
        """Add ordered running columns. ``specs`` maps a name to one of

        ``("index",)`` 0-based position, ``("sum", e)``, ``("max", e)``, ``("min", e)`` running
        totals up to and with the row, ``("last", e)`` last non-null at or before the row,
        ``("next", e)`` first non-null at or after it, ``("rmin", e)`` minimum from the row on.
        """
        w = self.window()
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # looking ahead runs over the reversed order: a frame that ends at the last row costs n² in Spark
        onward = Window.partitionBy(*[F.col(f"`{c}`") for c in self.parts]).orderBy(
            *[F.col(f"`{c}`").desc_nulls_last() for c in self.order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local, partial, cross = {}, {}, {}
        if self.split:
            carry_w = Window.partitionBy(*[F.col(f"`{c}`") for c in self.by]).orderBy("_b")
            before = carry_w.rowsBetween(Window.unboundedPreceding, -1)
            after = Window.partitionBy(*[F.col(f"`{c}`") for c in self.by]).orderBy(F.desc("_b")).rowsBetween(
                Window.unboundedPreceding, -1)
            key, _ = order_key(self.df, self.order)
        for name, spec in specs.items():
            kind = spec[0]
            e = as_col(spec[1]) if len(spec) > 1 else None
            if kind == "index":
                local[name] = (F.row_number().over(w) - 1).cast("bigint")
                p, c = F.count(F.lit(1)), lambda col: F.sum(col).over(before)
            elif kind == "sum":
                local[name] = F.sum(e).over(upto)
                p, c = F.sum(e), lambda col: F.sum(col).over(before)
            elif kind == "max":
                local[name] = F.max(e).over(upto)
                p, c = F.max(e), lambda col: F.max(col).over(before)
            elif kind == "min":
                local[name] = F.min(e).over(upto)
                p, c = F.min(e), lambda col: F.min(col).over(before)
            elif kind == "rmin":
                local[name] = F.min(e).over(onward)
                p, c = F.min(e), lambda col: F.min(col).over(after)
            elif kind == "last":
                local[name] = F.last(e, ignorenulls=True).over(upto)
                p = F.max_by(e, F.when(e.isNotNull(), key)) if self.split else None
                c = lambda col: F.last(col, ignorenulls=True).over(before)
            elif kind == "next":
                local[name] = F.last(e, ignorenulls=True).over(onward)
                p = F.min_by(e, F.when(e.isNotNull(), key)) if self.split else None
                c = lambda col: F.last(col, ignorenulls=True).over(after)
            else:
                raise ValueError(f"unknown scan kind: {kind}")
            partial[name], cross[name] = p, c
        out = self.df.select("*", *[c.alias(n) for n, c in local.items()])
        if not self.split:
            return out
        totals = self.df.groupBy(*self.parts).agg(*[p.alias(f"_c_{n}") for n, p in partial.items()])
        carry = totals.select(*self.parts, *[cross[n](F.col(f"_c_{n}")).alias(f"_x_{n}") for n in specs])
        out = join_by(out, carry, self.parts)
        merged = {}
        for name, spec in specs.items():
            a, b = F.col(f"`{name}`"), F.col(f"`_x_{name}`")
            kind = spec[0]
            if kind == "index":
                merged[name] = a + F.coalesce(b, F.lit(0))
            elif kind == "sum":
                merged[name] = F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))
            elif kind == "max":
                merged[name] = F.greatest(a, b)
            elif kind in ("min", "rmin"):
                merged[name] = F.least(a, b)
            else:
                merged[name] = F.coalesce(a, b)
        return out.withColumns(merged).drop(*[f"_x_{n}" for n in specs])

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop("_b", *self.temp)


def lay_out(df: DataFrame, by: list[str], order: list[str], limit: int | None = None) -> Layout:
    """Find series too long for one task and cut them into ranges of ``order``.

    Runs a count, a per-key count when the table is larger than one task, and one sample scan
    when there is a long series. ``order`` must identify a row within its series.
    """
    limit = limit or rows_per_task(df.sparkSession)
    n = df.count()
    if n <= limit:
        return Layout(df, by, order, limit=limit)
    limit_now = max(limit, math.ceil(n / MAX_RANGES))
    hot_rows, flagged = n, df.withColumn("_hot", F.lit(True))
    if by:
        # at most n / limit <= MAX_RANGES keys can be this long, so the table is small by construction
        hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit_now)
        found = hot.collect()
        if not found:
            return Layout(df, by, order, limit=limit_now)
        hot_rows = sum(r["_n"] for r in found)
        keys = df.sparkSession.createDataFrame(found, hot.schema).drop("_n").withColumn("_hot", F.lit(True))
        flagged = join_by(df, F.broadcast(keys), by)
    ranges = min(MAX_RANGES, math.ceil(hot_rows / limit_now))
    key, ddl = order_key(df, order)
    every = max(1, hot_rows // (ranges * SAMPLE_PER_RANGE))
    sample = (
        flagged.filter("_hot")
        .select(key.alias("k"))
        .filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
        .sort("k")
        .collect()
    )
    picks = [sample[len(sample) * i // ranges]["k"].asDict() for i in range(1, ranges)] if sample else []
    cuts = [c for i, c in enumerate(picks) if i == 0 or c != picks[i - 1]]
    if not cuts:
        return Layout(df, by, order, limit=limit_now)
    bucket = F.when(F.col("_hot"), range_of(key, ddl, cuts)).otherwise(F.lit(0))
    return Layout(flagged.withColumn("_b", bucket).drop("_hot"), by, order, split=True, limit=limit_now)


@dataclass
class Frame:
    """Rows set up for windows that look a bounded number of rows back and ahead."""

    df: DataFrame
    parts: list[str]
    order: list[str]
    split: bool

    def window(self):
        return Window.partitionBy(*[F.col(f"`{c}`") for c in self.parts]).orderBy(
            *[F.col(f"`{c}`").asc_nulls_first() for c in self.order]
        )

    def own(self, df: DataFrame) -> DataFrame:
        """Drop the border rows lent to neighbouring chunks and the helper columns."""
        return df.filter("_own").drop("_own", "_c", "_i") if self.split else df


def frame(df: DataFrame, by: list[str], order: list[str], before: int, after: int,
          limit: int | None = None) -> Frame:
    """Chunks of consecutive rows, each with ``before``/``after`` border rows of its neighbours."""
    lay = lay_out(df, by, order, limit)
    if not lay.split:
        return Frame(lay.df, by, order, False)
    size = max(lay.limit, before, after)
    indexed = lay.done(lay.scan({"_i": ("index",)}))
    return Frame(lend_borders(indexed, size, before, after), by + ["_c"], ["_i"], True)


def lend_borders(indexed: DataFrame, size: int, before: int, after: int, index: str = "_i") -> DataFrame:
    """Explode each row to its chunk and, near a border, to the neighbour that needs it."""
    home = F.floor(F.col(index) / size).cast("bigint")
    at = F.col(index) - home * size
    targets = F.array(
        home,
        F.when((at < after) & (home > 0), home - 1),
        F.when(at >= size - before, home + 1),
    )
    return (
        indexed.withColumn("_home", home)
        .withColumn("_c", F.explode(F.filter(targets, lambda t: t.isNotNull())))
        .withColumn("_own", F.col("_c") == F.col("_home"))
        .drop("_home")
    )


def with_index(df: DataFrame, by: list[str], order: list[str], name: str = "row_index") -> DataFrame:
    lay = lay_out(df, by, order)
    return lay.done(lay.scan({name: ("index",)}))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``; only a local master may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="sigtab-")
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so long loops do not replay their history."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
