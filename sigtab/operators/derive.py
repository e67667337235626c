"""Derived columns: formulas, derivatives, integrals, unit conversion, calibration, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.functions import units
from sigtab.functions.expressions import AGGREGATES, Compiler
from sigtab.functions.numeric import add_all, as_col, div, finite, keys, x_number
from sigtab.plans.layout import frame, lay_out, with_index, with_stats
from sigtab.plans.quantile import medians


def derive(df: DataFrame, name: str, formula: str, by=None, order=None) -> DataFrame:
    """Add ``name`` = ``formula`` over columns; a result that is not finite becomes null.

    Aggregates inside the formula (``mean std var`` with n in the divisor, ``sum min max len``) are
    taken per series and repeated on its rows. ``diff`` and ``integrate`` follow ``order``.
    """
    by, order = keys(by), keys(order)
    columns = list(df.columns)
    state = {"df": df, "helpers": []}

    def column(ref: str) -> Column:
        hit = ref if ref in columns else next((c for c in columns if c.replace(" ", "_") == ref), None)
        if hit is None:
            raise KeyError(f"no such column: {ref}")
        return finite(F.col(f"`{hit}`"))

    def fresh() -> str:
        state["helpers"].append(f"_f{len(state['helpers'])}")
        return state["helpers"][-1]

    def aggregate(kind: str, arg: Column) -> Column:
        out = fresh()
        state["df"] = with_stats(state["df"], by, {out: AGGREGATES[kind](arg)})
        return F.col(out)

    def ordered(kind: str, args: list[Column], options: dict) -> Column:
        if not order:
            raise ValueError(f"{kind} needs an order column")
        y, out = fresh(), fresh()
        state["df"] = state["df"].withColumn(y, args[0])
        spacing = args[1] if len(args) > 1 else options.get("x", options.get("dt", 1.0))
        if isinstance(spacing, Column):
            x = fresh()
            state["df"], spacing = state["df"].withColumn(x, spacing), x
        else:
            spacing = float(spacing)
        if kind == "diff":
            state["df"] = gradient(state["df"], y, spacing, by, order, out)
        else:
            state["df"] = integrate(state["df"], y, spacing, by, order, out, float(options.get("initial", 0.0)))
        return F.col(out)

    value = Compiler(column, aggregate, ordered).compile(formula)
    return state["df"].withColumn(name, finite(value)).drop(*state["helpers"])


def gradient(df: DataFrame, y: str, x: str | float, by, order, name: str = "gradient") -> DataFrame:
    """Central differences weighted for uneven spacing, one-sided at the ends; 0 for a single row."""
    fr = frame(df, keys(by), keys(order), 1, 1)
    w = fr.window()
    before, here, after = F.lag(finite(y)).over(w), finite(y), F.lead(finite(y)).over(w)
    has_before, has_after = F.lag(F.lit(1)).over(w).isNotNull(), F.lead(F.lit(1)).over(w).isNotNull()
    if isinstance(x, str):
        pos = x_number(df, x)
        hs, hd = pos - F.lag(pos).over(w), F.lead(pos).over(w) - pos
    else:
        hs = hd = F.lit(float(x))
    middle = div(hs * hs * after + (hd * hd - hs * hs) * here - hd * hd * before, hs * hd * (hs + hd))
    slope = (
        F.when(has_before & has_after, middle)
        .when(has_after, div(after - here, hd))
        .when(has_before, div(here - before, hs))
        .otherwise(F.lit(0.0))
    )
    return fr.own(fr.df.withColumn(name, slope))


def integrate(df: DataFrame, y: str, x: str | float, by, order, name: str = "integral",
              initial: float = 0.0) -> DataFrame:
    """Cumulative trapezoid along ``order``, starting at ``initial``."""
    by, order = keys(by), keys(order)
    fr = frame(df, by, order, 1, 0)
    w = fr.window()
    here, before = finite(y), F.lag(finite(y)).over(w)
    if isinstance(x, str):
        pos = x_number(df, x)
        step = pos - F.lag(pos).over(w)
    else:
        step = F.lit(float(x))
    part = F.when(F.lag(F.lit(1)).over(w).isNull(), F.lit(0.0)).otherwise((here + before) / 2 * step)
    stepped = fr.own(fr.df.withColumn("_area", part))
    lay = lay_out(stepped, by, order)
    summed = lay.done(lay.scan({name: ("sum", "_area"), "_lost": ("max", F.col("_area").isNull().cast("int"))}))
    kept = F.when(F.col("_lost") == 0, F.col(name) + F.lit(initial))
    return summed.withColumn(name, kept).drop("_area", "_lost")


def magnitude(*columns) -> Column:
    """Length of a vector given by its components."""
    return F.sqrt(add_all([finite(c) * finite(c) for c in columns]))


def to_local_time(column, zone: str = "Asia/Bangkok") -> Column:
    """A UTC timestamp as wall-clock time of ``zone``."""
    return F.from_utc_timestamp(as_col(column), zone)


def convert_units(df: DataFrame, column: str, source: str, target: str, name: str | None = None) -> DataFrame:
    name = name or f"{column} ({target})"
    return df.withColumn(name, units.convert(finite(F.col(f"`{column}`")), source, target))


def convert_table_units(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Convert each column whose name states a unit of a listed dimension; names are rewritten.

    ``targets`` maps a dimension to the wanted unit, for example ``{"voltage": "V"}``.
    """
    out = []
    for c in df.columns:
        unit = units.guess_unit(c)
        wanted = targets.get(units.dimension_of(unit)) if unit else None
        if wanted and wanted != unit:
            out.append(units.convert(finite(F.col(f"`{c}`")), unit, wanted).alias(c.replace(unit, wanted)))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def two_point_calibration(raw1, true1, raw2, true2) -> tuple[Column, Column]:
    """Slope and offset of the line through two reference readings; null when both raws agree."""
    raw1, true1, raw2, true2 = (as_col(c) if not isinstance(c, (int, float)) else F.lit(float(c))
                                for c in (raw1, true1, raw2, true2))
    a = div(true2 - true1, raw2 - raw1)
    return a, true1 - a * raw1


def calibrate(df: DataFrame, column: str, table: DataFrame, on: list[str], source: str, target: str,
              name: str = "calibrated") -> DataFrame:
    """Apply per-sensor two-point calibrations (``raw1 true1 raw2 true2``) and convert units."""
    a, b = two_point_calibration("raw1", "true1", "raw2", "true2")
    lines = table.select(*on, a.alias("_a"), b.alias("_o"))
    value = units.convert(F.col("_a") * finite(column) + F.col("_o"), source, target)
    return df.join(lines, on, "left").withColumn(name, value).drop("_a", "_o")


def seconds_from_start(df: DataFrame, time: str, by=None, name: str = "elapsed_s") -> DataFrame:
    out = with_stats(df, keys(by), {"_t0": F.min(F.col(time))})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.withColumn(name, (micros(time) - micros("_t0")) / F.lit(1e6)).drop("_t0")


def row_index(df: DataFrame, by, order, name: str = "row_index") -> DataFrame:
    """0-based position of a row in its series."""
    return with_index(df, keys(by), keys(order), name)


def sampling_rate(df: DataFrame, x: str, by=None) -> DataFrame:
    """One row per series: 1 / median step of ``x`` (seconds for timestamps); null when not positive."""
    by = keys(by)
    rows = df.select(*by, x_number(df, x).alias("_x")).filter(F.col("_x").isNotNull())
    fr = frame(rows, by, ["_x"], 1, 0)
    steps = fr.own(fr.df.withColumn("_dx", F.col("_x") - F.lag("_x").over(fr.window())))
    mid = medians(steps, by, {"_m": "_dx"})
    return mid.select(*by, F.when(F.col("_m") > 0, div(F.lit(1.0), F.col("_m"))).alias("fs_hz"))


def divider_resistance(voltage, supply: float, reference: float, topology: str = "sensor_low") -> Column:
    """Sensor resistance from the voltage of a divider; null outside the open supply range."""
    v = finite(voltage)
    inside = (v > 0) & (v < supply)
    if topology == "sensor_high":
        r = F.lit(reference) * (F.lit(supply) / F.when(v > 0, v) - 1)
    else:
        r = F.lit(reference) * v / F.when(v < supply, F.lit(supply) - v)
    r = finite(r)
    return F.when(inside & (r >= 0), r)
