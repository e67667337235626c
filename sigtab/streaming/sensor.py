"""Live sensor lines: parsing, channel values, moving averages that survive batches, exposure markers.

State is kept per device (and channel) and is bounded: the last few values, or the current marker.
With a watermark, idle keys expire after ``idle``; rows later than it are dropped by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigtab.functions.numeric import any_of, finite
from sigtab.operators.derive import divider_resistance

BAD = "_bad"


def unique_headers(names: list[str]) -> list[str]:
    """Header cells with repeats numbered ``name.1``, ``name.2``."""
    seen: dict[str, int] = {}
    out = []
    for name in (n.strip() for n in names):
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
    return out


def parse_lines(lines: DataFrame, schema: T.StructType, kind: str = "json", value: str = "value") -> DataFrame:
    """Other columns of ``lines`` plus the fields of ``schema``, ``error`` and ``warning``.

    ``error`` says why a line gives no record: malformed, or without any number. ``warning`` names
    JSON fields outside the schema, which are not kept. Blank lines and the CSV header are dropped.
    """
    text = F.trim(F.col(value))
    rows = lines.withColumn("_line", text).filter(F.length("_line") > 0)
    names = [f.name for f in schema.fields]
    numeric = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    keep = [c for c in lines.columns if c != value]
    if kind == "json":
        rows = rows.withColumn("_map", F.from_json("_line", "map<string,string>"))
        rows = rows.withColumn("_rec", F.from_json("_line", schema))
        broken = F.when(F.col("_map").isNull() | ~F.startswith("_line", F.lit("{")), "Invalid JSON")
        extra = F.array_except(F.map_keys("_map"), F.array(*[F.lit(n) for n in names]))
        warning = F.when(F.size(extra) > 0, F.concat(F.lit("ignored field(s): "), F.array_join(extra, ", ")))
    elif kind == "csv":
        rows = rows.filter(F.col("_line") != ",".join(names))
        wide = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))] + [T.StructField(BAD, T.StringType())])
        rows = rows.withColumn("_cells", F.from_csv("_line", wide.simpleString()[7:-1].replace(":", " "), {"columnNameOfCorruptRecord": BAD}))
        cast = lambda i, f: F.when(F.trim(F.col(f"_cells._{i}")) != "", F.col(f"_cells._{i}")).try_cast(f.dataType)
        rows = rows.withColumn("_rec", F.struct(*[cast(i, f).alias(f.name) for i, f in enumerate(schema.fields)]))
        broken = F.when(F.col(f"_cells.{BAD}").isNotNull(), f"CSV row does not have {len(names)} values")
        warning = F.lit(None).cast("string")
    else:
        raise ValueError(f"unknown line kind: {kind}")
    number = any_of([F.col(f"_rec.`{n}`").isNotNull() for n in numeric])
    error = F.coalesce(broken, F.when(~F.coalesce(number, F.lit(False)), "record needs at least one numeric field"))
    return rows.select(*keep, *[F.when(error.isNull(), F.col(f"_rec.`{n}`")).alias(n) for n in names],
                       error.alias("error"), warning.alias("warning"), F.when(error.isNotNull(), F.col("_line")).alias("line"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL").drop("error", "warning", "line")


def rejected(parsed: DataFrame) -> DataFrame:
    keep = [c for c in parsed.columns if c in ("device", "ts", "seq")]
    return parsed.filter("error IS NOT NULL OR warning IS NOT NULL").select(*keep, "line", F.coalesce("error", "warning").alias("reason"))


def channel_values(df: DataFrame, channels: dict[str, dict]) -> DataFrame:
    """Add one column per channel: ``{"output": {"source": column, "divider": {supply, reference, topology}}}``.

    ``source`` may list aliases; the first that exists is used. Every input row is kept.
    """
    out = {}
    for name, spec in channels.items():
        wanted = [spec["source"]] if isinstance(spec["source"], str) else list(spec["source"])
        lower = {c.lower(): c for c in df.columns}
        column = next((lower[w.lower()] for w in wanted if w.lower() in lower), None)
        if column is None:
            raise ValueError(f"no column for channel {name}")
        out[name] = divider_resistance(column, **spec["divider"]) if "divider" in spec else finite(column)
    return df.withColumns(out)


def to_channels(df: DataFrame, device: str, ts: str, seq: str, channels: list[str]) -> DataFrame:
    """Long form ``device, channel, ts, seq, value``."""
    return df.select(F.col(device).cast("string").alias("device"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).cast("bigint").alias("seq"),
                     *[finite(c).alias(c) for c in channels]).unpivot(["device", "ts", "seq"], channels, "channel", "value")


def _rows(batches) -> pd.DataFrame:
    parts = list(batches)
    pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
    order = np.lexsort((pdf["seq"].to_numpy(), pdf["ts"].to_numpy()))
    return pdf.take(order).reset_index(drop=True)


def _linger(state: GroupState, idle_ms: int | None, last) -> None:
    if idle_ms is not None:
        state.setTimeoutTimestamp(int(max(last.timestamp() * 1000, state.getCurrentWatermarkMs())) + idle_ms)


def moving_average(df: DataFrame, window: int, idle_ms: int | None = None) -> DataFrame:
    """``device, channel, ts, seq, value, average`` of a stream in the long form.

    The average is over the last ``window`` values that are not null, across batches. Null values
    pass with a null average and are not counted.
    """
    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _rows(batches)
        kept = np.array(state.get[0] if state.exists else [], float)
        values = pdf["value"].to_numpy(float)
        known = ~np.isnan(values)
        seen = np.concatenate((kept, values[known]))
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(window), seen)), window)[1:]
        means = np.full(len(values), np.nan)
        means[known] = (windows.sum(axis=1) / np.minimum(np.arange(1, len(seen) + 1), window))[len(kept):]
        state.update((seen[-window:].tolist(),))
        _linger(state, idle_ms, pdf["ts"].max())
        pdf["average"] = means  # not a number where the value is null, which Arrow turns into null
        yield pdf[["device", "channel", "ts", "seq", "value", "average"]]

    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy("device", "channel").applyInPandasWithState(
        step, "device string, channel string, ts timestamp, seq bigint, value double, average double", "kept array<double>", "append", timeout)


def moving_average_table(df: DataFrame, window: int) -> DataFrame:
    """The same averages of a finished table."""
    from sigtab.plans.layout import frame
    fr = frame(df.filter("value IS NOT NULL"), ["device", "channel"], ["ts", "seq"], window - 1, 0)
    done = fr.own(fr.df.withColumn("average", F.avg("value").over(fr.window().rowsBetween(-(window - 1), 0))))
    rest = df.filter("value IS NULL").withColumn("average", F.lit(None).cast("double"))
    return done.unionByName(rest)


def exposure_states(readings: DataFrame, markers: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``device, ts, seq, value, gas_state, event``: readings with the state of the last marker.

    ``markers`` holds ``device, ts, seq, state`` (on/off) and ``label``. Events since the previous
    reading are joined with ``;`` on the next one.
    """
    label = F.when(F.trim("label") != "", F.concat(F.lit(":"), F.trim("label"))).otherwise(F.lit(""))
    marks = markers.select("device", "ts", "seq", F.lit(None).cast("double").alias("value"), F.lower("state").alias("mark"),
                           F.concat(F.lit("gas_"), F.lower("state"), label).alias("note"))
    reads = readings.select("device", "ts", "seq", "value", F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("note"))

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _rows(batches)
        now, pending = (state.get[0], list(state.get[1])) if state.exists else ("off", [])
        marked = pdf["mark"].notna()
        before = (~marked).cumsum()  # readings so far
        notes = pdf["note"][marked].groupby(before[marked]).agg(list).to_dict()
        notes[0] = pending + notes.get(0, [])
        reads = pdf[~marked]
        out = reads[["device", "ts", "seq", "value"]].assign(
            gas_state=pdf["mark"].ffill().fillna(now)[~marked], event=[";".join(notes.get(k, [])) for k in range(len(reads))])
        now, pending = (pdf["mark"][marked].iloc[-1] if marked.any() else now), notes.get(len(reads), [])
        state.update((now, pending))
        _linger(state, idle_ms, pdf["ts"].max())
        yield out

    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return reads.unionByName(marks).groupBy("device").applyInPandasWithState(
        step, "device string, ts timestamp, seq bigint, value double, gas_state string, event string",
        "gas_state string, pending array<string>", "append", timeout)


def live_rate(df: DataFrame, device: str, ts: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows and rows per second per device and time window; closed windows only, later rows are dropped."""
    rows = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    t = rows.groupBy(F.window("_ts", every).alias("w"), F.col(device).alias("device")).agg(F.count(F.lit(1)).alias("samples"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return t.select("device", F.col("w.start").alias("start"), "samples", (F.col("samples") / seconds).alias("rate_hz"))


def append_to(df: DataFrame, path: str, checkpoint: str, every: str | None = "200 milliseconds"):
    """Start writing a stream to Parquet, each row once; ``every=None`` drains what is there and stops."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
