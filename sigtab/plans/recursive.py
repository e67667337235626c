"""Recursive filters over series of any length: an associative scan of filter states.

A chunk of consecutive rows turns the state at its start into the state at its end by a matrix power and a vector. These pairs, one
small row for each chunk, are composed in order; so every chunk learns its true start without looking at other chunks' rows,
however long the filter remembers. The backward run is scanned the same way from the last chunk on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.functions import filters
from sigtab.functions.numeric import finite
from sigtab.plans.layout import cut_lineage, lay_out, with_stats


def _extended(v: np.ndarray, pad: int, first: bool, last: bool) -> tuple[np.ndarray, int, int]:
    """Values with the odd extension at the ends of the series, and its lengths."""
    before, after = (pad if first else 0), (pad if last else 0)
    head = 2 * v[0] - v[before:0:-1] if before else v[:0]
    tail = 2 * v[-1] - v[-2: -after - 2: -1] if after else v[:0]
    return np.concatenate([head, v, tail]), before, after


def _composed(pdf: pd.DataFrame, step: np.ndarray) -> list[list[float]]:
    """The state at the start of each chunk, from lengths and end states in order; the first chunk starts by itself."""
    states, x = [], np.zeros(len(step))
    for length, end in zip(pdf["_len"], pdf["_end"]):
        states.append(x.tolist())
        x = np.linalg.matrix_power(step, int(length)) @ x + np.asarray(end, float)
    return states


def zero_phase(df: DataFrame, y: str, by: list[str], order: list[str], b: np.ndarray, a: np.ndarray, pad: int, name: str) -> DataFrame:
    """Add ``name``: the filter run forwards and backwards over the oddly extended series. Rows without a finite value are left out.

    A series of one task's rows is filtered whole; a longer one in chunks that exchange states only.
    """
    rows = df.filter(finite(y).isNotNull())
    lay = lay_out(rows, by, order)
    if not lay.split:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
            pdf[name] = filters.zero_phase(b, a, pdf[y].to_numpy(float), pad)
            return pdf

        return lay.df.groupBy(*by).applyInPandas(whole, T.StructType([*lay.df.schema.fields, T.StructField(name, T.DoubleType())]))

    size = max(lay.limit, pad + 1)
    work = with_stats(lay.done(lay.scan({"_i": ("index",)})), by, {"_n": F.count(F.lit(1))})
    top = F.greatest(F.lit(0), F.floor(F.col("_n") / size) - 1)  # the last chunk holds between one and two sizes
    work = cut_lineage(work.withColumn("_c", F.least(F.floor(F.col("_i") / size), top).cast("bigint")))
    values = F.transform(F.sort_array(F.collect_list(F.struct("_i", finite(y).alias("v")))), lambda p: p["v"])
    chunks = cut_lineage(work.groupBy(*by, "_c").agg(F.first("_n").alias("_n"), values.alias("_v")))
    step, rest = filters.step_matrix(b, a), filters.rest_state(b, a)
    key = T.StructType([work.schema[c] for c in [*by, "_c"]])
    pair = T.StructType([*key.fields, T.StructField("_len", T.LongType()), T.StructField("_end", T.ArrayType(T.DoubleType()))])

    def last_of(n: int) -> int:
        return max(0, n // size - 1)

    def forward(v: np.ndarray, c: int, n: int, x):
        u, before, after = _extended(v, min(pad, n - 1), c == 0, c == last_of(n))
        out, end = filters.recurse(b, a, u, rest * u[0] if c == 0 else x)
        return out, end, before, after

    def backward(out: np.ndarray, c: int, n: int, x):
        turned = out[::-1]
        done, end = filters.recurse(b, a, turned, rest * turned[0] if c == last_of(n) else x)
        return done[::-1], end

    def ends(pdf: pd.DataFrame, states) -> pd.DataFrame:
        got = []
        for i, (c, n, v) in enumerate(zip(pdf["_c"], pdf["_n"], pdf["_v"])):
            x = np.zeros(len(step)) if states is None else np.asarray(states.iloc[i], float)
            out, end, _, _ = forward(np.asarray(v, float), c, n, x)
            if states is not None:
                end = backward(out, c, n, np.zeros(len(step)))[1]
            got.append((len(out), end.tolist()))
        made = pdf[[*by, "_c"]].copy()
        made["_len"], made["_end"] = [g[0] for g in got], [g[1] for g in got]
        return made

    def first_ends(batches):
        for pdf in batches:
            yield ends(pdf, None)

    def second_ends(batches):
        for pdf in batches:
            yield ends(pdf, pdf["_x"])

    def composed(state: str, falling: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_c", ascending=not falling)
            out = pdf[[*by, "_c"]].copy()
            out[state] = _composed(pdf, step)
            return out

        return run

    def states_of(parts: DataFrame, state: str, falling: bool) -> DataFrame:  # a row for each chunk
        return cut_lineage(parts.groupBy(*by).applyInPandas(composed(state, falling), T.StructType([*key.fields, T.StructField(state, T.ArrayType(T.DoubleType()))])))

    def with_state(left: DataFrame, states: DataFrame, state: str) -> DataFrame:
        right = states.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in [*by, "_c"]], state)
        same = F.lit(True)
        for k in [*by, "_c"]:
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
        return left.join(right, same).drop(*[f"_r_{k}" for k in [*by, "_c"]])

    ahead = states_of(chunks.mapInPandas(first_ends, pair), "_x", False)
    back = states_of(with_state(chunks, ahead, "_x").mapInPandas(second_ends, pair), "_z", True)
    both = with_state(ahead, back, "_z")

    def finish(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i").reset_index(drop=True)
        c, n = int(pdf["_c"].iloc[0]), int(pdf["_n"].iloc[0])
        out, _, before, after = forward(pdf[y].to_numpy(float), c, n, np.asarray(states["_x"].iloc[0], float))
        done, _ = backward(out, c, n, np.asarray(states["_z"].iloc[0], float))
        pdf[name] = done[before: len(done) - after]
        return pdf

    grouped = work.groupBy(*by, "_c").cogroup(both.groupBy(*by, "_c"))
    return grouped.applyInPandas(finish, T.StructType([*work.schema.fields, T.StructField(name, T.DoubleType())])).drop("_i", "_n", "_c")
