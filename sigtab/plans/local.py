"""Ordered array functions with a bounded reach, run on chunks of consecutive rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtab.functions.numeric import finite
from sigtab.plans.layout import frame, with_stats


def apply_local(df: DataFrame, y: str, by: list[str], order: list[str], reach: int,
                fn: Callable[[np.ndarray, bool, bool], np.ndarray], name: str, kind=None) -> DataFrame:
    """Add ``name`` = ``fn(values, starts_series, ends_series)`` where a value depends on rows within ``reach``.

    A series of up to one task's rows is passed whole; a longer one in chunks with ``reach`` border
    rows from the neighbours. Rows without a finite value are left out.
    """
    rows = df.filter(finite(y).isNotNull())
    fr = frame(rows, by, order, reach, reach)
    work = fr.df
    if fr.split:
        work = with_stats(work, by, {"_last": F.max("_i")})
    schema = T.StructType(work.schema.fields + [T.StructField(name, kind or T.DoubleType())])
    sort, split = list(fr.order), fr.split

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(sort, kind="stable").reset_index(drop=True)
        first = not split or pdf["_i"].iloc[0] == 0
        last = not split or pdf["_i"].iloc[-1] == pdf["_last"].iloc[0]
        out = fn(pdf[y].to_numpy(float), bool(first), bool(last))
        pdf[name] = list(out) if getattr(out, "ndim", 1) > 1 else out
        return pdf

    done = work.groupBy(*fr.parts).applyInPandas(run, schema)
    return fr.own(done.drop("_last") if split else done)


def correlate(values: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Sum of taps times consecutive values, for every full position; by FFT when the taps are long."""
    if len(taps) < 128 or len(values) < 1024:
        return np.correlate(values, taps, "valid")
    size = 1 << int(np.ceil(np.log2(len(values) + len(taps))))
    full = np.fft.irfft(np.fft.rfft(values, size) * np.fft.rfft(taps[::-1], size), size)
    return full[len(taps) - 1: len(values)]


PAD = {"zero": "constant", "reflect": "symmetric", "nearest": "edge"}


def fir(df: DataFrame, y: str, by: list[str], order: list[str], taps: np.ndarray, before: int, mode: str,
        name: str) -> DataFrame:
    """out[i] = sum taps[k] * y[i - before + k], with the given extension at the ends of the series."""
    taps = np.asarray(taps, float)
    after = len(taps) - 1 - before

    def run(v: np.ndarray, first: bool, last: bool) -> np.ndarray:
        # chunk borders inside a series only touch lent rows, so any extension serves there
        return correlate(np.pad(v, (before, after), mode=PAD[mode]), taps)

    return apply_local(df, y, by, order, max(before, after), run, name)
