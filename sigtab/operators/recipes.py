"""Replaying recorded steps on any table, running one analysis over many sources, and user operations."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.operators import clean, fit, rows, signal
from sigtab.plans.layout import join_by

Step = Callable[..., DataFrame]


def _onto(name: str | None, column: str, made: Callable[[str], DataFrame]) -> DataFrame:
    """Write a result under ``name``, or back into the column it came from."""
    if name:
        return made(name)
    out = made("_step")
    return out.withColumn(column, F.col("_step")).drop("_step")


def _missing(df, scope="column", col=None, **_):
    return rows.drop_missing(df, {"any": None, "numeric": "numeric"}.get(scope, col))


STEPS: dict[str, Step] = {
    "fill_missing": lambda df, by, order, col, method="mean", value=None, new_col=None:
        _onto(new_col, col, lambda n: clean.fill_missing(df, col, method, value, by, order, n)),
    "interpolate_missing": lambda df, by, order, col, new_col=None:
        _onto(new_col, col, lambda n: clean.interpolate_missing(df, col, by, order, n)),
    "remove_duplicates": lambda df, by, order, subset=None: rows.drop_duplicates(df, subset or df.columns, order),
    "remove_outliers": lambda df, by, order, col, method="zscore", threshold=None: rows.drop_outliers(df, col, by, method, threshold),
    "normalize_column": lambda df, by, order, col, method="zscore", new_col=None:
        _onto(new_col, col, lambda n: clean.normalize(df, col, method, by, n)),
    "detrend_polynomial": lambda df, by, order, col, degree=1, x_col=None, new_col=None:
        _onto(new_col, col, lambda n: fit.detrend(df, col, degree, x_col, by, order, n)),
    "sort_dataframe": lambda df, by, order, col, ascending=True: clean.sort_rows(df, col, ascending),
    "resample_uniform": lambda df, by, order, x_col, y_cols, n_points=None: clean.resample_uniform(df, x_col, y_cols, n_points, by),
    "remove_missing_rows": lambda df, by, order, **p: _missing(df, **p),
    "crop_range": lambda df, by, order, col, min_value, max_value: rows.crop(df, col, min_value, max_value),
    "butterworth_filter": lambda df, by, order, col, fs, kind="lowpass", cutoff=1.0, degree=4, new_col=None:
        _onto(new_col, col, lambda n: signal.butterworth_filter(df, col, fs, kind, cutoff, degree, by, order, n)),
    "savitzky_golay": lambda df, by, order, col, window=11, degree=3, new_col=None:
        _onto(new_col, col, lambda n: signal.savitzky_golay(df, col, window, degree, by, order, n)),
    "median_filter": lambda df, by, order, col, kernel=5, new_col=None:
        _onto(new_col, col, lambda n: signal.median_filter(df, col, kernel, by, order, n)),
    "gaussian_smooth": lambda df, by, order, col, sigma=2.0, new_col=None:
        _onto(new_col, col, lambda n: signal.gaussian_smooth(df, col, sigma, by, order, n)),
    "apply_window": lambda df, by, order, col, window="hann", beta=14.0, new_col=None:
        _onto(new_col, col, lambda n: signal.taper(df, col, window, beta, by, order, n)),
    "add_moving_average": lambda df, by, order, col, window=25, new_col=None:
        signal.moving_average(df, col, window, by, order, new_col),
}


def replay(df: DataFrame, steps: str | list[dict], by=None, order=None, strict: bool = True) -> DataFrame:
    """Apply recorded steps ``[{"op": name, "params": {…}}, …]``, given as a list or as JSON.

    An unknown step is an error, or is passed over when ``strict`` is false.
    """
    for step in json.loads(steps) if isinstance(steps, str) else steps:
        made = STEPS.get(step["op"]) or _registered(step["op"])
        if made is None:
            if strict:
                raise ValueError(f"unknown step: {step['op']}")
            continue
        df = made(df, by, order, **(step.get("params") or {}))
    return df


# ---- user operations ----
_USER: dict[str, tuple[Callable, dict[str, type]]] = {}


def register(name: str, fn: Callable[..., DataFrame], parameters: dict[str, type] | None = None) -> None:
    """Make ``fn(df, **parameters)`` available to ``run`` and ``replay`` under ``name``."""
    if name in STEPS or name in _USER:
        raise ValueError(f"the name is taken: {name}")
    _USER[name] = fn, dict(parameters or {})


def run(name: str, df: DataFrame, **parameters) -> DataFrame:
    """Run a registered operation after checking its parameters against the declared types."""
    if name not in _USER:
        raise ValueError(f"unknown operation: {name}")
    fn, schema = _USER[name]
    unknown, absent = set(parameters) - set(schema), set(schema) - set(parameters)
    if unknown or absent:
        raise ValueError(f"parameters do not match: unknown {sorted(unknown)}, missing {sorted(absent)}")
    for key, kind in schema.items():
        if not isinstance(parameters[key], kind):
            raise TypeError(f"{key} must be {kind.__name__}")
    return fn(df, **parameters)


def _registered(name: str) -> Step | None:
    if name not in _USER:
        return None
    return lambda df, by, order, **p: run(name, df, **p)


# ---- one analysis over many sources ----

def analyse_sources(df: DataFrame, source: str, analysis: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """One record per source: ``status`` ok or failed, and the results of the analysis as ``metric.*``.

    ``analysis(df, by)`` runs once over all sources together; a source it gives no row for has failed.
    """
    result = analysis(df, [source])
    names = [c for c in result.columns if c != source]
    made = result.select(source, *[F.col(f"`{c}`").alias(f"metric.{c}") for c in names], F.lit(True).alias("_hit"))
    out = join_by(df.select(source).distinct(), made, [source])
    status = F.when(F.col("_hit"), "ok").otherwise("failed")
    return out.select(source, status.alias("status"), *[F.col(f"`metric.{c}`") for c in names])


def count_status(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"),
                       F.count(F.lit(1)).alias("total"))


def with_source(df: DataFrame, name: str = "source") -> DataFrame:
    """Rows of a file table with the path they came from."""
    return df.select("*", F.col("_metadata.file_path").alias(name))
