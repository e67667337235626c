"""Many short series in one group, so that the work of a group grows with rows and not with series."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_of(parts: list[str], n: int, limit: int) -> Column:
    """Number of the batch of a series, for batches of about a sixteenth of the ``limit`` of one task; ``n`` is the number of rows."""
    if not parts:
        return F.lit(0)
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in parts]), F.lit(max(1, math.ceil(16 * n / limit)))).cast("int")


def series_of(parts: list[str], *tables: pa.Table) -> list[np.ndarray]:
    """For each table the number of every row's series; rows with equal keys (null equals null) have equal numbers."""
    code = np.zeros(sum(t.num_rows for t in tables), np.int64)
    for k in parts:
        kind = tables[0][k].type
        col = pa.chunked_array([c for t in tables for c in t[k].cast(kind).chunks], kind).combine_chunks()
        if pa.types.is_floating(col.type):
            col = pc.add(col, pa.scalar(0.0, col.type))  # one zero
        if pa.types.is_nested(col.type):
            col = pa.array([repr(v) for v in col.to_pylist()])
        one = pc.dictionary_encode(col, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (one.max(initial=0) + 1) + one, return_inverse=True)[1].reshape(-1)
    return np.split(code, np.cumsum([t.num_rows for t in tables])[:-1])


def numbers(table: pa.Table, name: str, kind=float) -> np.ndarray:
    return table[name].to_numpy().astype(kind, copy=False)
