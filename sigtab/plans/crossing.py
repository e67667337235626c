"""Nearest row beyond a level, for many levels at once, on series of any length.

Rows are cut into chunks of consecutive positions. A search ends inside its own chunk, or is sent
to the one other chunk that a table of chunk maxima names. No chunk is larger than one task, and
many short ones share a group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.plans.batches import batch_of, numbers, series_of
from sigtab.plans.layout import join_by, rows_per_task, with_table


def _search(y: np.ndarray, fresh: np.ndarray, at: np.ndarray, begin: np.ndarray, level: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each query the last position before ``at`` above its level, and the minimum from there to ``at``.

    Position -1 when there is none; the minimum then reaches to the start. ``fresh`` marks the first position of each
    series, ``begin`` is that of the query's series.
    """
    found, low = np.full(len(at), -1), np.full(len(at), np.inf)
    y, fresh, ends, begins, levels = y.tolist(), fresh.tolist(), at.tolist(), begin.tolist(), level.tolist()
    # positions with falling values, the negated values, and the minimum since the position before
    stack, negative, least, i = [], [], [], 0
    for q in np.argsort(at, kind="stable").tolist():
        end = ends[q]
        if end == begins[q]:
            continue
        i = max(i, begins[q])
        while i < end:
            if fresh[i]:
                stack, negative, least = [], [], []
            lowest = v = y[i]
            while stack and negative[-1] >= -v:
                stack.pop()
                negative.pop()
                lowest = min(lowest, least.pop())
            stack.append(i)
            negative.append(-v)
            least.append(lowest)
            i += 1
        k = (bisect_left if strict else bisect_right)(negative, -levels[q])
        if k:
            found[q] = stack[k - 1]
        low[q] = min(least[k:], default=np.inf)
    return found, low


def nearest_crossing(rows: DataFrame, by: list[str], index: str, value: str, queries: DataFrame, query_id: str,
                     strict: bool = True, side: str = "left", limit: int | None = None) -> DataFrame:
    """``queries`` (``by``, ``query_id``, ``at``, ``level``) with ``found`` and ``span_min``.

    ``found`` is the nearest ``index`` to the left (right) of ``at`` whose value is above ``level``
    (at or above unless ``strict``), null when there is none. ``span_min`` is the smallest value
    strictly between ``found`` and ``at``, null when nothing lies between.
    """
    size = limit or rows_per_task(rows.sparkSession)
    left = side == "left"
    chunk = lambda c: F.floor(F.col(c) / size).cast("bigint")
    # fresh column identities, so results can be joined to the same table several times
    fresh = [F.col(k).alias(k) for k in by]
    data = rows.select(*fresh, F.col(index).alias("_i"), F.col(value).cast("double").alias("_v"), chunk(index).alias("_c"))
    asks = queries.select(*fresh, F.col(query_id).alias("_q"), F.col("at").cast("bigint").alias("_at"),
                          F.col("level").cast("double").alias("_l"), chunk("at").alias("_c"))
    head = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in by)
    qtype = queries.schema[query_id].dataType.simpleString()
    schema = f"{head}_q {qtype}, _at bigint, _l double, _c bigint, found bigint, span_min double"

    def inside(whole: bool):
        def run(data: pa.Table, asks: pa.Table) -> pa.Table:
            series, asked = series_of(keys, data, asks)
            # a chunk's rows stay together, in order, and places within it are below its size
            place = series * size + numbers(data, "_i", np.int64) % size
            order = np.argsort(place, kind="stable")
            place, pos, y = place[order], numbers(data, "_i", np.int64)[order], numbers(data, "_v")[order]
            y = np.where(np.isnan(y), -np.inf, y)
            fresh = np.diff(series[order], prepend=-1) != 0
            begin, end = np.searchsorted(place, asked * size), np.searchsorted(place, (asked + 1) * size)
            if not left:
                begin, end = len(y) - end, len(y) - begin
                fresh = np.append(fresh[1:], True)[::-1] if len(y) else fresh
            if whole:
                at = end
            else:
                at = np.searchsorted(place, asked * size + numbers(asks, "_at", np.int64) % size, "left" if left else "right")
                at = at if left else len(y) - at
            seq, where = (y, pos) if left else (y[::-1], pos[::-1])
            found, low = _search(seq, fresh, at, begin, numbers(asks, "_l"), strict)
            hit = found >= 0
            rows_hit = np.append(where, 0)[found]
            return pa.table([*asks.select(out).columns, pa.array(rows_hit, mask=~hit), pa.array(low, mask=~np.isfinite(low))],
                            names=[*out, "found", "span_min"])
        return run

    keys, out = by + ["_c"], [*by, "_q", "_at", "_l", "_c"]
    top, n = rows.agg(F.max(index), F.count(F.lit(1))).first()
    batch = batch_of(keys, n, size)

    def search(asks: DataFrame, whole: bool) -> DataFrame:
        both = data.withColumn("_g", batch).groupBy("_g").cogroup(asks.withColumn("_g", batch).groupBy("_g"))
        return both.applyInArrow(inside(whole), schema)

    first = search(asks, False)
    open_ones = first.filter(F.col("found").isNull())
    if (top or 0) < size:
        return _named(first, by, queries, query_id)
    # only series of several chunks need the table, so it has at most 2 n / size rows
    others = data.groupBy(*keys).agg(F.max("_v").alias("_hi"), F.min("_v").alias("_lo"))
    several = others.groupBy(*by).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    others = join_by(others, several, by, "inner") if by else others
    cells = others.groupBy(*by).agg(F.collect_list(F.struct("_c", "_hi", "_lo")).alias("_chunks"))
    link = with_table(open_ones, cells, by)
    beyond = (lambda s: s["_c"] < F.col("_c")) if left else (lambda s: s["_c"] > F.col("_c"))
    above = (lambda s: s["_hi"] > F.col("_l")) if strict else (lambda s: s["_hi"] >= F.col("_l"))
    hits = F.transform(F.filter(F.filter("_chunks", beyond), above), lambda s: s["_c"])
    link = link.withColumn("_tc", F.array_max(hits) if left else F.array_min(hits))
    nearer = (lambda s: s["_c"] > F.col("_tc")) if left else (lambda s: s["_c"] < F.col("_tc"))
    between = F.filter(F.filter("_chunks", beyond), lambda s: F.col("_tc").isNull() | nearer(s))
    target = link.select(*by, "_q", "_at", "_l", "_c", F.col("span_min").alias("_own"), "_tc",
                         F.array_min(F.transform(between, lambda s: s["_lo"])).alias("_mid"))
    asks2 = target.select(*by, "_q", "_at", "_l", F.coalesce("_tc", F.lit(-1)).cast("bigint").alias("_c"))
    second = search(asks2.filter("_c >= 0"), True)
    got = join_by(target, second.select(*by, "_q", "found", F.col("span_min").alias("_far")), by + ["_q"])
    ended = got.select(*by, "_q", "_at", "_l", "_c", "found", F.least("_own", "_mid", "_far").alias("span_min"))
    return _named(first.filter(F.col("found").isNotNull()).unionByName(ended), by, queries, query_id)


def _named(found: DataFrame, by: list[str], queries: DataFrame, query_id: str) -> DataFrame:
    return found.select(*by, F.col("_q").alias(query_id), F.col("_at").alias("at"), F.col("_l").alias("level"),
                        "found", "span_min")
