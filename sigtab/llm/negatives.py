"""Hard-negative mining: exact integer scores by Strassen products of tiles, kept in mergeable lists of the best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtab.llm import common

#: Numbers (64 bits) of the candidates that a task holds at once, and rows of a tile.
HELD, ANCHORS, CANDIDATES = 1 << 21, 128, 2048


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """The product of two int64 matrices by Strassen's seven products, down to sides of ``leaf``.

    Sides are padded with zeros to even numbers. Additions of whole numbers are exact modulo 2^64, and so is the result.
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * h), np.int64)
    out[:i, :h] = p1 + p4 - p5 + p7
    out[:i, h:] = p3 + p5
    out[i:, :h] = p2 + p4
    out[i:, h:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def whole_vectors(vectors: DataFrame, vector: str, key: str, label: Column, scale: int) -> DataFrame:
    """key, label and x (array<long>, floor(scale * c)), each different row once; rows with a null key, label, vector or entry, or an infinite or NaN one, go."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(key).alias("key"), label.alias("label"), F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")).distinct()


def _tiles(rows: DataFrame, anchors: DataFrame, groups: int, size: int, work, schema: str) -> DataFrame:
    """Run ``work`` for every tile of anchors and candidates.

    Candidates (row, key, label, x) are dealt into ``groups`` by a hash of their row number, each of which fits into a task's memory;
    every anchor (row, label, x, more) visits every group. Within a partition a group's candidates come first, by key; the
    anchors stream past them. ``work`` gets the anchors' batch, its matrix, and the candidates' rows, keys, labels and matrix.
    """
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    more = [c for c in anchors.columns if c not in ("row", "label", "x")]
    guests = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("group", F.lit(1).alias("side"), "row", F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "label", "x", *more)
    homes = rows.select(group.alias("group"), F.lit(0).alias("side"), "row", "key", "label", "x", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in more])
    dealt = homes.unionByName(guests).repartition(groups, "group").sortWithinPartitions("group", "side", "key", "row")

    def matrix(batch):
        lists = batch.column("x")
        lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((batch.num_rows, size), np.int64)
        out[np.arange(size)[None, :] < lengths[:, None]] = flat
        return out

    def mapped(batches):
        now, held, ready = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "side")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                group, side = marks[:, start].tolist()
                part = batch.slice(start, end - start)
                if group != now:
                    now, held, ready = group, [], None
                if not side:
                    held.append((*(part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "key", "label")), matrix(part)))
                    continue
                if not held:
                    continue
                ready = ready or tuple(np.concatenate(c) for c in zip(*held))
                for at in range(0, part.num_rows, ANCHORS):
                    some = part.slice(at, ANCHORS)
                    found = work(some, matrix(some), *ready)
                    if found is not None:
                        yield found

    return dealt.mapInArrow(mapped, schema)


def _scores(x: np.ndarray, y: np.ndarray):
    """Tiles of scores: (first candidate, matrix)."""
    for at in range(0, len(y), CANDIDATES):
        yield at, strassen(x, np.ascontiguousarray(y[at : at + CANDIDATES].T))


def _best(score: np.ndarray, usable: np.ndarray, most: int):
    """(row, column) of the ``most`` largest usable entries of each row; equal ones by column."""
    lowest = np.iinfo(np.int64).min
    left = np.where(usable, score, lowest)
    each = np.arange(len(left))
    for _ in range(min(most, left.shape[1])):
        at = left.argmax(axis=1)  # the first of equal ones
        real = usable[each, at] & (left[each, at] > lowest)
        if not real.any():
            return
        yield each[real], at[real]
        left[each, at] = lowest


def _positives(most: int):
    def work(some, x, rows, keys, labels, y):
        anchor, label, parts = some.column("row").to_numpy(), some.column("label").to_numpy(), []
        for first, score in _scores(x, y):
            end = first + score.shape[1]
            usable = (labels[None, first:end] == label[:, None]) & (rows[None, first:end] != anchor[:, None])
            for i, j in _best(score, usable, most):
                parts.append((anchor[i], rows[first + j], keys[first + j], score[i, j]))
        if parts:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["anchor", "row", "key", "score"])

    return work


def _negatives(most: int, low: int, high: int, whole: int):
    def work(some, x, rows, keys, labels, y):
        anchor, label, parts = some.column("row").to_numpy(), some.column("label").to_numpy(), []
        wanted = some.column("positives").to_pylist()
        top = max((len(w) for w in wanted), default=0)
        goals = np.full((len(anchor), top), 0, np.int64)
        real = np.zeros((len(anchor), top), bool)
        for i, w in enumerate(wanted):
            goals[i, : len(w)], real[i, : len(w)] = [p["score"] for p in w], True
        for first, score in _scores(x, y):
            other = labels[None, first : first + score.shape[1]] != label[:, None]
            for k in range(top):
                goal = goals[:, k, None]
                inside = other & real[:, k, None] & (low * goal <= whole * score) & (whole * score <= high * goal)
                at = np.flatnonzero(inside.any(axis=1))
                for i, j in _best(score[at], inside[at], most):
                    i = at[i]
                    parts.append((anchor[i], np.full(len(i), k), rows[first + j], keys[first + j], score[i, j]))
        if parts:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["anchor", "place", "row", "key", "score"])

    return work


def _merged(parts: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best ``most`` of each list, with their place from 1. Spark cuts each task's share to as many before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "key", "row")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, anchor: Column, vector: str = "embedding", key: str = "vec_id", label: Column | None = None, *, scale: int = 256,
         positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), whole: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor's hard negatives.

    Anchors are the rows of ``vectors`` where ``anchor`` (a condition on its columns) holds; all rows are candidates. A score is the inner product of
    floor(scale * c), exact. Higher scores come first, equal ones by smaller key (then by row). Of each of an anchor's first
    ``positives`` other rows with its label, the first ``negatives`` rows with another label are taken whose score is
    within ``window`` (in parts of ``whole``) of the positive's. An anchor without positives, or a positive without such rows, has no row.

    Rows with a null key, label or vector, or a null or non-finite entry, take no part. Repeated rows count once; rows that share a key only
    are rows of their own. Shorter vectors are padded with zeros. ValueError if ``whole`` times a score could exceed 64 bits. An integer
    key is needed. Each anchor meets each candidate in one tile, as the result demands; a task holds a group of candidates of
    bounded size and keeps the best of it for each anchor, whatever share of the rows a label or vector has.
    """
    spark, label = vectors.sparkSession, F.col("label") if label is None else label
    chosen = whole_vectors(vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False))), vector, key, F.struct(label.alias("l"), F.col("_anchor").alias("a")), scale).where("label.l is not null")
    chosen = chosen.select("key", F.col("label.l").cast("long").alias("label"), F.col("label.a").alias("anchor"), "x")
    rows = common.stored(chosen.withColumn("row", F.monotonically_increasing_id()), "vectors")
    seen = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("size"), F.max(F.greatest(F.array_max("x").cast("double"), -F.array_min("x").cast("double"))).alias("most")).first()
    n, size, most = seen["n"], max(1, seen["size"] or 0), int(seen["most"] or 0)
    if whole * size * most * most >= 1 << 63:
        raise ValueError(f"scores of entries up to {most} in {size} dimensions can exceed 64 bits; take a smaller scale")
    groups = max(1, -(-n * size // HELD), min(-(-n // 256), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind, plain = rows.schema["key"].dataType.simpleString(), rows.select("row", "key", "label", "x")
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("the key must be an integer")
    anchors = rows.where("anchor").select("row", "label", "x")
    best = _merged(_tiles(plain, anchors, groups, size, _positives(positives), f"anchor long, row long, key {kind}, score long"), ["anchor"], positives)
    best = common.stored(best, "positives")
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "row", "score"))).alias("positives"))  # at most `positives` each
    seeking = common.stored(rows.where("anchor").select("row", F.col("key").alias("id"), "label", "x").join(lists, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    found = _merged(_tiles(plain, seeking.drop("id"), groups, size, _negatives(negatives, *window, whole), f"anchor long, place long, row long, key {kind}, score long"), ["anchor", "place"], negatives)
    at = seeking.select(F.col("row").alias("anchor"), "id", F.posexplode("positives").alias("place", "p")).withColumn("place", F.col("place").cast("long"))
    named = found.join(at, ["anchor", "place"])
    return named.select(F.col("id").alias("anchor_id"), F.col("p.key").alias("positive_id"), "rank", F.col("key").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
