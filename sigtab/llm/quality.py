"""Quality classifier: a linear hinge-loss model on n-gram indicators that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common, textbytes

# Kinds of characters: small letters, capitals, digits, blanks, line ends, bytes above ASCII, some marks, the rest.
_MARKS = b".,!?|*#%&$<>-_():;'\"/=@[]"
_KIND = np.full(256, 31, np.uint32)
_KIND[128:] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], _KIND[0x0A] = 3, 4
_KIND[list(_MARKS)] = 6 + np.arange(len(_MARKS))
_GRAMS = 1 << 20  # n-grams of four kinds; the codes above describe repeated words
WIDTH = _GRAMS + 64
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(256)], np.uint64)


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each word (bytes between blanks), in order."""
    blank = (text == 0x20) | ((text >= 9) & (text <= 13))
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1])) if len(text) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(text))
    first = np.zeros(len(text), np.int64)
    first[starts] = starts
    place -= np.maximum.accumulate(first)
    value = text.astype(np.uint64) + np.uint64(1)
    value *= _POWERS[place & 255]
    value[blank] = 0
    return np.add.reduceat(value, starts)


def _longest_run(same: np.ndarray) -> int:
    breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    return int(np.diff(breaks).max())


def features(text: np.ndarray) -> np.ndarray:
    """The indicators of a text, ascending: n-grams of four character kinds; how long words repeat at once; how few words and word triples differ."""
    kinds = np.concatenate(([3], _KIND[text], [3])).astype(np.uint32)
    if len(kinds) < 4:
        kinds = np.concatenate((kinds, np.full(4 - len(kinds), 3, np.uint32)))
    grams = (kinds[:-3] << np.uint32(15)) | (kinds[1:-2] << np.uint32(10)) | (kinds[2:-1] << np.uint32(5)) | kinds[3:]
    seen = np.zeros(_GRAMS, bool) if len(grams) > 4096 else None
    if seen is None:
        found = np.unique(grams)
    else:
        seen[grams] = True
        found = np.flatnonzero(seen)
    words = word_hashes(text)
    more = [_GRAMS]
    if len(words) > 1:
        run = _longest_run(words[1:] == words[:-1])
        more += [_GRAMS + 1 + k for k in range(min(10, int(np.log2(run)) + 1))]
        more.append(_GRAMS + 16 + min(15, int(2 * np.log2(len(words) / len(np.unique(words))))))
        triples = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(0x85EBCA6B) + words[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        if len(triples):
            more.append(_GRAMS + 32 + min(15, int(4 * np.log2(len(triples) / len(np.unique(triples))))))
    return np.concatenate((found.astype(np.int64), np.array(more, np.int64))).astype(np.int32)


@dataclass
class SupportVectors:
    """``weights`` already hold the log-count ratios; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = np.sqrt(self.squares[found].sum()) or 1.0
        return float(self.weights[found].sum() / norm + self.bias)

    def score(self, text: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -40, 40))))


def _dual_descent(rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, cost: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Minimise |w|² / 2 + sum of cost · hinge loss over unit rows (scaled indicators) by coordinate steps on its dual."""
    weights, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[x] for x in rows]
    values = [v / (np.sqrt((v * v).sum()) or 1.0) for v in values]
    curve = np.array([(v * v).sum() + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for k in order.permutation(len(rows)):
            at, v, y = rows[k], values[k], label[k]
            slope = y * (weights[at] @ v + bias) - 1
            new = min(max(dual[k] - slope / curve[k], 0.0), cost[k])
            step = new - dual[k]
            if step:
                weights[at] += step * y * v
                bias += step * y
                dual[k] = new
                worst = max(worst, abs(step) * curve[k])
        if worst < tolerance:
            break
    return weights, bias


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (never below 0.1) and shift of the logistic curve through margins, with the usual softened targets."""
    good, bad = max(1, (label > 0).sum()), max(1, (label < 0).sum())
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack((margin, np.ones(len(margin))))
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.1, float(beta[0])), float(beta[1])


def fit_rows(rows: list[np.ndarray], label: np.ndarray, tune: np.ndarray, *, cost: float = 1.0, smooth: float = 1.0, rounds: int = 40) -> SupportVectors:
    """Fit on indicator rows with labels -1 and 1; the rows marked in ``tune`` only place the logistic curve."""
    train = np.flatnonzero(~tune)
    if len(set(label[train])) < 2 or len(set(label)) < 2:
        share = (np.sum(label > 0) + 1) / (len(label) + 2)
        return SupportVectors(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = {}
    for y in (-1, 1):
        own = [rows[k] for k in train if label[k] == y]
        counts[y] = smooth + np.bincount(np.concatenate(own), minlength=WIDTH) if own else np.full(WIDTH, smooth)
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    ratio[(counts[1] + counts[-1]) <= 2 * smooth + 1] = 0  # in no more than one row
    share = {y: np.mean(label[train] == y) for y in (-1, 1)}
    weights, bias = _dual_descent([rows[k] for k in train], ratio, label[train], np.array([cost * 0.5 / share[label[k]] for k in train]), rounds, 1e-3)
    model = SupportVectors(weights * ratio, ratio**2, bias, 1.0, 0.0)
    use = np.flatnonzero(tune) if len(set(label[tune])) == 2 else np.arange(len(rows))
    model.slope, model.shift = logistic(np.array([model.margin(rows[k]) for k in use]), label[use])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", *, rows: int = 12_000) -> SupportVectors:
    """Learn from at most about ``rows`` labelled rows, chosen by a hash of ``key``.

    Rows without a label or key teach nothing; a null text counts as empty; of several labels of one key the
    smallest counts. With labels of one kind only, or none, every text gets the share of ones (add-one smoothed).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = common.bounded(known, F.col("k"), rows).groupBy("k").agg(F.min("y").alias("y"))
    pairs = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")  # at most about `rows` small rows

    def collect(batches):
        for batch in batches:
            found = [features(t) for t in textbytes.documents(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"k": batch.column("k"), "y": batch.column("y"), "found": pa.array(found, pa.list_(pa.int32()))})

    got = pairs.mapInArrow(collect, f"k {docs.schema[key].dataType.simpleString()}, y int, found array<int>").withColumn("tune", common.fold(F.concat(F.col("k").cast("string"), F.lit("tune")), 5) == 0).toPandas()
    got = got.assign(k=got["k"].astype(str)).sort_values(["k", "y"], kind="stable")
    return fit_rows([np.asarray(x, np.int64) for x in got["found"]], np.where(got["y"] > 0, 1, -1), got["tune"].to_numpy(bool))


def predict(docs: DataFrame, model: SupportVectors, text: str = "text", out: tuple[str, str] = ("score", "predicted"), carry: list[str] | None = None) -> DataFrame:
    """Add the score (0 to 1, higher: better) and predicted (1 from 0.5 on) to every row; ``carry`` names the columns to keep (all).

    A null text is scored as an empty one. Columns of the names in ``out`` are replaced.
    """
    shared = common.to_workers(docs.sparkSession, model)
    keep = [c for c in (docs.columns if carry is None else carry) if c not in out]

    def score(batches):
        for batch in batches:
            found = np.array([shared().score(t) for t in textbytes.documents(batch.column(text))], float)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {out[0]: pa.array(found), out[1]: pa.array((found >= 0.5).astype(np.int32))})

    return docs.mapInArrow(score, common.with_columns(docs, keep, {out[0]: "double", out[1]: "int"}))
