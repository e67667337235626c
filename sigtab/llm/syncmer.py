"""Document fingerprints of closed syncmers, matched with their positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common

K, S, KEEP = 12, 4, 64
_ROLL = np.uint32(0x01000193)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    h = h * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(15))


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive characters."""
    out = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out *= _ROLL
        out += codes[k : len(codes) - n + 1 + k]
    return _scramble(out)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers: k characters whose smallest s characters (by hash) come first or last among them.

    Whether k characters are one depends on nothing around them, so a passage has the same anchors wherever it stands.
    A shorter text is one anchor as a whole; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < k:
        return np.zeros(min(1, len(codes)), np.int64), _rolled(codes, len(codes)) if len(codes) else codes
    inner = _rolled(codes, s)
    span = k - s + 1
    least = inner[: len(inner) - span + 1].copy()
    for j in range(1, span):
        np.minimum(least, inner[j : len(inner) - span + 1 + j], out=least)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
    chosen = codes[at].copy()
    for j in range(1, k):
        chosen *= np.uint32(0x85EBCA6B)
        chosen += codes[at + j]
    return at, _scramble(chosen)


def fingerprint(text: str, keep: int = KEEP) -> str:
    """The ``keep`` smallest anchor hashes in order, each with its first position: 8 and 8 hex digits. Empty for an empty text."""
    at, hashes = anchors(text)
    if not len(at):
        return ""
    if len(hashes) > 8 * keep:  # the smallest of a large set first
        bound = np.partition(hashes, 4 * keep)[4 * keep]
        small = hashes <= bound
        if len(np.unique(hashes[small])) >= keep:
            at, hashes = at[small], hashes[small]
    found, first = np.unique(hashes, return_index=True)
    pairs = np.column_stack((found[:keep], at[first[:keep]])).astype(">u4")
    return pairs.tobytes().hex()


def likeness(a: str, b: str, keep: int = KEEP, drift: int = 64) -> float:
    """Estimated share of the anchors of either text that the other has too, at agreeing positions: 2 · common / (all of a + all of b), 0 to 1.

    Of the ``keep`` smallest hashes of both together, those in both are matched; each match votes for its offset, and only
    matches within ``drift`` characters of the best supported offset count. Equal fingerprints give 1, one empty one 0.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (ha, pa_), (hb, pb) = (np.frombuffer(bytes.fromhex(x), ">u4").astype(np.int64).reshape(-1, 2).T for x in (a, b))
    union = np.union1d(ha, hb)[:keep]
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    use = both <= union[-1]
    if not use.any():
        return 0.0
    offset = np.sort(pa_[ia[use]] - pb[ib[use]])
    votes = np.searchsorted(offset, offset + drift, "right") - np.arange(len(offset))
    return float(2 * votes.max() / (len(union) + votes.max()))


def edited(text: str, other: str) -> str:
    """The last half of the characters (rounded down) replaced by as many, or all, of the other text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 2_000, most: int = 100_000) -> DataFrame:
    """key, fingerprint, edited_fingerprint, edited_sha256, n_chars, near_edited and near_next of every row, edited with the next row's text.

    Rows follow each other by key (nulls first), then text; after the last comes the first. They are dealt to ranges of the integer key
    of about ``rows`` rows (at most ``most`` ranges, cut on a bounded sample of keys); the first row of a range also visits the range before.
    A null text counts as empty. Repeated rows follow each other. One row alone is its own next.
    """
    own = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("place"))
    total = own.select("place").count()
    parts = min(most, total // rows + 1)
    some = np.sort(common.bounded(own.select("place"), F.col("place"), 16 * parts).toPandas()["place"].to_numpy(np.int64))
    cuts = np.unique(some[np.arange(1, parts) * len(some) // parts]) if len(some) else some

    def number(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"range": pa.array(np.searchsorted(cuts, batch.column("place").to_numpy(), "right")), "place": batch.column("place")})

    first = {r["range"]: r["place"] for r in own.select("place").mapInArrow(number, "range long, place long").groupBy("range").agg(F.min("place").alias("place")).collect()}  # a row for each range
    order = sorted(first)
    before = {r: order[n - 1] for n, r in enumerate(order)}

    def deal(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            ranges = np.searchsorted(cuts, place, "right")
            visit = np.flatnonzero([first[r] == x for r, x in zip(ranges.tolist(), place.tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(np.zeros(len(place), bool)), *batch.columns], names=["range", "guest", *batch.schema.names])
            if len(visit):
                yield pa.RecordBatch.from_arrays([pa.array([before[r] for r in ranges[visit].tolist()], pa.int64()), pa.array(np.ones(len(visit), bool)), *batch.take(pa.array(visit)).columns], names=["range", "guest", *batch.schema.names])

    def compare(batches):
        last = None  # (range, key, text, fingerprint) of the row that waits for its next one
        for batch in batches:
            rows_out = []
            for r, guest, k, t in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "k", "t"))):
                print_ = fingerprint(t)
                if last is not None and last[0] == r:
                    changed = edited(last[2], t)
                    again = fingerprint(changed)
                    rows_out.append((last[1], len(last[2]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), last[3], again, likeness(last[3], again), likeness(last[3], print_)))
                last = None if guest else (r, k, t, print_)
            columns = list(zip(*rows_out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (batch.schema.field("k").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[key, *_COLUMNS])

    dealt = own.mapInArrow(deal, common.with_columns(own, ["k", "t", "place"], {}, {"range": "long", "guest": "boolean"}))
    placed = dealt.repartition("range").sortWithinPartitions("range", "guest", "place", "t")
    return placed.mapInArrow(compare, common.with_columns(docs, [key], _COLUMNS))


_COLUMNS = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
