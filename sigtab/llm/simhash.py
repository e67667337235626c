"""SimHash fingerprints of word shingles, and their exact near pairs through a vantage-point tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common, textbytes

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Bit k is set if it is set in over half the XXH64 hashes of the shingles, repeats included; 0 without a word."""
    parts = text.translate(_LOWER).split()  # at ASCII blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)
    columns = found.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3) -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every row; a null text counts as empty."""

    def find(batches):
        for batch in batches:
            found = np.array([simhash(t.tobytes(), words) for t in textbytes.documents(batch.column(text))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(find, common.with_columns(docs, [key], {"fp": "long"}))


class VantageTree:
    """A binary tree over 64-bit fingerprints: each inner node has a vantage point and a radius; what is no farther goes left.

    It only says which shard a fingerprint lives in and which others its neighbours may live in; built on any sample, results are exact.
    """

    def __init__(self, sample: np.ndarray, leaves: int, reach: int):
        self.reach, self.point, self.radius, self.left, self.right, self.shards = reach, [], [], [], [], 0
        self._grow(sample.astype(np.uint64), max(1, len(sample) // max(1, leaves)))

    def _grow(self, points: np.ndarray, size: int) -> int:
        found = _vantage(points, self.reach) if len(points) > 1.5 * size else None
        if found is None:
            self.shards += 1
            return -self.shards  # a leaf: -1 - its number
        here, (point, radius) = len(self.point), found
        for column, value in ((self.point, point), (self.radius, radius), (self.left, 0), (self.right, 0)):
            column.append(value)
        far = np.bitwise_count(points ^ point) > radius
        self.left[here] = self._grow(points[~far], size)
        self.right[here] = self._grow(points[far], size)
        return here

    def shards_of(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (number in ``fp``, shard, guest): each at home once, and as a guest in other shards that may hold something within reach."""
        out, todo = [], [(0 if self.point else -1, np.arange(len(fp)), np.ones(len(fp), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), -1 - node), ~home))
                continue
            d = np.bitwise_count(fp[rows] ^ self.point[node]).astype(np.int64)
            r = self.radius[node]
            left, right = d <= r + self.reach, d > r - self.reach  # the triangle inequality rules the other side out
            todo += [(self.left[node], rows[left], home[left] & (d[left] <= r)), (self.right[node], rows[right], home[right] & (d[right] > r))]
        rows, shard, guest = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        of = np.zeros(len(fp), np.int64)
        of[rows[~guest]] = shard[~guest]
        use = ~guest | ((shard > of[rows]) ^ ((shard + of[rows]) % 2 == 1))  # of two shards one compares, in turn the later and the earlier
        return rows[use], shard[use], guest[use]


def _vantage(points: np.ndarray, reach: int):
    """Of some points the one whose median distance has the fewest points near it, and that distance; None if no split is worth it."""
    best, found = 0.75, None
    for point in points[np.linspace(0, len(points) - 1, 8).astype(int)]:
        d = np.bitwise_count(points ^ point).astype(np.int64)
        radius = int(np.median(d))
        inner = np.mean(d <= radius)
        near = np.mean((d > radius - reach) & (d <= radius + reach)) + 2 * max(0, abs(inner - 0.5) - 0.25)
        if near < best and 0 < inner < 1:
            best, found = near, (point, radius)
    return found


class Links:
    """Components of numbered items from pairs that come in pieces."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            if not len(a):
                break
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def near_components(fp: np.ndarray, guest: np.ndarray, reach: int, brute: int = 512) -> np.ndarray:
    """For each fingerprint the number of the first one in its component, linking those within reach of which one at least is no guest."""
    links = Links(len(fp))
    todo = [(np.flatnonzero(~guest), np.flatnonzero(guest))]
    while todo:
        own, other = todo.pop()
        if not len(own):
            continue
        found = _vantage(fp[own[:: max(1, len(own) // 4096)]], reach) if len(own) > brute else None
        if found is None:
            every = np.concatenate((own, other))
            for at in range(0, len(own), 256):
                piece = own[at : at + 256]
                for start in range(at, len(every), 8_192):
                    some = every[start : start + 8_192]
                    a, b = np.nonzero(np.bitwise_count(fp[piece][:, None] ^ fp[some][None, :]) <= reach)
                    links.add(piece[a], some[b])
            continue
        point, radius = found
        d, e = (np.bitwise_count(fp[x] ^ point).astype(np.int64) for x in (own, other))
        inside = d <= radius
        todo.append((own[inside], other[e <= radius + reach]))
        todo.append((own[~inside], np.concatenate((other[e > radius - reach], own[inside & (d > radius - reach)]))))
    return links.root


def components(edges: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) for the long columns a, b of ``edges``, by spreading minima and following labels.

    Each round is written, so that lineage stays short; rounds grow with the logarithm of the longest path.
    """
    both = common.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = common.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = spread.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = common.stored(spread.join(jump, spread["label"] == jump["at"], "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        common.discard(labels)
        labels = new
        if not changed:
            common.discard(both)
            return labels.select("node", "label")


def near_classes(prints: DataFrame, key: str = "doc_id", reach: int = 2, shard: int = 32_768, sample: int = 65_536) -> DataFrame:
    """fp and component_id (smallest key reachable over links of up to ``reach`` differing bits) for each distinct fp of ``prints``.

    Copies meet in one row before anything is compared. A tree over a bounded sample deals the distinct fingerprints to shards of about
    ``shard``; those near a border visit the shard beyond it, too (of two shards one does). A shard returns for each member of a component only its first member,
    never the pairs.
    """
    distinct = common.stored(prints.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    total = distinct.count()
    points = common.bounded(distinct.select("fp"), F.col("fp"), sample).orderBy("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = VantageTree(points, total // shard + 1, reach)
    shared = common.to_workers(prints.sparkSession, tree)

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            rows, number, guest = shared().shards_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), pa.array(fp[rows].view(np.int64)), pa.array(guest)], names=["shard", "fp", "guest"])

    def solve(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("fp").to_numpy(), kind="stable")
        fp = table.column("fp").to_numpy()[order]
        root = near_components(fp.view(np.uint64), table.column("guest").to_numpy(zero_copy_only=False)[order], reach)
        linked = np.bincount(root, minlength=len(root))[root] > 1
        return pa.table({"fp": fp[linked], "root": fp[root[linked]]})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long, guest boolean")
    member = common.stored(dealt.groupBy("shard").applyInArrow(solve, "fp long, root long"), "members")
    roots = common.stored(member.groupBy("fp").agg(F.min("root").alias("root"), F.collect_set("root").alias("all")), "roots")  # a root for each shard visited at most
    edges = roots.where(F.size("all") > 1).select(F.col("root").alias("a"), F.explode("all").alias("b"))
    named = components(edges)
    whole = roots.join(named, roots["root"] == named["node"], "left").select("fp", F.coalesce("label", "root").alias("class"))
    classed = common.stored(distinct.join(whole, "fp", "left").select("fp", "first", F.coalesce("class", "fp").alias("class")), "classed")
    smallest = classed.groupBy("class").agg(F.min("first").alias("component_id"))
    out = common.stored(classed.join(smallest, "class").select("fp", "component_id"), "classes")
    common.discard(distinct, member, roots, classed, named)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, reach: int = 2) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id for every row of ``docs``.

    Repeated rows and copies share a fingerprint and so a component. Null and blank texts have fingerprint 0 and link like any other.
    A null key is never a component_id unless no row of the component has another.
    """
    prints = common.stored(fingerprints(docs, text, key, words), "prints")
    classes = near_classes(prints, key, reach)
    return prints.join(classes, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
