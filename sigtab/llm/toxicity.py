"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common, textbytes
from sigtab.llm.quality import logistic

#: Bytes of an n-gram; blanks count, so that starts and ends of words are told apart.
GRAM = 5
_BLOCK = 64


def _grams(text: np.ndarray) -> np.ndarray:
    return textbytes.codes(textbytes.folded(text), GRAM)


def gram_text(code: int) -> str:
    return int(code).to_bytes(GRAM, "big").decode("utf-8", "replace")


class Vocabulary:
    """Finds the chosen n-grams in a text: a table of hash bits first, then the sorted codes themselves."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._hash(self.grams)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def terms(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-grams in the text, ascending, and how often each occurs."""
        codes = _grams(text)
        codes = codes[self.bits[self._hash(codes)]]
        at = np.searchsorted(self.grams, codes)
        at = at[self.grams[np.minimum(at, len(self.grams) - 1)] == codes] if len(self.grams) else at[:0]
        return np.unique(at, return_counts=True)


def choose_terms(counts: DataFrame, texts: dict[int, int], terms: int, lift: float = 3.0) -> np.ndarray:
    """The n-grams whose presence goes with the label most: largest log-likelihood ratio (G²), at least twice the logarithm of
    how many n-grams are tried (chance alone hardly exceeds that for any of them), and at least ``lift`` times as common with one
    label as with the other (else long texts and common languages would speak).

    ``counts`` has gram, ones and zeros (texts with it of either label); ``texts`` says how many texts have which label.
    """
    one, zero = float(max(texts.get(1, 0), 1)), float(max(texts.get(0, 0), 1))
    all_with, total = F.col("ones") + F.col("zeros"), one + zero

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (part(F.col("ones"), all_with * one / total) + part(F.col("zeros"), all_with * zero / total)
             + part(one - F.col("ones"), one - all_with * one / total) + part(zero - F.col("zeros"), zero - all_with * zero / total))
    ratio = F.log((F.col("ones") + 0.5) / (one + 1)) - F.log((F.col("zeros") + 0.5) / (zero + 1))
    tried = counts.where(all_with >= 3).select("gram", g.alias("g"), ratio.alias("ratio"))
    best = tried.where((F.col("g") >= 2 * np.log(max(2, tried.count()))) & (F.abs("ratio") >= np.log(lift))).orderBy(F.desc("g"), "gram").limit(terms)
    return best.toPandas()["gram"].to_numpy(np.int64).astype(np.uint64)


@dataclass
class Hits:
    examples: np.ndarray
    likeness: np.ndarray
    blocks_read: int


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples in blocks, with the largest weight of each term in each block.

    The sum of query weight times largest weight bounds the cosine with every example of a block. ``nearest`` reads
    blocks by falling bound and stops when the bound falls below the k-th best cosine so far, so the k it returns are exact.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, keys: np.ndarray):
        self.idf, n = idf, len(vectors)
        unit = [self.unit(*v) for v in vectors]
        lead = np.array([t[w.argmax()] if len(t) else -1 for (t, _), w in zip(vectors, unit)], np.int64)
        self.order = np.lexsort((keys, lead))  # examples led by the same term share blocks
        blocks = (n + _BLOCK - 1) // _BLOCK
        self.largest = np.zeros((len(idf), max(1, blocks)), np.float32)
        self.blocks = []
        for b in range(blocks):
            own = self.order[b * _BLOCK : (b + 1) * _BLOCK]
            terms = np.concatenate([vectors[k][0] for k in own])
            weights = np.concatenate([unit[k] for k in own])
            rows = np.repeat(np.arange(len(own)), [len(vectors[k][0]) for k in own])
            np.maximum.at(self.largest[:, b], terms, weights.astype(np.float32) * np.float32(1 + 1e-6))
            self.blocks.append((own, terms, weights, rows))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, without: int = -1) -> Hits:
        """The k examples (without number ``without``) of largest cosine above 0, ties by example number."""
        if not len(terms) or not self.blocks:
            return Hits(np.empty(0, np.int64), np.empty(0), 0)
        weight = self.unit(terms, counts)
        bound = weight @ self.largest[terms]
        dense = np.zeros(len(self.idf))
        dense[terms] = weight
        found, cosines, least, reads = np.empty(0, np.int64), np.empty(0), 0.0, 0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(found) >= k and bound[b] * (1 + 1e-5) < least:
                break
            own, at, value, rows = self.blocks[b]
            cosine = np.bincount(rows, dense[at] * value, minlength=len(own))
            good = (cosine > 0) & (own != without)
            found, cosines = np.append(found, own[good]), np.append(cosines, cosine[good])
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            least, reads = cosines[-1] if len(cosines) else 0.0, reads + 1
        return Hits(found, cosines, reads)


@dataclass
class Neighbours:
    """``slope`` and ``shift`` place the logistic curve through the log-odds of the votes; ``none`` is the score without any neighbour."""

    index: BlockMaxIndex
    keys: list
    labels: np.ndarray
    k: int
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    none: float = 0.5

    def vote(self, hits: Hits) -> float:
        """Share of ones among the neighbours, each with weight cosine² / (distance + 0.05), plus one vote of the prior: far neighbours hardly move it."""
        weight = hits.likeness**2 / (1.05 - np.minimum(hits.likeness, 1))
        return float((weight @ self.labels[hits.examples] + self.prior) / (weight.sum() + 1))

    def score(self, hits: Hits) -> float:
        if not len(hits.examples):
            return self.none
        p = min(max(self.vote(hits), 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift))))


def _calibrate(model: Neighbours, vectors: list, labels: np.ndarray, empty: tuple[int, int]) -> None:
    """Fit the curve on examples that are scored without themselves. ``empty``: examples without a term, and ones among them."""
    odds, truth, ones, none = [], [], empty[1], empty[0]
    for k, (terms, counts) in enumerate(vectors):
        hits = model.index.nearest(terms, counts, model.k, without=k)
        if len(hits.examples):
            p = min(max(model.vote(hits), 1e-6), 1 - 1e-6)
            odds.append(np.log(p / (1 - p)))
            truth.append(labels[k])
        else:
            none, ones = none + 1, ones + labels[k]
    model.none = float((ones + model.prior) / (none + 1))
    if 0 < sum(truth) < len(truth):
        model.slope, model.shift = logistic(np.array(odds), np.where(np.array(truth) > 0, 1, -1))


def extract(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """key, terms and counts of every row; a null or short text has none."""
    shared = common.to_workers(docs.sparkSession, vocabulary)

    def find(batches):
        for batch in batches:
            found = [shared().terms(t) for t in textbytes.documents(batch.column(text))]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "terms": pa.array([x for x, _ in found], pa.list_(pa.int32())), "counts": pa.array([x for _, x in found], pa.list_(pa.int32()))})

    return docs.select(key, text).mapInArrow(find, common.with_columns(docs, [key], {"terms": "array<int>", "counts": "array<int>"}))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", *,
          rows: int = 12_000, terms: int = 4096, k: int = 9) -> DataFrame:
    """key, score (0 to 1), predicted (1 from 0.5 on), neighbours (keys of the nearest examples, nearest first), likeness (their cosines)
    and evidence (the n-grams that the text shares with them) for every row of ``docs``.

    Examples are at most about ``rows`` labelled rows, chosen by a hash of ``key``; of several labels of one key the largest counts.
    The space is spanned by the up to ``terms`` n-grams whose presence goes with the label most; their document counts come from all rows.
    A text without any of these n-grams has no neighbour and gets the share of ones among such examples. A row's own example is not its neighbour.
    Null texts count as empty; repeated rows are scored each; a null key is never an example. Without any example every score is 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = common.stored(common.bounded(known, F.col("k"), rows).groupBy("k").agg(F.max("y").alias("y")), "examples")
    pairs = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")  # at most about `rows` small rows

    def count(batches):
        each = {0: [], 1: []}
        texts = {0: 0, 1: 0}

        def flush():
            for y in each:
                if each[y]:
                    grams, n = np.unique(np.concatenate(each[y]), return_counts=True)
                    n = n.astype(np.int64)
                    grams, n = np.append(grams.astype(np.int64), -1), np.append(n, texts[y])
                    zeros = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(grams), "ones": pa.array(n if y else zeros), "zeros": pa.array(zeros if y else n)})
                    each[y], texts[y] = [], 0

        held = 0
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), textbytes.documents(batch.column("text"))):
                grams = np.unique(_grams(t))
                each[int(y > 0)].append(grams)
                texts[int(y > 0)] += 1
                held += len(grams)
                if held > 8_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    once = pairs.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.first("text").alias("text")).select("y", "text")  # copies count once
    counts = common.stored(once.mapInArrow(count, "gram long, ones long, zeros long").groupBy("gram").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")), "grams")
    texts = next(({1: r["ones"], 0: r["zeros"]} for r in counts.where("gram = -1").collect()), {})
    vocabulary = Vocabulary(choose_terms(counts.where("gram >= 0"), texts, terms))
    vectors = common.stored(extract(docs, vocabulary, key, text), "vectors")
    width = len(vocabulary.grams)
    used = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()  # a row for each term at most
    total = vectors.count()
    idf = np.log((1 + total) / (1 + np.bincount(used["t"], used["count"], minlength=width)[:width])) + 1 if width else np.zeros(0)
    got = vectors.join(F.broadcast(chosen), vectors[key] == chosen["k"]).select(F.col(key).alias("key"), "terms", "counts", "y").toPandas()
    got = got.assign(name=got["key"].astype(str)).sort_values(["name", "y"], kind="stable").reset_index(drop=True)
    y = (got["y"].to_numpy() > 0).astype(int) if len(got) else np.zeros(0, int)
    full = np.array([len(t) > 0 for t in got["terms"]], bool)
    own = [(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(got["terms"][full], got["counts"][full])]
    keys = got["key"][full].tolist()
    model = Neighbours(BlockMaxIndex(own, idf, np.arange(len(own))), keys, y[full], k, float((y.sum() + 1) / (len(y) + 2)))
    _calibrate(model, own, y[full], (int((~full).sum()), int(y[~full].sum())))
    common.discard(counts, chosen)
    number = {x: n for n, x in enumerate(keys)}
    shared = common.to_workers(docs.sparkSession, (model, vocabulary.grams, [t for t, _ in own]))
    kind = docs.schema[key].dataType
    schema = common.with_columns(docs, [key], {"score": "double", "predicted": "int", "neighbours": f"array<{kind.simpleString()}>", "likeness": "array<double>", "evidence": "array<string>"})

    def rate(batches):
        model, grams, examples = shared()
        for batch in batches:
            scores, near, like, why = [], [], [], []
            for name, t, n in zip(batch.column(key).to_pylist(), batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                t, n = np.array(t, np.int64), np.array(n, np.int64)
                hits = model.index.nearest(t, n, model.k, without=number.get(name, -1))
                scores.append(model.score(hits))
                near.append([model.keys[e] for e in hits.examples])
                like.append(np.minimum(hits.likeness, 1.0).tolist())
                common_terms = np.intersect1d(t, np.concatenate([examples[e] for e in hits.examples])) if len(hits.examples) else []
                why.append([gram_text(grams[x]) for x in common_terms])
            scores = np.array(scores, float)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(near, pa.list_(batch.column(key).type)), pa.array(like, pa.list_(pa.float64())), pa.array(why, pa.list_(pa.string()))],
                                             names=[key, "score", "predicted", "neighbours", "likeness", "evidence"])

    return vectors.mapInArrow(rate, schema)
