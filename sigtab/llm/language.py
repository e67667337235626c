"""Language identification by Bloom filters of n-grams that answer for all languages at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common, textbytes

UNKNOWN = "und"
_HASHES = 3


@dataclass
class LanguageFilters:
    """``slots`` has a row for each slot and a 64-bit word for each 64 languages: bit k says whether the filter of language k has this slot.

    The bits of an n-gram's slots, joined by *and*, are all languages that may contain it.
    """

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    n: int
    usual: int

    def popcounts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, false positives included."""
        bits = int(np.log2(len(self.slots)))
        where = [textbytes.mixed(grams, bits, k) for k in range(_HASHES)]
        counts = np.zeros(64 * self.slots.shape[1])
        for word in range(self.slots.shape[1]):
            column = self.slots[:, word]
            found = column[where[0]]
            for at in where[1:]:
                found = found & column[at]
            for byte in range((min(64, len(self.languages) - 64 * word) + 7) // 8):
                seen = np.bincount((found >> np.uint64(8 * byte)).astype(np.uint8), minlength=256)
                counts[64 * word + 8 * byte : 64 * word + 8 * byte + 8] = seen @ _BITS
        return counts[: len(self.languages)]

    def decide(self, text: np.ndarray) -> tuple[str, float]:
        """The language with the largest corrected share of n-grams, and its share among all languages' fourth powers."""
        if not self.languages:
            return UNKNOWN, 0.0
        grams = textbytes.codes(textbytes.folded(text), self.n)
        share = np.zeros(len(self.languages))
        if len(grams):
            share = np.clip((self.popcounts(grams) / len(grams) - self.false_rate) / (1 - self.false_rate), 0, 1)
        if share.max() <= 0:
            return self.languages[self.usual], 1 / (1 + len(self.languages))
        best = int(share.argmax())
        return self.languages[best], float(share[best] ** 4 / (share**4).sum())


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, n: int = 4, rows: int = 40_000,
        least: float = 0.002, against: float = 0.1, per_language: int = 262_144) -> LanguageFilters:
    """Filters learned from at most about ``rows`` rows with a language (chosen by a hash of ``key``).

    Language L gets an n-gram that at least a share ``least`` of its texts (and two of them) contain, and a share of
    at least ``against`` times the largest of any language; of these the ``per_language`` commonest.
    Rows without a language or a text teach nothing. Without any such row the filters know no language and predict ``und``.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = common.bounded(known.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), F.col("k"), rows)

    def count(batches):
        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            each = [np.unique(textbytes.codes(textbytes.folded(t), n)) for t in textbytes.documents(batch.column("text"))]
            for name in sorted(set(langs)):
                own = [g for g, x in zip(each, langs) if x == name]
                grams, docs_with = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * (len(grams) + 1), pa.string()), "gram": pa.array(np.append(-1, grams.astype(np.int64))), "docs": pa.array(np.append(len(own), docs_with.astype(np.int64)))})

    counts = sample.drop("k").mapInArrow(count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    counts = common.stored(counts, "grams")
    totals = {r["lang"]: r["docs"] for r in counts.where("gram = -1").collect()}
    if not totals:
        common.discard(counts)
        return LanguageFilters([], np.zeros((1, 1), np.uint64), np.zeros(0), n, 0)
    languages = sorted(totals)
    index = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    total = F.create_map(*[F.lit(x) for name in languages for x in (name, float(totals[name]))])
    rate = counts.where("gram >= 0 and docs >= 2").select("gram", index[F.col("lang")].alias("l"), (F.col("docs") / total[F.col("lang")]).alias("rate")).where(F.col("rate") >= least)
    top = rate.groupBy("gram").agg(F.collect_list(F.struct("rate", "l")).alias("of"), F.max("rate").alias("top"))  # a row for each language at most
    kept = top.select("gram", F.explode("of").alias("x"), "top").where(F.col("x.rate") >= against * F.col("top")).select("gram", "x.l", "x.rate")
    members = {}
    for k in range(len(languages)):  # per language a bounded number of rows
        own = kept.where(F.col("l") == k).orderBy(F.desc("rate"), "gram").limit(per_language).select("gram").toPandas()
        members[k] = own["gram"].to_numpy(np.int64)
    common.discard(counts)
    bits = max(12, int(np.ceil(np.log2(12 * max(1, *(len(v) for v in members.values()))))))
    slots = np.zeros((1 << bits, (len(languages) + 63) // 64), np.uint64)
    for k, grams in members.items():
        for h in range(_HASHES):
            slots[np.unique(textbytes.mixed(grams, bits, h)), k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([np.count_nonzero(slots[:, k // 64] & np.uint64(1 << (k % 64))) / len(slots) for k in range(len(languages))])
    usual = max(range(len(languages)), key=lambda k: (totals[languages[k]], -k))
    return LanguageFilters(languages, slots, fill**_HASHES, n, usual)


def predict(docs: DataFrame, model: LanguageFilters, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"),
            carry: list[str] | None = None) -> DataFrame:
    """Add the predicted language and its score (0 to 1) to every row; ``carry`` names the columns to keep (all).

    A text that is null or has no letter gets ``und`` with score 0; one with letters of which no filter knows an n-gram
    gets the commonest language with the score 1 / (1 + languages).
    Columns of the names in ``out`` are replaced.
    """
    shared = common.to_workers(docs.sparkSession, model)
    keep = [c for c in (docs.columns if carry is None else carry) if c not in out]
    schema = common.with_columns(docs, keep, {out[0]: "string", out[1]: "double"})

    def score(batches):
        decide = shared().decide
        for batch in batches:
            found = [decide(t) if s and any(map(str.isalpha, s)) else (UNKNOWN, 0.0) for t, s in zip(textbytes.documents(batch.column(text)), batch.column(text).to_pylist())]
            columns = {c: batch.column(c) for c in keep} | {out[0]: pa.array([x for x, _ in found], pa.string()), out[1]: pa.array([x for _, x in found], pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(score, schema)
