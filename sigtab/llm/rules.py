"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    """What stands between ASCII blanks."""
    split = F.split(text, BLANKS)
    first = F.when(split[0] == "", 2).otherwise(1)  # only the first and the last can be empty
    return F.slice(split, first, F.greatest(F.lit(0), F.size(split) + 1 - first - F.when(F.element_at(split, -1) == "", 1).otherwise(0)))


def hashes(w: Column) -> Column:
    """A hash of each word; all later steps work on these numbers."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _next(a: Column, b: Column, apart: int) -> Column:
    """Hashes of the pairs (a[i], b[i + apart]) that there are."""
    n = F.greatest(F.lit(0), F.size(b) - apart)
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + apart, n), lambda x, y: F.xxhash64(x, y))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add w1 and w2 (a hash of each word and of each pair of neighbours), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words. A null text has none of them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    window = 3
    out = docs.withColumn("_w", words(whole)).withColumn("w1", hashes(F.col("_w"))).withColumn("w2", _next(F.col("w1"), F.col("w1"), 1))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.char_length(F.array_join("_w", "")).cast("long"), "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "_h": _next(F.col("w2"), F.col("w1"), 2)})
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Only texts with a repeated window are sorted: by hash to find its places, then by place to count the words they cover.
    out = out.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    out = out.withColumn("_p", F.array_sort(F.transform(F.filter("_o", lambda x, k: same(x, F.get("_o", k - 1)) | same(x, F.get("_o", k + 1))), lambda x: x["i"])))
    steps = F.transform("_p", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_p", k + 1) - p, F.lit(window))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_w", "_lines", "_h", "_o", "_p")


def judge_by_others(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", *, threshold: float = -0.15, buckets: int = 1 << 16, prior: float = 5.0, least_words: int = 50, most_repeated: int = 50, broadcast_keys: int = 500_000) -> DataFrame:
    """One row for each distinct key and text: key, the counts of ``base_counts``, base_failed, mean_ratio and kept.

    mean_ratio is the mean log ratio of the text's words and word pairs, hashed into ``buckets`` (a power of two); 0 without any. Each text is
    judged by the n-grams of the other texts only, and trusted counts are backed off to the corpus: the ratio of an n-gram is
    log((g + prior) / (e + prior)) with g trusted texts' occurrences, and e as many as would be expected there if
    trusted texts were like the corpus. ``prior`` occurrences at the corpus' share stand beside both, so that an n-gram too rare to
    be expected among the trusted ones speaks with about 0. The text's own row is taken out of the corpus, and out of the trusted counts if it
    is trusted; so a trusted text is judged like any other. All rows of ``trusted`` (keys) count; up to ``broadcast_keys`` of them are
    broadcast, more are joined as Spark chooses.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them in repeated windows. kept: not base_failed and
    mean_ratio at least ``threshold``. Repeated rows count once; rows of one key with different texts stay apart.
    """
    good = trusted.select(F.col(key).alias("_g")).where("_g is not null").distinct()
    good = common.stored(good, "trusted")
    good = F.broadcast(good) if good.count() <= broadcast_keys else good
    texts = docs.select(F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t")).join(good, F.col("_k") == F.col("_g"), "left").select("_k", "_t", F.when(F.col("_g").isNotNull(), 1).otherwise(0).alias("good"))
    at = texts.select("good", words(F.col("_t")).alias("w")).select("good", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("at")).where(F.col("at") < F.size("w"))
    each = at.select("good", F.xxhash64(F.get("w", F.col("at"))).alias("a"), F.when(F.col("at") + 1 < F.size("w"), F.xxhash64(F.get("w", F.col("at") + 1))).alias("b"))
    grams = each.select("good", F.explode(F.array(F.col("a"), F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")))).alias("h")).where("h is not null")
    counts = common.stored(grams.groupBy(F.col("h").bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"), F.sum("good").alias("g")), "buckets")
    sums = counts.agg(F.sum("n"), F.sum("g")).first()
    all_, own = float(sums[0] or 0), float(sums[1] or 0)
    counted = base_counts(texts.withColumn("same", F.xxhash64("_t")), "_t").drop("_t")
    # a text's buckets in order, so that equal ones stand together; a place counts where the bucket before is another
    sorted_ = counted.select("_k", "same", "good", *NUMBERS, F.sort_array(F.transform(F.concat("w1", "w2"), lambda x: x.bitwiseAND(F.lit(buckets - 1)))).alias("_s"))
    begins = sorted_.withColumn("_b", F.filter(F.sequence(F.lit(-1), F.size("_s") - 1), lambda i: (i >= 0) & ~F.get("_s", i).eqNullSafe(F.get("_s", i - 1))))
    # the place -1 stands for the document and carries its counts (and keeps Spark from inferring a filter that repeats all of this)
    items = begins.select("_k", "same", "good", "_s", "_b", *NUMBERS, F.posexplode(F.concat(F.array(F.lit(-1)), "_b")).alias("_i", "_at"))
    rows = items.select("_k", "same", "good", F.size("_s").alias("size"), F.get("_s", F.col("_at")).alias("bucket"), (F.coalesce(F.get("_b", F.col("_i")), F.size("_s")) - F.col("_at")).alias("c"),
                        *[F.when(F.col("_at") < 0, F.col(c)).alias(c) for c in NUMBERS])
    met = rows.join(F.broadcast(counts), "bucket", "left")  # a row for each bucket at most
    there = F.greatest(F.lit(0), F.col("g") - F.col("good") * F.col("c"))
    expected = (own - F.col("good") * F.col("size")) * F.greatest(F.lit(0), F.col("n") - F.col("c")) / F.greatest(F.lit(1.0), all_ - F.col("size"))
    weight = F.when(F.col("bucket").isNotNull(), F.col("c"))
    # plain numbers, so that the aggregate hashes
    found = met.groupBy("_k", "same").agg(*[F.max(c).alias(c) for c in NUMBERS], (F.sum(weight * F.log((there + prior) / (expected + prior))) / F.sum(weight)).alias("mean_ratio"))
    out = found.select(F.col("_k").alias(key), *NUMBERS, F.coalesce("mean_ratio", F.lit(0.0)).alias("mean_ratio"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("mean_ratio") >= threshold))
