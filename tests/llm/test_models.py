"""The operators that learn: quality, toxicity, language and mixing."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigtab.llm import common, language, mixing, quality, rules, textbytes, toxicity
from sigtab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def arr(text):
    return np.frombuffer(text.encode(), np.uint8)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_bytes():
    assert textbytes.folded(arr("Ab,  É9ß\n")).tobytes() == " ab é ß ".encode()
    assert textbytes.codes(arr("abcde"), 4).tolist() == [0x61626364, 0x62636465] and not len(textbytes.codes(arr("abc"), 4))
    assert len(quality.word_hashes(arr(" ab\tc  ab "))) == 3 and quality.word_hashes(arr("ab c ab"))[0] == quality.word_hashes(arr("ab c ab"))[2]
    assert len(quality.word_hashes(arr(""))) == len(quality.word_hashes(arr(" \n"))) == 0
    assert len(quality.features(arr(""))) and len(quality.features(arr("x" * 9000)))


def test_dual_descent_reaches_the_optimum():
    draw = np.random.default_rng(1)
    rows = [np.sort(draw.choice(40, 6, replace=False)) for _ in range(80)]
    y = np.where(np.array([3 in r or 5 in r for r in rows]), 1, -1)
    ratio, cost = draw.normal(size=40), np.full(80, 1.0)
    w, b = quality._dual_descent(rows, ratio, y, cost, 3000, 1e-9)
    x = np.zeros((80, 40))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = primal(w, b)
    for _ in range(300):  # no step from the minimum goes down
        assert primal(w + draw.normal(scale=0.01, size=40), b + draw.normal(scale=0.01)) >= best - 1e-6


@pytest.mark.parametrize("name,label", [("op3_quality", "quality"), ("op4_toxicity", "toxic")])
def test_held_out(spark, name, label):
    found = QUERIES[name](spark, SF).join(common.read(spark, SF, "labels"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all() and found["score"].between(0, 1).all()
    assert (held["predicted"] == held[label]).mean() > 0.93


def test_language_held_out(spark):
    found = QUERIES["op6_language_id"](spark, SF).join(common.read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(held) > 200 and (held["lang_pred"] == held["lang"]).mean() > 0.98


def test_filters_have_no_false_negatives():
    draw = np.random.default_rng(2)
    members = [draw.integers(0, 1 << 32, 500) for _ in range(70)]  # more languages than a word has bits
    slots = np.zeros((1 << 13, 2), np.uint64)
    for k, grams in enumerate(members):
        for h in range(3):
            slots[textbytes.mixed(grams, 13, h), k // 64] |= np.uint64(1 << (k % 64))
    model = language.LanguageFilters([f"l{k:02}" for k in range(70)], slots, np.full(70, 0.01), 4, 0)
    for k in (0, 63, 64, 69):
        counts = model.popcounts(members[k])
        assert counts[k] == 500 and np.delete(counts, k).max() < 100


def test_odd_rows(spark, odd, none):
    ids = [r["doc_id"] for r in odd.select("doc_id").collect()]
    marks = labels_of(spark, [(n, n % 2, int(n % 3 == 0)) for n in range(40)] + [(n, None, None) for n in range(40, 45)] + [(None, 1, 1), (3, 0, 1), (10**9, 1, 0)])
    for docs, n in ((odd, len(ids)), (none, 0)):
        for given in (marks, marks.limit(0), marks.where("quality = 1 and toxic = 0")):
            rated = quality.predict(docs, quality.fit(docs, given))
            assert rated.count() == n and rated.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
            assert rated.where("score is null or score < 0 or score > 1").count() == 0
        model = language.fit(docs)
        found = language.predict(docs, model)
        assert found.count() == n and found.where("text is null or text rlike '^[^\\\\p{L}]*$'").where("lang_pred <> 'und'").count() == 0
        assert found.where("lang_pred = 'und' and text rlike '\\\\p{L}'").count() == 0
        scored = toxicity.score(docs, marks)
        assert scored.count() == n and scored.where("score is null or score < 0 or score > 1").count() == 0
        assert toxicity.score(docs, marks.limit(0)).where("score <> 0.5").count() == 0
        mixed = mixing.mix(docs, mixing.domains_of(marks), {"clean": 0.5, "low": 0.3, "toxic": 0.2})
        assert mixed.where("rate is null or rate < 0").count() == 0 and mixed.count() == docs.select("doc_id", F.coalesce("text", F.lit(""))).distinct().count()


def test_block_max_is_exact():
    draw = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        terms = np.unique(draw.zipf(1.4, draw.integers(1, 30)) % 300)
        vectors.append((terms, draw.integers(1, 5, len(terms))))
    vectors += vectors[:20]  # ties
    idf = draw.uniform(1, 8, 300)
    index = toxicity.BlockMaxIndex(vectors, idf, np.arange(len(vectors)))
    dense = np.zeros((len(vectors), 300))
    for k, (t, c) in enumerate(vectors):
        dense[k, t] = index.unit(t, c)
    read = 0
    for q in range(0, 700, 7):
        cosine = dense @ dense[q]
        cosine[q] = 0
        hits = index.nearest(*vectors[q], 9, without=q)
        want = np.sort(cosine)[::-1][:9]
        assert np.allclose(hits.likeness, want[want > 0][: len(hits.likeness)]) and len(hits.examples) == (want > 0).sum()
        read += hits.blocks_read
    assert read < 100 * len(index.blocks)
    assert not len(index.nearest(np.empty(0, np.int64), np.empty(0, np.int64), 9).examples)


def spark_hash(*words):
    """xxhash64 of one word, or of the hashes of several."""
    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    each = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if len(each) == 1:
        return signed(each[0])
    seed = 42
    for h in each:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
    return signed(seed)


def test_base_counts_brute_force(spark, odd, none):
    import re
    from collections import Counter

    def count(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        places = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)

    more = spark.createDataFrame([(0, "a b c a b c\na b c a b c\n \n \nx|*\n"), (1, "q q q q q"), (2, "one two three"), (3, "\t")], "doc_id long, text string")
    for docs in (odd, more, none):
        for r in rules.base_counts(docs).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == count(r["text"]), r["text"]


def test_rates_meet_targets(spark):
    draw = random.Random(4)
    rows = []
    for n in range(400):
        p = [draw.random() ** 3 for _ in range(3)]
        rows.append((n, 1, draw.randint(0, 900), [x / sum(p) for x in p]))
    members = spark.createDataFrame(rows, "doc_id long, copies long, tokens long, p array<double>")
    whole = sum(r[2] for r in rows)
    targets = [0.5 * whole, 0.3 * whole, 0.2 * whole]
    rated, reached = mixing.fit_rates(members, targets)
    got = rated.toPandas()
    totals = np.array([(got["tokens"] * got["rate"] * got["p"].map(lambda p: p[i])).sum() for i in range(3)])
    assert np.allclose(totals, targets, rtol=2e-3) and np.allclose(totals, reached) and (got["rate"] >= 0).all()
    # the mildest rates that match: equality-constrained least squares around 1, in the metric of the tokens
    a = np.array([np.array(p) for p in got["p"]])
    gram = (a.T * got["tokens"].to_numpy()) @ a
    best = 1 + a @ np.linalg.solve(gram, np.array(targets) - (a.T @ got["tokens"].to_numpy()))
    assert (best > 0).all() and np.abs(best - got["rate"]).max() < 0.02
    far, reached = mixing.fit_rates(members, [0.99 * whole, 0.01 * whole, 0.0])  # out of reach: some rates end at 0
    assert far.where("rate = 0").count() > 0 and reached[2] < 0.2 * whole
    empty, reached = mixing.fit_rates(members.limit(0), [1.0, 1.0, 1.0])
    assert empty.count() == 0 and reached == [0, 0, 0]
