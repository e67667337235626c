"""Rates that meet reachable targets, whatever their size."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtab.llm import common, mixing


def members_of(spark, shares, n=300, hard=True):
    draw = np.random.default_rng(7)
    rows = []
    for k in range(n):
        d = draw.choice(len(shares), p=shares)
        p = np.eye(len(shares))[d] if hard else 0.97 * np.eye(len(shares))[d] + 0.03 * draw.dirichlet(np.ones(len(shares)) * 0.2)
        rows.append((k, 1, int(draw.integers(1, 900)), [float(x) for x in p]))
    return spark.createDataFrame(rows, "doc_id long, copies long, tokens long, p array<double>"), sum(r[2] for r in rows)


@pytest.mark.parametrize("shares,targets", [
    ((0.5, 0.3, 0.2), (0.7, 0.3, 0.0)),  # a zero target
    ((0.5, 0.3, 0.2), (0.7, 0.299, 0.001)),
    ((0.5, 1 / 6, 1 / 3), (0.94, 0.04, 0.02)),  # a third of the tokens, wanted 2 %
])
def test_reachable_targets_are_reached(spark, shares, targets):
    members, whole = members_of(spark, shares)
    rated, reached = mixing.fit_rates(members, [t * whole for t in targets])
    got = rated.toPandas()
    totals = [(got["tokens"] * got["rate"] * got["p"].map(lambda p: p[i])).sum() / whole for i in range(3)]
    assert np.allclose(totals, np.array(reached) / whole, atol=1e-9) and (got["rate"] >= 0).all()
    assert all(abs(a - b) <= 1e-3 * max(b, 1e-3) for a, b in zip(totals, targets))


def test_soft_members_with_a_small_target(spark):
    members, whole = members_of(spark, (0.5, 1 / 6, 1 / 3), hard=False)
    _, reached = mixing.fit_rates(members, [0.94 * whole, 0.04 * whole, 0.02 * whole])
    assert np.allclose(np.array(reached) / whole, [0.94, 0.04, 0.02], rtol=1e-3)


def test_a_gap_is_told(spark):
    docs = spark.createDataFrame([(n, f"some {'good' if n % 2 else 'bad'} words {n}") for n in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, "a" if n % 2 ^ (n % 10 == 0) else "b") for n in range(80)], "doc_id long, domain string")  # some are wrong
    with pytest.warns(UserWarning, match="no rates meet"):
        mixed = mixing.mix(docs, labels, {"a": 1.0, "b": 0.0})  # no text is quite without b
    assert mixed.reached["b"] > 0 and mixed.left_out <= 0.5
    with pytest.warns(UserWarning, match="not apart"):  # a word that says nothing
        blind = mixing.mix(docs.withColumn("text", F.lit("same words")), labels, {"a": 0.9, "b": 0.1})
    assert blind.largest == 1 and [r["rate"] for r in blind.select("rate").distinct().collect()] == [1.0]


def test_membership_brute_force(spark):
    """Counts, scores without the own text and posteriors against plain arithmetic."""
    draw = np.random.default_rng(3)
    words = {"x": ["mild", "calm", "warm"], "y": ["rude", "loud"], "z": ["odd"]}
    rows, labels = [], []
    for n in range(240):
        d = "xyz"[draw.choice(3, p=[0.6, 0.3, 0.1])]
        own = [str(draw.choice(words[d])) for _ in range(draw.integers(0, 4))]
        rows.append((n, " ".join([*own, *(f"w{v}" for v in draw.integers(0, 60, 12))])))
        if n < 200:
            labels.append((n, d))
    docs, known, domains = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string"), ["x", "y", "z"]
    table, least, share, texts = mixing.domain_table(docs, known, domains)
    text, domain = dict(rows), dict(labels)
    n, own = Counter(), {d: Counter() for d in domains}
    for k, d in labels:
        for w in set(text[k].split()):
            n[w] += 1
            own[d][w] += 1
    assert least == 2 * math.log(sum(c > 1 for c in n.values()))
    count = Counter(domain.values())
    assert share == [(count[d] + 0.5) / 201.5 for d in domains]

    def weights(w, without=None):
        gone = [1 if d == without else 0 for d in domains]
        m, each = n[w] - sum(gone), [own[d][w] - g for d, g in zip(domains, gone)]
        if n[w] < 2 or m <= 0 or sum(2 * c * math.log(c / (m * s)) for c, s in zip(each, share) if c) < least:
            return [0.0] * 3
        return [max(0.0, math.log((c + 4 * s) / ((m + 4) * s))) for c, s in zip(each, share)]

    def score(k, without=None):
        return [math.log1p(sum(weights(w, without)[i] for w in text[k].split())) for i in range(3)]

    left = mixing.scores_by_others(texts, table, least, domains, share)
    assert len(left) == 200
    for (d, s), k in zip(left, sorted(domain)):
        assert d == domain[k] and np.allclose(s, score(k, d))
    for r in mixing.scores(docs, table, least, share).collect():
        assert np.allclose(r["s"], score(r["doc_id"])) and r["tokens"] == len(text[r["doc_id"]].split())
    matrix, shift, gain = mixing.calibrate(left, domains, share)
    assert gain > 50
    logits = np.array([s for _, s in left]) @ matrix.T + shift
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(p.sum(axis=0), [count[d] for d in domains], atol=0.01)  # as many as there are
    mixed = mixing.mix(docs, known, {"x": 0.8, "y": 0.15, "z": 0.05})
    got = mixed.toPandas()
    for d in domains:
        assert abs((got["tokens"] * got["rate"] * got["p"].map(lambda p: p[d])).sum() - mixed.reached[d]) < 1e-6 and abs(mixed.reached[d] / mixed.wanted[d] - 1) < 2e-3
    scored = got.set_index("doc_id")
    for k in (0, 50, 239):
        logits = np.array(score(k)) @ matrix.T + shift
        assert np.allclose([scored["p"][k][d] for d in domains], np.exp(logits) / np.exp(logits).sum(), atol=1e-9)
    assert mixed.left_out == (got["rate"] <= 0).mean() and mixed.largest == got["rate"].max()


@pytest.mark.parametrize("size,kept", [("sf0.001", 0.9), ("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_the_pipelines_mix_keeps_clean_documents(spark, size, kept):
    import corpus_pipeline

    sf = f"/root/testdata/{size}"
    labels = common.read(spark, sf, "labels").where("toxic is not null").select("doc_id", F.when(F.col("toxic") > 0, "toxic").otherwise("clean").alias("domain"))
    mixed = mixing.mix(common.read(spark, sf, "documents"), labels, corpus_pipeline.TARGETS, anchor="clean").join(labels, "doc_id")
    share = {r["domain"]: r for r in mixed.groupBy("domain").agg(F.avg((F.col("rate") > 0.5).cast("int")).alias("kept"), F.avg("rate").alias("rate")).collect()}
    print(size, share)
    assert share["clean"]["kept"] >= kept and share["toxic"]["rate"] <= (1 if size == "sf0.001" else 0.5)
