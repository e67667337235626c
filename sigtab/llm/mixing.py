"""Mixing to target weights: soft domain membership by a naive Bayes table, and document rates by projected-gradient least squares."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtab.llm import common
from sigtab.llm.rules import words


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets))


def domain_table(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str = "domain", text: str = "text", key: str = "doc_id", *,
                 rows: int = 12_000, buckets: int = 1 << 18) -> tuple[DataFrame, float, list[float], DataFrame]:
    """(bucket, n, n0, n1 …: labelled texts that have the word bucket, all and of each domain), ``least``, the domains' shares, and the texts (k, d, w).

    Learned from at most about ``rows`` labelled rows, chosen by a hash of ``key``; of several labels of one key the first domain by name
    counts, of several texts of one key the one with the smallest hash. Only buckets that go with the domains have a row: a log-likelihood
    ratio G² of at least half of ``least``, twice the logarithm of the number of buckets in two texts or more; the full bound holds when texts are
    scored, for an example without its own counts.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(domain).isin(domains)).select(F.col(key).alias("k"), F.col(domain).alias("d"))
    chosen = common.stored(common.bounded(known, F.col("k"), rows).groupBy("k").agg(F.min("d").alias("d")), "examples")
    found = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(chosen), "k").withColumn("same", F.xxhash64("t"))  # at most about `rows` small rows
    one = found.groupBy("k").agg(F.min("same").alias("same"))
    texts = found.join(F.broadcast(one), ["k", "same"], "left_semi").groupBy("k", "same").agg(F.first("d").alias("d"), words(F.first("t")).alias("w"))
    texts = common.stored(texts.select("k", "d", "w"), "texts")
    counts = {r["d"]: r["n"] for r in texts.groupBy("d").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    seen = texts.select("d", F.explode(F.array_distinct("w")).alias("word")).select("d", _bucket(F.col("word"), buckets).alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("d") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    share = [(counts.get(d, 0) + 0.5) / (total + 0.5 * len(domains)) for d in domains]
    common.discard(chosen)
    counted = common.stored(seen.where("n > 1"), "counts")
    least = 2 * float(np.log(max(2, counted.count())))
    return counted.where(_ratio(F.col("n"), [F.col(f"n{i}") for i in range(len(domains))], share) >= least / 2), least, share, texts


def _ratio(n: Column, own: list[Column], share: list[float]) -> Column:
    """G²: how far a bucket's texts are from the domains' shares."""
    g = F.lit(0.0)
    for c, s in zip(own, share):
        g = g + F.when(c > 0, 2 * c * F.log(c / (n * s))).otherwise(0.0)
    return g


def _weights(n: Column, own: list[Column], share: list[float], prior: float, least: float) -> list[Column]:
    """The log ratio of each domain's share among texts with a bucket to its share among all, backed off to no ratio by ``prior`` texts; null below ``least``."""
    return [F.when((n > 0) & (_ratio(n, own, share) >= least), F.log((c + prior * s) / ((n + prior) * s))) for c, s in zip(own, share)]


def _summed(places: DataFrame, by: list[str], n: int) -> DataFrame:
    """s: for each domain log(1 + the sum of what a text's words speak for it), so that a few words count and many do not drown them."""
    met = places.groupBy(*by).agg(F.count("n").alias("copies"), F.max("n").cast("long").alias("tokens"), *[F.sum(F.greatest(F.lit(0.0), F.col(f"x{i}"))).alias(f"s{i}") for i in range(n)])
    score = [F.log1p(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) / F.col("copies")) for i in range(n)]
    return met.select(*by, "copies", "tokens", F.array(*score).alias("s"))


def scores(docs: DataFrame, table: DataFrame, least: float, share: list[float], text: str = "text", key: str = "doc_id", *, buckets: int = 1 << 18, prior: float = 4.0) -> DataFrame:
    """key, same (hash of the text), copies, tokens (words) and s (a score for each domain) for each distinct key and text.

    A text without a known word has scores of 0.
    """
    n = len(share)
    weights = table.select("bucket", *[w.alias(f"x{i}") for i, w in enumerate(_weights(F.col("n"), [F.col(f"n{i}") for i in range(n)], share, prior, least))]).where("x0 is not null")
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"), words(F.coalesce(text, F.lit(""))).alias("w"))
    places = texts.select("k", "same", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))  # -1 stands for the document
    hashed = places.select("k", "same", F.when(F.col("at") < 0, F.size("w")).alias("n"), F.when(F.col("at") >= 0, _bucket(F.get("w", F.col("at")), buckets)).alias("bucket"))
    met = hashed.join(F.broadcast(weights), "bucket", "left").where("n is not null or x0 is not null")  # a row for each bucket at most
    return _summed(met, ["k", "same"], n).withColumnRenamed("k", key)


def scores_by_others(texts: DataFrame, table: DataFrame, least: float, domains: list[str], share: list[float], *, buckets: int = 1 << 18, prior: float = 4.0) -> list[tuple[str, list[float]]]:
    """(domain, s) of each labelled text, scored by the counts of the other ones; as many as ``texts`` has rows, which is bounded."""
    n = len(domains)
    places = texts.select("k", "d", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    hashed = places.select("k", "d", F.when(F.col("at") < 0, F.size("w")).alias("n"), F.when(F.col("at") >= 0, _bucket(F.get("w", F.col("at")), buckets)).alias("bucket"))
    met = hashed.join(F.broadcast(table.withColumnRenamed("n", "all")), "bucket", "left").where("n is not null or all is not null")
    own = [F.col(f"n{i}") - F.when(F.col("d") == d, 1).otherwise(0) for i, d in enumerate(domains)]
    weighed = met.select("k", "d", "n", *[w.alias(f"x{i}") for i, w in enumerate(_weights(F.col("all") - 1, own, share, prior, least))])
    return [(r["d"], list(r["s"])) for r in _summed(weighed, ["k", "d"], n).orderBy("k").collect()]


def calibrate(examples: list[tuple[str, list[float]]], domains: list[str], share: list[float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Matrix and shift, so that softmax(matrix s + shift) is likeliest for the examples, and how much likelier (in logarithms) than their shares alone.

    Newton steps on the log-likelihood, which is concave; a faint pull towards no matrix keeps it finite. Mean posteriors then
    equal the domains' shares of the examples. Examples are as many as the labelled sample, which is bounded.
    """
    d = len(domains)
    start = np.concatenate([np.zeros(d * d), np.log(share)])
    if not examples:
        return np.zeros((d, d)), np.log(share), 0.0
    s, known = np.array([x for _, x in examples], float), np.array([domains.index(x) for x, _ in examples])
    inputs = np.concatenate([s, np.ones((len(s), 1))], axis=1)
    ridge = np.concatenate([np.full(d * d, 0.1), np.full(d, 1e-6)])

    def value(a):
        logits = s @ a[: d * d].reshape(d, d).T + a[d * d :]
        logits = logits - logits.max(axis=1, keepdims=True)
        whole = np.exp(logits).sum(axis=1, keepdims=True)
        loss = (np.log(whole[:, 0]) - logits[np.arange(len(s)), known]).sum()
        return loss + (ridge * (a - start) ** 2).sum() / 2, np.exp(logits) / whole, loss

    def laid(m):  # (d, d + 1) to the order of the parameters
        return np.concatenate([m[:, :d].ravel(), m[:, d]])

    place = laid(np.arange(d * (d + 1)).reshape(d, d + 1)).astype(int)
    at = start
    now, p, base = value(at)
    while True:
        slope = laid((p - np.eye(d)[known]).T @ inputs) + ridge * (at - start)
        curve = np.zeros((d, d + 1, d, d + 1))
        for i in range(d):
            for j in range(d):
                curve[i, :, j, :] = (inputs * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ inputs
        curve = curve.reshape(d * (d + 1), d * (d + 1))[np.ix_(place, place)] + np.diag(ridge)
        step, part = -np.linalg.solve(curve, slope), 1.0
        there, q, loss = value(at + step)
        while there > now and part > 1e-9:
            part /= 2
            there, q, loss = value(at + part * step)
        if not now - there > 1e-9 * max(1.0, now):
            return at[: d * d].reshape(d, d), at[d * d :], base - value(at)[2]
        at, now, p = at + part * step, there, q


def softmax(s: Column, matrix, shift) -> Column:
    logits = []
    for row, x in zip(matrix, shift):
        logit = F.lit(float(x))
        for i, m in enumerate(row):
            logit = logit + F.lit(float(m)) * F.get(s, F.lit(i))
        logits.append(logit)
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    e = F.transform(F.array(*[x - top for x in logits]), lambda x: F.exp(x))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def fit_rates(members: DataFrame, targets: list[float], *, tolerance: float = 1e-3, left_out: float = 0.4) -> tuple[DataFrame, list[float]]:
    """Add rate to ``members`` (copies, tokens, p), so that the expected tokens of each domain, sum of copies * tokens * rate * p, match ``targets``.

    Projected-gradient least squares from rates of 1: each step moves a document's rate along its memberships p, by one multiplier for each
    domain, and puts negative rates to 0. The gradient (deviations from the targets) is preconditioned by the domain by domain products of
    the documents that are above 0; where nothing is put to 0 one step meets all targets with the least change, so rates stay as
    near 1 as the targets let them. A step that does not lower the squared deviations, or would put more than a share ``left_out`` of all tokens
    to 0, is cut to a quarter. Steps end when every domain is within ``tolerance`` of
    its target (of a thousandth of all tokens for smaller ones), or when no step lowers the squares by a hundredth: then no nonnegative rates come
    closer, or only such that leave out most of the table. Each step is one sum over all rows. Also returns the totals reached. Without any token all rates are 1.
    """
    n, mass = len(targets), F.col("copies") * F.col("tokens")
    whole = members.agg(F.coalesce(F.sum(mass), F.lit(0)).cast("double")).first()[0]
    if not whole:
        return members.withColumn("rate", F.lit(1.0)), [0.0] * n
    goal = np.array(targets, float) / whole
    allowed = tolerance * np.maximum(goal, 1e-3)

    def p(i):
        return F.get("p", F.lit(i))

    def moved(rate: Column, a) -> Column:
        for i in range(n):
            rate = rate + p(i) * F.lit(float(a[i]))
        return F.greatest(F.lit(0.0), rate)

    def sums(rate: Column):
        """Totals, products of the rows above 0, and what is at 0, as shares of all tokens."""
        rated = members.select(mass.alias("m"), rate.alias("rate"), "p")
        above = F.when(F.col("rate") > 0, F.col("m")).otherwise(0)
        row = rated.agg(F.sum(F.when(F.col("rate") > 0, 0).otherwise(F.col("m"))), *[F.sum(F.col("m") * F.col("rate") * p(i)) for i in range(n)], *[F.sum(above * p(i) * p(j)) for i in range(n) for j in range(n)]).first()
        got = np.array(row, float) / whole
        return got[1 : 1 + n], got[1 + n :].reshape(n, n), got[0]

    rate = F.lit(1.0)
    totals, gram, _ = sums(rate)
    squares = lambda t: (((t - goal) / np.maximum(goal, 1e-3)) ** 2).sum()
    while (np.abs(totals - goal) > allowed).any():
        step, part = np.linalg.lstsq(gram, goal - totals, rcond=1e-10)[0], 1.0
        best = None
        while part > 1e-3:
            there = sums(moved(rate, part * step))
            if squares(there[0]) < squares(totals) and there[2] <= left_out:
                best = there
                break
            part /= 4
        if best is None:
            break
        gain = squares(best[0]) < 0.99 * squares(totals)
        rate, totals, gram = moved(rate, part * step), *best[:2]
        if not gain:
            break
    return members.withColumn("rate", rate), (totals * whole).tolist()


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "domain", text: str = "text", key: str = "doc_id", *, anchor: str | None = None, rows: int = 12_000) -> DataFrame:
    """key, same (hash of the text), copies, tokens, p (map from domain to posterior) and rate for each distinct key and text.

    ``targets`` are the domains' wanted shares of all tokens; they need not add up to 1. The total is that of the table, or with an ``anchor``
    what leaves this domain as large as it is. ``labels`` (key, domain) is the labelled table the classifier learns from; posteriors are
    calibrated on its texts, each scored by the others. The result's attributes ``wanted`` and ``reached`` map domains to expected tokens,
    ``left_out`` is the share of documents with rate 0 and ``largest`` the largest rate; a gap that no rates close is warned of. Where the
    words tell the labels apart no better than chance all rates are 1, which is warned of too.
    Null texts count as empty and weigh nothing.
    """
    domains = sorted(targets)
    table, least, share, texts = domain_table(docs, labels, domains, domain, text, key, rows=rows)
    matrix, shift, gain = calibrate(scores_by_others(texts, table, least, domains, share), domains, share)
    common.discard(texts)
    scored = scores(docs, table, least, share, text, key)
    members = common.stored(scored.select(key, "same", "copies", "tokens", softmax(F.col("s"), matrix, shift).alias("p")), "members")
    mass = F.col("copies") * F.col("tokens")
    sizes = members.agg(F.coalesce(F.sum(mass), F.lit(0)).cast("double").alias("all"), *[F.coalesce(F.sum(mass * F.col("p")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(domains))]).first()
    whole = sum(targets.values())
    unit = sizes["all"] / (whole or 1.0) if anchor is None else sizes[1 + domains.index(anchor)] / targets[anchor]
    wanted = [unit * targets[d] for d in domains]
    told_apart = gain > len(domains) ** 2  # likelier by more than as many numbers give by chance
    if told_apart:
        rated, reached = fit_rates(members, wanted)
        told = rated.agg(F.coalesce(F.avg((F.col("rate") <= 0).cast("int")), F.lit(0.0)), F.coalesce(F.max("rate"), F.lit(1.0))).first()
    else:
        rated, reached, told = members.withColumn("rate", F.lit(1.0)), [sizes[1 + i] for i in range(len(domains))], (0.0, 1.0)
        warnings.warn("the labels tell the domains not apart; all rates are 1", stacklevel=2)
    out = rated.withColumn("p", F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), "p"))
    out.wanted, out.reached, out.left_out, out.largest = dict(zip(domains, wanted)), dict(zip(domains, reached)), told[0], told[1]
    missed = [f"{d} {t:.0f} of {w:.0f}" for d, w, t in zip(domains, wanted, reached) if abs(t - w) > 1e-3 * max(w, 1e-3 * sizes["all"])]
    if missed and told_apart:
        warnings.warn(f"no rates meet all targets; expected tokens: {', '.join(missed)}", stacklevel=2)
    return out


def domains_of(labels: DataFrame) -> DataFrame:
    """The table ``labels`` (doc_id, quality, toxic) as doc_id and domain: toxic, low (quality 0) or clean; rows without both labels go."""
    named = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") < 1, "low").otherwise("clean")
    return labels.where("toxic is not null and quality is not null").select("doc_id", named.alias("domain"))
