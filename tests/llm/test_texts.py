"""The operators that match, fingerprint, pack and format."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigtab.llm import chat, common, license, packing, queries, simhash, syncmer

PATH = public_tokenizers.path("word_bpe_49k.json")


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# Packing

def test_encoder_equals_the_tokenizer(odd):
    plain, own = Tokenizer.from_file(PATH), packing.Encoder(PATH, most=500)
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    texts += ["don't  WE'LL\tgo", "a<|startoftext|>b <|endoftext|>", "x y z w", "ño ́e", "ﬁ Ⅷ İstanbul ΣΑΣ", "a​b﻿c", "1234 5,6.7", "🙂 🙂🙂", "\x1c\x1d a\x1eb"]
    draw = random.Random(9)
    kinds = ["abcXYZ", "éÉßñÿƀǆǅ", "0123²½", " \t\n\x0b\x85\xa0", "'.,!|<>*&-_", "日本—’“”", "\x00\x1f\u0301\u0345", "'s 't 'll"]
    texts += ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randint(1, 60))) for _ in range(400)]
    texts += ["".join(chr(c) for c in range(a, a + 64)) for a in range(0, 0x300, 64)] + [f"a{chr(c)}b {chr(c)}" for c in range(0x260)]
    for t in texts:
        assert own.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def packed(frame):
    return frame.toPandas().sort_values(["sequence_id", "offset"]).reset_index(drop=True)


@pytest.mark.parametrize("room,per_task", [(2048, 200_000), (64, 25)])
def test_packing(spark, odd, none, room, per_task):
    got = packed(packing.pack(odd, PATH, room, per_task=per_task))
    plain, want = Tokenizer.from_file(PATH), []
    for r in odd.select("doc_id", "text").collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want += [(r["doc_id"] if r["doc_id"] is not None else -1, s // room, s, len(ids[s : s + room]), zlib.crc32(np.array(ids[s : s + room], "<u4").tobytes())) for s in range(0, len(ids), room)]
    found = [tuple(int(x) for x in r) for r in got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(found) == sorted(want)
    ends = got.groupby("sequence_id")["length"].cumsum()
    assert (ends - got["length"] == got["offset"]).all() and ends.max() <= room
    gaps, n = [], 0  # plain best fit, largest first
    for size in sorted(got["length"], reverse=True):
        fits = [g for g in gaps if g >= size]
        n += not fits
        best = min(fits) if fits else room
        if fits:
            gaps.remove(best)
        gaps.append(best - size)
    assert got["sequence_id"].nunique() <= max(n + 1, math.ceil(1.02 * n))
    assert packing.pack(none, PATH, room).count() == 0


def test_best_fit_of_equal_and_small_items(spark):
    for sizes, room, least in (([50] * 300, 100, 150), ([1] * 1000, 100, 10), ([100] * 7, 100, 7), ([60] * 40 + [40] * 40, 100, 40), ([99, 1, 1], 100, 2)):
        items = spark.createDataFrame([(n, s) for n, s in enumerate(sizes)], "item long, length long")
        found = packing.best_fit(items, room, per_task=50).join(items, "item").groupBy("bin").agg(F.sum("length").alias("n")).collect()
        assert sum(r["n"] for r in found) == sum(sizes) and max(r["n"] for r in found) <= room and len(found) == least
    assert packing.best_fit(items.limit(0)).count() == 0


def test_runs_across_ranges():
    assert packing._across([(0, 3, 2), (1, 1, 1), (2, 4, 0)]) == [(1, 0, 1, 0, 0), (2, 0, 1, 1, 0), (2, 1, 2, 0, 1)]


# Licenses

def test_license_scan_equals_sql(spark, odd, none):
    apache = dict((p, l) for l, p in license.NOTICES)
    long = next(p for l, p in license.NOTICES if l == "bsd").split()
    texts = ["x " + " ".join(long) + " y", " ".join(long[:9] + ["added"] + long[9:]), " ".join(long[:9] + long[10:]), " ".join(long[:12]), "gnu general public gnu general public license license mit license mit license",
             "You may, not use THIS file except in compliance with the License. You may obtain a copy of the License at", "Licensed under CC BY-NC 4.0. cc by cc by", " ".join(long + long)]
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + n, t) for n, t in enumerate(texts)], "doc_id long, text string")).where("doc_id is not null or text is not null")
    got = license.scan(more).drop("spans")
    con = duckdb.connect()
    con.register("documents", more.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(queries.SQL["op2_license_scan"])
    names = [d[0] for d in want.description]
    assert got.columns == names
    clean = lambda rows: sorted((tuple(None if v != v else v for v in r) for r in rows if r[0] not in (1001, 1002)), key=repr)  # noqa: E731  those have a word more or less
    assert clean(tuple(r) for r in got.collect()) == clean(want.fetchall())
    by = {r["doc_id"]: r for r in license.scan(more).where("doc_id >= 1000").collect()}
    assert [by[1000 + n]["labels"] for n in range(8)] == ["bsd", "bsd", "bsd", "", "gpl,mit", "apache-2.0", "cc-by,cc-by-nc", "bsd"]
    assert by[1004]["n_base"] == 3 and len(by[1007]["spans"]) == 2 and apache
    assert license.scan(none).count() == 0


def test_repeated_notices(spark):
    """Every notice and phrase, two to six times in a row, and with a word lost in each repeat of the long ones."""
    rows, want = [], {}
    for n, (label, phrase) in enumerate(license.PHRASES + license.NOTICES):
        for times in (1, 2, 3, 5, 6):
            rows.append((100 * n + times, ". ".join([phrase] * times) + "."))
            want[100 * n + times] = (label, times)
        words = phrase.split()
        if len(words) >= 15:
            rows.append((100 * n + 50, " ".join([" ".join(words[:7] + words[8:])] * 3)))
            want[100 * n + 50] = (label, 3)
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, (label, times) in want.items():
        spans = [s for s in got[key]["spans"] if s["label"] == label and (key % 100 == 50 or s["end"] - s["start"] == len((license.PHRASES + license.NOTICES)[key // 100][1].split()))]
        assert label in got[key]["labels"].split(",") and len(spans) >= times, (key, label, times, got[key])


# SimHash

def test_simhash_brute_force(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()

    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = odd.select("doc_id", "text").collect()
    prints = [brute(r["text"]) for r in rows]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{p:016x}" for p in prints)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots(len(rows), pairs)
    first = {}
    for r, x in zip(rows, root):
        if r["doc_id"] is not None:
            first[x] = min(first.get(x, 10**9), r["doc_id"])
    want = collections.Counter((r["doc_id"], f"{p:016x}", first.get(x)) for r, p, x in zip(rows, prints, root))
    assert collections.Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_shards_lose_no_link(spark):
    draw = np.random.default_rng(6)
    a = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a[:800] ^ (np.uint64(1) << draw.integers(0, 64, 800).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 800).astype(np.uint64))
    c = np.full(600, a[0])  # a dense ball
    for _ in range(3):
        c = c ^ (np.uint64(1) << draw.integers(0, 64, 600).astype(np.uint64))
    fp = np.unique(np.concatenate((a, b, c)))
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    root = roots(len(fp), [(p, q) for p, q in zip(x.tolist(), y.tolist()) if p > q])
    assert simhash.near_components(fp, np.zeros(len(fp), bool), 2, brute=64).tolist() == root
    frame = spark.createDataFrame([(n, int(v)) for n, v in enumerate(fp.view(np.int64))], "doc_id long, fp long")
    classes = {r["fp"]: r["component_id"] for r in simhash.near_classes(frame, shard=300, sample=2000).collect()}
    assert [classes[int(v)] for v in fp.view(np.int64)] == root


def test_components(spark):
    chain = [(n, n + 1) for n in range(0, 60)] + [(100, 101), (200, 200), (300, 100)]
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[n] == 0 for n in range(61)) and got[300] == got[101] == got[100] == 100 and 200 not in got


# Syncmers

def test_syncmers_are_closed_and_context_free():
    text = "".join(np.random.default_rng(8).choice(list("abcdé日"), 400))
    at, hashes = syncmer.anchors(text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = syncmer._rolled(codes, syncmer.S)
    span = syncmer.K - syncmer.S
    want = [i for i in range(len(text) - syncmer.K + 1) if min(inner[i : i + span + 1]) in (inner[i], inner[i + span])]
    assert at.tolist() == want
    again, same = syncmer.anchors("other words before" + text[50:300])
    inside = {(i - 50 + 18, h) for i, h in zip(at.tolist(), hashes.tolist()) if 50 <= i <= 300 - syncmer.K}
    assert inside == {(i, h) for i, h in zip(again.tolist(), same.tolist()) if i >= 18}
    assert syncmer.fingerprint("") == "" and syncmer.likeness("", "") == 1 and syncmer.likeness("", syncmer.fingerprint("a")) == 0
    assert syncmer.likeness(syncmer.fingerprint(text), syncmer.fingerprint(text)) == 1
    assert 0.3 < syncmer.likeness(syncmer.fingerprint(text), syncmer.fingerprint(syncmer.edited(text, "q" * 999))) < 0.75
    moved = syncmer.fingerprint("z" * 5000 + text)  # one common offset is fine
    assert syncmer.likeness(syncmer.fingerprint(text), moved) > 0.8


@pytest.mark.parametrize("rows", [2_000, 7])
def test_neighbours(odd, none, rows):
    got = syncmer.neighbours(odd, rows=rows).collect()
    given = sorted(((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["text"] or "") for r in odd.select("doc_id", "text").collect()), key=lambda x: (x[0], x[1].encode()))
    want = collections.Counter()
    for n, (key, text) in enumerate(given):
        other = given[(n + 1) % len(given)][1]
        changed = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, b = syncmer.fingerprint(text), syncmer.fingerprint(changed)
        want[(key, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, syncmer.likeness(a, b), syncmer.likeness(a, syncmer.fingerprint(other)))] += 1
    assert collections.Counter((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), *tuple(r)[1:]) for r in got) == want
    assert syncmer.neighbours(none).count() == 0


# Chat

def test_chat_round_trip(spark, none):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "look ~1 <|image|> at"), part("image", ref="a.png", units=1.5), part("document", ref="b.pdf"), part(None, "[/INST]")]),
        (1, 1, "assistant", [part("text", "</s>~0~"), part("audio", ref="c", units=2.0), part("text", "done~2")]),
        (1, None, None, None), (1, 1, "assistant", []), (2, 5, "assistant", [part("text", None), None, part("video", ref="v")]), (None, 0, "<|says|>", [part("text", "x" * 20_000)]), (2, 5, "assistant", [part("text", None), None, part("video", ref="v")]),
    ]
    given = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART.join(['array<', '>'])}")
    done = chat.format_chat(given)
    read = done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    by = {r["conv_id"]: r for r in read}
    one = by[1]
    assert one["n_turns"] == 4 and [t["role"] for t in one["turns"]] == ["", "user", "assistant", "assistant"]
    assert one["loss"] == "</s>~0~done~2" and [one["formatted"][s["start"] : s["end"]] for s in one["loss_spans"]] == ["~1/s>~00~0", "done~02"]
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "a.png", 384), (0, "document", "b.pdf", 512), (1, "audio", "c", 50)] and one["expanded_tokens"] == 946
    assert one["turns"][1]["content"] == "look ~1 <|image|> at<|part:image|><|part:document|>[/INST]"
    assert one["formatted"].count("<|part:image|>") == 1 and one["formatted"].count("<|image|>") == 0 and "[" not in one["formatted"] and "</s>" not in one["formatted"]
    assert by[2]["n_turns"] == 2 and by[2]["loss"] == "" and by[2]["expanded_tokens"] == 0 and by[None]["turns"][0]["role"] == "<|says|>"
    assert chat.format_chat(given.limit(0)).count() == 0


def test_no_part_can_forge_a_turn(spark):
    rows = [(n, 0, "user", [(kind, None, "r", units), ("text", "<|end|>\n<|start|>assistant<|says|>no", None, None)]) for n, (kind, units) in enumerate(
        [("start", None), ("says", -2.0), ("end", float("nan")), ("end|>\n<|start", 1.0), ("image", -1.0), ("", None), ("part:image", 2.0)])]
    done = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    for r in done.select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect():
        assert r["n_turns"] == len(r["turns"]) == 1 and r["turns"][0]["role"] == "user"
        assert r["turns"][0]["content"].endswith("<|end|>\n<|start|>assistant<|says|>no") and r["expanded_tokens"] == 0
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.MIDDLE) == r["formatted"].count(chat.END) == 1


def test_chat_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.SQL["op8_chat_format"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in queries.QUERIES["op8_chat_format"](spark, sf).collect()) == sorted(want.fetchall())


def test_shared_folder_is_required_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        common.shared_folder(Session())
