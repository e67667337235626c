"""Best-fit packing of tokenized documents in bulk-synchronous rounds."""

from __future__ import annotations

import gc
import re
import struct
import sys
import types
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtab.llm import common

_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_END = b"\0\0\0\0"


def _of(kind: str) -> str:
    """The characters below U+0180 of a Unicode category, escaped for a set."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_LETTERS, _DIGITS = _of("L"), _of("N")
_BLANKS = "".join(re.escape(chr(c)) for c in range(0x180) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
#: How the tokenizer's file cuts a text into parts, for characters below U+0180; the second one for texts without an apostrophe.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+").findall
_PLAIN_PARTS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+").findall
_HIGH = re.compile("[^\x00-\u017f]").search
#: Python alone takes these for blanks, or other libraries alone.
_ODD = re.compile("[\x1c-\x1f\u180e\u200b\ufeff]").search


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte: printable ones for themselves, the rest in order from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, the same as the tokenizer's own.

    The tokenizer never looks beyond a blank, so each distinct word between blanks is looked up whole and encoded once. Merges never cross the
    parts that the tokenizer's pattern cuts; below U+0180 lower-casing needs no context and nothing composes, so new words are cut
    here into parts, each of them encoded once. Words with other characters go to the tokenizer as they are, as do texts with its
    special tokens or odd blanks. At most 2 * ``most`` words and parts each are kept: a full table becomes the older one,
    and what is met again moves on to the new one, so that frequent words stay.
    """

    def __init__(self, path: str, most: int = 300_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.letters = Tokenizer.from_file(path), most, _byte_letters()
        self.parts, self.words, self.old_parts, self.old_words = {}, {}, {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isalpha() else "".join([self.letters[b] for b in part.encode()])
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _low(self, word: str) -> bytes:
        low = word.lower()
        found = (low,) if low.isascii() and low.isalpha() else (_PARTS if "'" in low else _PLAIN_PARTS)(low)
        known = self.parts
        for x in found:
            if x not in known:
                ids = self.old_parts.get(x)
                known[x] = self._part(x) if ids is None else ids
        return known[found[0]] if len(found) == 1 else b"".join([known[x] for x in found])

    def encode(self, text: str) -> bytes:
        if _ODD(text) or "<|" in text and any(x in text for x in _SPECIAL):
            return self._whole(text)
        if len(self.words) > self.most:
            self.words, self.old_words = {}, self.words
        if len(self.parts) > self.most:
            self.parts, self.old_parts = {}, self.parts
        if text.isascii() or not _HIGH(text):
            text = text.lower()
        words, known = text.split(), self.words
        out = list(map(known.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            ids = known.get(w) or self.old_words.get(w)
            if ids is None:
                ids = self._whole(w) if _HIGH(w) else self._low(w)
            if len(w) <= 200:
                known[w] = ids
            out[k] = ids
        return b"".join(out)


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process and path; it stays for later tasks."""
    kept = sys.modules.setdefault("_sigtab_worker", types.ModuleType("_sigtab_worker"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path)
    return kept.encoder


def pieces(docs: DataFrame, path: str, room: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32 and item (a number of its own) for each piece of at most ``room`` tokens of every row.

    A null text counts as empty; every document ends with the id 0, so it has a piece.
    """

    def cut(batches):
        item, encoder = TaskContext.get().partitionId() << 40, _encoder(path)
        gc.freeze()  # the encoder's tables hold no cycles
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                rows, places, lengths, sums = [], [], [], []
                for k, t in enumerate(some.column(text).to_pylist()):
                    ids = memoryview(encoder.encode(t or "") + _END)
                    for start in range(0, len(ids), 4 * room):
                        part = ids[start : start + 4 * room]
                        rows.append(k)
                        places.append(start // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                places = np.array(places, np.int64)
                yield pa.RecordBatch.from_arrays([some.column(key).take(pa.array(rows)), pa.array((places // room).astype(np.int32)), pa.array(places), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(item + np.arange(len(rows)))],
                                                 names=[key, "piece", "start", "length", "ids_crc32", "item"])
                item += len(rows)

    return docs.select(key, text).mapInArrow(cut, common.with_columns(docs, [key], {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "item": "long"}))


def _sweep(batches):
    """Walk from large to small through places and items: an item takes the latest place that is still free.

    Emits matched items (state 0), then what is left, numbered: items that found no place (1), and places (2) from the last on;
    last a row (3) with how many of both are left.
    """
    part, free, state, ids, bins, length, rank, waiting = TaskContext.get().partitionId(), [], [], [], [], [], [], 0

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(state, pa.int32()), pa.array(ids, pa.int64()), pa.array(bins, pa.int64()), pa.array(length, pa.int64()), pa.array(rank, pa.int64())],
                                           names=["part", "state", "item", "bin", "length", "rank"])
        for column in (state, ids, bins, length, rank):
            column.clear()
        return batch

    for batch in batches:
        for size, is_item, name in zip(*(batch.column(c).to_pylist() for c in ("size", "is_item", "name"))):
            if not is_item:
                free.append(name)
                continue
            found = bool(free)
            state.append(0 if found else 1)
            ids.append(name)
            bins.append(free.pop() if found else None)
            length.append(size)
            rank.append(None if found else waiting)
            waiting += not found
        yield out()
    for at in range(0, len(free), 100_000):
        some = free[::-1][at : at + 100_000]
        state += [2] * len(some)
        ids += [None] * len(some)
        bins += some
        length += [None] * len(some)
        rank += range(at, at + len(some))
        yield out()
    state.append(3)
    ids.append(None)
    bins.append(None)
    length.append(waiting)
    rank.append(len(free))
    yield out()


def _across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (part, waiting items, free places) in order of falling size: (part, first item, end, part of the places, first place) runs."""
    stack, runs = [], []
    for part, items, places in left:
        done = 0
        while done < items and stack:
            other, first, count = stack.pop()
            n = min(count, items - done)
            runs.append((part, done, done + n, other, first))
            done += n
            if n < count:
                stack.append((other, first + n, count - n))
        if places:
            stack.append((part, 0, places))
    return runs


def _match(items: DataFrame, gaps: DataFrame, events: int, largest: int, smallest: int, per_task: int):
    """One sweep: (matched: item, bin, length; the rest: item, length), both read from its one written table. A gap offers as many places of ``largest`` as fit, the last with the rest."""
    spark = items.sparkSession
    fits = F.greatest(F.lit(1), F.floor(F.col("gap") / largest)).cast("int")
    places = gaps.where(F.col("gap") >= smallest).select("bin", "gap", fits.alias("n")).select(
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"), "bin", "gap", "n").select(
        F.when(F.col("k") < F.col("n"), F.lit(largest)).otherwise(F.col("gap") - (F.col("n") - 1) * largest).cast("long").alias("size"), F.lit(False).alias("is_item"), F.col("bin").alias("name"), "k")
    both = places.unionByName(items.select(F.col("length").alias("size"), F.lit(True).alias("is_item"), F.col("item").alias("name"), F.lit(0).alias("k")))
    parts = max(1, -(-events // per_task))
    order = [F.desc("size"), F.asc("is_item"), F.asc("name"), F.asc("k")]
    swept = both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep, "part int, state int, item long, bin long, length long, rank long")
    swept = common.stored(swept, "swept")
    left = swept.where("state = 3").select("part", "length", "rank").collect()  # a row for each task of the sweep
    runs = _across(sorted((r["part"], r["length"], r["rank"]) for r in left))
    matched = swept.where("state = 0").select("item", "bin", "length")
    waiting = swept.where("state = 1").select("part", "item", "length", "rank")
    if not runs:
        return matched, waiting.select("item", "length")
    table = spark.createDataFrame(runs, "part int, low long, high long, other int, first long")  # two for each task of the sweep at most
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    found = waiting.join(F.broadcast(table), "part").where(inside).select("item", "length", F.col("other").alias("p"), (F.col("first") + F.col("rank") - F.col("low")).alias("r"))
    free = swept.where("state = 2").select(F.col("part").alias("p"), F.col("rank").alias("r"), "bin")
    ends = table.groupBy("part").agg(F.max("high").alias("taken"))
    rest = waiting.join(F.broadcast(ends), "part", "left").where(F.col("rank") >= F.coalesce("taken", F.lit(0))).select("item", "length")
    return matched.unionByName(found.join(free, ["p", "r"]).select("item", "bin", "length")), rest


def best_fit(items: DataFrame, room: int = 2048, per_task: int = 200_000) -> DataFrame:
    """item, bin and turn (its place among the items of the bin) for items (item, length from 1 to ``room``), in as few bins as best fit finds.

    Sizes are worked off by class, largest first: over half the room, over a third, over a quarter,
    then by halves down to a 32nd, then all the rest. In each round items
    of the class and gaps are range-sorted together; a sweep in every range gives each item the smallest place that is free and fits,
    and what is left over is matched between ranges by rank. Gaps shrink, and rounds repeat until no item of the class finds a place;
    for the rest as many empty bins open as their tokens need.
    """
    spark = items.sparkSession
    fitting = F.floor(F.lit(room) / F.col("length")).cast("int")
    grade = F.when(fitting < 4, fitting).otherwise(F.least(F.lit(7), F.floor(F.log2(fitting.cast("double")) + 1e-9).cast("int") + 2))
    items = common.stored(items.select("item", "length", grade.alias("grade")), "items")
    known = {r["grade"]: r for r in items.groupBy("grade").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("largest"), F.min("length").alias("smallest")).collect()}
    placed = []
    floor = min((r["smallest"] for r in known.values()), default=1)
    gaps = stored = common.stored(items.where("grade = 1").select(F.col("item").alias("bin"), (F.lit(room) - F.col("length")).alias("gap")).where(F.col("gap") >= floor), "gaps")
    opened, turn = 0, 0
    for k in sorted(set(known) - {1}):
        n, largest, smallest = known[k]["n"], known[k]["largest"], known[k]["smallest"]
        waiting, tokens = items.where(F.col("grade") == k).select("item", "length"), known[k]["tokens"]
        offers = gaps.where(F.col("gap") >= smallest).count()
        while n:
            if not offers:
                offers = -(-tokens // room)
                fresh = spark.range(opened + 1, opened + 1 + offers).select((-F.col("id")).alias("bin"), F.lit(room).cast("long").alias("gap"))
                gaps, opened = gaps.unionByName(fresh), opened + offers
            turn += 1
            matched, waiting = _match(waiting, gaps, n + offers, largest, smallest, per_task)
            matched = common.stored(matched.withColumn("round", F.lit(turn)), "placed")
            shrunk = gaps.unionByName(matched.select("bin", (-F.col("length")).alias("gap"))).groupBy("bin").agg(F.sum("gap").alias("gap"))
            gaps, old = common.stored(shrunk.where(F.col("gap") >= floor), "gaps"), stored
            common.discard(old)
            stored = gaps
            placed.append(matched._stored_at)
            sizes = waiting.select("length", F.lit(None).cast("long").alias("gap")).unionByName(gaps.where(F.col("gap") >= known[k]["smallest"]).select(F.lit(None).cast("long").alias("length"), "gap"))
            left = sizes.agg(F.count("length").alias("n"), F.sum("length").alias("tokens"), F.max("length").alias("largest"), F.min("length").alias("smallest"), F.count("gap").alias("offers"), F.max("gap").alias("gap")).first()
            n, tokens, largest, smallest = left["n"], left["tokens"], left["largest"], left["smallest"]
            offers = left["offers"] if n and left["gap"] and left["gap"] >= smallest else 0
    first = items.where("grade = 1").select("item", F.col("item").alias("bin"), F.lit(0).alias("round"))
    return first.unionByName(spark.read.schema("item long, bin long, round int").parquet(*placed)) if placed else first


def pack(docs: DataFrame, path: str, room: int = 2048, text: str = "text", key: str = "doc_id", per_task: int = 200_000) -> DataFrame:
    """The pieces of all documents with sequence_id and offset: key, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``room`` tokens are cut. Offsets within a sequence have no gap. Repeated rows are packed each;
    an empty table gives an empty result.
    """
    cut = common.stored(pieces(docs, path, room, text, key), "pieces")
    full = F.col("length") == room
    where = common.stored(best_fit(cut.where(~full).select("item", "length"), room, per_task), "bins")
    rest = cut.where(~full).join(where, "item")
    all_ = cut.where(full).select("*", F.col("item").alias("bin"), F.lit(0).alias("round")).unionByName(rest)
    before = Window.partitionBy("bin").orderBy("round", "item").rowsBetween(Window.unboundedPreceding, -1)  # a bin has at most `room` items
    return all_.select(key, "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
