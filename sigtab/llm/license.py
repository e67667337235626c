"""License scan by diagonal voting of word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases that name a license, and words of well-known notices.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case. The Kelvin sign, whose small letter is an ASCII k, is kept apart first."""
    split = F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b"))), SEPARATORS)
    first = F.when(split[0] == "", 2).otherwise(1)  # only the first and the last can be empty
    return F.slice(split, first, F.greatest(F.lit(0), F.size(split) + 1 - first - F.when(F.element_at(split, -1) == "", 1).otherwise(0)))


def _templates(spark: SparkSession, k: int, base: bool):
    rows = [(n, label, phrase, base) for n, (label, phrase) in enumerate(PHRASES if base else NOTICES, 0 if base else len(PHRASES))]
    table = spark.createDataFrame(rows, "template int, label string, phrase string, base boolean").withColumn("ws", F.split("phrase", " "))
    at = table.select("template", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - k)).alias("tpos"))
    gram = F.slice("ws", F.col("tpos") + 1, k)
    hashed = at.select(F.xxhash64(*[F.get(gram, F.lit(i)) for i in range(k)]).alias(f"h{k}"), F.struct("template", "tpos", F.lit(k).alias("k"), F.array_join(gram, " ").alias("gram")).alias("m"))
    return table, hashed.groupBy(f"h{k}").agg(F.collect_list("m").alias(f"m{k}"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", *, drift: int = 3, covered: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """One row for each distinct key and text: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Each rolling pair and triple of words meets the templates (a fixed list, broadcast) by its hash, and is compared word by word.
    Matches of a template vote for a diagonal, the word at which the template would begin. A phrase stands where all its pairs vote
    for one diagonal. A notice stands where the triples of one diagonal cover a share ``covered`` of its words; so each of any number of
    repeats in a row counts. Other diagonals of a notice, up to ``drift`` words (at most half the notice) apart, are merged, as words may be missing
    or added, and the span counts if the matched triples together cover that share within ``stretch`` times its length.
    score is the largest such share (1 for a phrase), 0 without any. ``spans`` are struct(label, start, end), in words, end excluded.
    A null or empty text has no word. Repeated rows count once; rows of one key with different texts stay apart.
    """
    spark = docs.sparkSession
    phrases, pairs = _templates(spark, 2, True)
    notices, triples = _templates(spark, 3, False)
    known = phrases.unionByName(notices).select("template", "label", "base", F.size("ws").alias("length"))
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"), words(F.coalesce(text, F.lit(""))).alias("w"))
    rows = texts.select("key", "same", "w", F.size("w").alias("n"), F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))  # -1 stands for the document
    w = [F.get("w", F.col("at") + i) for i in range(3)]
    hashed = rows.withColumn("h2", F.xxhash64(w[0], w[1])).withColumn("h3", F.xxhash64(*w))
    met = hashed.join(F.broadcast(pairs), "h2", "left").join(F.broadcast(triples), "h3", "left").where((F.col("at") == -1) | F.col("m2").isNotNull() | F.col("m3").isNotNull())
    none = F.array().cast("array<struct<template:int,tpos:int,k:int,gram:string>>")
    real = F.filter(F.concat(F.coalesce("m2", none), F.coalesce("m3", none)), lambda m: (F.col("at") >= 0) & (m["gram"] == F.array_join(F.slice("w", F.col("at") + 1, m["k"]), " ")))
    votes = met.select("key", "same", "n", "at", F.explode_outer(real).alias("m")).where((F.col("at") == -1) | F.col("m").isNotNull())
    diagonal = votes.groupBy("key", "same", "m.template", (F.col("at") - F.col("m.tpos")).alias("begin")).agg(F.max("n").alias("n"), F.collect_set("m.tpos").alias("tpos"))
    placed = diagonal.join(F.broadcast(known), "template", "left")
    k = F.when(F.col("base"), 2).otherwise(3)

    def share_of(tpos: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(tpos, lambda t: F.sequence(t, t + k - 1))))) / F.col("length")

    placed = placed.withColumn("alone", F.col("base") | F.coalesce(share_of(F.col("tpos")) >= covered, F.lit(False)))  # a place of its own
    by = Window.partitionBy("key", "same", "template", "alone").orderBy("begin")
    near = F.least(F.lit(drift), F.floor((F.col("length") - 1) / 2))
    apart = F.col("alone") | F.coalesce(F.col("begin") - F.lag("begin").over(by) > near, F.lit(True))
    islands = placed.withColumn("island", F.struct("alone", F.sum(F.when(apart, 1).otherwise(0)).over(by)))
    spans = islands.groupBy("key", "same", "template", "label", "base", "length", "island").agg(
        F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"),
        F.min(F.col("begin") + F.array_min("tpos")).alias("start"), F.max(F.col("begin") + F.array_max("tpos") + k).alias("end"))
    verified = spans.withColumn("share", share_of(F.col("tpos"))).withColumn("good", F.col("template").isNotNull() & F.when(F.col("base"), F.col("share") == 1).otherwise((F.col("share") >= covered) & (F.col("end") - F.col("start") <= stretch * F.col("length"))))
    base = F.col("good") & F.col("base")

    def joined(of: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(of, F.col("label")))), ",")

    return verified.groupBy("key", "same").agg(
        F.max("n").cast("long").alias("n_words"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("good")).alias("labels"), F.coalesce(F.max(F.when(F.col("good"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("good"), F.struct("label", "start", "end")))).alias("spans")).select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
