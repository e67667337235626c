"""From raw documents to packed training sequences, in five written stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtab.llm import common, language, mixing, packing, quality, simhash

#: Wanted shares of the tokens; the clean ones stay as many as they are.
TARGETS = {"clean": 0.98, "toxic": 0.02}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good, with their columns; learned from the labelled rows that op3 learns from."""
    labels = common.read(spark, sf_dir, "labels").where(common.fold(F.col("doc_id"), 3) != 1)
    rated = quality.predict(docs, quality.fit(docs, labels), out=("_quality_score", "_quality_good"))
    return rated.where("_quality_good = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is clear (score of at least 0.5), with their columns.

    Learned from the rows that op6 learns from. If none of them has a language, every document with a letter stays.
    """
    model = language.fit(docs.where(common.fold(F.col("doc_id"), 4) != 2))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, out=("_language", "_language_score"))
    return found.where((F.col("_language") != language.UNKNOWN) & (F.col("_language_score") >= 0.5)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, one row of it. Rows without a doc_id all stay."""
    classes = simhash.near_duplicates(docs.where("doc_id is not null"))
    kept = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept"))
    first = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(docs.where("doc_id is null"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays (once) with the probability of its rate, decided by a hash of its doc_id and text."""
    labels = common.read(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", F.when(F.col("toxic") > 0, "toxic").otherwise("clean").alias("domain"))
    rates = mixing.mix(docs, labels, TARGETS, anchor="clean").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same"), "rate")
    draw = F.pmod(F.xxhash64("_id", "_same", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    kept = rates.where(draw < F.col("rate")).select("_id", "_same")
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_same")), "left_semi")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_to_targets),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and hashes decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
