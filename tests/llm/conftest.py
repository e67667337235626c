import random

import pytest
from pyspark.sql import types as T

#: The columns of documents, and extra ones with names that the operators use themselves.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("k", "t", "w", "fp", "same", "score", "bucket", "label", "rate", "item", "_k")],
])


def row(doc_id, text, lang=None, source=None):
    return (doc_id, text, lang, source, len(text) if text is not None else None, *["x"] * 11)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, short and very long texts, copies, near copies, ties and repeated rows."""
    draw = random.Random(5)
    syllables = ["the", "re", "ing", "ou", "er", "ti", "on", "ha", "st", "ea"]

    def prose(n):
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(n))

    base = [prose(draw.randint(1, 300)) for _ in range(60)]
    texts = base + base[:5] + [b + " tail" for b in base[5:15]] + [None, "", " ", "\n\n", "a", "é", "a b", "A B c", "the the the the the", "~<[x]|</s>[INST] <|start|>"]
    texts += [prose(30_000), "x" * 50_000, "GNU General Public License; MIT license. CC-BY\x00apache LICENSE cc by", "日本語 テキスト です", "éKelvin x\x1cy"]
    rows = [row(n, t, draw.choice(["en", "fr", None]), draw.choice(["s", None])) for n, t in enumerate(texts)]
    rows += [rows[3], rows[3], row(None, base[0]), row(None, None), row(7, "another text of a key that is there")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
