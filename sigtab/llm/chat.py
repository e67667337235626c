"""Chat formatting: typed content parts become one text with placeholders, attachment references and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|start|>", "<|says|>", "<|end|>\n"
#: What may not stay in a text, and what stands for it; the first must be undone last.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
#: Expanded tokens for each unit of an attachment: tiles of an image, seconds of audio, pages of a document.
RATES = {"image": 256.0, "audio": 25.0, "document": 512.0}
PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    """No control string survives, as all of them begin with ``<`` or ``[``."""
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def format_chat(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                loss_roles: tuple[str, ...] = ("assistant",), rates: dict[str, float] | None = None) -> DataFrame:
    """One row for each conversation: key, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts`` is an array of struct(kind, text, ref, units). Each part is visited by its kind: a text is escaped; an
    image, audio or document becomes a placeholder such as ``<|part:image|>``, which no control string equals whatever the kind, and an entry of ``attachments`` (turn, kind, ref,
    tokens), in the order of the placeholders; tokens are the units (null: one; negative or NaN: none) times the rate, rounded up. A kind
    without a rate becomes a placeholder of no tokens.
    ``loss_spans`` are struct(start, end) in characters from 0: every text part of a turn of ``loss_roles``.

    Turns stand in order of turn (nulls first), then role and parts; repeated rows are turns of their own. Null roles, texts
    and part arrays count as empty; a null kind is a text; a null part is left out. Rows with a null key form one conversation.
    """
    rates = RATES if rates is None else rates
    name, kind = F.coalesce(F.col(role), F.lit("")), lambda p: F.coalesce(p["kind"], F.lit("text"))

    def visit(p: Column) -> Column:
        rate = F.lit(0.0)
        for k, v in rates.items():
            rate = F.when(kind(p) == k, F.lit(float(v))).otherwise(rate)
        text = kind(p) == "text"
        units = F.when(F.isnan(p["units"]) | (p["units"] < 0), 0.0).otherwise(F.coalesce(p["units"], F.lit(1.0)))
        return F.struct(
            F.when(text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|part:"), escape(kind(p)), F.lit("|>"))).alias("out"),
            (text & name.isin(*loss_roles)).alias("loss"),
            F.when(~text, F.struct(F.col(turn).alias("turn"), kind(p).alias("kind"), p["ref"].alias("ref"), F.ceil(units * rate).alias("tokens"))).alias("attachment"))

    def mark(text: Column) -> Column:
        return F.struct(text.alias("out"), F.lit(False).alias("loss"), F.lit(None).cast("struct<turn:bigint,kind:string,ref:string,tokens:bigint>").alias("attachment"))

    given = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    visited = F.transform(given, visit)
    pieces = F.concat(F.array(mark(F.concat(F.lit(START), escape(name), F.lit(MIDDLE)))), visited, F.array(mark(F.lit(END))))
    turns = messages.withColumn(turn, F.col(turn).cast("long")).select(F.col(key).alias("key"), F.col(turn).alias("turn"), name.alias("role"), pieces.alias("pieces"))
    numbered = turns.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "pieces")))
    rows = numbered.select("key", "number", F.posexplode("pieces").alias("place", "piece"))
    so_far = F.sum(F.char_length("piece.out")).over(Window.partitionBy("key").orderBy("number", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = rows.select("key", "number", "place", "piece", so_far.cast("long").alias("end"))
    whole = laid.groupBy("key").agg(F.max("number").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("number", "place", "piece", "end"))).alias("all"))  # a conversation is one row
    spans = F.transform(F.filter("all", lambda x: x["piece"]["loss"] & (F.char_length(x["piece"]["out"]) > 0)), lambda x: F.struct((x["end"] - F.char_length(x["piece"]["out"])).alias("start"), x["end"].alias("end")))
    attached = F.transform(F.filter("all", lambda x: x["piece"]["attachment"].isNotNull()), lambda x: x["piece"]["attachment"])
    return whole.select(F.col("key").alias(key), "n_turns", F.array_join(F.transform("all", lambda x: x["piece"]["out"]), "").alias("formatted"), spans.alias("loss_spans"), attached.alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of struct(role, content), unescaped."""
    split = F.filter(F.split(formatted, r"<\|start\|>"), lambda x: x != "")
    return F.transform(split, lambda x: F.struct(
        unescape(F.substring_index(x, MIDDLE, 1)).alias("role"),
        unescape(F.regexp_replace(F.substring_index(x, MIDDLE, -1), r"<\|end\|>\n$", "")).alias("content")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
