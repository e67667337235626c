"""The registered queries of this subpackage, ``(spark, sf_dir) -> DataFrame``, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtab.llm import archive, chat, common, language, license, mixing, negatives, packing, quality, rules, simhash, syncmer, toxicity, whiten

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = language.fit(docs.where(common.fold(F.col("doc_id"), 4) != 2))
    found = language.predict(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(common.fold(F.col("doc_id"), 3) != 1))
    found = quality.predict(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    found = toxicity.score(docs, labels.where(common.fold(F.col("doc_id"), 5) != 0))
    return found.select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "neighbours", "evidence")


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"))


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(common.read(spark, sf_dir, "documents")).drop("spans")


_NOTICES = ", ".join(f"({n}, '{label}', '{phrase}', {str(n < len(license.PHRASES)).lower()})" for n, (label, phrase) in enumerate(license.PHRASES + license.NOTICES))
#: Notices are looked up word for word; those with missing or added words, of which the given documents have none, are tested apart.
SQL["op2_license_scan"] = f"""
WITH texts AS (SELECT DISTINCT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(t, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM texts),
tpl AS (SELECT *, string_split(phrase, ' ') AS ws, len(string_split(phrase, ' ')) AS length FROM (VALUES {_NOTICES}) v(template, label, phrase, base)),
places AS (SELECT id, w, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM docs),
kept AS (SELECT id, label, base, p - 1 AS s FROM places JOIN tpl ON word = tpl.ws[1] AND w[p : p + length - 1] = tpl.ws)
SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(base) FILTER (base) AS n_base, min(s) FILTER (base)::BIGINT AS first_word, max(s) FILTER (base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, (count(label) > 0)::INT::DOUBLE AS score
FROM docs LEFT JOIN kept USING (id) GROUP BY id, doc_id
"""


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = common.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    marked = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = chat.format_chat(given.unionByName(marked).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


SQL["op8_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(chat.START + chat.MIDDLE + chat.END)} + length(regexp_replace(role || text, '[~<[]', '..', 'g'))) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    return rules.judge_by_others(docs, labels.where("quality = 1").select("doc_id")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_ratio")


@query
def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.neighbours(common.read(spark, sf_dir, "documents"))


#: Wanted shares of the tokens.
TARGETS = {"clean": 0.94, "low": 0.04, "toxic": 0.02}


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.read(spark, sf_dir, "documents"), mixing.domains_of(common.read(spark, sf_dir, "labels")), TARGETS)
    return mixed.select("doc_id", "tokens", *[F.col("p")[d].alias(f"p_{d}") for d in sorted(TARGETS)], "rate")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten.whiten(common.read(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


SQL["op12_hard_negatives"] = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS id, b.label AS label, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = archive.archive(common.read(spark, sf_dir, "pages"), seconds=F.lit(946684800) + F.col("page_id"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture")


SQL["op13_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, CASE WHEN regexp_matches(url, '[\x00-\x20\x7F]') THEN url_encode(url) ELSE url END AS u FROM pages),
d AS (SELECT page_id, t, u, sha1(t) AS h, regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^.*@|:[0-9]*$', '', 'g') AS host FROM p),
k AS (SELECT page_id, t, h, min(page_id) OVER (PARTITION BY h) AS first, strftime(to_timestamp(946684800 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured,
  CASE WHEN regexp_matches(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^#]*)', 1) ELSE coalesce(u, '') END AS url_key FROM d)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url_key, captured,
  row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) AS capture
FROM k
"""
