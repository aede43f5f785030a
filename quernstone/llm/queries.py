"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, fingerprints, langid, media, mixing, near_dedup, pii, preferences, simhash, token_counts, token_shards, whitening

LINKED = near_dedup.Sketching(words=3, percent=85)
VOCABULARY = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
LAYOUT = token_shards.Layout(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
COUNTING = token_counts.Counting(public_tokenizers.path("byte_bpe_50k.json"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), LINKED)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.grouped_report(_documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preferences.formatted(preferences.weaker_replies(turns))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), VOCABULARY)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_documents(spark, sf_dir))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(_documents(spark, sf_dir), LAYOUT)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.token_counts(docs, COUNTING)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_minhash_near_dedup, op3_document_fingerprints, op4_chat_formatting, op5_language_id, op6_byte_bpe, op7_pii, op8_token_shards, op9_mixing, op10_token_counts, op11_embedding_whitening, op12_phrase_collocations, op13_simhash_near_dedup)}

ORACLE: dict[str, str] = {}

ORACLE["op4_chat_formatting"] = r"""
WITH last_reply AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id),
earlier AS (SELECT c.conv_id, arg_max(c.text, c.turn) AS before FROM conversations c JOIN last_reply l USING (conv_id) WHERE c.role = 'assistant' AND c.turn < l.last GROUP BY c.conv_id),
sides AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS good,
         coalesce(CASE WHEN c.role = 'assistant' AND c.turn = l.last THEN coalesce(e.before, '') ELSE c.text END, '') AS bad
  FROM conversations c JOIN last_reply l USING (conv_id) LEFT JOIN earlier e USING (conv_id)),
firsts AS (SELECT conv_id, min(turn) AS cut FROM sides WHERE good IS DISTINCT FROM bad GROUP BY conv_id),
marked AS (SELECT s.*, f.cut IS NULL OR s.turn < f.cut AS shared, '<|im_start|>' || role || chr(10) AS head, '<|im_end|>' || chr(10) AS tail FROM sides s LEFT JOIN firsts f USING (conv_id)),
placed AS (
  SELECT *, coalesce(sum(CASE WHEN shared THEN 0 ELSE length(head || good || tail) END) OVER w, 0) AS good_at,
            coalesce(sum(CASE WHEN shared THEN 0 ELSE length(head || bad || tail) END) OVER w, 0) AS bad_at
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, CAST(count(*) FILTER (WHERE shared) AS INTEGER) AS prefix_turns,
  coalesce(string_agg(head || good || tail, '' ORDER BY turn) FILTER (WHERE shared), '') AS prompt,
  coalesce(string_agg(head || good || tail, '' ORDER BY turn) FILTER (WHERE NOT shared), '') AS chosen,
  coalesce(string_agg(head || bad || tail, '' ORDER BY turn) FILTER (WHERE NOT shared), '') AS rejected,
  coalesce(string_agg((good_at + length(head)) || ':' || (good_at + length(head || good || tail)), ',' ORDER BY turn) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((bad_at + length(head)) || ':' || (bad_at + length(head || bad || tail)), ',' ORDER BY turn) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""

ORACLE["op12_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
parts AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
placed AS (SELECT lang, unnest(list_zip(words, words[2 :], words[3 :])) AS w FROM parts WHERE len(words) > 0),
grams AS (
  SELECT lang, 1 AS length, w[1] AS phrase FROM placed
  UNION ALL SELECT lang, 2, w[1] || ' ' || w[2] FROM placed WHERE w[2] IS NOT NULL
  UNION ALL SELECT lang, 3, w[1] || ' ' || w[2] || ' ' || w[3] FROM placed WHERE w[3] IS NOT NULL),
counts AS (SELECT lang, length, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE length = 1 GROUP BY lang),
candidates AS (SELECT lang, length, phrase, string_split(phrase, ' ') AS words, n AS a FROM counts WHERE length > 1 AND n >= 10),
cuts AS (SELECT lang, length, phrase, a, k, array_to_string(words[1 : k], ' ') AS first, array_to_string(words[k + 1 :], ' ') AS rest FROM candidates, (VALUES (1), (2)) AS ks(k) WHERE k < length),
firsts AS MATERIALIZED (SELECT c.*, x.n AS l FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first),
scores AS (SELECT f.*, y.n AS r, CAST(1000000::HUGEINT * f.a * f.a // (f.l::HUGEINT * y.n) AS BIGINT) AS score FROM firsts f JOIN counts y ON y.lang = f.lang AND y.phrase = f.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(words[1 : 2], ' '), array_to_string(words[2 : 3], ' ')]) AS inner_phrase FROM candidates WHERE length = 3) GROUP BY ALL),
kept AS (SELECT w.* FROM lowest w LEFT JOIN longer o ON o.lang = w.lang AND o.inner_phrase = w.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t USING (lang) WHERE r.rank <= 2000
"""
