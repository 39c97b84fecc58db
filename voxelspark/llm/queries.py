"""Registered queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .chat_template import digests, format_conversations
from .common import table
from .conversations import REPAIR_SQL, damaged, repair_report
from .exact_dedup import exact_groups
from .langid import language_of
from .licenses import license_scan, scan_sql
from .mixing import mix_rates
from .ngram_join import ngram_components
from .packing import pack
from .pii import pii_spans
from .quality import RULES, STOP_WORDS, quality
from .sharding import kd_shards
from .token_count import count_tokens
from .whitening import whiten


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), width=4, percent=85)


#: Weights of the domains that the labels tell, and the domain whose tokens set the size of the mix.
TARGETS = {"good": 0.94, "poor": 0.02, "toxic": 0.04}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as (doc_id, domain): toxic, else good or poor by quality; null where a label is missing."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGETS, anchor="good")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).withColumn("broken", F.array_join("broken", ","))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(table(spark, sf_dir, "documents"), fold=1, folds=3)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return digests(format_conversations(rows.unionByName(added)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), ids=rows)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), k=8)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_mixing": op2_mixing,
        "op3_token_counts": op3_token_counts,
        "op4_quality_rules": op4_quality_rules,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_sharding": op6_sharding,
        "op7_pii": op7_pii,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_language_id": op9_language_id,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": op4_sql(),
        "op8_exact_dedup": OP8,
        "op10_chat_formatting": OP10,
        "op11_conversation_repair": REPAIR_SQL,
        "op13_license_scan": scan_sql(),
    }


OP8 = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP10 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(14 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op4_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for group in STOP_WORDS for w in group.split()}))
    broken = []
    for r in RULES:
        tests = ([f"{r.num} < {r.den} * {float(r.low)}::DOUBLE"] if r.low is not None else []) + ([f"{r.num} > {r.den} * {float(r.high)}::DOUBLE"] if r.high is not None else [])
        broken.append(f"CASE WHEN {r.den} > 0 AND ({' OR '.join(tests)}) THEN '{r.name}' END")
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM texts),
words AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
grams AS (
  SELECT row, i, string_agg(w, ' ') OVER eight AS gram, count(*) OVER eight AS n FROM words
  WINDOW eight AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twins AS (SELECT row, i, n = 8 AND count(*) OVER (PARTITION BY row, gram, n) > 1 AS twin FROM grams),
covered AS (
  SELECT row, count(*) FILTER (hit) AS n_repeat_words
  FROM (SELECT row, bool_or(twin) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM twins)
  GROUP BY row),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(list_filter(regexp_split_to_array(lower(text), '[ 	-
.,;:!?]+'), lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(length(array_to_string(regexp_extract_all(text, '\p{{Lu}}{{2,}}'), '')) AS BIGINT) AS n_capitals,
         CAST(len(lines) AS BIGINT) AS n_lines, 1 AS one
  FROM split LEFT JOIN covered USING (row)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         list_filter([{', '.join(broken)}], lambda x: x IS NOT NULL) AS broken
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(broken) = 0 AS kept,
       n_stop_words, n_capitals, n_lines, array_to_string(broken, ',') AS broken
FROM judged
"""
