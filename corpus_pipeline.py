"""A corpus pipeline from five of the operators: each stage is written as Parquet and read by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelspark.llm.common import durable, table
from voxelspark.llm.exact_dedup import drop_copies
from voxelspark.llm.mixing import mixed
from voxelspark.llm.ngram_join import one_of_each
from voxelspark.llm.packing import pack
from voxelspark.llm.quality import keep_good
from voxelspark.llm.queries import TARGETS, domain_labels


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the base rules and the threshold table, each by itself: repeated rows stay or go together, and
    null, empty and blank texts go, as they have too few words. Columns stay as they are. No rows give no rows."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest id; null counts as the empty text, and null ids lose against others. Of
    rows that repeat the kept id and text one stays. Columns stay as they are. No rows give no rows."""
    return drop_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 80 % of five-word shingles join, directly or over others, the row with the smallest id.
    Null ids, and null or empty texts, have no links and stay. Columns stay as they are. No rows give no rows."""
    return one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its rate says, so that the expected tokens of the domains meet TARGETS; clean documents have
    rates of one and more and stay. Null texts have the posterior of the empty text, null ids share one draw; targets that
    cannot be met, as without labels, give a warning and the nearest rates. Columns stay as they are. No rows: no rows."""
    return mixed(docs, domain_labels(spark, sf_dir), TARGETS, anchor="good")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row lies in sequences of 2048 tokens: (doc_id, piece, start, length, ids_crc32, sequence_id,
    offset). Null texts count as empty, which is one token; rows that repeat an id are packed one by one. No rows: no
    rows."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL cannot express the learnt stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
