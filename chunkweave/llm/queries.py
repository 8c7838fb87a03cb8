"""Queries of the operators in this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkweave.llm import chat, minhash, urlfilter
from chunkweave.llm.bpe import round_trip
from chunkweave.llm.chat import rotate_perspectives
from chunkweave.llm.media import find_copies, media_column
from chunkweave.llm.minhash import near_duplicates
from chunkweave.llm.nbsvm import quality_scores
from chunkweave.llm.packing import best_fit_packing
from chunkweave.llm.quality_rules import apply_rules
from chunkweave.llm.secret_scan import find_secrets
from chunkweave.llm.sharding import ring_shards
from chunkweave.llm.urlfilter import filter_urls
from chunkweave.session import table

TOKENIZER_FOLDER = "/opt/tokenizers"
SHARDS = 40


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file: the installed package's, else the folder's."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZER_FOLDER}/{name}"
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(spark, media_column(table(spark, sf_dir, "embeddings")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards(spark, table(spark, sf_dir, "documents"), SHARDS)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_media_columns": op2_media_columns,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_url_filters": op5_url_filters,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_secret_scans": op10_secret_scans,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": chat.oracle_sql(),
    "op5_url_filters": urlfilter.oracle_sql(),
    "op6_minhash_near_dedup": minhash.oracle_sql(),
}
