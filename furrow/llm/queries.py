"""The queries opN_<name>, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from furrow.llm import jaccard, neardup, oracles, packing, passages, pii, piece_scan, quality, substrings, token_counts, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

#: The key of the surrogates; a deployment passes its own secret to pii.pseudonymise.
PII_KEY = b"furrow demonstration key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "n_entities", "text")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near(spark, table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_words(spark, table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_bytes(spark, table(spark, sf_dir, "documents"))


def op9_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_scan.encode_decode(spark, table(spark, sf_dir, "documents"), PIECE_BPE)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_pii_surrogates, op3_embedding_near_dedup, op4_token_counts, op5_toxicity, op6_substring_dedup, op7_ngram_jaccard_join, op8_suffix_array_dedup, op9_piece_scan, op10_quality_rules)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op3_embedding_near_dedup": oracles.OP3, "op6_substring_dedup": oracles.OP6, "op7_ngram_jaccard_join": oracles.OP7, "op8_suffix_array_dedup": oracles.OP8}
