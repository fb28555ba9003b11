"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import best_fit_packing, byte_bpe, centroid_clusters, line_dedup, near_dedup, ngram_trie, payload_chunks, quality_rules, repeat_removal, secret_scan, sim_dedup, token_counts, vector_codes
from evidentia.llm.oracles import ORACLES
from evidentia.llm.tables import read
from evidentia.llm.tokenizers_public import default_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.query(read(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"))


def op2_payload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_chunks.query(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(read(spark, sf_dir, "documents"))


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_removal.query(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.query(read(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(read(spark, sf_dir, "documents"))


def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.query(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.query(read(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"), default_path("byte_bpe_50k.json"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.query(read(spark, sf_dir, "embeddings"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.query(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_payload_chunks, op3_line_dedup, op4_repeat_removal, op5_byte_bpe, op6_secret_scan, op7_ngram_trie, op8_best_fit_packing, op9_near_dedup, op10_quality_rules, op11_vector_codes, op12_simhash_dedup, op13_centroid_clusters)
}
__all__ = ["ORACLES", "QUERIES"]
