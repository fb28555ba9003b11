"""A training-data pipeline over `documents`: STAGES, each a function (spark, docs, sf_dir) -> DataFrame whose result is written as
Parquet and read again as the next one's docs; run() applies them all.

quality_rules   rejects documents and removes failing lines from the rest
line_dedup      keeps one line of each component of equal or similar lines
near_dedup      keeps one document of each group of near-duplicates
secret_scan     replaces secrets in texts
pack            packs the documents' tokens into sequences

All but the last return the columns of `documents` in their order; n_chars follows the text. A text that the quality rules keep is kept to the
end: only near-duplicates go, and a document whose lines all occur in earlier ones stays as an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import best_fit_packing, line_dedup, near_dedup, quality_rules, secret_scan, tables
from evidentia.llm.tokenizers_public import default_path

#: No stage's tokens, digests or set hashes can be expressed in SQL.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _as_documents(out: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, columns = quality_rules.clean(docs), docs.columns
    return _as_documents(kept, columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(line_dedup.dedup(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(docs).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(secret_scan.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.query(docs, default_path("byte_bpe_50k.tiktoken"), default_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), bytes_heavy=True)
    return STAGES[-1][1](spark, docs, sf_dir)
