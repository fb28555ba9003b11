"""Exact length histogram: documents are aggregated by encoded length; suffix sums answer totals, quantiles and truncated
totals for every context limit.

For a limit L the truncated total is sum(min(length, L)) = (tokens of texts up to L) + L * (texts longer than L). Between two
lengths of the table the answer follows from the row of the smaller one, so one row per distinct length answers every limit.

The suffix sums are taken in two levels (blocks of 1024 lengths, then inside a block), so no task sees the whole histogram.
Null and empty texts count as length 0; repeated rows count each; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import tables, tokenizers_public
from evidentia.llm.bytesets import slices

BLOCK = 1024


def lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) by the byte-level vocabulary, without special tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizers_public.encoder(vocabulary)
        for batch in slices(batches):
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return tables.texts(docs).mapInArrow(count, "doc_id long, n_tokens long")


def histogram(sized: DataFrame, by: str = "n_tokens") -> DataFrame:
    return sized.groupBy(F.col(by).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def answers(counts: DataFrame) -> DataFrame:
    """For each distinct length: texts and tokens of that length, at it or above (suffix sums), corpus totals, the share of
    texts up to it (its quantile) and the total of all texts truncated to it."""
    counts = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(  # one row per 1024 lengths: at most (longest text) / 1024 rows
        "block",
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(everything).alias("total_docs"),
        F.sum("b_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        "tokens",
        (F.sum("n_docs").over(inside) + F.col("docs_above")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("tokens_above")).alias("tokens_from"),
        "total_docs",
        "total_tokens",
    )
    longer = F.col("docs_from") - F.col("n_docs")
    return out.withColumn("quantile", (F.col("total_docs") - longer) / F.col("total_docs")).withColumn(
        "truncated_total", F.col("total_tokens") - F.col("tokens_from") + F.col("tokens") + F.col("n_tokens") * longer
    )


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """One row: the total of all texts truncated to any limit, from the row with the largest length up to it."""
    up_to = F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "docs_from", "n_docs", "tokens_from", "tokens", "total_tokens"))
    row = table.agg(F.max(up_to).alias("r"), F.max("total_docs").alias("d"))
    longer = F.coalesce(F.col("r.docs_from") - F.col("r.n_docs"), F.col("d"))
    shorter = F.coalesce(F.col("r.total_tokens") - F.col("r.tokens_from") + F.col("r.tokens"), F.lit(0))
    return row.select(F.lit(limit).alias("context_limit"), F.coalesce(shorter + longer * F.lit(limit), F.lit(0)).alias("truncated_total"))


def quantile(table: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of texts does not exceed."""
    return table.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    # written, as blocks and lengths both read it: texts are encoded once
    return answers(tables.written(histogram(lengths(docs, vocabulary))))
