"""Reading tables, bounded Arrow batches and written intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.written import scratch

#: Of a batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of any table; other columns are left out, a null text is an empty one."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Removes the shuffle files of a job when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, *, bytes_heavy: bool = False) -> DataFrame:
    """Cuts the lineage of df with a Parquet table in the shared folder: a lost executor costs a re-read,
    not a recomputation. Once it is written, its shuffle files go: nothing reads them again."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.option("compression", "zstd") if bytes_heavy else df.write
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
