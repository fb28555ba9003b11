"""Intermediate tables written to the folder that driver and executors share: they cut lineage, so that a lost executor costs a re-read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. A temporary folder stands in only on a local master without that setting, as in
    tests; on a cluster it would be another folder on each machine, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/evidentia-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
