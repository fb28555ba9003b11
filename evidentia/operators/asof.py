"""As-of joins: each row with the last earlier fact of its key, by ranges of seq, so that a key with very many rows is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def last_before(rows: DataFrame, facts: DataFrame, by: list[str], name: str, span: int = SPAN) -> DataFrame:
    """rows with `name`: a struct of the columns of facts besides `by` and seq, of the fact with the greatest seq below the row's; null without one.

    Inside a range the facts before a row are a running last value; the last fact of the ranges before is carried over, one row per key and range."""
    own = [c for c in facts.columns if c not in (*by, "seq")]
    keys, part = [*by, "seq"], F.floor(F.col("seq") / span).alias("_part")
    told = facts.select(*keys, part, F.struct(*own).alias("_fact"))
    asked = rows.select(*keys, part, F.struct(*rows.columns).alias("_row"))
    both = told.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked.withColumn("_fact", F.lit(None).cast(told.schema["_fact"].dataType)))
    inside = Window.partitionBy(*by, "_part").orderBy("seq", F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = both.withColumn("_inside", F.last("_fact", ignorenulls=True).over(inside)).where("_row is not null").select(*by, "_part", "_row", "_inside")
    tails = both.groupBy(*by, "_part").agg(F.max_by("_fact", F.when(F.col("_fact").isNotNull(), F.col("seq"))).alias("_tail"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*by, "_part", F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    return answered.join(carried, [*by, "_part"]).select("_row.*", F.coalesce("_inside", "_carried").alias(name))


def sum_before(rows: DataFrame, by: list[str], amount: str, name: str, span: int = SPAN) -> DataFrame:
    """rows with `name`: the sum of `amount` over the rows of the same key with a smaller seq, which names a row in its key."""
    parted = rows.withColumn("_part", F.floor(F.col("seq") / span))
    sums = parted.groupBy(*by, "_part").agg(F.sum(amount).alias("_sum"))
    carried = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carried"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("_inside", inside).join(carried, [*by, "_part"]).withColumn(name, F.col("_inside") + F.col("_carried")).drop("_part", "_inside", "_carried")
