"""Merging of review batches: scores per dimension with pressure from findings, imports and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_identifier(found: DataFrame) -> DataFrame:
    """One finding per identifier: that of the first batch and turn."""
    return found.groupBy("identifier").agg(F.min_by(F.struct(*[c for c in found.columns if c != "identifier"]), F.struct("batch", "turn")).alias("f")).select("identifier", "f.*")


def pressure(found: DataFrame) -> DataFrame:
    """Per dimension, in hundredths: confidence (1, .7, .4) x impact (1, .7, .5, .3), summed."""
    confidence = F.when(F.col("confidence") == "high", 10).when(F.col("confidence") == "medium", 7).otherwise(4)
    impact = F.when(F.col("impact_scope") == "codebase", 10).when(F.col("impact_scope") == "subsystem", 7).when(F.col("impact_scope") == "module", 5).otherwise(3)
    return found.groupBy("dimension").agg(F.sum(confidence * impact).alias("pressure"), F.count("*").alias("n_findings"))


def severity(found: DataFrame) -> DataFrame:
    """Per finding: confidence (1.2, 1, .75) x impact (1, 1.3, 1.6, 2) x fix (1, 1.3, 1.7), in hundred-thousandths."""
    c = F.when(F.col("confidence") == "high", 120).when(F.col("confidence") == "medium", 100).otherwise(75)
    i = F.when(F.col("impact_scope") == "codebase", 20).when(F.col("impact_scope") == "subsystem", 16).when(F.col("impact_scope") == "module", 13).otherwise(10)
    f = F.when(F.col("fix_scope") == "architectural_change", 17).when(F.col("fix_scope") == "multi_file_refactor", 13).otherwise(10)
    return found.withColumn("severity", c * i * f)


def merged_scores(assessed: DataFrame, found: DataFrame) -> DataFrame:
    """dimension, batches, mean, least, score: 0.7 mean + 0.3 least - min(2.2 pressure, 24), within 60 and 90."""
    own = assessed.groupBy("dimension").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.min("score").alias("least"))
    joined = own.join(pressure(found), "dimension", "left")
    p = F.coalesce(F.col("pressure"), F.lit(0)) / 100
    score = 0.7 * (F.col("total") / F.col("n")) + 0.3 * F.col("least") - F.least(2.2 * p, F.lit(24.0))
    return joined.select("dimension", "n", "least", F.coalesce("pressure", F.lit(0)).alias("pressure"), F.greatest(F.lit(60.0), F.least(F.lit(90.0), score)).alias("score"))


def mean_scores(assessed: DataFrame) -> DataFrame:
    """assessed (batch, dimension, score, note): per dimension the mean score to one decimal, halves up, and the last batch's note, the greatest if it has several."""
    mean = F.sum("score") / F.count("score")
    last = F.max(F.when(F.col("note").isNotNull(), F.struct("batch", "note")))["note"]
    return assessed.groupBy("dimension").agg((F.floor(10 * mean + 0.5) / 10).alias("score"), last.alias("note"))


def near_target(scores: DataFrame, target: float, tolerance: float = 0.01) -> DataFrame:
    """The integrity check: dimensions whose score sits on the target, if there are two or more; their score becomes 0."""
    hit = F.abs(F.col("score") - target) <= tolerance
    n = scores.agg(F.count(F.when(hit, 1)).alias("hits"), F.lit(1).alias("_"))
    out = scores.withColumn("_", F.lit(1)).join(F.broadcast(n), "_").drop("_")
    violates = hit & (F.col("hits") >= 2)
    return out.select("dimension", "score", violates.alias("violates"), F.when(violates, 0.0).otherwise(F.col("score")).alias("kept_score"))


def missing_feedback(scores: DataFrame, found: DataFrame, below: float = 85.0) -> DataFrame:
    """Dimensions scored below 85 without any finding."""
    return scores.where(F.col("score") < below).join(found.select("dimension").distinct(), "dimension", "left_anti").select("dimension", "score")


def imported(state: DataFrame, found: DataFrame) -> DataFrame:
    """Review findings put into a state (id, status, summary): new ones inserted, known ones seen again, their summary renewed if open."""
    new = found.select(F.concat(F.lit("review::"), "identifier").alias("id"), F.concat_ws(" ", "dimension", "impact_scope").alias("new_summary"))
    both = state.join(new, "id", "full_outer")
    fresh = F.col("status").isNull()
    return both.select(
        "id",
        F.coalesce("status", F.lit("open")).alias("status"),
        F.when(fresh | ((F.col("status") == "open") & F.col("new_summary").isNotNull()), F.col("new_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(fresh, "inserted").when(F.col("new_summary").isNotNull(), "seen").otherwise("absent").alias("action"),
    )


def coverage(files: DataFrame, reviewed: DataFrame, today: int, most_age: int) -> DataFrame:
    """files (path, hash) with reviews (path, hash, day): unreviewed, changed, stale or fresh."""
    joined = files.join(reviewed.withColumnsRenamed({"hash": "reviewed_hash"}), "path", "left")
    state = F.when(F.col("reviewed_hash").isNull(), "unreviewed").when(F.col("hash") != F.col("reviewed_hash"), "changed").when(F.lit(today) - F.col("day") > most_age, "stale").otherwise("fresh")
    return joined.select("path", state.alias("state"))
