"""History, queue and plan: phases, milestones, batches, queue order, skips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators.ordering import numbered

LEVELS = (80, 90, 95, 100)


def phases(history: DataFrame) -> DataFrame:
    """For each scan: first_scan, regression (strict fell by more than .5), stagnation (three within .1), maintenance (over 93), middle_grind (over 80
    and under a point in three), refinement (over 80), early_momentum. history has one row per scan of one project."""
    w = Window.orderBy("seq")
    a, b = F.lag("strict").over(w), F.lag("strict", 2).over(w)
    s = F.col("strict")
    tenths = lambda x: F.round(10 * x).cast("int")
    out = history.select("seq", "strict", tenths(s).alias("t0"), tenths(a).alias("t1"), tenths(b).alias("t2"))
    phase = (
        F.when(F.col("seq") <= 1, "first_scan")
        .when(F.col("t1") - F.col("t0") > 5, "regression")
        .when((F.col("t0") == F.col("t1")) & (F.col("t0") == F.col("t2")), "stagnation")
        .when(F.col("t0") > 930, "maintenance")
        .when((F.col("t0") > 800) & (F.abs(F.col("t0") - F.col("t2")) < 10), "middle_grind")
        .when(F.col("t0") > 800, "refinement")
        .otherwise("early_momentum")
    )
    return out.select("seq", "strict", phase.alias("phase"))


def milestones(history: DataFrame) -> DataFrame:
    """Levels that a scan reached and the one before had not."""
    w = Window.orderBy("seq")
    both = history.select("seq", "strict", F.lag("strict").over(w).alias("before"))
    levels = F.array_compact(F.array(*(F.when((F.col("strict") >= x) & (F.col("before") < x), x) for x in LEVELS)))
    return both.select("seq", F.explode(levels).alias("level"))


def next_target(history: DataFrame) -> DataFrame:
    target = F.coalesce(*(F.when(F.col("strict") < x, x) for x in LEVELS), F.lit(100))
    return history.select("seq", target.alias("target"), F.round((target - F.col("strict")) * 10).cast("int").alias("missing_tenths"))


def batches(paths: DataFrame, size: int) -> DataFrame:
    """Paths in order, cut into groups of `size`."""
    return numbered(paths.select("path"), "path").select("path", F.floor(F.col("place") / size).alias("batch"))


def queue(findings: DataFrame, planned: DataFrame, skipped: DataFrame, n: int = 20) -> DataFrame:
    """The first n: planned ids in their order, then by (tier, subjective last, confidence, reopens, id); skipped ids come last."""
    rows = findings.where("status = 'open' and not suppressed").join(planned, "id", "left").join(skipped.select("id", F.lit(True).alias("is_skipped")), "id", "left")
    kind = F.when(F.col("is_skipped"), 2).when(F.col("pos").isNotNull(), 0).otherwise(1)
    order = [kind.asc(), F.col("pos").asc_nulls_last(), F.col("tier"), F.col("detector") == "review", text.confidence_rank(F.col("confidence")), F.desc("reopen_count"), F.col("id")]
    return rows.withColumn("kind", kind).orderBy(*order).limit(n).select("id", "kind", "tier")


def superseded(plan: DataFrame, findings: DataFrame) -> DataFrame:
    """Planned ids that no finding has any more."""
    return plan.join(findings.select("id"), "id", "left_anti")


def live_members(clusters: DataFrame, findings: DataFrame) -> DataFrame:
    """Cluster sizes after references to findings that are gone were dropped; empty clusters go."""
    return clusters.join(findings.select("id"), "id", "left_semi").groupBy("cluster").agg(F.count("*").alias("n"))


def resurfaced(skipped: DataFrame, today: str) -> DataFrame:
    """Temporary skips whose day has come."""
    return skipped.where((F.col("kind") == "temporary") & (F.col("review_after") < today))


def kept_superseded(rows: DataFrame, today: str, days: int = 90) -> DataFrame:
    """Rows younger than 90 days; those without a readable day stay."""
    day = F.try_to_date(F.col("at"), "yyyy-MM-dd")
    return rows.where(day.isNull() | (F.datediff(F.lit(today).cast("date"), day) < days))


def moved(plan: DataFrame, id_: str, place: int) -> DataFrame:
    """One id taken out of a queue (pos 0, 1, ... without gaps, id) and put in at a place, at its end at most. An id that is not there moves nothing; of a repeated id the last row moves."""
    bounds = plan.agg(F.count("*").alias("n"), F.max(F.when(F.col("id") == id_, F.col("pos"))).alias("cur"), F.lit(1).alias("_"))
    sized = plan.withColumn("_", F.lit(1)).join(F.broadcast(bounds), "_")
    pos, cur, to = F.col("pos").cast("long"), F.col("cur"), F.least(F.lit(place), F.col("n") - 1)
    left = pos - F.when(pos > cur, 1).otherwise(0)
    others = left + F.when(cur.isNotNull() & (left >= to), 1).otherwise(0)
    return sized.select("id", F.when(pos == cur, to).otherwise(others).alias("pos"))
