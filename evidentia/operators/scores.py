"""Scores: capped failures per detector and mode, dimension scores, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.text import confidence_weight, round_tenth
from evidentia.operators.findings import FAILURES, candidates, modes

#: Detector -> (dimension, tier, counted by file, weighted by lines).
POLICIES = {
    "structural": ("File health", 3, False, False),
    **{d: ("Code quality", 3, False, False) for d in ("unused", "logs", "exports", "deprecated", "props", "react", "global_mutable_config", "orphaned", "flat_dirs", "naming", "facade", "stale_exclude", "patterns", "single_use", "coupling", "responsibility_cohesion", "private_imports", "layer_violation")},
    "smells": ("Code quality", 3, True, False),
    "dict_keys": ("Code quality", 3, True, False),
    "dupes": ("Duplication", 3, False, False),
    "boilerplate_duplication": ("Duplication", 3, False, False),
    "test_coverage": ("Test health", 4, True, True),
    "subjective_review": ("Test health", 4, True, False),
    "security": ("Security", 4, True, False),
    "cycles": ("Security", 4, False, False),
    "concerns": (None, 3, True, False),
    "review": (None, 3, True, False),
}
WEIGHTS = {"File health": 2.0, "Code quality": 1.0, "Duplication": 1.0, "Test health": 1.0, "Security": 1.0}
SAMPLE = 200
NOT_COUNTED = ("review", "concerns")


def policies(spark: SparkSession) -> DataFrame:
    rows = [(d, *p) for d, p in POLICIES.items()]
    return spark.createDataFrame(rows, "detector string, dimension string, policy_tier int, file_based boolean, loc_weighted boolean")


def detector_stats(findings: DataFrame, potentials: DataFrame) -> DataFrame:
    """mode, detector, potential, issues, weighted failures (in tenths, exact), pass rate.

    Weights are summed per file first, so that the caps are applied in a map-side combined aggregate: a file's failures of a
    file-based detector count 2.0 at most from 6 findings on, 1.5 from 3 on, else 1.0; findings of the whole repository count tenfold, uncapped;
    for a detector weighted by lines a file counts no more than its first finding, by id.
    """
    known = F.broadcast(policies(findings.sparkSession))  # one row per policy
    rows = modes(candidates(findings)).join(known, "detector", "left")
    by_file, by_loc = F.coalesce("file_based", F.lit(False)), F.coalesce("loc_weighted", F.lit(False))
    base = confidence_weight(F.col("confidence"))
    loc = F.coalesce(F.get_json_object("detail", "$.loc_weight").cast("int"), F.lit(1)) * 10
    repo_wide = by_file & (F.col("file") == ".") & F.coalesce(F.get_json_object("detail", "$.holistic") == "true", F.lit(False))
    rows = rows.withColumn("w", F.when(repo_wide, base * 10).when(by_loc, loc).otherwise(base)).withColumn("repo_wide", repo_wide)
    per_file = rows.groupBy("mode", "detector", "file", by_file.alias("by_file"), by_loc.alias("by_loc"), "repo_wide").agg(
        F.count("*").alias("n"), F.sum("w").alias("w"), F.min_by("w", "id").alias("first_w")
    )
    cap = F.when(F.col("by_loc"), F.col("first_w")).when(F.col("n") >= 6, 20).when(F.col("n") >= 3, 15).otherwise(10)
    capped = F.when(F.col("by_file") & ~F.col("repo_wide"), F.least("w", cap)).otherwise(F.col("w"))
    failed = per_file.groupBy("mode", "detector").agg(F.sum("n").alias("issues"), F.sum(capped).alias("weighted"))
    grid = potentials.withColumn("mode", F.explode(F.array(*map(F.lit, FAILURES))))
    counted = (F.col("potential") > 0) & ~F.col("detector").isin(*NOT_COUNTED)
    zero = F.lit(0).cast("long")
    w = F.when(counted, F.coalesce("weighted", zero)).otherwise(zero)
    rate = F.when(counted, F.greatest((F.col("potential") * 10 - w) / (F.col("potential") * 10), F.lit(0.0))).otherwise(1.0)
    return grid.join(failed, ["mode", "detector"], "left").select("mode", "detector", "potential", F.when(counted, F.coalesce("issues", zero)).otherwise(zero).alias("issues"), w.alias("weighted_tenths"), rate.alias("pass_rate"))


def dimension_scores(findings: DataFrame, potentials: DataFrame) -> DataFrame:
    """mode, dimension, checks, issues, score."""
    stats = detector_stats(findings, potentials).where("potential > 0").join(F.broadcast(policies(findings.sparkSession)), "detector").where("dimension is not null")
    out = stats.groupBy("mode", "dimension").agg(F.sum("potential").alias("checks"), F.sum("issues").alias("issues"), F.sum("weighted_tenths").alias("w"), F.max("policy_tier").alias("tier"))
    share = F.greatest((F.col("checks") * 10 - F.col("w")) / (F.col("checks") * 10), F.lit(0.0))
    return out.select("mode", "dimension", "tier", "checks", "issues", round_tenth(share * 100).alias("score"))


def health(scores: DataFrame, subjective: DataFrame | None = None) -> DataFrame:
    """mode, overall: the weighted mean of dimension scores, a dimension's weight scaled down below 200 checks; with subjective scores
    (dimension, score, weight), 0.4 of it and 0.6 of their mean."""
    weight = F.coalesce(*(F.when(F.col("dimension") == d, w) for d, w in WEIGHTS.items()), F.lit(1.0))
    # tenths and whole checks: exact sums whatever the order
    scaled = (weight * F.least("checks", F.lit(SAMPLE))).cast("long")
    mechanical = scores.groupBy("mode").agg((F.sum(F.round(F.col("score") * 10).cast("long") * scaled) / F.sum(scaled) / 10).alias("mechanical"))
    if subjective is None:
        return mechanical.select("mode", "mechanical", round_tenth(F.col("mechanical")).alias("overall"))
    mean = subjective.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("subjective"))
    both = mechanical.withColumn("_", F.lit(1)).join(F.broadcast(mean.withColumn("_", F.lit(1))), "_").drop("_")
    raw = F.when(F.col("subjective").isNull(), F.col("mechanical")).otherwise(F.col("mechanical") * 0.4 + F.col("subjective") * 0.6)
    return both.select("mode", "mechanical", "subjective", round_tenth(raw).alias("overall"))


def gaps(scores: DataFrame) -> DataFrame:
    """Dimensions whose lenient score is more than a point above the strict one, the three widest."""
    pivot = scores.groupBy("dimension").agg(*(F.max(F.when(F.col("mode") == m, F.col("score"))).alias(m) for m in ("lenient", "strict")))
    gap = F.round(F.col("lenient") * 10 - F.col("strict") * 10).cast("int")
    return pivot.withColumn("gap_tenths", gap).where("gap_tenths > 10").orderBy(F.desc("gap_tenths"), "dimension").limit(3)


def score_drag(scores: DataFrame, n: int = 5, mode: str = "strict") -> DataFrame:
    return scores.where((F.col("mode") == mode) & (F.col("score") < 100)).orderBy("score", "dimension").limit(n).select("dimension", "score", "issues")


def trends(now: DataFrame, before: DataFrame, band: float = 0.5) -> DataFrame:
    """dimension, score, previous, trend: up, down, same within the band, new."""
    joined = now.select("dimension", "score").join(before.select("dimension", F.col("score").alias("previous")), "dimension", "left")
    change = F.col("score") - F.col("previous")
    trend = F.when(F.col("previous").isNull(), "new").when(change > band, "up").when(change < -band, "down").otherwise("same")
    return joined.withColumn("trend", trend)


def ranked_per_detector(findings: DataFrame, per_detector: int, overall: int | None = None) -> DataFrame:
    """The noise budget: the first N of each detector by (tier, confidence, id); then an overall cap on all but security findings.

    Hot detectors: rank windows over one detector would hold its rows in one task, so each hash bucket of it keeps its
    first N before they meet."""
    from evidentia.functions.text import confidence_rank

    order = ["tier", confidence_rank(F.col("confidence")), "id"]
    salted = findings.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("detector", "_salt").orderBy(*order))).where(F.col("_r") <= per_detector).drop("_salt", "_r")
    kept = some.withColumn("rank", F.row_number().over(Window.partitionBy("detector").orderBy(*order))).where(F.col("rank") <= per_detector)
    if overall is None:
        return kept
    secure = kept.where("detector = 'security'")
    return kept.where("detector <> 'security'").orderBy(*order).limit(overall).unionByName(secure)
