"""Filters on findings, the scan merge and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import patterns, text

NEVER_RESOLVED = ("security", "hardcoded_secrets")
#: Statuses that count as failures, by mode. A finding resolved by a scan never does.
FAILURES = {
    "lenient": ("open",),
    "strict": ("open", "wontfix"),
    "verified_strict": ("open", "wontfix", "fixed", "false_positive"),
}


def show(findings: DataFrame, status: str = "open", detector: str | None = None, prefix: str | None = None, tier: int | None = None, needle: str | None = None) -> DataFrame:
    """Unsuppressed findings; the tier is matched exactly, the needle in summary, file or id in any case."""
    tests = [~F.col("suppressed"), F.col("status") == status]
    tests += [F.col("detector") == detector] if detector else []
    tests += [F.col("file").startswith(prefix)] if prefix else []
    tests += [F.col("tier") == tier] if tier else []
    tests += [reduce(lambda a, b: a | b, (F.lower(c).contains(needle.lower()) for c in ("summary", "file", "id")))] if needle else []
    return findings.where(reduce(lambda a, b: a & b, tests))


def queue_filter(findings: DataFrame, status: str = "open", most_tier: int = 4, chronic: bool = False, scope: str | None = None) -> DataFrame:
    """Tiers up to most_tier; chronic: reopened twice or more; scope: `file:prefix` or `detector:name`."""
    out = findings.where((F.col("status") == status) & (F.col("tier") <= most_tier) & ~F.col("suppressed"))
    if chronic:
        out = out.where("reopen_count >= 2")
    kind, _, value = (scope or "").partition(":")
    return out.where(F.col("file").startswith(value)) if kind == "file" else out.where(F.col("detector") == value) if kind == "detector" else out


def fix_candidates(findings: DataFrame, detector: str, needle: str = "") -> DataFrame:
    return findings.where((F.col("status") == "open") & ~F.col("suppressed") & (F.col("tier") == 1) & (F.col("detector") == detector) & (F.col("summary").contains(needle) | F.col("file").contains(needle)))


def modes(findings: DataFrame) -> DataFrame:
    """One row per mode in which a finding fails."""
    fails = F.array_compact(F.array(*(F.when(F.col("status").isin(*s), m) for m, s in FAILURES.items())))
    return findings.withColumn("mode", F.explode(fails))


def candidates(findings: DataFrame) -> DataFrame:
    """Findings that can count: not suppressed, in a scored zone."""
    return findings.where(~F.col("suppressed") & patterns.is_scored(F.col("zone")))


def suspects(prev: DataFrame, cur: DataFrame, ran: DataFrame | None, force: bool = False) -> DataFrame:
    """(detector): detectors whose silence is no evidence. Always review; else, with nothing found now: those that did not run, those that ran
    and had 3 or more open before, and, without knowledge of what ran, those that had any."""
    before = prev.where("status = 'open'").groupBy("detector").agg(F.count("*").alias("before"))
    now = cur.groupBy("detector").agg(F.count("*").alias("now"))
    joined = before.join(now, "detector", "left")
    silent = F.col("now").isNull()
    if force:
        return joined.select("detector").where(F.lit(False))
    if ran is None:
        return joined.where((F.col("detector") == "review") | silent).select("detector")
    joined = joined.join(ran.select("detector").distinct().withColumn("ran", F.lit(True)), "detector", "left")
    return joined.where((F.col("detector") == "review") | (silent & (F.col("ran").isNull() | (F.col("before") >= 3)))).select("detector")


def merge(prev: DataFrame, cur: DataFrame, ran: DataFrame | None, lang: str, scope: str | None = None, exclude: list[str] | None = None, ignore: list[str] | None = None, force: bool = False) -> DataFrame:
    """The scan merge: one full outer join on id, then status rules.

    action: new, matched, reopened, suppressed (an ignore pattern matched), resolved, kept, or why a missing finding was kept: other_lang,
    out_of_scope, excluded, suspect, protected (security findings are never resolved by absence), already.
    """
    p, c = prev.alias("p"), cur.dropDuplicates(["id"]).alias("c")
    both = p.join(c, F.col("p.id") == F.col("c.id"), "full_outer")
    doubt = suspects(prev, cur, ran, force).select(F.col("detector").alias("doubted"))
    both = both.join(F.broadcast(doubt), F.col("p.detector") == F.col("doubted"), "left")  # one row per detector at most
    found, known = F.col("c.id").isNotNull(), F.col("p.id").isNotNull()
    file = F.coalesce("c.file", "p.file")
    pattern = patterns.first_ignore(F.coalesce("c.id", "p.id"), file, ignore or [])
    missing = (
        F.when(F.col("p.status") == "auto_resolved", "already")
        .when(F.col("p.lang") != lang, "other_lang")
        .when(~patterns.in_scope(F.col("p.file"), scope), "out_of_scope")
        .when(patterns.any_excluded(F.col("p.file"), exclude or []), "excluded")
        .when(F.col("doubted").isNotNull(), "suspect")
        .when(F.col("p.detector").isin(*NEVER_RESOLVED), "protected")
        .otherwise("resolved")
    )
    action = (
        F.when(found & pattern.isNotNull(), "suppressed")
        .when(found & ~known, "new")
        .when(found & F.col("p.status").isin("fixed", "auto_resolved"), "reopened")
        .when(found, "matched")
        .otherwise(missing)
    )
    latest = lambda name: F.coalesce(F.col(f"c.{name}"), F.col(f"p.{name}"))
    old = F.coalesce("p.status", F.lit("open"))
    out = both.select(
        F.coalesce("c.id", "p.id").alias("id"),
        latest("detector").alias("detector"),
        file.alias("file"),
        *(latest(n).alias(n) for n in ("tier", "confidence", "summary", "detail", "zone")),
        F.coalesce("p.lang", F.lit(lang)).alias("lang"),
        old.alias("old_status"),
        F.coalesce("p.reopen_count", F.lit(0)).alias("old_reopens"),
        F.coalesce("p.suppressed", F.lit(False)).alias("old_suppressed"),
        action.alias("action"),
        F.when(found, pattern).alias("suppression_pattern"),
    )
    a = F.col("action")
    status = F.when(a == "resolved", "auto_resolved").when(a == "reopened", "open").otherwise(F.col("old_status"))
    reopens = F.col("old_reopens") + F.when(a == "reopened", 1).otherwise(0)
    note = F.when(a == "reopened", F.concat(F.lit("reopened "), reopens, F.lit(" times, was "), "old_status")).when(
        a == "resolved", F.when(F.col("old_status") == "wontfix", "no longer found; was wontfix").otherwise("no longer found")
    )
    hidden = F.when(a == "suppressed", True).when(a.isin("new", "matched", "reopened"), False).otherwise(F.col("old_suppressed"))
    return out.select("id", "detector", "file", "tier", "confidence", "summary", "detail", "zone", "lang", status.alias("status"), reopens.alias("reopen_count"), hidden.alias("suppressed"), "suppression_pattern", note.alias("note"), "action")


def diff(merged: DataFrame, raw: DataFrame) -> DataFrame:
    """One row of counts: what the scan changed, chronic findings, and the share suppressed."""
    count = lambda c: F.count(F.when(c, 1))
    a = F.col("action")
    out = merged.agg(
        *(count(a == x).alias(x) for x in ("new", "matched", "reopened", "suppressed", "resolved", "other_lang", "out_of_scope", "suspect", "protected")),
        count((F.col("reopen_count") >= 2) & (F.col("status") == "open")).alias("chronic"),
        count((F.col("status") == "open") & ~F.col("suppressed")).alias("open"),
        F.max(F.lit(1)).alias("_"),
    )
    found = raw.agg(F.count("*").alias("raw_findings"), F.max(F.lit(1)).alias("_"))
    share = F.when(F.col("raw_findings") > 0, F.floor(1000 * F.col("suppressed") / F.col("raw_findings") + 0.5) / 10).otherwise(0.0)
    return out.join(F.broadcast(found), "_").drop("_").withColumn("suppressed_pct", share)


def stats(findings: DataFrame) -> DataFrame:
    """Counts by tier and over all (tier null); suppressed rows are included."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in text.STATUSES]
    return findings.rollup("tier").agg(F.count("*").alias("total"), *counts)


def resolve(findings: DataFrame, pattern: str, status: str, note: str) -> DataFrame:
    """A point update of open findings whose id fits a glob."""
    hit = patterns.like_glob(F.col("id"), pattern) & (F.col("status") == "open")
    return findings.withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "note": F.when(hit, note)})


def move(findings: DataFrame, src: str, dst: str) -> DataFrame:
    """Findings of a renamed file or directory get the new path and map key; the finding's own id stays."""
    below = F.col("file").startswith(src.rstrip("/") + "/")
    new: Column = F.when(F.col("file") == src, F.lit(dst)).when(below, F.concat(F.lit(dst), F.substring(F.col("file"), len(src) + 1, 1 << 30))).otherwise(F.col("file"))
    return findings.withColumn("map_key", text.finding_id(F.col("detector"), new, F.col("key"))).withColumn("file", new)


def subjective_overlay(scores: DataFrame, assessed: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Dimension rows with the latest assessment of each dimension put over them."""
    names = text.dimension_name(F.col("dimension"))
    weight = F.coalesce(*(F.when(names == k, F.lit(v)) for k, v in weights.items()), F.lit(1.0))
    rows = assessed.select("dimension", "score", weight.alias("weight"), F.lit(True).alias("subjective"))
    return scores.join(rows.select("dimension"), "dimension", "left_anti").select("dimension", "score", F.lit(None).cast("double").alias("weight"), F.lit(False).alias("subjective")).unionByName(rows)
