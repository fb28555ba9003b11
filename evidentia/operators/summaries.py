"""Aggregates over findings: concerns, signals, clusters, priorities, actions, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import patterns, text


def _open(findings: DataFrame) -> DataFrame:
    return findings.where("status = 'open' and not suppressed")


def concerns(findings: DataFrame) -> DataFrame:
    """Files that two detectors flag, or one with 300 lines or more in its detail."""
    loc = F.get_json_object("detail", "$.loc").cast("int")
    own = _open(findings).groupBy("file").agg(F.sort_array(F.collect_set("detector")).alias("detectors"), F.max(loc).alias("most_loc"), F.count("*").alias("sources"))
    return own.where((F.size("detectors") >= 2) | (F.col("most_loc") >= 300))


def shared_profiles(findings: DataFrame, least_files: int = 3) -> DataFrame:
    """Detector sets of two or more that at least three files have in common."""
    own = _open(findings).groupBy("file").agg(F.concat_ws(",", F.sort_array(F.collect_set("detector"))).alias("profile"), F.count_distinct("detector").alias("k"))
    return own.where("k >= 2").groupBy("profile").agg(F.count("*").alias("files"), F.min("file").alias("first")).where(F.col("files") >= least_files)


def systemic_smells(findings: DataFrame, least_files: int = 5) -> DataFrame:
    smell = F.get_json_object("detail", "$.smell_id").alias("smell")
    return _open(findings).where("detector = 'smells'").groupBy(smell).agg(F.count_distinct("file").alias("files"), F.count("*").alias("n")).where(F.col("files") >= least_files)


def cluster_keys(findings: DataFrame) -> DataFrame:
    """Three keys for each finding: its detector with its entity, its file's directory, its detector."""
    keys = F.array(F.concat(F.lit("detector::"), "detector", F.lit("::"), text.entity(F.col("id"))), F.concat(F.lit("file::"), text.basename(F.col("file"))), F.concat(F.lit("auto::"), "detector"))
    return findings.withColumn("cluster", F.explode(keys))


def auto_clusters(findings: DataFrame, shown: int = 5) -> DataFrame:
    """Clusters of two or more open findings: size and first ids. Ids are kept up to `shown` while counting, so that a hot cluster is never gathered."""
    rows = cluster_keys(_open(findings))
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n >= 2")


def file_priority(findings: DataFrame, exclude: list[str]) -> DataFrame:
    """n x (1 + 0.3 x detectors), in tenths."""
    own = _open(findings).where(~patterns.any_excluded(F.col("file"), exclude)).groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("detector").alias("detectors"))
    return own.withColumn("priority", F.col("n") * (10 + 3 * F.col("detectors")))


def density(findings: DataFrame, n: int = 10) -> DataFrame:
    """The files with most findings (two or more)."""
    return _open(findings).groupBy("file").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "file").limit(n)


def top_detectors(findings: DataFrame, n: int = 3) -> DataFrame:
    return _open(findings).groupBy("detector").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "detector").limit(n)


def analysis(findings: DataFrame) -> DataFrame:
    """Open findings by detector, by tier and over all."""
    return _open(findings).groupingSets([["detector"], ["tier"], []], "detector", "tier").agg(F.count("*").alias("n"))


def debt(findings: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    open_ = F.col("status") == "open"
    return findings.where("not suppressed").agg(count(open_).alias("open"), count(F.col("status") == "wontfix").alias("wontfix"), count(open_ & (F.col("reopen_count") >= 2)).alias("chronic"))


def risks(findings: DataFrame) -> DataFrame:
    """Flags: open security findings (high), findings reopened three times (medium)."""
    flags = F.array_compact(F.array(F.when(F.col("detector") == "security", F.struct(F.lit("security_open").alias("flag"), F.lit("high").alias("level"))), F.when(F.col("reopen_count") >= 3, F.struct(F.lit("reopened").alias("flag"), F.lit("medium").alias("level")))))
    return _open(findings).withColumn("f", F.explode(flags)).groupBy("f.flag", "f.level").agg(F.count("*").alias("n"))


#: What to do about a detector's findings.
ACTIONS = {"unused": "auto_fix", "orphaned": "reorganize", "coupling": "reorganize", "structural": "refactor", "smells": "refactor", "dupes": "refactor", "cycles": "refactor", "naming": "reorganize", "security": "manual_fix", "test_coverage": "manual_fix", "review": "manual_fix", "signature": "manual_fix"}
ACTION_ORDER = ["auto_fix", "manual_fix", "refactor", "reorganize"]


def with_action(findings: DataFrame) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("detector") == d, a) for d, a in ACTIONS.items()), F.lit("manual_fix"))
    order = F.coalesce(*(F.when(F.col("action") == a, k) for k, a in enumerate(ACTION_ORDER)))
    impact = text.action_impact(F.col("confidence"), F.col("tier"), F.col("reopen_count"))
    return findings.withColumn("action", kind).withColumn("action_order", order).withColumn("impact", impact)


def actions(findings: DataFrame, n: int = 20) -> DataFrame:
    return with_action(_open(findings)).orderBy("action_order", F.desc("impact"), "id").limit(n).select("id", "action", "impact")


def lanes(findings: DataFrame) -> DataFrame:
    """Open findings by kind of action: how many, in how many files, and how many of the files another lane holds too."""
    own = with_action(_open(findings)).groupBy("action", "file").agg(F.count("*").alias("n"))
    shared = own.groupBy("file").agg((F.count("*") > 1).alias("shared"))
    out = own.join(shared, "file").groupBy("action").agg(F.sum("n").alias("findings"), F.count("*").alias("files"), F.count(F.when(F.col("shared"), 1)).alias("shared_files"))
    return out.withColumn("parallel", F.col("shared_files") == 0)


def tree(findings: DataFrame) -> DataFrame:
    """Findings by every directory above a file, suppressed ones included."""
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return findings.groupBy("file", "tier").agg(F.count("*").alias("n")).withColumn("path", F.explode(above)).groupBy("path").agg(F.sum("n").alias("findings"), F.min("tier").alias("worst_tier"))


def scope_breakdown(findings: DataFrame, scope: str) -> DataFrame:
    inside = patterns.in_scope(F.col("file"), scope)
    return _open(findings).agg(F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(~inside, 1)).alias("outside"))


def chronic(findings: DataFrame) -> DataFrame:
    return findings.where("status = 'open' and reopen_count >= 2").select("id", "reopen_count")


def naming_minority(paths: DataFrame) -> DataFrame:
    """Files of a directory (five files or more) that follow a convention of 2 to 4 files and under 15 % of it."""
    own = paths.select("path", text.parent(F.col("path")).alias("dir"), text.convention(text.stem(F.col("path"))).alias("convention"))
    by = own.groupBy("dir", "convention").agg(F.count("*").alias("n"))
    whole = by.groupBy("dir").agg(F.sum("n").alias("total"))
    rare = by.join(whole, "dir").where("total >= 5 and n >= 2 and n < 5 and n * 100 < total * 15 and convention <> 'other'")
    return rare.select("dir", "convention", "n", "total")


def flat_directories(paths: DataFrame, most: int = 12) -> DataFrame:
    return paths.groupBy(text.parent(F.col("path")).alias("dir")).agg(F.count("*").alias("files")).where(F.col("files") > most)


def signature_drift(functions: DataFrame) -> DataFrame:
    """Function names with three definitions or more in three files or more that differ in their number of parameters."""
    kept = functions.where(~F.col("name").rlike(r"^(__.*__|test_.*|main|run|setup|teardown)$"))
    out = kept.groupBy("name").agg(F.count("*").alias("defs"), F.count_distinct("file").alias("files"), F.min("params").alias("least"), F.max("params").alias("most"))
    return out.where("defs >= 3 and files >= 3 and least <> most")


def scan_warnings(d: DataFrame) -> DataFrame:
    """Of a scan diff: which warnings it gives."""
    rules = {"many_reopened": F.col("reopened") > 5, "many_new": F.col("new") > 10, "chronic": F.col("chronic") >= 3}
    return d.select(F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))).alias("warning"))
