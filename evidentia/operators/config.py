"""Typed edits of project configurations: every edit checked by the type of its key, the last valid one of a key stands, unknown fields stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings with their type and default as JSON, in their order; lists and objects can be unset but not set.
SETTINGS = [
    ("target_strict_score", "score", "95"),
    ("review_max_age_days", "age", "30"),
    ("review_batch_max_files", "count", "80"),
    ("holistic_max_age_days", "age", "30"),
    ("generate_scorecard", "flag", "true"),
    ("badge_path", "file", '"scorecard.png"'),
    ("exclude", "list", "[]"),
    ("ignore", "list", "[]"),
    ("ignore_metadata", "object", "{}"),
    ("zone_overrides", "object", "{}"),
    ("review_dimensions", "list", "[]"),
    ("large_files_threshold", "count", "0"),
    ("props_threshold", "count", "0"),
    ("finding_noise_budget", "count", "10"),
    ("finding_noise_global_budget", "count", "0"),
    ("needs_rescan", "flag", "false"),
    ("languages", "object", "{}"),
]
_COUNT = r"^\+?0*[0-9]{1,10}$"


def _lookup(key: Column, place: int) -> Column:
    return F.coalesce(*(F.when(key == s[0], s[place]) for s in SETTINGS))


def _count(raw: Column) -> Column:
    """A whole number of 32 bits without a sign, or null."""
    value = F.when(raw.rlike(_COUNT), F.regexp_replace(raw, r"^\+", "").try_cast("long"))
    return F.when(value < F.lit(1 << 32), value)


def judged(edits: DataFrame) -> DataFrame:
    """edits (project, seq, op, key, raw) with value, the new value as JSON, or error."""
    kind, raw, n = _lookup(F.col("key"), 1), F.col("raw"), _count(F.col("raw"))
    flag = F.when(F.lower(raw).isin("true", "1", "yes"), "true").when(F.lower(raw).isin("false", "0", "no"), "false")
    text = F.when((raw != "") & ~raw.endswith("/"), F.concat(F.lit('"'), F.regexp_replace(raw, r'(["\\])', r"\\$1"), F.lit('"')))
    forms = {
        "score": (F.when(n <= 100, n.cast("string")), F.when(n.isNull(), "expected integer").otherwise("must be 0-100")),
        "age": (F.when(raw == "never", "0").otherwise(n.cast("string")), F.lit("expected integer or never")),
        "count": (n.cast("string"), F.lit("expected integer")),
        "flag": (flag, F.lit("expected boolean")),
        "file": (text, F.lit("must be a filename")),
    }
    pick = lambda i, rest: reduce(lambda acc, k: acc.when(kind == k, forms[k][i]), list(forms)[1:], F.when(kind == "score", forms["score"][i])).otherwise(rest)
    is_set = F.col("op") == "set"
    value = F.when(is_set, pick(0, F.lit(None).cast("string"))).when(F.col("op") == "unset", _lookup(F.col("key"), 2))
    error = F.when(~F.col("op").isin("set", "unset"), "unknown operation").when(is_set, pick(1, F.lit("unknown or non-settable key"))).otherwise("unknown key")
    return edits.withColumn("value", value).withColumn("error", F.when(F.col("value").isNull(), error))


def settings(configs: DataFrame, edits: DataFrame) -> DataFrame:
    """configs (project, config as JSON, null or broken: all defaults) to (project, key, value as JSON): defaults, what the document says, unknown fields too, and the last valid edit of each key."""
    said = configs.select("project", F.explode(F.coalesce(F.from_json("config", "map<string,variant>"), F.create_map().cast("map<string,variant>"))).alias("key", "v")).select("project", "key", F.to_json("v").alias("value"), F.lit(1).alias("rank"))
    defaults = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, _, v in SETTINGS)))
    basic = configs.select("project", defaults.alias("d")).select("project", "d.key", "d.value", F.lit(0).alias("rank"))
    last = judged(edits).where("value is not null").groupBy("project", "key").agg(F.max_by("value", "seq").alias("value")).select("project", "key", "value", F.lit(2).alias("rank"))
    known = last.join(configs.select("project"), "project", "left_semi")
    return basic.union(said).union(known).groupBy("project", "key").agg(F.max_by("value", "rank").alias("value"))


def documents(resolved: DataFrame) -> DataFrame:
    """(project, config): one JSON document per project, settings in their order, then unknown fields by name."""
    place = F.coalesce(*(F.when(F.col("key") == k, F.lit(n)) for n, (k, _, _) in enumerate(SETTINGS)), F.lit(len(SETTINGS)))
    field = F.struct(place.alias("place"), "key", F.concat(F.to_json(F.array("key")), F.lit(":"), "value").alias("text"))
    own = resolved.groupBy("project").agg(F.sort_array(F.collect_list(field)).alias("f"))
    # the key is quoted as an array of one, whose brackets go
    parts = F.transform("f", lambda x: F.regexp_replace(x["text"], r'^\["((?:[^"\\]|\\.)*)"\]', '"$1"'))
    return own.select("project", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("config"))
