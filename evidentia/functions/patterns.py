"""Path patterns: globs, exclusions, ignores, zones, scopes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import basename


def like_glob(target: Column, pattern: str) -> Column:
    """`*` stands for any run; both ends are anchored."""
    return target.rlike("(?s)^" + ".*".join(map(re.escape, pattern.split("*"))) + "$")


def like_tree_glob(path: Column, pattern: str) -> Column:
    """`*` spans slashes, `?` is one character, a leading `**/` may be left out."""
    body = pattern.removeprefix("**/")
    regex = re.escape(body).replace(r"\*\*", ".*").replace(r"\*", ".*").replace(r"\?", ".")
    return path.rlike(f"(?s)^{'(?:.*/)?' if body != pattern else ''}{regex}$")


def excluded(path: Column, pattern: str) -> Column:
    """No `*`: contained. One: at the end, at the start, or (inside) contains the first part and ends with the second. More: the
    pattern without outer `*` is contained."""
    stars = pattern.count("*")
    if not stars:
        return path.contains(pattern)
    if stars > 1:
        return path.contains(pattern.strip("*"))
    head, tail = pattern.split("*")
    if not head:
        return path.endswith(tail)
    return path.startswith(head) if not tail else path.contains(head) & path.endswith(tail)


def any_excluded(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (excluded(path, p) for p in patterns), F.lit(False))


def ignored(finding: Column, file: Column, pattern: str) -> Column:
    """With `*` a glob over the id (if it has `::`) or the file; with `::` a prefix of the id; else the file itself."""
    if "*" in pattern:
        return like_glob(finding if "::" in pattern else file, pattern)
    return finding.startswith(pattern) if "::" in pattern else file == pattern


def first_ignore(finding: Column, file: Column, patterns: list[str]) -> Column:
    """The first pattern of the list that matches, or null."""
    return F.coalesce(*(F.when(ignored(finding, file, p), p) for p in patterns), F.lit(None).cast("string"))


def in_scope(path: Column, scope: str | None) -> Column:
    """No scope, or '.', holds everything; else the path itself, what lies below it, and repository-level rows."""
    if scope in (None, "", "."):
        return F.lit(True)
    clean = scope.rstrip("/")
    return path.startswith(clean + "/") | (path == clean) | (path == ".")


#: Zone rules in order of precedence.
COMMON_ZONES = [
    ("vendor", ["/vendor/", "/third_party/", "/vendored/"]),
    ("generated", ["/generated/", "/__generated__/"]),
    ("test", ["/tests/", "/test/", "/fixtures/"]),
    ("script", ["/scripts/", "/bin/"]),
]
#: Zones that do not count towards scores.
UNSCORED = ("test", "config", "generated", "vendor")


def in_zone(path: Column, pattern: str) -> Column:
    """Six shapes: /directory/, .extension, prefix_, _suffix, a base name with an extension, part of the path."""
    name = basename(path)
    if pattern.startswith("/") and pattern.endswith("/"):
        return F.concat(F.lit("/"), path, F.lit("/")).contains(pattern)
    if pattern.startswith("."):
        return name.contains(pattern)
    if pattern.endswith("_"):
        return name.startswith(pattern)
    if pattern.startswith("_"):
        return name.endswith(pattern)
    if "/" not in pattern and re.search(r"\.[A-Za-z0-9]{1,5}$", pattern):
        return name == pattern
    return path.contains(pattern)


def zone_of(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first rule that matches, else production."""
    hits = [F.when(reduce(lambda a, b: a | b, (in_zone(path, p) for p in patterns)), zone) for zone, patterns in rules]
    return F.coalesce(*hits, F.lit("production"))


def is_scored(zone: Column) -> Column:
    return ~F.coalesce(zone, F.lit("production")).isin(*UNSCORED)


#: Detectors whose findings a zone skips; generated and vendored files skip all.
SKIPPED = {
    "test": ["coupling", "orphaned", "flat_dirs", "naming", "single_use", "facade", "cycles", "exports", "private_imports", "layer_violation", "responsibility_cohesion", "global_mutable_config", "dict_keys"],
    "config": ["coupling", "orphaned", "flat_dirs", "naming", "single_use", "facade", "cycles", "exports", "smells", "react", "props", "uncalled_functions", "private_imports", "layer_violation", "responsibility_cohesion", "global_mutable_config", "dict_keys"],
    "script": ["coupling", "orphaned", "flat_dirs", "naming", "single_use", "facade", "cycles", "exports", "private_imports", "layer_violation"],
}


def is_skipped(zone: Column, detector: Column) -> Column:
    """Whether a zone skips a detector's findings; no zone is production, which skips none."""
    listed = [(zone == z) & detector.isin(*names) for z, names in SKIPPED.items()]
    return F.coalesce(reduce(lambda a, b: a | b, listed, zone.isin("generated", "vendor")), F.lit(False))
