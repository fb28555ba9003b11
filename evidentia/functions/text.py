"""Column functions on ids, paths, names, dates and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finding_id(detector: Column, file: Column, key: Column | None = None) -> Column:
    """detector::file or detector::file::key."""
    parts = [detector, file] if key is None else [detector, file, key.cast("string")]
    return F.concat_ws("::", *parts)


def entity(finding: Column) -> Column:
    """The third part of an id, with everything after it; null if there is none."""
    return F.try_element_at(F.split(finding, "::", 3), F.lit(3))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    clean = slashes(path)
    return F.when(clean.startswith(base), F.substring(clean, len(base) + 1, 1 << 30)).otherwise(clean)


def resolve(path: Column, root: str) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), path)


def basename(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def parent(path: Column) -> Column:
    """Directory of a path, '.' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def label(detector: Column) -> Column:
    """A detector's or cluster's name in words."""
    return F.initcap(F.replace(detector, F.lit("_"), F.lit(" ")))


def dimension_name(name: Column) -> Column:
    """Lower case, trimmed, runs of spaces and underscores collapsed."""
    return F.trim(F.regexp_replace(F.lower(name), "[ _]+", " "))


def status_canonical(status: Column) -> Column:
    """The older name of fixed."""
    return F.when(status == "resolved", "fixed").otherwise(status)


STATUSES = ("open", "fixed", "auto_resolved", "wontfix", "false_positive")


def status_parse(status: Column) -> Column:
    """Loose: trimmed, lower case, unknown is open."""
    clean = status_canonical(F.lower(F.trim(status)))
    return F.when(clean.isin(*STATUSES), clean).otherwise("open")


def confidence_weight(confidence: Column) -> Column:
    """In tenths: 10, 7, 3."""
    return F.when(confidence == "high", 10).when(confidence == "medium", 7).otherwise(3)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2)


def tier_weight(tier: Column) -> Column:
    """In tenths: 10, 15, 20, 30."""
    return F.when(tier == 1, 10).when(tier == 2, 15).when(tier == 3, 20).otherwise(30)


def action_impact(confidence: Column, tier: Column, reopened: Column) -> Column:
    """In hundredths: confidence x tier weight + half a point for each time it was reopened."""
    return confidence_weight(confidence) * tier_weight(tier) + 50 * reopened


def is_stale(day: Column, today: Column, most_days: int) -> Column:
    """Age by years of 365 and months of 30 days; a malformed day is stale."""
    number = lambda c: F.substring(c, 1, 4).cast("int") * 365 + F.substring(c, 6, 2).cast("int") * 30 + F.substring(c, 9, 2).cast("int")
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}"), number(today) - number(day) > most_days).otherwise(True)


def timestamp_text(at: Column) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def convention(name: Column) -> Column:
    """Naming convention of a file's stem."""
    return (
        F.when(name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab")
        .when(name.rlike(r"^[A-Z][A-Za-z0-9]*$"), "pascal")
        .when(name.rlike(r"^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike(r"^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$"), "camel")
        .when(name.rlike(r"^[a-z0-9]+$"), "flat")
        .otherwise("other")
    )


def round_tenth(value: Column) -> Column:
    """Half up at one decimal, of a value from 0 on."""
    return F.floor(value * 10 + 0.5) / 10


def clamp(value: Column, least: float = 0, most: float = 100) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def score_bar(score: Column, width: int = 20) -> Column:
    """Filled and empty cells."""
    full = F.floor(score / 100 * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), width - full))


def body_normalised(body: Column) -> Column:
    """Trimmed lines without blanks and comments."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(#|//|/\*)"))
    return F.array_join(kept, "\n")


def body_hash(body: Column) -> Column:
    return F.sha2(body_normalised(body), 256)


def max_findings(n: Column) -> Column:
    return F.greatest(F.lit(10), n)
