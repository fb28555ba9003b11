"""The event ledger: chain verification, projections, and state rules of an append-only, hash-chained event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.relations import GENESIS
from evidentia.sources.written import written

SPAN = 4096
#: Legal moves of a change.
MOVES = [("planned", "lane"), ("lane", "verifying"), ("verifying", "verified"), ("verified", "landed"), ("planned", "discarded"), ("lane", "discarded"), ("verifying", "discarded")]


def with_previous(events: DataFrame) -> DataFrame:
    """Each event with the one before it by seq: an equi-join on seq - 1, so that no task holds the whole chain."""
    before = events.select((F.col("seq") + 1).alias("seq"), F.col("payload_hash").alias("expected"), F.lit(True).alias("has_before"))
    return events.join(before, "seq", "left")


def violations(events: DataFrame, tasks: int | None = None) -> DataFrame:
    """(seq, problem): gaps in seq, links that do not fit, payloads that do not fit their hash, ids used twice. tasks: how many to deal the events over, where their number is known."""
    dealt = lambda rows, key: rows.repartition(tasks, key) if tasks else rows
    altered = (F.col("payload_hash") != F.sha2("payload", 256)).alias("altered")
    own = written(events.select("seq", "event_id", "prev_hash", "payload_hash", altered))  # read for each end of a link, and for ids; payloads stay behind
    linked = with_previous(dealt(own.drop("event_id"), "seq"))
    first = F.col("seq") == 1
    tests = [
        ("gap", ~first & F.col("has_before").isNull()),
        ("link", F.col("prev_hash") != F.when(first, F.lit(GENESIS)).otherwise(F.col("expected"))),
        ("payload", F.col("altered")),
    ]
    found = linked.select("seq", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in tests)))).alias("problem"))
    ids = dealt(own.select("event_id", "seq"), "event_id")
    twice = ids.groupBy("event_id").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).where("n > 1").select("seq", F.lit("repeated_id").alias("problem"))
    return found.union(twice)


def projection(events: DataFrame) -> DataFrame:
    """Per kind: number, first and last seq, the last payload."""
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("payload", "seq").alias("last_payload"))


def illegal_moves(changes: DataFrame) -> DataFrame:
    """changes (change, seq, status): steps that no rule allows; a change begins as planned."""
    w = Window.partitionBy("change").orderBy("seq")  # the events of one change
    steps = changes.withColumn("before", F.lag("status").over(w))
    legal = F.coalesce(*(F.when((F.col("before") == a) & (F.col("status") == b), True) for a, b in MOVES), F.lit(False)) | (F.col("before").isNull() & (F.col("status") == "planned"))
    return steps.where(~legal).select("change", "seq", "before", "status")


def latest(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def crowded(lanes: DataFrame, most: int = 1) -> DataFrame:
    """lanes (lane, seq, step +1 or -1): moments with more than one lane open. The running count is taken per range of seq, with the sums before it carried over."""
    spans = lanes.withColumn("span", F.floor(F.col("seq") / SPAN))
    before = spans.groupBy("span").agg(F.sum("step").alias("s")).select("span", F.coalesce(F.sum("s").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("step").over(Window.partitionBy("span").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return spans.join(before, "span").select("lane", "seq", (inside + F.col("before")).alias("open")).where(F.col("open") > most)


def dangling(rows: DataFrame, targets: DataFrame, on: str) -> DataFrame:
    """References without a target."""
    return rows.join(targets.select(on), on, "left_anti")


def ladder(results: DataFrame) -> DataFrame:
    """results (run, step, passed): every step after a run's first failure is inconclusive."""
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max((~F.col("passed")).cast("int")).over(w), F.lit(0)) == 1
    return results.select("run", "step", F.when(failed, "inconclusive").when(F.col("passed"), "passed").otherwise("failed").alias("verdict"))
