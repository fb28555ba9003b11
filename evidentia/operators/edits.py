"""Edit logs of clusters and assessments: the state that a log leaves, by last writers, and the edits that found nothing to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.asof import last_before


def clusters(edits: DataFrame) -> DataFrame:
    """edits (log, seq, op, key, name, members) to (log, key, name, member), a row with a null member for an empty cluster. `create` starts a cluster anew, `delete` ends it, `add` and `remove`
    change members; of a member's edits since its cluster's last start the last one stands. Edits of a cluster that isn't there do nothing."""
    starts = edits.where("op in ('create', 'delete')").groupBy("log", "key").agg(F.max_by(F.struct("op", "name", F.col("seq").alias("since")), "seq").alias("s")).select("log", "key", "s.*").where("op = 'create'").drop("op")
    since = edits.where("op <> 'delete'").join(starts.drop("name"), ["log", "key"]).where("seq >= since")
    last = since.select("log", "key", "seq", "op", F.explode("members").alias("member")).groupBy("log", "key", "member").agg(F.max_by("op", "seq").alias("op")).where("op <> 'remove'").drop("op")
    return starts.drop("since").join(last, ["log", "key"], "left")


def refused_cluster_edits(edits: DataFrame) -> DataFrame:
    """(log, seq, op, key) of deletes, adds and removes where no such cluster was at that moment."""
    told = edits.where("op in ('create', 'delete')").select("log", "key", "seq", "op")
    return last_before(edits.where("op <> 'create'"), told, ["log", "key"], "was").where("not coalesce(was.op = 'create', false)").select("log", "seq", "op", "key")


def assessments(edits: DataFrame) -> DataFrame:
    """edits (log, seq, op, dimension, value) to (log, dimension, value): what was put last and not removed since."""
    return edits.groupBy("log", "dimension").agg(F.max_by(F.struct("op", "value"), "seq").alias("l")).where("l.op = 'put'").select("log", "dimension", "l.value")


def removals(edits: DataFrame) -> DataFrame:
    """(log, seq, dimension, found): whether a removal had something to remove."""
    told = edits.select("log", "dimension", "seq", "op")
    return last_before(edits.where("op = 'remove'"), told, ["log", "dimension"], "was").select("log", "seq", "dimension", F.coalesce(F.col("was.op") == "put", F.lit(False)).alias("found"))
