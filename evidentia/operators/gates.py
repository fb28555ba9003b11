"""What a ledger's state allows next: the first gate, in order, that stops a change from being worked on or from landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.event_rules import change_states, decoded, ruleset_hash
from evidentia.sources.written import written

_PLAN = ["head", "tree", "lineage", "brief", "brief_hash"]


class State:
    """The last state of every ledger, as tables; each row is the last event of its key, by partial maxima."""

    def __init__(self, events: DataFrame):
        e = written(decoded(events))
        of = lambda *kinds: e.where(F.col("kind").isin(*kinds))
        last = lambda rows, *columns: rows.groupBy("ledger", "subject").agg(F.max_by(F.struct(*columns), "seq").alias("v")).select("ledger", "subject", "v.*")
        base = [F.get_json_object("payload", f"$.base.{c}").alias(c) for c in _PLAN[:2]]
        plans = of("change_planned").groupBy("ledger", "subject").agg(F.min_by(F.struct(*base, *(F.col(f"p.{c}").alias(c) for c in _PLAN[2:])), "seq").alias("v")).select("ledger", "subject", "v.*")
        self.changes = plans.join(last(change_states(e), "status"), ["ledger", "subject"])
        lane = of("lane_opened", "lane_closed")
        self.lanes = last(lane, F.when(F.col("kind") == "lane_opened", "active").otherwise(F.col("p.outcome")).alias("lane"), F.col("p.lane_path").alias("lane_path"))
        self.open_decisions = last(of("decision_opened", "decision_answered"), "kind").where("kind = 'decision_opened'").select("ledger", "subject")
        self.rulesets = of("ruleset_ratified").groupBy("ledger").agg(F.max_by("payload", "seq").alias("ruleset"))
        self.verifications = last(of("verification_recorded"), F.get_json_object("payload", "$.result_tree").alias("result_tree"))
        self.ledgers = e.select("ledger").distinct()


def _verdict(rows: DataFrame, *gates: tuple[str, Column], passed: str) -> DataFrame:
    """(ledger, verdict, change): the first gate whose condition holds, else `passed` with the change."""
    gate = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in gates), F.lit(passed))
    return rows.select("ledger", gate.alias("verdict"), F.when(gate == passed, F.col("subject")).alias("change"))


def _one(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Per ledger how many rows there are and the columns of one of them (the only one, where the count is 1)."""
    return rows.groupBy("ledger").agg(F.count("*").alias(f"n_{name}"), *(F.min(c).alias(c) for c in columns))


def climbable(state: State, repos: DataFrame) -> DataFrame:
    """repos (ledger, dirty, head, tree, rules) to one row per ledger: (ledger, verdict, change). Work can start on the only planned change, if no lane is active, no lane of a discarded
    change is retained, no decision is open, the ratified rule set has a purpose and not more verifiers than its budget, and repository and rule set are those of the plan."""
    held = state.lanes.join(state.changes.select("ledger", "subject", "status"), ["ledger", "subject"], "left")
    lanes = held.groupBy("ledger").agg(F.count(F.when(F.col("lane") == "active", 1)).alias("active"), F.count(F.when((F.col("lane") == "retained") & (F.col("status") == "discarded"), 1)).alias("failed"))
    rows = state.ledgers.join(lanes, "ledger", "left").join(_one(state.open_decisions, "open"), "ledger", "left").join(state.rulesets, "ledger", "left")
    rows = rows.join(_one(state.changes.where("status = 'planned'"), "planned", "subject", *_PLAN), "ledger", "left").join(repos.withColumnsRenamed({"head": "head_now", "tree": "tree_now"}), "ledger")
    field = lambda f: F.get_json_object("ruleset", f)
    verifiers = F.coalesce(F.size(F.from_json(field("$.verifier_commands"), "array<string>")), F.lit(0))
    return _verdict(
        rows,
        ("active_lane", F.col("active") > 0), ("failed_lane", F.col("failed") > 0), ("open_decisions", F.col("n_open") > 0), ("no_ruleset", F.col("ruleset").isNull()),
        ("unratified", field("$.purpose").startswith("UNRATIFIED")), ("no_verifiers", verifiers == 0), ("too_many_verifiers", verifiers > F.coalesce(field("$.budget.subprocesses").cast("long"), F.lit(0))),
        ("planned_changes", F.coalesce("n_planned", F.lit(0)) != 1), ("dirty", F.col("dirty")), ("head", ~F.col("head").eqNullSafe(F.col("head_now"))), ("tree", ~F.col("tree").eqNullSafe(F.col("tree_now"))),
        ("ruleset_file", ~F.col("lineage").eqNullSafe(ruleset_hash(F.col("rules")))), ("ruleset_ratified", ~F.col("lineage").eqNullSafe(ruleset_hash(F.col("ruleset")))), ("brief", ~F.col("brief_hash").eqNullSafe(F.sha2("brief", 256))),
        passed="ready",
    )


def landable(state: State, repos: DataFrame) -> DataFrame:
    """repos (ledger, dirty, head, tree, lane_exists, result_tree) to one row per ledger: exactly one verified change with a retained lane on this head and tree can
    land, if its lane is there and holds the verified tree. Without such a change the verdict says what the verified ones lack."""
    verified = state.changes.where("status = 'verified'").join(state.lanes.where("lane = 'retained'"), ["ledger", "subject"], "left")
    now = repos.select("ledger", F.col("head").alias("head_now"), F.col("tree").alias("tree_now"))
    judged = verified.join(now, "ledger").withColumns({"kept": F.col("lane").isNotNull(), "here": F.col("head").eqNullSafe(F.col("head_now")) & F.col("tree").eqNullSafe(F.col("tree_now"))})
    seen = judged.groupBy("ledger").agg(F.count("*").alias("n_verified"), F.count(F.when(F.col("kept"), 1)).alias("n_kept"))
    candidates = judged.where("kept and here").join(state.verifications.withColumnRenamed("result_tree", "verified_tree"), ["ledger", "subject"], "left")
    rows = state.ledgers.join(seen, "ledger", "left").join(_one(candidates, "fit", "subject", "verified_tree"), "ledger", "left").join(repos, "ledger")
    none = F.coalesce("n_fit", F.lit(0)) == 0
    return _verdict(
        rows,
        ("dirty", F.col("dirty")), ("nothing_verified", none & F.coalesce(F.col("n_verified") == 0, F.lit(True))), ("no_retained_lane", none & (F.col("n_kept") == 0)), ("wrong_base", none), ("several", F.col("n_fit") > 1),
        ("lane_missing", ~F.col("lane_exists")), ("not_verified", F.col("verified_tree").isNull()), ("result_tree", F.col("verified_tree") != F.col("result_tree")),
        passed="landable",
    )
