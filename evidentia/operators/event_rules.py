"""What a ledger refuses: every event against the state that the events before it leave, without replaying the ledger in one task.

The state just before an event is looked up, not carried along: last values of a key by as-of joins, first appearances of ids by equi-joins, the
number of open lanes by sums over ranges of seq. Events are judged against the log as it is written; a replay stops at a ledger's first
refused event, up to which both are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.asof import last_before, sum_before
from evidentia.operators.ledger import MOVES
from evidentia.sources.written import written

_COVERAGE = "struct<seen:bigint,total:bigint>"
_FACT = f"struct<id:string,snapshot:string,denominator:{_COVERAGE}>"
RULESET = "purpose string, non_goals array<string>, allowed_paths array<string>, protected_paths array<string>, compatibility map<string,string>, verifier_commands array<string>, risk_ceiling string, budget struct<attempts:bigint,wall_secs:bigint,subprocesses:bigint>"
#: Fields that events of all kinds are decoded by; what a kind does not have is null.
PAYLOAD = (
    f"id string, repo_id string, head string, tree string, file_universe {_COVERAGE}, snapshot string, denominator {_COVERAGE}, gates array<struct<id:string,description:string>>, evidence array<string>, "
    f"status string, decision_id string, chosen string, hash string, lineage string, brief string, brief_hash string, predicted array<{_FACT}>, change_id string, reason string, lane_path string, base_head string, base_tree string, "
    f"outcome string, change string, ruleset_hash string, realized array<{_FACT}>"
)
#: The kinds of events.
KINDS = ["snapshot_taken", "fact_recorded", "decision_opened", "decision_answered", "ruleset_ratified", "change_planned", "change_status", "lane_opened", "lane_closed", "attempt_logged", "verification_recorded"]


def canonical_ruleset(payload: Column) -> Column:
    """JSON of a rule set with its fields in their fixed order, missing lists and maps empty, without its hash."""
    r = F.from_json(payload, RULESET)
    empty = {"non_goals": F.array().cast("array<string>"), "compatibility": F.create_map().cast("map<string,string>")}
    empty |= {c: empty["non_goals"] for c in ("allowed_paths", "protected_paths", "verifier_commands")}
    names = ["purpose", "non_goals", "allowed_paths", "protected_paths", "compatibility", "verifier_commands", "risk_ceiling", "budget"]
    return F.to_json(F.struct(*(F.coalesce(r[n], empty[n]).alias(n) if n in empty else r[n].alias(n) for n in names)))


def ruleset_hash(payload: Column) -> Column:
    return F.sha2(canonical_ruleset(payload), 256)


def decoded(events: DataFrame) -> DataFrame:
    """events (ledger, seq, kind, payload) with p, the payload's fields, and subject, the id of what the event is about."""
    p = F.from_json("payload", PAYLOAD)
    out = events.select("ledger", "seq", "kind", "payload", p.alias("p"))
    return out.withColumn("subject", F.coalesce("p.change_id", "p.decision_id", "p.change", "p.id", F.lit("")))


def _of(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds))


def _with_fields(events: DataFrame, kinds: list[str], fields: list[str], **more: Column) -> DataFrame:
    """Events of these kinds with those fields of p alone, and further columns: what goes through sorts and joins is no wider than its rules need."""
    return _of(events, *kinds).select("ledger", "seq", "kind", "subject", F.struct(*(F.col(f"p.{f}").alias(f) for f in fields)).alias("p"), *(c.alias(n) for n, c in more.items()))


def _first_seen(events: DataFrame, kind: str, ident: Column) -> DataFrame:
    return _of(events, kind).select("ledger", ident.alias("ident"), "seq").groupBy("ledger", "ident").agg(F.min("seq").alias("since"))


def _known(rows: DataFrame, ident: Column, seen: DataFrame, name: str) -> DataFrame:
    """rows with `name`: whether ident appeared before the row's seq."""
    at = seen.select("ledger", F.col("ident").alias("_ident"), F.col("since").alias("_since"))
    return rows.withColumn("_ident", ident).join(at, ["ledger", "_ident"], "left").withColumn(name, F.coalesce(F.col("_since") < F.col("seq"), F.lit(False))).drop("_ident", "_since")


def _unknown_in_list(rows: DataFrame, idents: Column, seen: DataFrame) -> DataFrame:
    """(ledger, seq) of the rows that list an id that has not appeared before them."""
    each = rows.select("ledger", "seq", F.explode(idents).alias("_one"))
    return _known(each, F.col("_one"), seen, "known").where("not known").select("ledger", "seq").distinct().withColumn("unknown", F.lit(True))


def _covered(c: Column) -> Column:
    return F.coalesce(c["seen"] <= c["total"], F.lit(True))


def _uncovered_in(facts: Column) -> Column:
    return F.coalesce(F.exists(facts, lambda f: ~_covered(f["denominator"])), F.lit(False))


def _refused(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """(ledger, seq, kind, reason): the first rule, in order, that a row breaks."""
    reason = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules))
    return rows.select("ledger", "seq", "kind", reason.alias("reason")).where("reason is not null")


def lane_states(events: DataFrame) -> DataFrame:
    """Lane events with before (lane_path and state of the change's last lane event before it: active, retained or removed) and wip, the lanes that are active before it."""
    own = _with_fields(events, ["lane_opened", "lane_closed"], ["lane_path", "base_head", "base_tree", "outcome", "reason"])
    state = F.when(F.col("kind") == "lane_opened", "active").otherwise(F.col("p.outcome"))
    told = own.select("ledger", "subject", "seq", F.col("p.lane_path").alias("lane_path"), state.alias("state"))
    seen = last_before(own, told, ["ledger", "subject"], "before")
    step = F.when(F.col("kind") == "lane_opened", 1).when(F.col("before.state") == "active", -1).otherwise(0)
    return sum_before(written(seen.withColumn("step", step)), ["ledger"], "step", "wip")


def change_states(events: DataFrame) -> DataFrame:
    """(ledger, subject, seq, status) after each event that sets a change's status."""
    return _of(events, "change_planned", "change_status").select("ledger", "subject", "seq", F.when(F.col("kind") == "change_planned", "planned").otherwise(F.col("p.status")).alias("status"))


def refusals(events: DataFrame) -> DataFrame:
    """(ledger, seq, kind, reason, stops): refused events of ledgers' events (ledger, seq, kind, payload); stops marks the first of its ledger, where a replay ends."""
    e = written(decoded(events).withColumn("payload_hash", F.sha2("payload", 256)))  # read by every rule
    p = F.col
    snapshots, facts = _first_seen(e, "snapshot_taken", p("payload_hash")), _first_seen(e, "fact_recorded", p("p.id"))
    planned, verified = _first_seen(e, "change_planned", p("p.id")), _first_seen(e, "verification_recorded", p("p.change"))
    plans = _of(e, "change_planned").groupBy("ledger", "subject").agg(F.min_by(F.struct(F.get_json_object("payload", "$.base.head").alias("head"), F.get_json_object("payload", "$.base.tree").alias("tree"), p("p.lineage").alias("lineage")), "seq").alias("plan"))
    status = change_states(e)

    def with_change(rows: DataFrame) -> DataFrame:
        """Its status before the event, and whether it was planned by then."""
        return _known(last_before(rows, status, ["ledger", "subject"], "was"), p("subject"), planned, "is_planned").join(plans, ["ledger", "subject"], "left")

    first_repo = _of(e, "snapshot_taken").groupBy("ledger").agg(F.min_by("p.repo_id", "seq").alias("repo"))
    snaps = _known(_of(e, "snapshot_taken").join(first_repo, "ledger"), p("payload_hash"), snapshots, "again")
    out = [_refused(snaps, ("coverage", ~_covered(p("p.file_universe"))), ("other_repo", p("p.repo_id") != p("repo")), ("repeated", p("again")))]

    recorded = _known(_known(_of(e, "fact_recorded"), p("p.snapshot"), snapshots, "has_snapshot"), p("p.id"), facts, "again")
    out.append(_refused(recorded, ("coverage", ~_covered(p("p.denominator"))), ("unknown_snapshot", ~p("has_snapshot")), ("repeated", p("again"))))

    # what must stay the same when a decision is opened again: all but its status
    fixed = F.to_json(F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: k != "status"))
    state = lambda c: F.coalesce(F.get_json_object(c, "$.status.state"), F.lit(""))
    is_opened = p("kind") == "decision_opened"
    decisions = _with_fields(e, ["decision_opened", "decision_answered"], ["chosen"], fixed=F.when(is_opened, fixed), opened=is_opened, state=F.when(is_opened, state(p("payload"))))
    kept = _of(e, "decision_opened").select("ledger", "subject", "seq", fixed.alias("fixed"), F.transform("p.gates", lambda g: g["id"]).alias("gates"))
    with_last = written(last_before(written(last_before(decisions, kept, ["ledger", "subject"], "prior")), decisions.select("ledger", "subject", "seq", "opened"), ["ledger", "subject"], "latest"))
    opened = with_last.where("opened").join(_unknown_in_list(_of(e, "decision_opened"), p("p.evidence"), facts), ["ledger", "seq"], "left")
    out.append(_refused(opened, ("not_open", p("state") != "open"), ("unknown_fact", p("unknown")), ("reopened_wrongly", p("prior").isNotNull() & ((p("prior.fixed") != p("fixed")) | p("latest.opened")))))
    answered = with_last.where("not opened")
    out.append(_refused(answered, ("unknown_decision", p("prior").isNull()), ("not_open", ~p("latest.opened")), ("unknown_branch", ~F.array_contains("prior.gates", p("p.chosen")))))

    rulesets = _of(e, "ruleset_ratified").withColumn("own_hash", ruleset_hash(p("payload")))
    out.append(_refused(rulesets, ("hash", (F.coalesce("p.hash", F.lit("")) != "") & (p("p.hash") != p("own_hash")))))

    own_plans = _with_fields(e, ["change_planned"], ["status", "brief", "brief_hash", "lineage", "predicted"], base=F.sha2(F.get_json_object("payload", "$.base"), 256))
    changes = last_before(own_plans, rulesets.select("ledger", "seq", "own_hash"), ["ledger"], "rules")
    changes = _known(_known(changes, p("base"), snapshots, "has_base"), p("subject"), planned, "again")
    changes = changes.join(_unknown_in_list(own_plans, F.transform("p.predicted", lambda f: f["snapshot"]), snapshots), ["ledger", "seq"], "left")
    out.append(
        _refused(
            changes, ("not_planned", p("p.status") != "planned"), ("brief_hash", F.sha2("p.brief", 256) != p("p.brief_hash")), ("unknown_snapshot", ~p("has_base")), ("lineage", ~p("rules.own_hash").eqNullSafe(p("p.lineage"))),
            ("coverage", _uncovered_in(p("p.predicted"))), ("unknown_fact_snapshot", p("unknown")), ("repeated", p("again")),
        )
    )

    moves = with_change(_with_fields(e, ["change_status"], ["status", "reason"]))
    final, has_reason = p("p.status").isin("discarded", "landed"), F.coalesce(p("p.reason"), F.lit("")) != ""
    legal = reduce(lambda a, b: a | b, [(p("was.status") == x) & (p("p.status") == y) for x, y in MOVES])
    out.append(_refused(moves, ("reason_needed", final & ~has_reason), ("reason_unwanted", ~final & p("p.reason").isNotNull()), ("unknown_change", ~p("is_planned")), ("illegal_move", ~F.coalesce(legal, F.lit(False)))))

    lanes = written(with_change(written(lane_states(e))))  # a look-up reads its rows twice, and two rules read what it finds
    identity = (F.coalesce("p.lane_path", F.lit("")) == "") | ~p("p.base_head").eqNullSafe(p("plan.head")) | ~p("p.base_tree").eqNullSafe(p("plan.tree"))
    out.append(_refused(lanes.where("kind = 'lane_opened'"), ("unknown_change", ~p("is_planned")), ("not_planned", ~p("was.status").eqNullSafe(F.lit("planned"))), ("identity", identity), ("second_lane", p("wip") > 0), ("retained_lane", p("before.state") == "retained")))
    held, path = p("before.state"), p("before.lane_path") != p("p.lane_path")
    open_or_kept = (held == "active") | (held == "retained") & (p("p.outcome") == "removed")
    out.append(_refused(lanes.where("kind = 'lane_closed'"), ("reason_needed", F.coalesce("p.reason", F.lit("")) == ""), ("no_lane", ~F.coalesce(open_or_kept, F.lit(False))), ("path", path)))

    out.append(_refused(_known(_of(e, "attempt_logged"), p("subject"), planned, "is_planned"), ("unknown_change", ~p("is_planned"))))

    own_checks = _with_fields(e, ["verification_recorded"], ["base_tree", "ruleset_hash", "realized"])
    checks = _known(with_change(own_checks), p("subject"), verified, "again")
    checks = checks.join(_unknown_in_list(own_checks, F.transform("p.realized", lambda f: f["snapshot"]), snapshots), ["ledger", "seq"], "left")
    differs = ~p("p.base_tree").eqNullSafe(p("plan.tree")) | ~p("p.ruleset_hash").eqNullSafe(p("plan.lineage"))
    out.append(
        _refused(
            checks, ("unknown_change", ~p("is_planned")), ("not_verifying", ~p("was.status").eqNullSafe(F.lit("verifying"))), ("differs", differs), ("coverage", _uncovered_in(p("p.realized"))),
            ("unknown_fact_snapshot", p("unknown")), ("repeated", p("again")),
        )
    )
    out.append(_refused(e, ("unknown_kind", ~F.coalesce(p("kind").isin(*KINDS), F.lit(False)))))
    found = written(reduce(DataFrame.union, out))
    first = found.groupBy("ledger").agg(F.min("seq").alias("_first"))
    return found.join(first, "ledger").select("ledger", "seq", "kind", "reason", (p("seq") == p("_first")).alias("stops"))


def attempts(events: DataFrame) -> DataFrame:
    """(ledger, change, attempts, first_seq, last_seq) of the attempts that are logged for each change."""
    return _of(decoded(events), "attempt_logged").groupBy("ledger", F.col("subject").alias("change")).agg(F.count("*").alias("attempts"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
