"""Each rule by which a ledger refuses an event, against the state that the events before it leave; as-of lookups over ranges."""

import hashlib
import json
import random

import pytest

from evidentia.operators import asof, event_rules
from evidentia.streaming import ledger_stream

SNAP = {"repo_id": "r", "head": "h", "tree": "t", "file_universe": {"seen": 1, "total": 2}}
RULES = {"purpose": "p", "allowed_paths": ["src/**"], "verifier_commands": ["make"], "risk_ceiling": "R1", "budget": {"attempts": 1, "wall_secs": 2, "subprocesses": 3}}
CANONICAL = {"purpose": "p", "non_goals": [], "allowed_paths": ["src/**"], "protected_paths": [], "compatibility": {}, "verifier_commands": ["make"], "risk_ceiling": "R1", "budget": RULES["budget"]}


def text(value):
    return json.dumps(value, separators=(",", ":"))


def sha(value):
    return hashlib.sha256((value if isinstance(value, str) else text(value)).encode()).hexdigest()


DECISION = {"id": "d", "gates": [{"id": "a", "description": "x"}], "evidence": ["f"], "status": {"state": "open"}}
PLAN = {"id": "c", "lineage": sha(CANONICAL), "base": SNAP, "brief": "b", "brief_hash": sha("b"), "predicted": [{"id": "x", "snapshot": sha(SNAP)}], "status": "planned"}
LANE = {"change_id": "c", "lane_path": "/l", "base_head": "h", "base_tree": "t"}
CHECK = {"change": "c", "base_tree": "t", "ruleset_hash": sha(CANONICAL), "realized": []}


def move(status, **more):
    return ("change_status", {"change_id": "c", "status": status, **more})


def close(outcome, **more):
    return ("lane_closed", {"change_id": "c", "lane_path": "/l", "outcome": outcome, "reason": "r", **more})


START = [("snapshot_taken", SNAP), ("fact_recorded", {"id": "f", "snapshot": sha(SNAP)}), ("decision_opened", DECISION), ("decision_answered", {"decision_id": "d", "chosen": "a"}), ("ruleset_ratified", RULES | {"hash": sha(CANONICAL)})]
PLANNED = [*START, ("change_planned", PLAN)]
OPENED = [*PLANNED, ("lane_opened", LANE), move("lane")]
VERIFYING = [*OPENED, move("verifying")]
WHOLE = [*VERIFYING, ("verification_recorded", CHECK), move("verified"), close("retained"), move("landed", reason="r"), close("removed"), ("decision_opened", DECISION), ("attempt_logged", {"change_id": "c"})]
OVER = {"seen": 3, "total": 2}
CASES = [
    (WHOLE, None),
    ([("snapshot_taken", SNAP | {"file_universe": OVER})], "coverage"),
    ([*START, ("snapshot_taken", SNAP | {"repo_id": "s"})], "other_repo"),
    ([*START, ("snapshot_taken", SNAP)], "repeated"),
    ([*START, ("fact_recorded", {"id": "g", "snapshot": sha(SNAP), "denominator": OVER})], "coverage"),
    ([("fact_recorded", {"id": "g", "snapshot": sha(SNAP)})], "unknown_snapshot"),
    ([*START, ("fact_recorded", {"id": "f", "snapshot": sha(SNAP)})], "repeated"),
    ([*START, ("decision_opened", DECISION | {"id": "e", "status": {"state": "superseded"}})], "not_open"),
    ([*START, ("decision_opened", DECISION | {"id": "e", "evidence": ["f", "z"]})], "unknown_fact"),
    ([*START, ("decision_opened", DECISION | {"gates": []})], "reopened_wrongly"),
    ([*START[:3], ("decision_opened", DECISION)], "reopened_wrongly"),
    ([*START, ("decision_answered", {"decision_id": "q", "chosen": "a"})], "unknown_decision"),
    ([*START, ("decision_answered", {"decision_id": "d", "chosen": "a"})], "not_open"),
    ([*START[:3], ("decision_answered", {"decision_id": "d", "chosen": "b"})], "unknown_branch"),
    ([("ruleset_ratified", RULES | {"hash": "0"})], "hash"),
    ([*START, ("change_planned", PLAN | {"status": "lane"})], "not_planned"),
    ([*START, ("change_planned", PLAN | {"brief_hash": "0"})], "brief_hash"),
    ([*START, ("change_planned", PLAN | {"base": SNAP | {"head": "x"}})], "unknown_snapshot"),
    ([*START, ("ruleset_ratified", RULES | {"purpose": "q"}), ("change_planned", PLAN)], "lineage"),
    ([*START[:4], ("change_planned", PLAN)], "lineage"),
    ([*START, ("change_planned", PLAN | {"predicted": [{"id": "x", "snapshot": sha(SNAP), "denominator": OVER}]})], "coverage"),
    ([*START, ("change_planned", PLAN | {"predicted": [{"id": "x", "snapshot": "z"}]})], "unknown_fact_snapshot"),
    ([*PLANNED, ("change_planned", PLAN)], "repeated"),
    ([*PLANNED, move("discarded")], "reason_needed"),
    ([*PLANNED, move("landed", reason="")], "reason_needed"),
    ([*PLANNED, move("lane", reason="r")], "reason_unwanted"),
    ([*START, move("lane")], "unknown_change"),
    ([*PLANNED, move("verifying")], "illegal_move"),
    ([*START, ("lane_opened", LANE)], "unknown_change"),
    ([*PLANNED, move("lane"), ("lane_opened", LANE)], "not_planned"),
    ([*PLANNED, ("lane_opened", LANE | {"lane_path": ""})], "identity"),
    ([*PLANNED, ("lane_opened", LANE | {"base_tree": "x"})], "identity"),
    ([*PLANNED, ("lane_opened", LANE), ("lane_opened", LANE)], "second_lane"),
    ([*PLANNED, ("change_planned", PLAN | {"id": "k"}), ("lane_opened", LANE), ("lane_opened", LANE | {"change_id": "k"})], "second_lane"),
    ([*PLANNED, ("lane_opened", LANE), close("retained"), ("lane_opened", LANE)], "retained_lane"),
    ([*PLANNED, ("lane_opened", LANE), close("removed"), ("lane_opened", LANE)], None),
    ([*OPENED, close("retained", reason="")], "reason_needed"),
    ([*PLANNED, close("removed")], "no_lane"),
    ([*OPENED, close("retained"), close("retained")], "no_lane"),
    ([*OPENED, close("removed", lane_path="/m")], "path"),
    ([*OPENED, close("retained"), close("removed", lane_path="/m")], "path"),
    ([*START, ("attempt_logged", {"change_id": "c"})], "unknown_change"),
    ([*START, ("verification_recorded", CHECK)], "unknown_change"),
    ([*OPENED, ("verification_recorded", CHECK)], "not_verifying"),
    ([*VERIFYING, ("verification_recorded", CHECK | {"base_tree": "x"})], "differs"),
    ([*VERIFYING, ("verification_recorded", CHECK | {"realized": [{"id": "x", "snapshot": sha(SNAP), "denominator": OVER}]})], "coverage"),
    ([*VERIFYING, ("verification_recorded", CHECK | {"realized": [{"id": "x", "snapshot": "z"}]})], "unknown_fact_snapshot"),
    ([*VERIFYING, ("verification_recorded", CHECK), ("verification_recorded", CHECK)], "repeated"),
    ([*START, ("mystery", {})], "unknown_kind"),
]


@pytest.fixture(scope="module")
def refused(spark):
    """All cases at once, a ledger each; in each only the last event can be refused."""
    rows = [(f"l{n}", k + 1, kind, text(payload)) for n, (events, _) in enumerate(CASES) for k, (kind, payload) in enumerate(events)]
    found = event_rules.refusals(spark.createDataFrame(rows, "ledger string, seq long, kind string, payload string")).collect()
    return {(r.ledger, r.seq): (r.reason, r.stops) for r in found}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_rule(refused, n):
    events, reason = CASES[n]
    mine = {seq: v for (ledger, seq), v in refused.items() if ledger == f"l{n}"}
    assert mine == ({} if reason is None else {len(events): (reason, True)})


def test_as_of_over_ranges(spark):
    facts = [("a", 3, "x"), ("a", 9, "y"), ("a", 40, "z"), (None, 5, "n"), ("b", 20, "q")]
    rows = [(k, s) for k in ("a", "b", "c") for s in range(0, 60)]
    got = asof.last_before(spark.createDataFrame(rows, "k string, seq long"), spark.createDataFrame(facts, "k string, seq long, v string"), ["k"], "was", span=8).collect()
    for r in got:
        before = [v for k, s, v in sorted(facts, key=lambda f: f[1]) if k == r.k and s < r.seq]
        assert (r.was.v if r.was else None) == (before[-1] if before else None)
    assert len(got) == len(rows)
    sums = asof.sum_before(spark.createDataFrame([("a", s, s % 3 - 1) for s in range(50)], "k string, seq long, n int"), ["k"], "n", "total", span=8).collect()
    assert {r.seq: r.total for r in sums} == {s: sum(x % 3 - 1 for x in range(s)) for s in range(50)}


def test_one_long_ledger_as_a_stream(spark, tmp_path):
    """A chain that is much longer than a block of waiting rows, out of order over batches, with a broken and a repeated row; another ledger never closes its gap."""
    rows, prev = [], "0" * 64
    for k in range(1, 1501):
        digest = sha(f"p{k}")
        rows.append(("one", k, prev, digest, "broken" if k == 700 else f"p{k}"))
        prev = digest
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, rows[0], ("two", 2, "x", "y", "z")], "ledger string, seq long, prev_hash string, payload_hash string, payload string")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ledger_stream.run_once(spark, ledger_stream.checked(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted([("one", k, "payload" if k == 700 else "ok") for k in range(1, 1501)] + [("one", rows[0][1], "repeated")])
