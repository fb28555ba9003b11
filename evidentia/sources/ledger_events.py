"""Ledgers of events of all kinds, with faults, derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BUDGET = '"risk_ceiling":"R1","budget":{"attempts":2,"wall_secs":9,"subprocesses":4}'
_KINDS = [
    "snapshot_taken", "fact_recorded", "decision_opened", "decision_answered", "ruleset_ratified", "change_planned", "lane_opened", "change_status",
    "attempt_logged", "change_status", "verification_recorded", "change_status", "lane_closed", "change_status", "lane_closed", "decision_opened",
]


def _snapshot(number: str, seen: str = "3", repo: str = "'repo'") -> str:
    return f"""'{{"repo_id":"' || {repo} || '","head":"h' || ({number}) || '","tree":"t' || ({number}) || '","file_universe":{{"seen":' || {seen} || ',"total":5}}}}'"""


def _decision(gates: str) -> str:
    evidence = """c || '"' || if(f = 8 and p = 2, ',"zz"', '')"""
    return f"""'{{"id":"d' || c || '","gates":[' || {gates} || '],"evidence":["f' || {evidence} || '],"status":{{"state":"' || if(f = 7 and p = 2, 'superseded', 'open') || '"}}}}'"""


def _status(status: str, reason: str = "''") -> str:
    return f"""'{{"change_id":"c' || c || '","status":"' || {status} || '"' || {reason} || '}}'"""


def _closed(outcome: str, reason: str) -> str:
    return f"""'{{"change_id":"c' || c || '","lane_path":"/l/' || if(f = 26 and p = 12, 'x', '') || c || '","outcome":"' || {outcome} || '","reason":"' || {reason} || '"}}'"""


def ledger_events_sql(events: str, div: str, sha: str) -> str:
    """SQL of (ledger, seq, kind, payload): the life of a change in 16 events, many times over, with a fault f of another kind in 29 of every 31 lives.
    A third of the events share one ledger. div and sha: integer division and SHA-256 of the dialect."""
    canonical = f"""'{{"purpose":"p' || c || '","non_goals":[],"allowed_paths":["src/**"],"protected_paths":[],"compatibility":{{}},"verifier_commands":["make"],{_BUDGET}}}'"""
    rules, snapshot = sha.format(canonical), sha.format(_snapshot("c"))
    both, one = """'{"id":"a","description":"x"},{"id":"b","description":"y"}'""", """'{"id":"a","description":"x"}'"""
    brief = sha.format("'do ' || c")
    payloads = [
        f"if(f = 3, {_snapshot('c - 1')}, {_snapshot('c', 'if(f = 1, 9, 3)', 'if(f = 2, ' + repr('other') + ', ' + repr('repo') + ')')})",
        f"""'{{"id":"f' || if(f = 6, c - 3, c) || '","snapshot":"' || if(f = 4, 'none', {snapshot}) || '","denominator":{{"seen":' || if(f = 5, 3, 1) || ',"total":2}}}}'""",
        _decision(both),
        """'{"decision_id":"d' || if(f = 9, 'x', '') || c || '","chosen":"' || if(f = 10, 'z', 'a') || '","raw_text":"t"}'""",
        f"""'{{"purpose":"p' || c || '","allowed_paths":["src/**"],"verifier_commands":["make"],{_BUDGET},"hash":"' || if(f = 11, 'bad', {rules}) || '"}}'""",
        f"""'{{"id":"c' || if(f = 18, c - 3, c) || '","lineage":"' || if(f = 15, 'bad', {rules}) || '","base":' || {_snapshot("if(f = 16, c + 1, c)")} || ',"brief":"do ' || c || '","brief_hash":"' || if(f = 14, 'bad', {brief})
          || '","predicted":[{{"id":"x","snapshot":"' || if(f = 17, 'none', {snapshot}) || '"}}],"status":"' || if(f = 13, 'lane', 'planned') || '"}}'""",
        """'{"change_id":"c' || c || '","lane_path":"/l/' || c || '","base_head":"h' || if(f = 19, 'x', '') || c || '","base_tree":"t' || c || '"}'""",
        _status("'lane'", """if(f = 20, ',"reason":"x"', '')"""),
        """'{"change_id":"c' || if(f = 21, 'x', '') || c || '"}'""",
        _status("if(f = 22, 'verified', 'verifying')"),
        f"""'{{"change":"c' || c || '","base_tree":"t' || if(f = 23, 'x', '') || c || '","result_tree":"r' || c || '","ruleset_hash":"' || {rules} || '","realized":[]}}'""",
        _status("if(f = 24, 'discarded', 'verified')"),
        _closed("'retained'", "if(f = 25, '', 'kept')"),
        _status("'landed'", """',"reason":"done"'"""),
        _closed("if(f = 28, 'retained', 'removed')", "'gone'"),
        f"""if(c % 4 = 0, {_decision(f"if(f = 29, {one}, {both})")}, '{{"change_id":"c' || c || '"}}')""",
    ]
    kind = " ".join(f"when p = {k} then '{v}'" for k, v in enumerate(_KINDS))
    payload = " ".join(f"when p = {k} then {v}" for k, v in enumerate(payloads))
    return f"""select if(c % 3 = 0, 'main', 'side' || (c {div} 60)) as ledger, event_id + 1 as seq,
    case when p = 4 and f = 12 then 'mystery' when p = 12 and f = 27 then 'attempt_logged' when p = 15 and c % 4 > 0 then 'attempt_logged' {kind} end as kind, case {payload} end as payload
  from (select event_id, event_id {div} 16 as c, event_id % 16 as p, (event_id {div} 16) % 31 as f from {events})"""


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    braces = ledger_events_sql("EVENTS", "div", "sha2({}, 256)").replace("{", "{{").replace("}", "}}")
    return spark.sql(braces.replace("EVENTS", "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
