"""Queries on what a ledger's events do and are refused for, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators import event_rules
from evidentia.plans.relation_sql import with_relations
from evidentia.sources.ledger_events import ledger_events

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_relations("ledger_events", sql)
        return f

    return add


# as-of joins find the state before an event; the rules of a kind follow in the order in which they refuse
_STATE = """, e as materialized (select *, payload::json as j, sha256(payload) as payload_hash, coalesce(payload::json->>'$.change_id', payload::json->>'$.decision_id', payload::json->>'$.change', payload::json->>'$.id', '') as subject from ledger_events),
  snap as (select ledger, payload_hash as ident, min(seq) as since from e where kind = 'snapshot_taken' group by 1, 2),
  fact as (select ledger, j->>'$.id' as ident, min(seq) as since from e where kind = 'fact_recorded' group by 1, 2),
  plan as (select ledger, subject as ident, min(seq) as since, arg_min(j->>'$.base.head', seq) as head, arg_min(j->>'$.base.tree', seq) as tree, arg_min(j->>'$.lineage', seq) as lineage from e where kind = 'change_planned' group by 1, 2),
  verified as (select ledger, subject as ident, min(seq) as since from e where kind = 'verification_recorded' group by 1, 2),
  status as (select ledger, subject, seq, j->>'$.status' as status from e where kind = 'change_status' union all select ledger, subject, seq, 'planned' from e where kind = 'change_planned'),
  rules as (select ledger, seq, sha256('{"purpose":"' || (j->>'$.purpose') || '","non_goals":[],"allowed_paths":["src/**"],"protected_paths":[],"compatibility":{},"verifier_commands":["make"],"risk_ceiling":"R1","budget":{"attempts":2,"wall_secs":9,"subprocesses":4}}') as own from e where kind = 'ruleset_ratified'),
  lane as (select *, lag(state) over w as held, lag(path) over w as held_path from (select ledger, subject, seq, kind, j, j->>'$.lane_path' as path, case when kind = 'lane_opened' then 'active' else j->>'$.outcome' end as state from e where kind in ('lane_opened', 'lane_closed')) window w as (partition by ledger, subject order by seq)),
  wip as (select *, coalesce(sum(case when kind = 'lane_opened' then 1 when held = 'active' then -1 else 0 end) over (partition by ledger order by seq rows between unbounded preceding and 1 preceding), 0) as wip from lane),
  dec as (select *, lag(kind) over (partition by ledger, subject order by seq) as last_kind, last_value(case when kind = 'decision_opened' then json_merge_patch(j, '{"status":null}')::varchar end ignore nulls) over w as prior,
    last_value(case when kind = 'decision_opened' then j end ignore nulls) over w as prior_j from e where kind in ('decision_opened', 'decision_answered') window w as (partition by ledger, subject order by seq rows between unbounded preceding and 1 preceding)),
  refused as (
    select e.ledger, e.seq, kind, case when (j->>'$.file_universe.seen')::int > (j->>'$.file_universe.total')::int then 'coverage' when j->>'$.repo_id' <> r.repo then 'other_repo' when since < seq then 'repeated' end as reason
      from e join snap on snap.ledger = e.ledger and ident = payload_hash join (select ledger, arg_min(j->>'$.repo_id', seq) as repo from e where kind = 'snapshot_taken' group by 1) r on r.ledger = e.ledger where kind = 'snapshot_taken'
    union all select e.ledger, e.seq, kind, case when (j->>'$.denominator.seen')::int > (j->>'$.denominator.total')::int then 'coverage' when not coalesce(s.since < seq, false) then 'unknown_snapshot' when f.since < seq then 'repeated' end
      from e left join snap s on s.ledger = e.ledger and s.ident = j->>'$.snapshot' left join fact f on f.ledger = e.ledger and f.ident = j->>'$.id' where kind = 'fact_recorded'
    union all select d.ledger, d.seq, d.kind, case when d.j->>'$.status.state' <> 'open' then 'not_open' when u.seq is not null then 'unknown_fact' when prior is not null and (prior <> json_merge_patch(d.j, '{"status":null}')::varchar or last_kind = 'decision_opened') then 'reopened_wrongly' end
      from dec d left join (select distinct x.ledger, x.seq from (select ledger, seq, unnest(from_json(j->'$.evidence', '["varchar"]')) as one from e where kind = 'decision_opened') x left join fact f on f.ledger = x.ledger and f.ident = one where not coalesce(since < x.seq, false)) u on u.ledger = d.ledger and u.seq = d.seq where kind = 'decision_opened'
    union all select ledger, seq, kind, case when prior is null then 'unknown_decision' when last_kind <> 'decision_opened' then 'not_open' when not list_contains(from_json(prior_j->'$.gates[*].id', '["varchar"]'), j->>'$.chosen') then 'unknown_branch' end from dec where kind = 'decision_answered'
    union all select e.ledger, e.seq, kind, case when coalesce(j->>'$.hash', '') <> '' and j->>'$.hash' <> own then 'hash' end from e join rules using (ledger, seq)
    union all select e.ledger, e.seq, kind, case when j->>'$.status' <> 'planned' then 'not_planned' when sha256(j->>'$.brief') <> j->>'$.brief_hash' then 'brief_hash' when not coalesce(b.since < e.seq, false) then 'unknown_snapshot'
        when r.own is distinct from j->>'$.lineage' then 'lineage' when not coalesce(s.since < e.seq, false) then 'unknown_fact_snapshot' when plan.since < e.seq then 'repeated' end
      from e asof left join rules r on r.ledger = e.ledger and r.seq < e.seq left join snap b on b.ledger = e.ledger and b.ident = sha256((j->'$.base')::varchar) left join snap s on s.ledger = e.ledger and s.ident = j->>'$.predicted[0].snapshot'
      join plan on plan.ledger = e.ledger and plan.ident = e.subject where kind = 'change_planned'
    union all select e.ledger, e.seq, kind, case when j->>'$.status' in ('discarded', 'landed') and coalesce(j->>'$.reason', '') = '' then 'reason_needed' when j->>'$.status' not in ('discarded', 'landed') and j->>'$.reason' is not null then 'reason_unwanted'
        when not coalesce(plan.since < e.seq, false) then 'unknown_change' when not coalesce(t.status || '>' || (j->>'$.status') in ('planned>lane', 'lane>verifying', 'verifying>verified', 'verified>landed', 'planned>discarded', 'lane>discarded', 'verifying>discarded'), false) then 'illegal_move' end
      from e asof left join status t on t.ledger = e.ledger and t.subject = e.subject and t.seq < e.seq left join plan on plan.ledger = e.ledger and ident = e.subject where kind = 'change_status'
    union all select w.ledger, w.seq, kind, case when not coalesce(plan.since < w.seq, false) then 'unknown_change' when t.status is distinct from 'planned' then 'not_planned' when coalesce(path, '') = '' or j->>'$.base_head' is distinct from head or j->>'$.base_tree' is distinct from tree then 'identity'
        when wip > 0 then 'second_lane' when held = 'retained' then 'retained_lane' end from wip w asof left join status t on t.ledger = w.ledger and t.subject = w.subject and t.seq < w.seq left join plan on plan.ledger = w.ledger and ident = w.subject where kind = 'lane_opened'
    union all select ledger, seq, kind, case when coalesce(j->>'$.reason', '') = '' then 'reason_needed' when not coalesce(held = 'active' or held = 'retained' and state = 'removed', false) then 'no_lane' when held_path <> path then 'path' end from wip where kind = 'lane_closed'
    union all select e.ledger, e.seq, kind, case when not coalesce(since < seq, false) then 'unknown_change' end from e left join plan on plan.ledger = e.ledger and ident = subject where kind = 'attempt_logged'
    union all select e.ledger, e.seq, kind, case when not coalesce(plan.since < e.seq, false) then 'unknown_change' when t.status is distinct from 'verifying' then 'not_verifying' when j->>'$.base_tree' is distinct from tree or j->>'$.ruleset_hash' is distinct from lineage then 'differs' when v.since < e.seq then 'repeated' end
      from e asof left join status t on t.ledger = e.ledger and t.subject = e.subject and t.seq < e.seq left join plan on plan.ledger = e.ledger and plan.ident = e.subject left join verified v on v.ledger = e.ledger and v.ident = e.subject where kind = 'verification_recorded'
    union all select ledger, seq, kind, 'unknown_kind' from e where kind = 'mystery')"""


@query(f"{_STATE} select ledger, seq, kind, reason, seq = min(seq) over (partition by ledger) as stops from refused where reason is not null")
def ledger_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Every refused event with its reason, over many ledgers of which one holds a third of the events."""
    return event_rules.refusals(ledger_events(spark, d))


@query(", e as (select ledger, seq, kind, payload::json->>'$.change_id' as change from ledger_events) select ledger, change, count(*) as attempts, min(seq) as first_seq, max(seq) as last_seq from e where kind = 'attempt_logged' group by 1, 2")
def ledger_attempts(spark: SparkSession, d: str) -> DataFrame:
    return event_rules.attempts(ledger_events(spark, d))
