"""The relations of `sources.relations` in DuckDB SQL, for the oracles."""

from __future__ import annotations

from evidentia.sources.ledger_events import ledger_events_sql
from evidentia.sources.relations import DETECTORS, SCRIPT_TEMPLATES, SMELLS, TEMPLATES, ZONES


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ALL_FINDINGS = f"""all_findings as (
  select *, detector || '::' || file || '::' || key as id,
    '{{"loc_weight":' || loc_weight || ',"smell_id":"' || smell_id || '","loc":' || loc || ',"holistic":' || holistic || '}}' as detail
  from (select o_orderkey as key, {_list(DETECTORS)}[(o_orderkey % 12 + 1)::int] as detector, 'cust/' || (o_custkey % 97) || '.py' as file,
    (1 + (o_orderkey // 12) % 4)::int as tier,
    case when o_orderpriority[1] in ('1', '2') then 'high' when o_orderpriority[1] = '3' then 'medium' else 'low' end as confidence,
    'finding ' || (o_orderkey % 50) as summary, (o_orderkey % 5 + 1)::int as loc_weight, {_list(SMELLS)}[(o_orderkey % 4 + 1)::int] as smell_id,
    (o_orderkey % 400)::int as loc, o_orderkey % 50 = 0 as holistic,
    case when o_orderkey % 13 = 0 then 'auto_resolved' when o_orderkey % 11 = 0 then 'false_positive' when o_orderstatus = 'F' then 'fixed'
      when o_orderstatus = 'P' then 'wontfix' else 'open' end as status,
    greatest(o_orderkey % 5 - 1, 0)::int as reopen_count, o_orderkey % 17 = 0 as suppressed, {_list(ZONES)}[(o_custkey % 10 + 1)::int] as zone,
    case when o_orderkey % 7 < 5 then 'python' else 'typescript' end as lang, ((o_orderkey // 12) % 3)::int as third from orders))"""
PREV = "prev as (select * exclude (third) from all_findings where third <> 0)"
CUR = """cur as (select * exclude (third) replace ('open' as status, 0 as reopen_count, false as suppressed, summary || '!' as summary)
  from all_findings where third <> 1 and detector not in ('naming', 'orphaned'))"""
POTENTIALS = f"""potentials as (select detector, case when detector = 'signature' then 0 else n * (list_position({_list(DETECTORS)}, detector) + 1) end::bigint as potential
  from (select {_list(DETECTORS)}[(o_orderkey % 12 + 1)::int] as detector, count(*) as n from orders group by 1) where detector <> 'orphaned')"""
FILES = "files as (select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, text as content from documents)"
CODE_LINES = f"""code_lines as materialized (
  select path, row_number() over (partition by path order by l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::int as line,
    replace({_list(TEMPLATES)}[((l_orderkey * 31 + l_linenumber * 7 + l_partkey) % {len(TEMPLATES)} + 1)::int], '{{k}}', (l_orderkey % 20)::varchar) as text
  from (select *, 'pkg' || (l_partkey % 7) || '/mod_' || l_partkey || '.' || ['py', 'ts', 'go', 'cs', 'dart', 'gd', 'tsx', 'py'][(l_partkey % 8 + 1)::int] as path from lineitem
    union all select *, 'big/sup_' || l_suppkey || '.py' from lineitem where l_suppkey % 10 = 0))"""
def _unit(part: str) -> str:
    return f"'app' || ({part} % 5) || case when {part} % 11 = 0 then '/test' else '' end || case when {part} % 3 = 0 then '/_unit_' else '/unit_' end || {part}"


SCRIPT_LINES = f"""script_lines as materialized (
  select path, row_number() over (partition by path order by l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::int as line,
    replace(replace(replace(replace({_list(SCRIPT_TEMPLATES)}[((l_orderkey * 17 + l_linenumber * 5 + l_suppkey) % {len(SCRIPT_TEMPLATES)} + 1)::int], '{{k}}', (l_orderkey % 40)::varchar), '{{m}}', (l_orderkey % 40 % 5)::varchar), '{{s}}', other), '{{d}}', replace(other, '/', '.')) as text
  from (select *, {_unit("l_partkey")} || '.' || ['py', 'ts', 'gd', 'cs', 'dart', 'gd', 'tsx', 'py'][(l_partkey % 8 + 1)::int] as path, {_unit("near")} as other
    from (select *, greatest(l_partkey + 8 * (l_linenumber - 4), l_partkey % 8) as near from lineitem)))"""
EDGES = """edges as (
  with item as (select l_orderkey, l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_partkey) as dst from lineitem)
  select distinct src, dst, (src + dst) % 9 = 0 as deferred from (select src, dst from item union all select dst, src from item where l_orderkey % 500 = 0) where src <> dst)"""
HISTORY = """history as (select row_number() over (order by day)::int as seq, day, round(1000 * (1 - errors / total)) / 10 as strict, total, errors
  from (select (ts::date)::varchar as day, count(*) as total, count(*) filter (event_type = 'error') as errors from events group by 1))"""
ASSESSMENTS = """assessments as (select (doc_id % 8)::int as batch, source as dimension, (60 + quality * 30 - toxic * 20)::double as score, doc_id
  from labels join (select doc_id, source from documents) using (doc_id))"""
REVIEW_FINDINGS = """review_findings as (select (turn % 8)::int as batch, 'c' || conv_id as identifier, 'src' || (conv_id % 20) as dimension,
  ['high', 'medium', 'low'][(turn % 3 + 1)::int] as confidence, case role when 'user' then 'module' when 'assistant' then 'local' else 'codebase' end as impact_scope,
  ['single_edit', 'multi_file_refactor', 'architectural_change', 'other'][(turn % 4 + 1)::int] as fix_scope, turn from conversations)"""
LEDGER = f"""ledger as (select row_number() over w as seq, 'evt-' || event_id as event_id, 1 as schema, coalesce(sha256(lag(props) over w), '{'0' * 64}') as prev_hash,
  sha256(props) as payload_hash, ts as at, event_type as kind, props as payload, event_id as number from events window w as (order by event_id))"""
TAMPERED = "tampered as (select * exclude (number) replace (case when number % 1000 = 7 then payload || ' ' else payload end as payload) from ledger)"

LEDGER_EVENTS = f"ledger_events as materialized ({ledger_events_sql('events', '//', 'sha256({})')})"

_NEEDS = {"ledger_events": LEDGER_EVENTS, "all_findings": ALL_FINDINGS, "prev": PREV, "cur": CUR, "potentials": POTENTIALS, "files": FILES, "code_lines": CODE_LINES, "script_lines": SCRIPT_LINES, "edges": EDGES, "history": HISTORY, "assessments": ASSESSMENTS, "review_findings": REVIEW_FINDINGS, "ledger": LEDGER, "tampered": TAMPERED}


def with_relations(names: str, query: str, recursive: bool = False) -> str:
    """WITH the named relations (and what they need) and the query, which may go on with further expressions after a leading comma."""
    wanted = names.split()
    if {"prev", "cur"} & {*wanted}:
        wanted = ["all_findings", *wanted]
    if "tampered" in wanted:
        wanted = ["ledger", *wanted]
    parts = [_NEEDS[n] for n in dict.fromkeys(wanted)]
    return f"with {'recursive ' * recursive}" + ",\n".join(parts) + "\n" + query
