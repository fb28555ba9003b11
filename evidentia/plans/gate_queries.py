"""Queries on gates, path rules and hashes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import hashes, jsonpatch, patterns
from evidentia.operators import gates, graph, path_rules
from evidentia.plans.code_queries import _PATHS, _paths
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel
from evidentia.sources.ledger_events import ledger_events

QUERIES: dict = {}
ORACLES: dict = {}


def query(names: str, sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_relations(names, sql) if names else sql
        return f

    return add


def _projects(spark: SparkSession, d: str) -> tuple[gates.State, DataFrame]:
    """A ledger for every 21 events, which end anywhere in a change's life, and what their repositories look like."""
    number = F.floor((F.col("seq") - 1) / 21)
    state = gates.State(ledger_events(spark, d).withColumn("ledger", F.concat(F.lit("p"), number)))
    n = F.substring("ledger", 2, 20).cast("long")
    last = F.floor(((n + 1) * 21 - 1) / 16)
    rules = F.concat(F.lit('{"purpose":"p'), last, F.lit('","allowed_paths":["src/**"],"verifier_commands":["make"],"risk_ceiling":"R1","budget":{"attempts":2,"wall_secs":9,"subprocesses":4}}'))
    repos = state.ledgers.select(
        "ledger", (n % 11 == 0).alias("dirty"), F.when(n % 7 == 0, "hx").otherwise(F.concat(F.lit("h"), last)).alias("head"), F.when(n % 13 == 0, "tx").otherwise(F.concat(F.lit("t"), last)).alias("tree"),
        F.when(n % 6 == 0, "{}").otherwise(rules).alias("rules"), (n % 5 != 0).alias("lane_exists"), F.when(n % 9 == 0, "rx").otherwise(F.concat(F.lit("r"), last)).alias("result_tree"),
    )
    return state, repos


_PROJECTS = """, e as materialized (select 'p' || ((seq - 1) // 21) as ledger, seq, kind, payload::json as j, coalesce(payload::json->>'$.change_id', payload::json->>'$.decision_id', payload::json->>'$.change', payload::json->>'$.id', '') as subject from ledger_events),
  num as (select distinct ledger, ledger[2:]::bigint as n, ((ledger[2:]::bigint + 1) * 21 - 1) // 16 as last from e),
  repo as (select ledger, n % 11 = 0 as dirty, case when n % 7 = 0 then 'hx' else 'h' || last end as head, case when n % 13 = 0 then 'tx' else 't' || last end as tree, case when n % 6 <> 0 then last end as rules, n % 5 <> 0 as lane_exists, case when n % 9 = 0 then 'rx' else 'r' || last end as result_tree from num),
  chg as (select ledger, subject, arg_min(j, seq) as plan, (select arg_max(case when s.kind = 'change_planned' then 'planned' else s.j->>'$.status' end, s.seq) from e s where s.ledger = e.ledger and s.subject = e.subject and s.kind in ('change_planned', 'change_status')) as status from e where kind = 'change_planned' group by 1, 2),
  lanes as (select ledger, subject, arg_max(case when kind = 'lane_opened' then 'active' else j->>'$.outcome' end, seq) as lane from e where kind in ('lane_opened', 'lane_closed') group by 1, 2),
  rs as (select ledger, arg_max(j, seq) as r from e where kind = 'ruleset_ratified' group by 1),
  opened as (select ledger, count(*) as n_open from (select ledger, subject, arg_max(kind, seq) as k from e where kind like 'decision%' group by 1, 2) where k = 'decision_opened' group by 1)"""
_HASH = "sha256('{{\"purpose\":\"p' || {} || '\",\"non_goals\":[],\"allowed_paths\":[\"src/**\"],\"protected_paths\":[],\"compatibility\":{{}},\"verifier_commands\":[\"make\"],\"risk_ceiling\":\"R1\",\"budget\":{{\"attempts\":2,\"wall_secs\":9,\"subprocesses\":4}}}}')"


@query("ledger_events", f"""{_PROJECTS}, held as (select l.ledger, count(*) filter (lane = 'active') as active, count(*) filter (lane = 'retained' and status = 'discarded') as failed from lanes l left join chg using (ledger, subject) group by 1),
  pl as (select ledger, count(*) as n, min(subject) as subject, min(plan->>'$.base.head') as head, min(plan->>'$.base.tree') as tree, min(plan->>'$.lineage') as lineage, min(plan->>'$.brief') as brief, min(plan->>'$.brief_hash') as brief_hash from chg where status = 'planned' group by 1),
  v as (select repo.ledger, pl.subject, case when active > 0 then 'active_lane' when failed > 0 then 'failed_lane' when n_open > 0 then 'open_decisions' when r is null then 'no_ruleset' when coalesce(pl.n, 0) <> 1 then 'planned_changes' when dirty then 'dirty'
    when pl.head is distinct from repo.head then 'head' when pl.tree is distinct from repo.tree then 'tree' when rules is null or lineage is distinct from {_HASH.format("rules")} then 'ruleset_file'
    when lineage is distinct from {_HASH.format("substr(r->>'$.purpose', 2)")} then 'ruleset_ratified' when brief_hash is distinct from sha256(brief) then 'brief' else 'ready' end as verdict
    from repo left join held using (ledger) left join opened using (ledger) left join rs using (ledger) left join pl using (ledger))
  select ledger, verdict, case when verdict = 'ready' then subject end as change from v""")
def climb_gates(spark: SparkSession, d: str) -> DataFrame:
    state, repos = _projects(spark, d)
    return gates.climbable(state, repos)


@query("ledger_events", f"""{_PROJECTS}, ver as (select ledger, subject, arg_max(j->>'$.result_tree', seq) as verified_tree from e where kind = 'verification_recorded' group by 1, 2),
  jd as (select c.ledger, c.subject, lane is not null as kept, plan->>'$.base.head' = head and plan->>'$.base.tree' = tree as here, verified_tree from chg c join repo using (ledger) left join (select * from lanes where lane = 'retained') l using (ledger, subject) left join ver using (ledger, subject) where status = 'verified'),
  g as (select ledger, count(*) as n_verified, count(*) filter (kept) as n_kept, count(*) filter (kept and here) as n_fit, min(subject) filter (kept and here) as subject, min(verified_tree) filter (kept and here) as verified_tree from jd group by 1),
  v as (select repo.ledger, subject, case when dirty then 'dirty' when coalesce(n_verified, 0) = 0 then 'nothing_verified' when n_kept = 0 then 'no_retained_lane' when n_fit = 0 then 'wrong_base' when n_fit > 1 then 'several' when not lane_exists then 'lane_missing'
    when verified_tree is null then 'not_verified' when verified_tree <> result_tree then 'result_tree' else 'landable' end as verdict from repo left join g using (ledger))
  select ledger, verdict, case when verdict = 'landable' then subject end as change from v""")
def land_gates(spark: SparkSession, d: str) -> DataFrame:
    state, repos = _projects(spark, d)
    return gates.landable(state, repos)


_KINDS = "['pkg' || (k % 7) || '/*.py', '**/mod_' || k || '.ts', 'pkg?/mod_' || k || '*', '*_' || k || '.go', 'big/**', 'pkg' || (k % 7) || '/mod_' || k || '.py', 'p*/mod_?' || k || '.*', '*' || k || '*']"
_GLOB_SQL = f"globs as (select k, {_KINDS}[(k % 8 + 1)::int] as gl from (select p_partkey as k from part))"
# of a glob as RE2: a leading `**/` may be left out
_RE = "'^' || case when gl like '**/%' then '(.*/)?' else '' end || replace(replace(regexp_replace(regexp_replace(gl, '^\\*\\*/', ''), '([.+])', '\\\\\\1', 'g'), '?', '.'), '*', '.*') || '$'"


def _globs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    kinds = [("pkg", k % 7, "/*.py"), ("**/mod_", k, ".ts"), ("pkg?/mod_", k, "*"), ("*_", k, ".go"), ("big/**",), ("pkg", k % 7, "/mod_", k, ".py"), ("p*/mod_?", k, ".*"), ("*", k, "*")]
    text = [F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)) for parts in kinds]
    return rel.table(spark, d, "part").select(k.alias("k"), F.array(*text)[(k % 8).cast("int")].alias("glob"))


@query("code_lines", f""", {_GLOB_SQL}, g as (select distinct gl, starts_with(gl, '**/') as lead, replace(replace(replace(regexp_replace(gl, '^\\*\\*/', ''), '_', '!_'), '?', '_'), '*', '%') as lk from globs), f as (select distinct path from code_lines)
  select gl as "glob", count(*) as files, min(path) as first, max(path) as last from g join f on path like lk escape '!' or lead and path like '%/' || lk escape '!' group by 1""")
def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    """A glob for every part against all files."""
    found = path_rules.matches(rel.code_lines(spark, d).select("path").distinct(), _globs(spark, d), [])
    return found.groupBy("glob").agg(F.count("*").alias("files"), F.min("path").alias("first"), F.max("path").alias("last"))


_LANE_SQL = """paths as (select distinct l_orderkey % 300 as lane, 'pkg' || (l_partkey % 7) || '/mod_' || l_partkey || case when l_partkey % 3 = 0 then '.py' else '.ts' end as path from lineitem),
  rules as (select lane, 'pkg' || ((lane + i) % 7) || case when i = 1 then '/**' when i = 2 then '/*.py' else '/mod_?*' || (lane % 10) || '.ts' end as gl, i, i < 4 as writes from (select unnest(range(0, 300)) as lane), (values (1), (2), (3), (4)) v(i)
    union all select lane, '**/mod_' || lane || '.*', 5, false from (select unnest(range(0, 300)) as lane) union all select lane, 'pkg' || (lane % 7) || '/mod_' || lane || '.ts', 6, true from (select unnest(range(0, 300)) as lane))"""


def _lanes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = F.col("l_partkey")
    path = F.concat(F.lit("pkg"), part % 7, F.lit("/mod_"), part, F.when(part % 3 == 0, ".py").otherwise(".ts"))
    paths = rel.table(spark, d, "lineitem").select((F.col("l_orderkey") % 300).alias("lane"), path.alias("path"))
    lane, i = F.col("lane"), F.col("i")
    own = spark.range(300).select(F.col("id").alias("lane"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i"))
    near = F.concat(F.lit("pkg"), (lane + i) % 7, F.when(i == 1, "/**").when(i == 2, "/*.py").otherwise(F.concat(F.lit("/mod_?*"), lane % 10, F.lit(".ts"))))
    glob = F.when(i == 5, F.concat(F.lit("**/mod_"), lane, F.lit(".*"))).when(i == 6, F.concat(F.lit("pkg"), lane % 7, F.lit("/mod_"), lane, F.lit(".ts"))).otherwise(near)
    return paths, own.select("lane", glob.alias("glob"), i.alias("place"), ((i < 4) | (i == 6)).alias("writes"))


@query("", f"with {_LANE_SQL}, m as (select lane, path, bool_or(writes) as written, bool_or(not writes) as guarded from paths join (select *, {_RE} as re from rules) using (lane) where regexp_matches(path, re) group by 1, 2) "
  "select lane, path, not coalesce(written, false) as outside, coalesce(guarded, false) as blocked from paths left join m using (lane, path) where not coalesce(written, false) or guarded")
def write_set_violations(spark: SparkSession, d: str) -> DataFrame:
    """Changed paths of 300 lanes, each with write globs and protected globs of its own."""
    paths, rules = _lanes(spark, d)
    return path_rules.violations(paths, rules.where("writes"), rules.where("not writes"), ["lane"])


@query("", f"""with {_LANE_SQL}, g as (select *, {_RE} as re from rules), lit as (select * from g where not regexp_matches(gl, '[*?]')),
  hits as (select w.lane, w.i as at_w, p.i as at_g, 0 as kind, p.gl as what from g w join g p on w.lane = p.lane and w.writes and not p.writes where not regexp_matches(w.gl, '[*?]') and regexp_matches(w.gl, p.re) or not regexp_matches(p.gl, '[*?]') and regexp_matches(p.gl, w.re)
    union all select w.lane, w.i, p.i, 1, path from paths join g w using (lane) join g p using (lane) where w.writes and not p.writes and regexp_matches(path, w.re) and regexp_matches(path, p.re))
  select lane, 'protected' as problem, arg_min(what, (at_w, at_g, kind, what)) as what from hits group by 1""")
def protected_intersections(spark: SparkSession, d: str) -> DataFrame:
    paths, rules = _lanes(spark, d)
    return path_rules.intersections(paths, rules.where("writes").select("lane", "place", "glob"), rules.where("not writes").select("lane", "place", "glob"), ["lane"])


_FNV = "list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), (2 * i + 1)::int, 2))::int::hugeint)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616)"


@query("", f"with t as (select distinct p_name || p_type || 'é' as x from part union select '') select x as name, lpad(lower(format('{{:x}}', {_FNV}::ubigint)), 16, '0') as hash from t")
def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    names = rel.table(spark, d, "part").select(F.concat("p_name", "p_type", F.lit("é")).alias("name")).distinct()
    return names.union(spark.range(1).select(F.lit(""))).select("name", hashes.fnv1a64(F.col("name")).alias("hash"))


_PATCHES = """['{"purpose":"' || event_type || '"}', '{"hash":"x","' || event_type || '":1}', '{"budget":{"attempts":1,"calls":2,"bytes":3}}', '{"budget":{"wall_secs":9},"zeal":1,"apex":2}', '[1]', '{}', '{"budget":7,"non_goals":[]}']"""


@query("", f"""with p as (select event_id, {_PATCHES}[(event_id % 7 + 1)::int]::json as p from events), k as (select event_id, unnest(json_keys(p)) as key, p from p),
  bad as (select event_id, key, key as field from k where key not in ('purpose', 'non_goals', 'allowed_paths', 'protected_paths', 'compatibility', 'verifier_commands', 'risk_ceiling', 'budget', 'hash')
    union all select event_id, 'budget', 'budget.' || b from (select event_id, unnest(json_keys(p->'$.budget')) as b from k where key = 'budget') where b not in ('attempts', 'wall_secs', 'subprocesses'))
  select event_id, case when json_type(p) <> 'OBJECT' then 'not an object' else f.field end as problem from p left join (select event_id, min(s).field as field from (select event_id, {{'key': key, 'field': field}} as s from bad) group by 1) f using (event_id)""")
def patch_problems(spark: SparkSession, d: str) -> DataFrame:
    """Patches of rule sets: those that name something unknown."""
    kind = F.col("event_type")
    texts = [F.concat(F.lit('{"purpose":"'), kind, F.lit('"}')), F.concat(F.lit('{"hash":"x","'), kind, F.lit('":1}')), F.lit('{"budget":{"attempts":1,"calls":2,"bytes":3}}'), F.lit('{"budget":{"wall_secs":9},"zeal":1,"apex":2}'), F.lit("[1]"), F.lit("{}"), F.lit('{"budget":7,"non_goals":[]}')]
    return rel.table(spark, d, "events").select("event_id", jsonpatch.patch_problem(F.array(*texts)[(F.col("event_id") % 7).cast("int")]).alias("problem"))


_SKIPS = """('test', ['coupling', 'orphaned', 'naming', 'cycles']), ('config', ['coupling', 'orphaned', 'naming', 'cycles', 'smells']), ('script', ['coupling', 'orphaned', 'naming', 'cycles'])"""


# of the table's detectors
@query("prev", f"select zone, detector, coalesce(zone in ('generated', 'vendor') or list_contains(names, detector), false) as skipped, count(*) as n from prev left join (values {_SKIPS}) v(z, names) on z = zone group by 1, 2, 3")
def zone_skips(spark: SparkSession, d: str) -> DataFrame:
    """Findings by zone and detector, and whether their zone skips them."""
    f = rel.findings_prev(spark, d)
    return f.groupBy("zone", "detector", patterns.is_skipped(F.col("zone"), F.col("detector")).alias("skipped")).agg(F.count("*").alias("n"))


@query("edges", f""", {_PATHS}, x as (select distinct src, dst, a.path as p, b.path as q from edges join paths a on a.node = src join paths b on b.node = dst)
  select src, dst, 'shared' as direction, null as source_tool, case when q like 'tools/%' then split_part(q, '/', 2) end as target_tool, q like 'tools/%' as violating from x where p like 'shared/%' and (q like 'shared/%' or q like 'tools/%')
  union all select src, dst, 'tools', split_part(p, '/', 2), split_part(q, '/', 2), split_part(p, '/', 2) <> split_part(q, '/', 2) from x where p like 'tools/%/%' and q like 'tools/%'""")
def tool_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Edges from shared files and between tools, and which of them violate the boundaries."""
    return graph.tool_coupling(rel.edges(spark, d), _paths(spark, d), "shared/", "tools/")
