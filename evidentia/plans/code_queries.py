"""Queries on source lines, dependency graphs and the ledger, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import detectors as det
from evidentia.operators import graph, ledger, summaries
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(names: str, sql: str | None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_relations(names, sql, recursive) if names else sql
        return f

    return add


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_COMMENT = "regexp_matches(ltrim(text), '^(#|//|\\*|/\\*)')"


def _rules(rules: list, comments: bool = False) -> str:
    tested = " union all ".join(f"select path, line, '{n}' as rule, '{c}' as confidence from code_lines where regexp_matches(text, {_s(p)})" + ("" if comments else f" and not {_COMMENT}") for n, c, p in rules)
    return f"hits as ({tested})"


@query("code_lines", f", {_rules(det.SECURITY)} select path, line, rule, case when path like 'pkg3/%' then 'low' else confidence end as confidence from hits")
def security_scan(spark: SparkSession, d: str) -> DataFrame:
    return det.security(rel.code_lines(spark, d), F.col("path").startswith("pkg3/"))


for _name, _table, _ext in (("ts_security", det.TS_SECURITY, "ts"), ("ts_smells", det.TS_SMELLS, "ts"), ("cs_security", det.CS_SECURITY, "cs"), ("go_patterns", det.GO_PATTERNS, "go")):

    def _counted(spark: SparkSession, d: str, table: list = _table, ext: str = _ext) -> DataFrame:
        return det.counted_hits(rel.code_lines(spark, d).where(text.extension(F.col("path")) == ext), table)

    _counted.__name__ = _name
    query("code_lines", f", {_rules(_table)} select path, rule, count(*) as n, min(line) as first_line from hits where path like '%.{_ext}' group by 1, 2")(_counted)


@query("code_lines", "select path, count(*) as loc from code_lines group by 1 having count(*) > 300")
def large_files(spark: SparkSession, d: str) -> DataFrame:
    return det.large_files(rel.code_lines(spark, d))


_CX = ", ".join(f"count(*) filter (regexp_matches(text, {_s(p)})) as {n}" for n, _, _, p in det.COMPLEXITY)
_CS = " + ".join(f"case when {n} >= {k} then {n} * {w} else 0 end" for n, w, k, _ in det.COMPLEXITY)


@query("code_lines", f", c as (select path, count(*) as loc, {_CX} from code_lines group by 1) select *, {_CS} as score from c where loc >= 50 and {_CS} >= 200")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    return det.complexity(rel.code_lines(spark, d))


@query("code_lines", ", x as (select path, line, (length(text) - length(ltrim(text))) // 4 as depth from code_lines where trim(text) <> '') select path, max(depth) as depth, arg_min(line, -depth * 1000000 + line) as line from x group by 1 having max(depth) > 4")
def deepest_indent(spark: SparkSession, d: str) -> DataFrame:
    return det.deepest_indent(rel.code_lines(spark, d), 4)


@query("code_lines", "select path, line, 6 as params from code_lines where text like 'def wide_%'")
def long_parameters(spark: SparkSession, d: str) -> DataFrame:
    return det.long_parameters(rel.code_lines(spark, d))


@query("code_lines", "select path, line, regexp_extract(text, '^(\\w+) =', 1) as name from code_lines where text like 'cache\\_%' escape '\\'")
def mutable_globals(spark: SparkSession, d: str) -> DataFrame:
    return det.mutable_globals(rel.code_lines(spark, d))


@query("code_lines", """select path, line, case when text like 'import %' then text[8:] when text like 'from .%' then '.sibling_' || regexp_extract(text, '_(\\d+) ', 1) else regexp_extract(text, '^from (\\S+)', 1) end as module,
  case when text like 'from%' then regexp_extract(text, 'import (\\w+)$', 1) end as name, false as deferred from code_lines where text like 'import %' or text like 'from %'""")
def imports(spark: SparkSession, d: str) -> DataFrame:
    return det.imports(rel.code_lines(spark, d))


@query("code_lines", """, i as (select path, line, regexp_extract(text, 'import (\\w+)$', 1) as name from code_lines where text like 'from %'),
  w as (select path, line, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '#.*$', ''), '\\w+'))) as name from code_lines where not regexp_matches(text, '^\\s*(from|import)\\b')),
  m as (select path, name, max(line) as last from w group by 1, 2) select path, i.line, name from i left join m using (path, name) where last is null or last < i.line""")
def unused_imports(spark: SparkSession, d: str) -> DataFrame:
    return det.unused_imports(rel.code_lines(spark, d))


@query("code_lines", f""", f as (select path as file, line, regexp_extract(text, 'def (\\w+)', 1) as name from code_lines where regexp_matches(text, '^\\s*def \\w+\\(.*\\)\\s*:')),
  c as (select distinct unnest(regexp_extract_all(text, '\\b(\\w+)\\(', 1)) as name from code_lines where not {_COMMENT} and not regexp_matches(text, '^\\s*def '))
  select name, file, line from f anti join c using (name)""")
def uncalled_functions(spark: SparkSession, d: str) -> DataFrame:
    return det.uncalled(rel.code_lines(spark, d))


_DEFS = """f as (select path as file, line, regexp_extract(text, 'def (\\w+)', 1) as name, case when text like '%wide%' then 6 when text like '%method%' then 0 else 2 end as params from code_lines where regexp_matches(text, '^\\s*def \\w+\\(.*\\)\\s*:'))"""


@query("code_lines", f", {_DEFS}, g as (select replace(replace(name, 'wide', 'x'), 'func', 'x') as name, file, params from f) select name, count(*) as defs, count(distinct file) as files, min(params) as least, max(params) as most from g group by 1 having count(*) >= 3 and count(distinct file) >= 3 and min(params) <> max(params)")
def signature_drift(spark: SparkSession, d: str) -> DataFrame:
    f = det.functions(rel.code_lines(spark, d))
    return summaries.signature_drift(f.withColumn("name", F.regexp_replace("name", "wide|func", "x")))


@query("code_lines", """, s as (select path, line, max(case when text like 'def %' then line end) over w as d, max(case when regexp_matches(text, '^\\S') and text not like 'def %' then line end) over w as t from code_lines window w as (partition by path order by line))
  select path, line, case when d is not null and (t is null or d > t) then d end as def_line from s""")
def function_scopes(spark: SparkSession, d: str) -> DataFrame:
    return det.scopes(rel.code_lines(spark, d))


@query("code_lines", """, c as (select path, line, text, min(case when regexp_matches(text, '^\\S') then line end) over (partition by path order by line rows between 1 following and unbounded following) as nxt, max(line) over (partition by path) as last from code_lines)
  select path, line, regexp_extract(text, '^class (\\w+)', 1) as name, coalesce(nxt, last + 1) - line as loc from c where text like 'class %'""")
def class_blocks(spark: SparkSession, d: str) -> DataFrame:
    return det.class_blocks(rel.code_lines(spark, d))


_DEPTH = """b as (select path, line, sum(length(replace(text, '}', '')) - length(replace(text, '{', ''))) over (partition by path order by line) as s from code_lines), e as (select path, line, (s - least(0, min(s) over (partition by path order by line)))::bigint as depth from b)"""


@query("code_lines", f", {_DEPTH} select path, max(depth) as depth from e group by 1 having max(depth) >= 3")
def nested_closures(spark: SparkSession, d: str) -> DataFrame:
    return det.nested_closures(rel.code_lines(spark, d))


def _ahead(start: str, wanted: str, n: int) -> str:
    return f""", a as (select path, line, text, max(regexp_matches(text, {_s(wanted)})::int) over (partition by path order by line rows between current row and {n - 1} following) as seen from code_lines)
  select path, line from a where regexp_matches(text, {_s(start)}) and seen = 0"""


_MAP, _KEY, _ASYNC, _AWAIT = r"\.map\s*\(\s*(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>", r"\bkey\s*=", r"async\s+(?:function\s+(\w+)|\(|(\w+)\s*=>)", r"\bawait\b"


@query("code_lines", _ahead(_MAP, _KEY, 10))
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    return det.without_follower(rel.code_lines(spark, d), _MAP, _KEY, 10)


@query("code_lines", _ahead(_ASYNC, _AWAIT, 50))
def async_without_await(spark: SparkSession, d: str) -> DataFrame:
    return det.without_follower(rel.code_lines(spark, d), _ASYNC, _AWAIT, 50)


@query("code_lines", """select path, count(*) as n, min(line) as first_line, array_to_string(list_sort(list(distinct regexp_extract(text, '\\[([^\\]]+)\\]', 1)) filter (text like '%[%')), ',') as tags from code_lines where text like 'console.%' group by 1""")
def console_logs(spark: SparkSession, d: str) -> DataFrame:
    return det.console_logs(rel.code_lines(spark, d))


ORACLES["console_logs"] = ORACLES["console_logs"].replace("array_to_string(", "coalesce(array_to_string(").replace(", ',') as tags", ", ','), '') as tags")


@query("code_lines", "select path, sum(3)::bigint as n from code_lines where text like '<B onClick%' group by 1")
def inline_handlers(spark: SparkSession, d: str) -> DataFrame:
    return det.inline_handlers(rel.code_lines(spark, d))


@query("code_lines", """, k as (select path, unnest(regexp_extract_all(text, '\\w\\[["''](\\w+)["'']\\]', 1)) as key from code_lines) select path, count(distinct key) as keys from k group by 1 having count(distinct key) >= 4""")
def dict_keys(spark: SparkSession, d: str) -> DataFrame:
    return det.dict_keys(rel.code_lines(spark, d))


@query("code_lines", f""", x as (select path, count(*) as loc, count(*) filter ({_COMMENT}) as c, count(*) filter (regexp_matches(text, '\\b(logger|console|log)\\.\\w+\\(')) as l, count(*) filter (regexp_matches(text, '^\\s*(def|function|func) ')) as f,
  count(*) filter (text ilike '%deprecat%') as dep, count(*) filter (regexp_matches(text, '\\bTODO\\b')) as todo from code_lines group by 1) select path, c * 10 > loc * 3 as comment_heavy, l > 3 * f as log_heavy, dep >= 3 or todo >= 2 as migrating from x where loc >= 30""")
def debt_signals(spark: SparkSession, d: str) -> DataFrame:
    return det.debt_signals(rel.code_lines(spark, d))


def _test_paths(spark: SparkSession, d: str) -> DataFrame:
    p, k = rel.table(spark, d, "part"), F.col("p_partkey")
    tests = p.where(k % 3 == 0).select(F.concat(F.lit("t/"), F.when(k % 2 == 0, F.concat(F.lit("test_mod_"), k)).otherwise(F.concat(F.lit("Mod_"), k, F.lit("_test"))), F.lit(".py")).alias("path"), F.lit("test").alias("zone"))
    return p.select(F.concat(F.lit("src/mod_"), k, F.lit(".py")).alias("path"), F.lit("production").alias("zone")).union(tests)


@query("", "select 'src/mod_' || p_partkey || '.py' as path from part where p_partkey % 3 <> 0")
def test_coverage(spark: SparkSession, d: str) -> DataFrame:
    return det.uncovered(_test_paths(spark, d))


@query("code_lines", "select path, string_agg(text, chr(10) order by line) as content from code_lines where text not like 'console.%' group by 1")
def line_fixer(spark: SparkSession, d: str) -> DataFrame:
    lines = rel.code_lines(spark, d)
    return det.without_lines(lines, lines.where(F.col("text").startswith("console.")))


@query("files", """select path, line::int as line, text from (select path, unnest(string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n')) as text, generate_subscripts(string_split_regex(regexp_replace(content, '\\r?\\n$', ''), '\\r?\\n'), 1) as line from files where content <> '')""")
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    return det.lines_of(rel.files(spark, d))


# ---- graphs


def _paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 40 == 0, "main.py").when(k % 41 == 0, "__init__.py").otherwise(F.concat(F.lit("mod_"), k, F.lit(".py")))
    return rel.table(spark, d, "part").select(k.alias("node"), F.concat(F.when(k % 4 == 0, "shared/").when(k % 4 == 1, "tools/a/").otherwise("tools/b/"), name).alias("path"), F.col("p_size").alias("loc"))


_PATHS = "paths as (select p_partkey as node, case p_partkey % 4 when 0 then 'shared/' when 1 then 'tools/a/' else 'tools/b/' end || case when p_partkey % 40 = 0 then 'main.py' when p_partkey % 41 = 0 then '__init__.py' else 'mod_' || p_partkey || '.py' end as path, p_size as loc from part)"
_METRICS = "m as (select node, count(distinct other) filter (way = 'in') as fan_in, count(distinct other) filter (way = 'out') as fan_out from (select dst as node, src as other, 'in' as way from edges union all select src, dst, 'out' from edges) group by 1)"


@query("edges", f", {_METRICS} select *, floor(100 * fan_out / (fan_in + fan_out) + 0.5) / 100 as instability from m")
def coupling_metrics(spark: SparkSession, d: str) -> DataFrame:
    return graph.metrics(rel.edges(spark, d), tasks=2 * rel.tasks(spark, d, "lineitem"))


@query("edges", f", {_METRICS} select *, floor(100 * fan_out / (fan_in + fan_out) + 0.5) / 100 as instability, case when fan_in + fan_out >= 30 then 'high' else 'medium' end as confidence from m where fan_in + fan_out >= 15")
def coupling_detector(spark: SparkSession, d: str) -> DataFrame:
    return graph.coupled(rel.edges(spark, d), tasks=2 * rel.tasks(spark, d, "lineitem"))


@query("edges", f", {_PATHS}, k as (select node from paths where path not like '%shared/mod_1%') select * from edges where src in (select node from k) and dst in (select node from k)")
def graph_finalize(spark: SparkSession, d: str) -> DataFrame:
    return graph.without(rel.edges(spark, d), _paths(spark, d), ["shared/mod_1"])


@query("edges", f", {_PATHS} select node, path, loc from paths where node not in (select dst from edges) and path not like '%/main.py' and path not like '%/\\_\\_init\\_\\_.py' escape '\\'")
def orphaned(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(_paths(spark, d), rel.edges(spark, d), ["main"], ["__init__.py"])


@query("edges", f", {_PATHS} select dst as node, min(src) as importer, any_value(loc) as loc from edges join paths on node = dst where loc between 20 and 300 group by dst having count(distinct src) = 1")
def single_use(spark: SparkSession, d: str) -> DataFrame:
    return graph.single_use(rel.edges(spark, d), _paths(spark, d).select("node", "loc"))


@query("edges", f", {_PATHS} select src, dst, deferred, a.path as src_path, b.path as dst_path from edges join paths a on a.node = src join paths b on b.node = dst where a.path like 'shared/%' and b.path like 'tools/%'")
def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    return graph.layer_violations(rel.edges(spark, d), _paths(spark, d), "shared/", "tools/")


@query("edges", """, reach(a, b) as (select src, dst from edges where not deferred union select a, dst from reach join edges on b = src where not deferred),
  scc as (select x.a as node, least(x.a, min(x.b)) as component from reach x join reach y on x.a = y.b and x.b = y.a where x.a <> x.b group by 1) select node, component, count(*) over (partition by component) as size from scc""", recursive=True)
def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(rel.edges(spark, d).where("not deferred"))


@query("edges", """, u as (select src as a, dst as b from edges union select dst, src from edges), cc(node, cluster) using key (node) as (select distinct a, a from u union
  (select u.a, min(x.cluster) from cc x join u on u.b = x.node join recurring.cc y on y.node = u.a where x.cluster < y.cluster group by u.a)) select node, cluster from cc""", recursive=True)
def connected_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.clusters(rel.edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))


_BODY = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '^(#|//|/\\*)')), chr(10))"


@query("", f"with f as (select 'doc_' || doc_id as name, {_BODY} as body from documents where len(string_split(text, chr(10))) >= 3), g as (select body, min(name) as a from f group by 1 having count(*) > 1) select a, name as b from f join g using (body) where a <> name")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = rel.table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("name"), F.col("text").alias("body"), F.size(F.split("text", "\n")).alias("loc"))
    return graph.exact_duplicates(docs, 3)


# ---- ledger


@query("tampered", """, l as (select *, lag(payload_hash) over (order by seq) as expected from tampered where seq % 5000 <> 77), p as (select seq, case when seq > 1 and (seq - 1) % 5000 = 77 then 'gap' end as g, case when seq > 1 and (seq - 1) % 5000 <> 77 and prev_hash <> expected or seq = 1 and prev_hash <> repeat('0', 64) then 'link' end as k,
  case when payload_hash <> sha256(payload) then 'payload' end as h from l) select seq, problem from (select seq, unnest([g, k, h]) as problem from p) where problem is not null""")
def ledger_violations(spark: SparkSession, d: str) -> DataFrame:
    return ledger.violations(rel.ledger(spark, d, tampered=True).where("seq % 5000 <> 77"), tasks=rel.tasks(spark, d, "events"))


@query("ledger", "select seq, event_id, schema, prev_hash, payload_hash, kind, payload from ledger")
def ledger_chain(spark: SparkSession, d: str) -> DataFrame:
    return rel.ledger(spark, d).drop("at")


@query("ledger", "select kind, count(*) as n, min(seq) as first_seq, max(seq) as last_seq, arg_max(payload, seq) as last_payload from ledger group by 1")
def ledger_projection(spark: SparkSession, d: str) -> DataFrame:
    return ledger.projection(rel.ledger(spark, d))


_STATUS = "['planned', 'lane', 'verifying', 'verified', 'landed', 'discarded']"


def _changes(spark: SparkSession, d: str) -> DataFrame:
    e = rel.table(spark, d, "events")
    status = rel.pick(["planned", "lane", "verifying", "verified", "landed", "discarded"], (F.col("event_id") * 7 + F.floor(F.col("event_id") / 50)) % 6)
    return e.select(F.floor(F.col("event_id") / 4).alias("change"), F.col("event_id").alias("seq"), status.alias("status"))


_CHANGES = f"changes as (select event_id // 4 as change, event_id as seq, {_STATUS}[((event_id * 7 + event_id // 50) % 6 + 1)::int] as status from events)"


@query("", f"with {_CHANGES}, s as (select *, lag(status) over (partition by change order by seq) as before from changes) select change, seq, before, status from s where not (before is null and status = 'planned' or (before, status) in ({', '.join(f'''('{a}', '{b}')''' for a, b in ledger.MOVES)})) or (before is null and status <> 'planned')")
def change_transitions(spark: SparkSession, d: str) -> DataFrame:
    return ledger.illegal_moves(_changes(spark, d))


@query("", f"with {_CHANGES} select change, arg_max(status, seq) as status, max(seq) as seq from changes group by 1")
def change_latest(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_changes(spark, d))


@query("", """with l as (select event_id % 97 as lane, event_id as seq, case when event_id % 3 = 0 then -1 else 1 end as step from events), s as (select *, sum(step) over (order by seq) as open from l) select lane, seq, open::bigint as open from s where open > 1""")
def lanes_in_progress(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    lanes = rel.table(spark, d, "events").select((e % 97).alias("lane"), e.alias("seq"), F.when(e % 3 == 0, -1).otherwise(1).alias("step"))
    return ledger.crowded(lanes)


@query("", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")
def referential_check(spark: SparkSession, d: str) -> DataFrame:
    o = rel.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return ledger.dangling(o, rel.table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("", """with r as (select event_id // 6 as run, event_id % 6 as step, value >= 1 as passed from events), x as (select *, coalesce(max((not passed)::int) over (partition by run order by step rows between unbounded preceding and 1 preceding), 0) as f from r)
  select run, step, case when f = 1 then 'inconclusive' when passed then 'passed' else 'failed' end as verdict from x""")
def verifier_ladder(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return ledger.ladder(rel.table(spark, d, "events").select(F.floor(e / 6).alias("run"), (e % 6).alias("step"), (F.col("value") >= 1).alias("passed")))
