"""Queries on script files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators import detectors as det
from evidentia.operators import python_imports
from evidentia.operators import script_rules as rules
from evidentia.plans.code_queries import _s
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_relations("script_lines", sql, False)
        return f

    return add


def _m(pattern: str) -> str:
    return f"regexp_matches(text, {_s(pattern)})"


_OUT_OF_TESTS = "path not like '%/test/%'"


def _hits(table: list) -> str:
    return " union all ".join(f"select path, line, '{n}' as rule, '{c}' as confidence from code where {_m(p)}" for n, c, p in table)


@query(f""", code as (select * from script_lines where not regexp_matches(ltrim(text), '^(#|//|\\*|/\\*)')), a as ({_hits(det.SECURITY)}), b as ({_hits(det.TS_SECURITY)}), c as ({_hits(det.CS_SECURITY)})
  select 'any' as rules, * from a union all select 'ts', * from b where path like '%.ts' or path like '%.tsx' union all select 'cs', * from c where path like '%.cs'""")
def script_security(spark: SparkSession, d: str) -> DataFrame:
    """The three security rule tables, each over the files that it is for."""
    lines = rel.script_lines(spark, d)
    parts = [("any", lines, det.SECURITY), ("ts", lines.where("path like '%.ts' or path like '%.tsx'"), det.TS_SECURITY), ("cs", lines.where("path like '%.cs'"), det.CS_SECURITY)]
    out = None
    for name, own, table in parts:
        hits = det.rule_hits(own, table).selectExpr(f"'{name}' as rules", "path", "line", "rule", "confidence")
        out = hits if out is None else out.union(hits)
    return out


@query(f""", own as (select * from script_lines where path like '%.dart' and {_OUT_OF_TESTS}), code as (select * from own where ltrim(text) not like '//%'),
  g as (select path, line, text, max({_m("BuildContext")}::int) over w as used, max({_m("await")}::int) over w as waits from own window w as (partition by path order by line rows between 1 following and 30 following))
  select path, 'empty_catch' as rule, line, 1::bigint as n from code where {_m(rules.EMPTY_CATCH)}
  union all select path, 'build_context_async', line, 1 from g where used = 1 and waits = 1 and {_m(rules.ASYNC_WITH_CONTEXT)}
  union all select path, 'debug_prints', 0, count(*) from code where {_m(rules.PRINT)} group by 1 having count(*) >= 3""")
def dart_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rules.dart_patterns(rel.script_lines(spark, d))


def _many(name: str, test: str, least: int) -> str:
    return f"union all select path, '{name}', 0, count(*) from code where {test} group by 1 having count(*) >= {least}"


_LOADS = f"({_m(rules.LOAD)} and not {_m(rules.PRELOAD)})"


@query(f""", code as (select * from script_lines where path like '%.gd' and {_OUT_OF_TESTS} and ltrim(text) not like '#%')
  select path, 'prefer_preload' as rule, line, 1::bigint as n from code where {_LOADS} and regexp_matches(ltrim(text), '^(var|const) ')
  {_many("deep_node_paths", _m(rules.NODE_PATH), 5)} {_many("excessive_load", _LOADS, 3)} {_many("debug_prints", _m(rules.PRINT), 3)}""")
def gdscript_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rules.gdscript_patterns(rel.script_lines(spark, d))


@query("select path, line from script_lines where text like 'useEffect(() => { }%'")
def empty_effects(spark: SparkSession, d: str) -> DataFrame:
    return rules.empty_effects(rel.script_lines(spark, d))


@query(f""", n as (select path, line, text, length(replace(text, '}}', '')) - length(replace(text, '{{', '')) as net from script_lines),
  s as (select *, sum(net) over (partition by path order by line) as s from n), e as (select *, s - least(0, min(s) over (partition by path order by line)) as depth from s),
  b as (select *, coalesce(lag(depth) over (partition by path order by line), 0) as before, {_m(rules.CONDITION)} as starts from e),
  a as (select l.path, l.line, max(x.line) as start from b l join b x on x.path = l.path and x.line <= l.line and x.starts where {_m(rules.HOOK).replace("text", "l.text")} group by 1, 2)
  select a.path, a.line from a join b x on x.path = a.path and x.line = a.start join b m on m.path = a.path and m.line between a.start and a.line group by 1, 2 having min(m.depth) > min(x.before)""")
def hooks_in_conditions(spark: SparkSession, d: str) -> DataFrame:
    return rules.hooks_in_conditions(rel.script_lines(spark, d))


@query(f""", i as (select path, line, text, {_m("import type")} as type_only from script_lines where {_m(rules.NAMED_IMPORT)} or {_m(rules.DEFAULT_IMPORT)}),
  p as (select path, line, type_only, trim(unnest(case when text like '%{{%' then string_split(regexp_extract(text, '\\{{([^}}]*)\\}}', 1), ',') else [regexp_extract(text, {_s(rules.DEFAULT_IMPORT)}, 1)] end)) as part from i),
  names as (select path, line, type_only, case when part like '% as %' then trim(split_part(part, ' as ', 2)) else regexp_replace(part, '^type ', '') end as name from p),
  w as (select path, line, unnest(regexp_extract_all(text, '\\w+')) as name from script_lines where not regexp_matches(ltrim(text), '^(//|\\*)')), m as (select path, name, max(line) as last from w group by 1, 2)
  select path, line, name, type_only from names left join m using (path, name) where (last is null or last <= line) and not (name = 'React' and path like '%.tsx')""")
def unused_script_imports(spark: SparkSession, d: str) -> DataFrame:
    return rules.unused_script_imports(rel.script_lines(spark, d))


_TRY_TARGETS = r""", dots as (select path, module, length(regexp_extract(module, '^\.*', 0)) as n, replace(regexp_replace(module, '^\.+', ''), '.', '/') as tail, string_split(path, '/') as dirs from wanted),
  bases as (select *, case when n = 0 then '' else array_to_string(dirs[:greatest(len(dirs) - n, 0)], '/') || '/' end as base from dots),
  places as (select path, module, ltrim(base, '/') || tail || e as target, i as place from bases, (values ('.py', 0), ('/__init__.py', 1)) v(e, i) where n > 0 and tail <> ''
    union all select path, module, ltrim(base, '/') || '__init__.py', 0 from bases where n > 0 and tail = ''
    union all select path, module, array_to_string(string_split(module, '.')[:k], '/') || e, -2 * k + i from (select path, module, unnest(range(1, len(string_split(module, '.')) + 1)) as k from bases where n = 0), (values ('.py', 0), ('/__init__.py', 1)) v(e, i)),
  resolved as (select path, module, arg_min(target, place) as target from places semi join (select distinct path as target from script_lines) using (target) group by 1, 2)"""
_IS_PRIVATE = "x[1] = '_' and x not in ('__init__', '__main__')"


@query(rf""", own as (select path, line, trim(text) as t from script_lines where path like '%.py'),
  plain as (select path, line, trim(split_part(trim(m), ' ', 1), '(),') as module from (select path, line, unnest(string_split(regexp_extract(t, '^import\s+(.+)$', 1), ',')) as m from own where regexp_matches(t, '^import\s'))),
  froms as (select path, line, regexp_extract(t, '^from\s+([.\w]+)\s+import\s+(.+)$', 1) as base, regexp_extract(t, '^from\s+([.\w]+)\s+import\s+(.+)$', 2) as names from own where regexp_matches(t, '^from\s+[.\w]+\s+import\s+.')),
  items as (select path, line, base, trim(split_part(trim(n), ' ', 1), '(),') as x from (select path, line, base, unnest(string_split(names, ',')) as n from froms)),
  c as (select path, line, module, list_filter(string_split(regexp_replace(module, '^\.+', ''), '.'), lambda x: {_IS_PRIVATE})[1] as name from (select path, line, module from plain union all select path, line, base from froms)
    union all select path, line, case when base like '%.' then base || x else base || '.' || x end, x from items where {_IS_PRIVATE}),
  wanted as (select distinct path, module from c where name is not null){_TRY_TARGETS}
  select path, name as private_name, target as resolved, min(line) as line from c join resolved using (path, module) where name is not null and regexp_extract(path, '^(.*)/', 1) <> regexp_extract(target, '^(.*)/', 1) group by 1, 2, 3""")
def private_imports(spark: SparkSession, d: str) -> DataFrame:
    lines = rel.script_lines(spark, d)
    return rules.private_imports(lines, lines.select("path").distinct())


# each import looks back for the guard that it is in and forward for its next mention
@query(r""", own as materialized (select path, line, text, trim(text) as t, length(text) - length(ltrim(text)) as ind from script_lines where path like '%.py'),
  imps as (select * from own where regexp_matches(t, '^(import\s+\S|from\s+\S+\s+import\s+.)') and t not like '%# noqa%'),
  tries as (select i.path, i.line, max(g.line) as since from imps i join own g on g.path = i.path and g.line < i.line and g.t = 'try:' group by 1, 2),
  ended as (select t.path, t.line from tries t join own x on x.path = t.path and x.line > t.since and x.line <= t.line where x.t <> '' and x.ind = 0 and x.t not in ('try:', 'finally:') and x.t not like 'except%' and x.t not like 'if TYPE_CHECKING:%'),
  types as (select i.path, i.line, max(g.line) as since, arg_max(g.ind, g.line) as depth from imps i join own g on g.path = i.path and g.line < i.line and g.t like 'if TYPE_CHECKING:%' group by 1, 2),
  left_type as (select t.path, t.line from types t join own x on x.path = t.path and x.line > t.since and x.line <= t.line where x.t <> '' and x.ind <= t.depth),
  free as (select * from imps anti join (select path, line from tries anti join ended using (path, line)) using (path, line) anti join (select path, line from types anti join left_type using (path, line)) using (path, line)),
  names as (select path, line, split_part(rtrim(regexp_extract(t, '^import\s+(\S+)', 1), ','), '.', 1) as name from free where t like 'import%' and regexp_extract(t, '^import\s+(\S+)', 1) like '%.%'
    union all select path, line, case when s like '% as %' then trim(split_part(s, ' as ', 2)) else s end from (
      select path, line, trim(trim(trim(split_part(s, '#', 1)), '()')) as s from (select path, line, unnest(string_split(regexp_extract(t, '^from\s+\S+\s+import\s+(.+)', 1), ',')) as s from free where t like 'from%' and not starts_with(t, 'from __future__')))),
  lists as (select s.path, s.line as a, coalesce(min(x.line), 1000000000) as b from own s left join own x on x.path = s.path and x.line >= s.line and contains(x.text, ']') where contains(s.text, '__all__ = [') group by 1, 2),
  exports as (select distinct o.path, unnest(list_transform(regexp_extract_all(o.text, '"[^"]+"|''[^'']+'''), lambda q: q[2:-2])) as name from own o join lists on lists.path = o.path and o.line between a and b),
  words as (select path, unnest(list_distinct(regexp_extract_all(split_part(text, '#', 1), '\w+'))) as name, line from own where t <> '' and not regexp_matches(t, '^(#|import |from )')),
  used as (select path, name, max(line) as last from words group by 1, 2)
  select path, n.line, name from names n anti join exports using (path, name) left join used using (path, name) where last is null or last <= n.line""")
def unused_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Names that Python imports bind outside guards, that nothing exports or uses later."""
    return python_imports.unused(rel.script_lines(spark, d))
