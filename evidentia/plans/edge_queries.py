"""Queries on dependency edges that are read from source texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import graph, import_edges
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel
from evidentia.sources.written import written

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_relations("script_lines", sql, recursive)
        return f

    return add


_KNOWN = ", known as materialized (select distinct path as target from script_lines)"
# forms in the words of RE2; paths are folded by replacing a folder and the `..` after it
_SCRIPTS = _KNOWN + """, whole as (select path, string_agg(text, chr(10) order by line) as content from script_lines where regexp_matches(path, '\\.tsx?$') group by 1),
  spec as (select distinct path, unnest(list_concat(list_concat(regexp_extract_all(content, '(?:import|export)\\s+(?:.*?\\s+from\\s+)?[''"]([^''"]+)[''"]', 1),
    regexp_extract_all(content, 'import\\s*\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1)), regexp_extract_all(content, 'require\\s*\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1))) as spec from whole),
  joined as (select path, replace(regexp_replace(regexp_replace(path, '[^/]*$', '') || spec, '[^/]+/\\.\\./', ''), '/./', '/') as base from spec where spec like '.%'),
  tries as (select path, base, unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js']) as tail, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8], 1) as place from joined),
  scripts as materialized (select distinct src, dst from (select path as src, arg_min(target, place) as dst from tries join known on target = base || tail group by path, base))"""
# a def holds until a line with text that is indented as little and opens no def itself
_PYTHON = """, py as (select path, line, text, trim(text, ' ') as t, length(text) - length(ltrim(text, ' ')) as ind from script_lines where path like '%.py'),
  opened as (select *, max(case when regexp_matches(t, '^(async )?def ') then line end) over (partition by path order by line) as def_line from py),
  imps as (select path, line, def_line, coalesce(nullif(regexp_extract(t, '^import\\s+(\\S+)', 1), ''), nullif(regexp_extract(t, '^from\\s+(\\S+)\\s+import\\b', 1), '')) as module, t like 'from%' as is_from from opened),
  ended as (select i.path, i.line from imps i join py d on d.path = i.path and d.line = i.def_line join py x on x.path = i.path and x.line > i.def_line and x.line <= i.line
    where i.module is not null and x.t <> '' and x.t not like '#%' and x.ind <= d.ind group by 1, 2),
  late as (select i.path, module, is_from, def_line is not null and e.path is null as deferred from imps i left join ended e on e.path = i.path and e.line = i.line where module is not null),
  absolute as (select path, module, unnest(range(len(string_split(module, '.')), 0, -1)) as k from (select distinct path, module from late where not (is_from and module like '.%'))),
  places as (select path, module, array_to_string(string_split(module, '.')[:k], '/') || tail as target, -2 * k + n as place from absolute, (values ('.py', 0), ('/__init__.py', 1)) v(tail, n)
    union all select path, module, regexp_extract(path, '^(.*)/', 1) || '/' || module[2:] || '.py', 0 from late where is_from and module like '.%'),
  python as materialized (select path as src, target as dst, max(deferred::int) = 1 as deferred from late join (select path, module, arg_min(target, place) as target from places join known using (target) group by 1, 2) using (path, module) group by 1, 2)"""


def _scripts(lines: DataFrame) -> DataFrame:
    known = lines.select("path").distinct()
    return import_edges.script_edges(known.join(import_edges.sources(lines.where(F.col("path").rlike(r"\.tsx?$"))), "path", "left"))


def _python(lines: DataFrame) -> DataFrame:
    return import_edges.python_edges(lines.where("path like '%.py'"), lines.select("path").distinct())


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of edges, from lines that are numbered and written once."""
    lines = written(rel.script_lines(spark, d))
    return import_edges.graph(_scripts(lines), _python(lines))


@query(f"{_SCRIPTS} select src, dst from scripts")
def script_import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _scripts(written(rel.script_lines(spark, d)))


@query(f"{_KNOWN}{_PYTHON} select src, dst, deferred from python")
def python_import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _python(written(rel.script_lines(spark, d)))


_GRAPH = f"{_SCRIPTS}{_PYTHON}, g as materialized (select src, dst, false as deferred from scripts union all select src, dst, deferred from python)"


@query(f"""{_GRAPH}, n as (select node, count(distinct other) filter (way = 'in') as fan_in, count(distinct other) filter (way = 'out') as fan_out from (select dst as node, src as other, 'in' as way from g union all select src, dst, 'out' from g) group by 1)
  select node, fan_in, fan_out, floor(100 * fan_out / (fan_in + fan_out) + 0.5) / 100 as instability from n""")
def source_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Coupling of files by the imports in their texts."""
    return graph.metrics(_graph(spark, d))


@query(f"""{_GRAPH}, e as materialized (select distinct src, dst from g where not deferred and src <> dst), reach(a, b) as (select src, dst from e union select a, dst from reach join e on b = src),
  m as (select x.a as node, min(x.b) as least, count(*) as size from reach x join reach y on x.a = y.b and x.b = y.a group by 1)
  select node, least as component, size from m where size > 1""", recursive=True)
def source_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Import cycles among files; imports inside functions close none."""
    return graph.strong_components(_graph(spark, d).where("not deferred").select("src", "dst"))
