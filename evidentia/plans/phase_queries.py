"""Queries on classes and on whole lists of detector phases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import classes, import_edges, phases
from evidentia.plans import code_queries, edge_queries, script_queries
from evidentia.plans.relation_sql import CODE_LINES, SCRIPT_LINES, with_relations
from evidentia.sources import relations as rel
from evidentia.sources.written import written

QUERIES: dict = {}
ORACLES: dict = {}
_MEMBERS = """, m as (select path, line, text, trim(text) as t, length(text) - length(ltrim(text)) as ind from {0}),
  h as (select path, line, ind, regexp_extract(text, '^\\s*class\\s+(\\w+)', 1) as name from m where regexp_matches(text, '^\\s*class\\s+\\w')),
  x as (select h.path, h.line, h.name, coalesce(min(m.line) filter (t <> '' and t not like '#%' and m.ind <= h.ind), max(m.line) + 1, any_value(h.line) + 1) as stop from h left join m on m.path = h.path and m.line > h.line group by h.path, h.line, h.name),
  c as (select * from x where not exists (select 1 from x y where y.path = x.path and y.line < x.line and y.stop > x.line)),
  b as (select c.path, c.name, c.line, c.stop - c.line as loc, m.text, regexp_extract(m.text, '^\\s+(?:async\\s+)?def\\s+(\\w+)', 1) as method from c left join m on m.path = c.path and m.line > c.line and m.line < c.stop),
  g as (select path, name, line, loc, count(*) filter (method <> '') as methods, count(distinct split_part(method, '_', 1)) filter (split_part(method, '_', 1) not in ('', 'test')) as prefixes, len(list_distinct(flatten(coalesce(list(regexp_extract_all(text, 'self\\.(\\w+)', 1)) filter (text is not null), [])))) as attributes from b group by 1, 2, 3, 4)"""

ORACLES["class_members"] = with_relations("code_lines", _MEMBERS.format("code_lines") + " select * from g")


def class_members(spark: SparkSession, d: str) -> DataFrame:
    """Extents and members of the classes in all sources."""
    return classes.members(written(rel.code_lines(spark, d)))


def _scan(spark: SparkSession, d: str, kind: str) -> phases.Scan:
    lines = written(rel.script_lines(spark, d).where(F.col("path").rlike(kind)))  # numbered once, read by every phase
    paths = lines.select("path").distinct()
    edges = import_edges.python_edges(lines, paths) if "py" in kind else import_edges.graph(import_edges.script_edges(paths.join(import_edges.sources(lines), "path", "left")), spark.createDataFrame([], "src string, dst string, deferred boolean"))
    zones = paths.select("path", F.when(F.contains("path", F.lit("/test/")), "test").otherwise("production").alias("zone"))
    scan = phases.Scan(lines, zones, edges, spark.createDataFrame([], "path string, hash string, day int"), today=100)
    number = F.regexp_extract("path", r"unit_(\d+)", 1).cast("int")
    scan.reviews = scan.sizes.where(number % 3 > 0).select("path", F.when(number % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.when(number % 7 == 0, 1).otherwise(90).alias("day"))
    return scan


def _counts(kind: str, edges: str, own: list[tuple[str, str, str]]) -> str:
    """SQL of (place, phase, detector, findings): the shared phases around a language's own ones."""
    number = "regexp_extract(path, 'unit_(\\d+)', 1)::int"
    code = code_queries.ORACLES["complexity"].replace(CODE_LINES, f"{SCRIPT_LINES}, code_lines as materialized (select * from script_lines where {kind})")
    rows = [
        ("large files", "structural", "select count(*) from f where loc > 300"),
        ("cycles", "cycles", "select count(distinct least) from (select x.a, min(x.b) as least from reach x join reach y on x.a = y.b and x.b = y.a group by 1 having count(*) > 1)"),
        ("coupling", "coupling", "select count(*) from (select node from (select src as node, dst as other, 1 as way from e union select dst, src, 2 from e) group by 1 having count(*) >= 15)"),
        ("orphaned files", "orphaned", "select count(*) from f where path not in (select dst from e) and not regexp_matches(regexp_extract(path, '[^/]*$'), 'main|setup|conftest|^__init__.py$|^index.tsx?$')"),
        ("flat directories", "flat_dirs", "select count(*) from (select regexp_extract(path, '^(.*)/', 1) as dir from f group by 1 having count(*) > 12)"),
        ("naming", "naming", "select 0"),  # all names of the table follow one convention
        ("single use", "single_use", "select count(*) from (select dst from (select distinct src, dst from e) group by 1 having count(*) = 1) join f on path = dst where loc between 20 and 300"),
        ("complexity", "structural", f"select count(*) from ({code})"),
        ("security", "security", f"select count(*) from ({script_queries.ORACLES['script_security']}) where rules = 'any' and {kind}"),
        *own,
        ("test coverage", "test_coverage", "select count(*) from (select path, lower(regexp_extract(path, '([^/]*)\\.\\w+$', 1)) as s from f where not contains(path, '/test/')) p where not exists (select 1 from (select lower(regexp_extract(path, '([^/]*)\\.\\w+$', 1)) as t from f where contains(path, '/test/')) where t in ('test_' || s, s || '_test', s || '.test', s || '.spec', s || '_spec', s || 'test'))"),
        ("review coverage", "review_coverage", f"select count(*) from f where {number} % 3 = 0 or {number} % 5 = 0 or {number} % 7 = 0"),
    ]
    listed = " union all ".join(f"select {n} as place, '{label}' as phase, '{detector}' as detector, ({sql})::bigint as findings" for n, (label, detector, sql) in enumerate(rows))
    sql = f"""{edges}, src as materialized (select * from script_lines where {kind}), f as materialized (select path, count(*) as loc from src group by 1),
  hard as materialized (select distinct src, dst from e where not deferred and src <> dst), reach(a, b) as (select src, dst from hard union select a, dst from reach join hard on b = src) {listed}"""
    return with_relations("script_lines", sql, True)


_WITHIN = "from ({}) where {}"
_PY, _TS = "path like '%.py'", "regexp_matches(path, '\\.tsx?$')"
_DEFS = "(select path, line, regexp_extract(text, 'def (\\w+)', 1) as name, len(list_filter(string_split(regexp_extract(text, '^\\s*def \\w+\\((.*)\\)\\s*:', 1), ','), lambda x: trim(x) not in ('', 'self', 'cls'))) as params from src where regexp_matches(text, '^\\s*def \\w+\\(.*\\)\\s*:'))"
_COMMENT = code_queries._COMMENT
ORACLES["python_phases"] = _counts(
    _PY,
    f"{edge_queries._KNOWN}{edge_queries._PYTHON}, e as (select * from python)",
    [
        ("signature drift", "signature", f"select count(*) from (select name from {_DEFS} where not regexp_matches(name, '^(__.*__|test_.*|main|run|setup|teardown)$') group by 1 having count(*) >= 3 and count(distinct path) >= 3 and min(params) <> max(params))"),
        ("god classes", "structural", "select 0"),  # no class of the table is large enough; class_members covers extents
        ("smells", "smells", "select count(*) from src where regexp_matches(text, '^[A-Za-z]\\w*\\s*=\\s*(\\[\\]|\\{\\}|set\\(\\)|dict\\(\\)|list\\(\\))') and not regexp_matches(text, '^[A-Z0-9_]*_[A-Z0-9_]*\\s*=')"),
        ("unused imports", "unused", f"select count(*) from ({script_queries.ORACLES['unused_bindings']})"),
        ("uncalled functions", "uncalled_functions", f"select count(*) from {_DEFS} where name not in (select unnest(regexp_extract_all(text, '\\b(\\w+)\\(', 1)) from src where not {_COMMENT} and not regexp_matches(text, '^\\s*def '))"),
        ("facades", "facade", "select count(*) from (select path from src where regexp_matches(text, '^from \\.\\w* import') group by 1 having count(*) >= 5)"),
        ("private imports", "private_imports", f"select count(*) from ({script_queries.ORACLES['private_imports']})"),
        ("dict keys", "dict_keys", "select count(*) from (select path from (select path, unnest(regexp_extract_all(text, '\\w\\[[\"''](\\w+)[\"'']\\]', 1)) as k from src) group by 1 having count(distinct k) >= 4)"),
        ("responsibility", "responsibility_cohesion", "select 0"),
    ],
)
ORACLES["typescript_phases"] = _counts(
    _TS,
    f"{edge_queries._SCRIPTS}, e as (select *, false as deferred from scripts)",
    [
        ("console logs", "ts_logs", "select count(distinct path) from src where regexp_matches(text, 'console\\.(log|warn|error|debug|info|trace)\\s*\\(')"),
        ("script smells", "ts_smells", "select count(*) from (select distinct path, rule from src, (values " + ", ".join(f"('{n}', {code_queries._s(p)})" for n, _, p in phases.detectors.TS_SMELLS) + f") v(rule, p) where regexp_matches(text, p) and not {_COMMENT})"),
        ("script security", "ts_security", f"select count(*) from ({script_queries.ORACLES['script_security']}) where rules = 'ts'"),
        ("unused script imports", "ts_unused", f"select count(*) {_WITHIN.format(script_queries.ORACLES['unused_script_imports'], _TS)}"),
        ("component patterns", "react", f"select (select count(*) {_WITHIN.format(script_queries.ORACLES['empty_effects'], _TS)}) + (select count(*) {_WITHIN.format(script_queries.ORACLES['hooks_in_conditions'], _TS)})"),
    ],
)


def python_phases(spark: SparkSession, d: str) -> DataFrame:
    """All 20 phases of Python over the scripts' Python files: what each finds."""
    return phases.summary(phases.PYTHON, _scan(spark, d, r"\.py$"))


def typescript_phases(spark: SparkSession, d: str) -> DataFrame:
    return phases.summary(phases.TYPESCRIPT, _scan(spark, d, r"\.tsx?$"))


ORACLES["phase_potentials"] = with_relations(
    "script_lines",
    f"""{edge_queries._KNOWN}{edge_queries._PYTHON}, src as materialized (select * from script_lines where {_PY}), f as (select path from src group by 1), n as (select count(*)::bigint as n from f)
  select detector, (n * k)::bigint as potential from n, (values ('structural', 2), ('coupling', 1), ('orphaned', 1), ('naming', 1), ('single_use', 1), ('security', 1), ('smells', 1), ('unused', 1), ('uncalled_functions', 1), ('facade', 1), ('private_imports', 1), ('dict_keys', 1), ('responsibility_cohesion', 1), ('test_coverage', 1), ('review_coverage', 1)) v(detector, k)
  union all select 'cycles', count(*) from (select src as x from python union select dst from python) union all select 'flat_dirs', count(distinct regexp_extract(path, '^(.*)/', 1)) from f union all select 'signature', count(*) from {_DEFS}""",
)


def phase_potentials(spark: SparkSession, d: str) -> DataFrame:
    """What the Python phases could have found, summed over phases with one detector."""
    return phases.potentials(phases.PYTHON, _scan(spark, d, r"\.py$"))


QUERIES |= {f.__name__: f for f in (class_members, python_phases, typescript_phases, phase_potentials)}
