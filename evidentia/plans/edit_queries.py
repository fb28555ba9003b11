"""Queries on edits: of texts by fixers, of configurations, of clusters and of assessments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import config, edits, fixes
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(names: str, sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_relations(names, sql) if names else sql
        return f

    return add


def _findings(lines: DataFrame) -> DataFrame:
    """First-tier findings on lines: prints of Python, console calls and default imports of scripts, relative imports of Python; some are not open."""
    t, script = F.col("text"), F.col("path").rlike(r"\.tsx?$")
    forms = [
        ("smells", ~script & t.rlike(r"^print\("), F.lit(None).cast("string"), F.lit("debug_print")),
        ("ts_logs", script & t.rlike(r"^console\.log\("), F.lit(None).cast("string"), F.lit(None).cast("string")),
        ("ts_unused", script & t.rlike(r"^import \w+ from"), F.regexp_extract("text", r"^import (\w+) from", 1), F.lit(None).cast("string")),
        ("unused", ~script & t.rlike(r"^from \."), F.lit(None).cast("string"), F.lit(None).cast("string")),
    ]
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(d).alias("detector"), F.to_json(F.struct("line", i.alias("import"), s.alias("smell"))).alias("detail"))) for d, c, i, s in forms)))
    own = lines.where(script | F.col("path").endswith(".py")).select(F.col("path").alias("file"), "line", F.explode(hits).alias("h"))
    status = F.when(F.col("line") % 5 == 0, "fixed").otherwise("open")
    return own.select("file", "h.*", status.alias("status"), (F.col("line") % 7 == 0).alias("suppressed"), F.when(F.col("line") % 11 == 0, 2).otherwise(1).alias("tier"), F.when(F.col("file").endswith(".py"), "python").otherwise("typescript").alias("lang"))


_OPEN = "line % 5 <> 0 and line % 7 <> 0 and line % 11 <> 0"
# of each file the two fixers that can have work; the second one's numbers count in the text that the first one left
_FIXED = f""", own as materialized (select *, path like '%.py' as py from script_lines where path like '%.py' or path like '%.ts' or path like '%.tsx'),
  m1 as (select distinct path, line from own where {_OPEN} and case when py then starts_with(text, 'print(') else starts_with(text, 'console.log(') end),
  n1 as (select path, count(*) as n from m1 group by 1),
  c1 as (select own.path, any_value(py) as py, n, case when any_value(py) then n else count(*) filter (regexp_matches(text, '^\\s*console\\.(log|warn|error|debug|info|trace)\\s*\\(')) end as changes from own join n1 using (path) group by own.path, n),
  s1 as materialized (select path, py, text, row_number() over (partition by path order by line) as line from own anti join (select path, line from m1 join c1 using (path) where changes > 0) using (path, line)),
  m2 as (select path, line, regexp_extract(text, '^import (\\w+) from', 1) as name from own where {_OPEN} and case when py then starts_with(text, 'from .') else regexp_matches(text, '^import \\w+ from') end),
  n2 as (select path, count(*) as n from m2 group by 1),
  c2 as (select n2.path, case when n2.path like '%.py' then any_value(n) else coalesce(count(distinct s1.line) filter (contains(text, 'import ' || name || ' from') or contains(text, 'import type ' || name || ' from')), 0) end as changes from n2 join m2 using (path) left join s1 on s1.path = m2.path and s1.line = m2.line group by 1),
  s2 as (select path, text, row_number() over (partition by path order by line) as line from s1 anti join (select path, line from m2 join c2 using (path) where changes > 0) using (path, line)),
  told as (select path, case when py then 'python-debug-logs' else 'ts-logs' end as fixer, changes as lines_changed, case when changes = 0 then 0 when py then changes else n end as findings_fixed, changes > 0 as modified from c1
    union all select path, case when path like '%.py' then 'python-unused-imports' else 'ts-unused-imports' end, changes, changes, changes > 0 from c2)"""


def _script_sources(spark: SparkSession, d: str) -> DataFrame:
    return rel.script_lines(spark, d).where(F.col("path").rlike(r"\.(py|tsx?)$"))


@query("script_lines", f"{_FIXED} select path, line::int as line, text from s2")
def fixed_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _script_sources(spark, d)
    return fixes.run(lines, _findings(lines))[0]


@query("script_lines", f"{_FIXED} select * from told")
def fixer_results(spark: SparkSession, d: str) -> DataFrame:
    lines = _script_sources(spark, d)
    return fixes.run(lines, _findings(lines))[1]


@query("script_lines", f"{_FIXED} select path, case when path like '%.py' then 'python-debug-logs' else 'ts-logs' end as fixer, 0::bigint as lines_changed, n as findings_fixed, false as modified from n1 union all select path, case when path like '%.py' then 'python-unused-imports' else 'ts-unused-imports' end, 0, n, false from n2")
def fixer_dry_run(spark: SparkSession, d: str) -> DataFrame:
    return fixes.dry_run(_findings(_script_sources(spark, d)))


_RAWS = "['95', '101', '-3', '+7', 'never', '4294967296', 'YES', 'no', 'maybe', 'badge.png', 'dir/', '0012', '', 'a\"b']"
_KEYS = "['target_strict_score', 'review_max_age_days', 'generate_scorecard', 'badge_path', 'props_threshold', 'needs_rescan', 'exclude', 'nonsense']"
_EDIT_SQL = f"edits as (select 'p' || (o_custkey % 700) as project, o_orderkey as seq, case when o_orderkey % 17 = 0 then 'unset' else 'set' end as op, {_KEYS}[(o_orderkey % 1013 % 8 + 1)::int] as key, {_RAWS}[(o_orderkey % 1019 % 14 + 1)::int] as raw from orders)"
# in words of the types: whole numbers below 2**32, yes or no, names that don't end in a slash
_JUDGED = f"""{_EDIT_SQL}, n as (select *, case when regexp_matches(raw, '^\\+?[0-9]+$') and raw::hugeint < 4294967296 then raw::hugeint::varchar end as num, case when lower(raw) in ('true', '1', 'yes') then 'true' when lower(raw) in ('false', '0', 'no') then 'false' end as flag from edits),
  j as (select *, case when op = 'unset' then case key when 'target_strict_score' then '95' when 'review_max_age_days' then '30' when 'generate_scorecard' then 'true' when 'badge_path' then '"scorecard.png"' when 'props_threshold' then '0' when 'needs_rescan' then 'false' when 'exclude' then '[]' end
    else case key when 'target_strict_score' then case when num::int <= 100 then num end when 'review_max_age_days' then case when raw = 'never' then '0' else num end when 'props_threshold' then num when 'generate_scorecard' then flag when 'needs_rescan' then flag
      when 'badge_path' then case when raw <> '' and raw not like '%/' then to_json(raw)::varchar end end end as value from n)"""


def _edits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    keys = ["target_strict_score", "review_max_age_days", "generate_scorecard", "badge_path", "props_threshold", "needs_rescan", "exclude", "nonsense"]
    raws = ["95", "101", "-3", "+7", "never", "4294967296", "YES", "no", "maybe", "badge.png", "dir/", "0012", "", 'a"b']
    return rel.table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 700).alias("project"), k.alias("seq"), F.when(k % 17 == 0, "unset").otherwise("set").alias("op"), rel.pick(keys, k % 1013 % 8).alias("key"), rel.pick(raws, k % 1019 % 14).alias("raw"))


@query("", f"""with {_JUDGED} select project, seq, op, key, value, case when value is null then case when op = 'unset' then 'unknown key' when key = 'target_strict_score' then case when num is null then 'expected integer' else 'must be 0-100' end
  when key = 'review_max_age_days' then 'expected integer or never' when key = 'props_threshold' then 'expected integer' when key in ('generate_scorecard', 'needs_rescan') then 'expected boolean' when key = 'badge_path' then 'must be a filename' else 'unknown or non-settable key' end end as error from j""")
def config_edits(spark: SparkSession, d: str) -> DataFrame:
    return config.judged(_edits(spark, d)).drop("raw")


_DEFAULTS = ", ".join(f"('{k}', '{v}')" for k, _, v in config.SETTINGS)


@query("", f"""with {_JUDGED}, c as (select distinct 'p' || (c_custkey % 700) as project, c_custkey % 700 as n from customer), l as (select project, key, arg_max(value, seq) as value from j where value is not null group by 1, 2),
  said as (select project, 'props_threshold' as key, (n % 9)::varchar as value from c where n % 3 > 0 union all select project, 'future', '{{"a":' || n || '}}' from c where n % 3 > 0),
  k as (select project, k as key, v as value, 0 as rank from c, (values {_DEFAULTS}) d(k, v) union all select *, 1 from said union all select project, key, value, 2 from l semi join c using (project))
  select project, key, arg_max(value, rank) as value from k group by 1, 2""")
def config_settings(spark: SparkSession, d: str) -> DataFrame:
    """Configurations with a field that no setting knows, some missing, and the edits of all orders."""
    n = F.col("c_custkey") % 700
    said = F.concat(F.lit('{"props_threshold": '), n % 9, F.lit(', "future": {"a":'), n, F.lit("}}"))
    configs = rel.table(spark, d, "customer").select(F.concat(F.lit("p"), n).alias("project"), F.when(n % 3 > 0, said).alias("config")).distinct()
    return config.settings(configs, _edits(spark, d))


_CLUSTER_SQL = """log as (select 'log' || (o_custkey % 40) as log, o_orderkey as seq, ['create', 'add', 'add', 'remove', 'add', 'delete', 'remove'][(o_orderkey % 1009 % 7 + 1)::int] as op, 'k' || (o_orderkey % 997 % 9) as key, 'name' || o_orderkey as name,
    ['m' || (o_orderkey % 5), 'm' || (o_orderkey % 8)] as members from orders)"""


def _cluster_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    ops = rel.pick(["create", "add", "add", "remove", "add", "delete", "remove"], k % 1009 % 7)
    members = F.array(F.concat(F.lit("m"), k % 5), F.concat(F.lit("m"), k % 8))
    return rel.table(spark, d, "orders").select(F.concat(F.lit("log"), F.col("o_custkey") % 40).alias("log"), k.alias("seq"), ops.alias("op"), F.concat(F.lit("k"), k % 997 % 9).alias("key"), F.concat(F.lit("name"), k).alias("name"), members.alias("members"))


# replayed as states: each edit belongs to the life that the last create or delete before it began
@query("", f"""with {_CLUSTER_SQL}, lives as (select *, count(*) filter (op in ('create', 'delete')) over (partition by log, key order by seq) as life from log), last_life as (select log, key, max(life) as life from lives group by 1, 2),
  alive as (select log, key, life, name from lives join last_life using (log, key, life) where op = 'create'),
  m as (select log, key, member, arg_max(op, seq) as op from (select log, key, life, seq, op, unnest(members) as member from lives) join alive using (log, key, life) group by 1, 2, 3)
  select log, key, name, member from alive left join (select * from m where op <> 'remove') using (log, key)""")
def cluster_edits(spark: SparkSession, d: str) -> DataFrame:
    return edits.clusters(_cluster_log(spark, d))


@query("", f"""with {_CLUSTER_SQL}, r as (select *, last_value(case when op in ('create', 'delete') then op end ignore nulls) over (partition by log, key order by seq rows between unbounded preceding and 1 preceding) as was from log)
  select log, seq, op, key from r where op <> 'create' and was is distinct from 'create'""")
def cluster_edits_refused(spark: SparkSession, d: str) -> DataFrame:
    return edits.refused_cluster_edits(_cluster_log(spark, d))


_ASSESS_SQL = "log as (select 'state' || (doc_id % 30) as log, doc_id as seq, case when (doc_id // 30) % 4 = 3 then 'remove' else 'put' end as op, source as dimension, lang || doc_id as value from documents)"


def _assessment_log(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return rel.table(spark, d, "documents").select(F.concat(F.lit("state"), i % 30).alias("log"), i.alias("seq"), F.when(F.floor(i / 30) % 4 == 3, "remove").otherwise("put").alias("op"), F.col("source").alias("dimension"), F.concat("lang", i).alias("value"))


@query("", f"with {_ASSESS_SQL} select log, dimension, arg_max(value, seq) as value from log group by 1, 2 having arg_max(op, seq) = 'put'")
def assessment_edits(spark: SparkSession, d: str) -> DataFrame:
    return edits.assessments(_assessment_log(spark, d))


@query("", f"with {_ASSESS_SQL}, r as (select *, lag(op) over (partition by log, dimension order by seq) as was from log) select log, seq, dimension, coalesce(was = 'put', false) as found from r where op = 'remove'")
def assessment_removals(spark: SparkSession, d: str) -> DataFrame:
    return edits.removals(_assessment_log(spark, d))
