"""Queries on review contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import context
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_relations("prev", sql)
        return f

    return add


def _findings(spark: SparkSession, d: str) -> DataFrame:
    f, k = rel.findings_prev(spark, d), F.col("key")
    detector = F.when(F.col("detector") == "naming", "global_mutable_config").otherwise(F.col("detector"))
    summary = F.concat(F.when(k % 3 == 0, "Error ").otherwise("finding "), F.repeat(F.lit("x"), (k % 4000).cast("int")))
    detail = F.to_json(F.struct(F.when(k % 4 > 0, k % 1000).alias("complexity"), F.when(k % 5 > 0, k % 300).alias("importer_count"), F.when(k % 6 > 0, F.concat(F.lit("fn"), k % 500)).alias("function_name")))
    return f.select(F.concat(F.lit("p"), F.regexp_extract("file", r"(\d+)", 1).cast("int") % 30).alias("project"), "id", detector.alias("detector"), "file", summary.alias("summary"), detail.alias("detail"), "status", "suppressed")


_SECTIONS = """, f as (select 'p' || (regexp_extract(file, '(\\d+)', 1)::int % 30) as project, id, case when detector = 'naming' then 'global_mutable_config' else detector end as detector, file, key as k,
    case when key % 3 = 0 then 'Error ' else 'finding ' end || repeat('x', (key % 4000)::int) as summary from prev where status = 'open' and not suppressed),
  fan as (select project, file, arg_max(k % 300, id) as n from f where detector = 'coupling' and k % 5 > 0 group by 1, 2),
  dup as (select project, 'fn' || (k % 500) as name, list(file order by id)[:50] as files from f where detector = 'dupes' and k % 6 > 0 group by 1, 2 having count(*) >= 2),
  e as (select project, 'complexity_hotspots' as section, -(k % 1000) as rank, id as t, '{"file":"' || file || '","score":' || (k % 1000) || '.0,"detail":"' || summary || '"}' as item from f where detector in ('structural', 'smells') and k % 4 > 0
    union all select project, 'exception_hotspots', 0, id, '{"file":"' || file || '","score":1.0,"detail":"' || summary || '"}' from f where detector = 'smells' and k % 3 = 0
    union all select project, 'signal_density', 0, file, '{"file":"' || file || '","detector_count":' || count(distinct detector) || ',"detectors":["' || array_to_string(list_sort(list(distinct detector)), '","') || '"]}' from f group by project, file having count(*) >= 2
    union all select project, 'mutable_globals', 0, id, '{"file":"' || file || '","name":"' || id || '","detail":"' || summary || '"}' from f where detector = 'global_mutable_config'
    union all select project, 'high_fan_in', -n, file, '{"file":"' || file || '","count":' || n || '}' from fan
    union all select project, 'duplicate_clusters', 0, name, '{"function_name":"' || name || '","files":["' || array_to_string(files, '","') || '"]}' from dup),
  s as (select * from (values ('complexity_hotspots', 10, 5, 1), ('exception_hotspots', 10, 10, 2), ('signal_density', 15, 8, 3), ('mutable_globals', 10, 10, 4), ('high_fan_in', 10, 5, 5), ('duplicate_clusters', 10, 5, 6)) v(section, m1, m2, nth)),
  r as (select project, section, (row_number() over (partition by project, section order by rank, t) - 1)::int as place, item, m1, m2, nth from e join s using (section) qualify place < m1)"""


@query(f"{_SECTIONS} select project, section, place, item from r")
def context_sections(spark: SparkSession, d: str) -> DataFrame:
    """What the sections of each project's review context hold before the budget."""
    return context.entries(_findings(spark, d))


@query(f"""{_SECTIONS}, p as (select distinct project from r), a as (select project, nth, section, coalesce(string_agg(item, ',' order by place), '') as whole, coalesce(string_agg(item, ',' order by place) filter (place < m2), '') as less from (select * from p, s) left join r using (project, section, m1, m2, nth) group by all),
  d as (select project, '{{' || string_agg('"' || section || '":[' || whole || ']', ',' order by nth) || '}}' as whole, '{{' || string_agg('"' || section || '":[' || less || ']', ',' order by nth) || '}}' as less from a group by 1)
  select project, length(whole) > 50000 as trimmed, case when length(whole) > 50000 then less else whole end as context from d""")
def context_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Each project's review context within 50,000 characters."""
    return context.bundles(context.entries(_findings(spark, d)))
