"""Queries on imports, projects, classes, clusters and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import resolve, summaries
from evidentia.plans.code_queries import _PATHS, _paths
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


def _imports(spark: SparkSession, d: str) -> DataFrame:
    """Edges as dotted imports; every third names an attribute too."""
    at = lambda s: _paths(spark, d).select(F.col("node").alias(s), F.col("path").alias(f"{s}_path"))
    e = rel.edges(spark, d).join(at("src"), "src").join(at("dst"), "dst")
    dotted = F.replace(F.regexp_replace("dst_path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    return e.select(F.col("src_path").alias("importer"), F.concat(dotted, F.when(F.col("src") % 3 == 0, ".attr").otherwise("")).alias("module")).distinct()


_IMPORTS = f"""{_PATHS}, imports as (select distinct a.path as importer, replace(regexp_replace(b.path, '(/__init__)?\\.py$', ''), '/', '.') || case when src % 3 = 0 then '.attr' else '' end as module
  from edges join paths a on a.node = src join paths b on b.node = dst), known as (select distinct path from paths where node % 5 <> 0)"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where("node % 5 <> 0")


@query("edges", f""", {_IMPORTS}, p as (select importer, module, string_split(module, '.') as s from imports), t as (select importer, module, unnest(range(1, len(s) + 1)) as k, s from p),
  c as (select importer, module, -k * 2 as place, array_to_string(s[:k], '/') || '.py' as target from t union all select importer, module, -k * 2 + 1, array_to_string(s[:k], '/') || '/__init__.py' from t)
  select importer, module, arg_min(target, place) as target from c join known on path = target group by 1, 2""")
def import_absolute(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_absolute(_imports(spark, d), _known(spark, d))


@query("edges", f""", {_PATHS}, known as (select distinct path from paths where node % 5 <> 0), i as (select distinct a.path as importer, case when dst % 9 = 0 then '.' when a.path like 'tools/%' and dst % 2 = 0 then '..b.mod_' || dst else '.mod_' || dst end as module, dst from edges join paths a on a.node = src),
  c as (select importer, module, case when module = '.' then regexp_replace(importer, '/[^/]*$', '') || '/__init__.py' when module like '..b%' then 'tools/b/mod_' || dst || '.py' else regexp_replace(importer, '/[^/]*$', '') || '/mod_' || dst || '.py' end as target from i)
  select distinct importer, module, target from c join known on path = target""")
def import_relative(spark: SparkSession, d: str) -> DataFrame:
    e = rel.edges(spark, d).join(_paths(spark, d).select(F.col("node").alias("src"), F.col("path").alias("importer")), "src")
    module = F.when(F.col("dst") % 9 == 0, ".").when(F.col("importer").startswith("tools/") & (F.col("dst") % 2 == 0), F.concat(F.lit("..b.mod_"), "dst")).otherwise(F.concat(F.lit(".mod_"), "dst"))
    return resolve.resolve_relative(e.select("importer", module.alias("module")).distinct(), _known(spark, d))


@query("", """with f as (select 'web/' || case when p_partkey % 4 = 0 then 'lib/' else '' end || 'm' || p_partkey || case p_partkey % 3 when 0 then '.ts' when 1 then '.tsx' else '/index.ts' end as path, p_partkey from part),
  i as (select 'web/lib/m' || ((p_partkey // 4) * 4) || '.x' as importer, case when p_partkey % 4 = 0 then './m' else '../m' end || p_partkey as module, path as target from f where p_partkey % 11 <> 0) select distinct * from i""")
def import_script(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = rel.table(spark, d, "part")
    files = p.select(F.concat(F.lit("web/"), F.when(k % 4 == 0, "lib/").otherwise(""), F.lit("m"), k, F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.ts")).alias("path"))
    spec = F.when(k % 11 == 0, F.lit("react")).otherwise(F.concat(F.when(k % 4 == 0, "./m").otherwise("../m"), k))
    imports = p.select(F.concat(F.lit("web/lib/m"), F.floor(k / 4) * 4, F.lit(".x")).alias("importer"), spec.alias("module")).distinct()
    return resolve.resolve_script(imports, files)


# the project's languages by name, in the declared order
@query("", """with f as (select 'p' || o_custkey as project, ['Cargo.toml', 'setup.py', 'go.mod', 'composer.json', 'src/setup.py', 'app.csproj', 'pubspec.yaml', 'package.json', 'lib/go.mod', 'tsconfig.json', 'README.md'][(o_orderkey % 1009 % 11 + 1)::int] as path from orders),
  l as (select project, case path when 'Cargo.toml' then 'rust' when 'setup.py' then 'python' when 'go.mod' then 'go' when 'composer.json' then 'php' when 'app.csproj' then 'csharp' when 'pubspec.yaml' then 'dart' when 'package.json' then 'typescript' when 'tsconfig.json' then 'typescript' end as language from f)
  select project, arg_min(language, list_position(['python', 'typescript', 'javascript', 'go', 'csharp', 'dart', 'rust', 'java', 'kotlin', 'ruby', 'php'], language)) as language from l where language is not null group by 1""")
def language_sniff(spark: SparkSession, d: str) -> DataFrame:
    """Projects of some files each, with markers of several languages."""
    names = ["Cargo.toml", "setup.py", "go.mod", "composer.json", "src/setup.py", "app.csproj", "pubspec.yaml", "package.json", "lib/go.mod", "tsconfig.json", "README.md"]
    files = rel.table(spark, d, "orders").select(F.concat(F.lit("p"), "o_custkey").alias("project"), rel.pick(names, F.col("o_orderkey") % 1009 % 11).alias("path"))
    return resolve.detected(spark, files)


@query("code_lines", """select ext, case ext when 'py' then 'python' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'go' then 'go' when 'cs' then 'csharp' when 'dart' then 'dart' else 'gdscript' end as language, count(*) as files
  from (select distinct path, regexp_extract(path, '\\.([a-z]+)$', 1) as ext from code_lines) group by 1""")
def extension_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.extension_counts(spark, rel.code_lines(spark, d).select("path").distinct())


def _classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return rel.table(spark, d, "part").select(
        F.concat(F.lit("m"), k % 100, F.lit(".py")).alias("path"), F.concat(F.lit("C"), k).alias("name"), (k % 27).alias("methods"), (k % 613).alias("loc"), (k % 9).alias("prefixes"), (k % 13).alias("attributes")
    )


_CLASSES = "c as (select 'm' || (p_partkey % 100) || '.py' as path, 'C' || p_partkey as name, p_partkey % 27 as methods, p_partkey % 613 as loc, p_partkey % 9 as prefixes, p_partkey % 13 as attributes from part)"


@query("", f"with {_CLASSES}, r as (select path, name, list_filter([case when methods >= 20 then 'too_many_methods' end, case when loc >= 500 then 'too_many_lines' end, case when methods > 15 and prefixes > 5 then 'low_cohesion' end], lambda x: x is not null) as r from c) select path, name, array_to_string(r, ',') as rules from r where len(r) >= 2")
def god_classes(spark: SparkSession, d: str) -> DataFrame:
    return resolve.god_classes(_classes(spark, d))


@query("", f"with {_CLASSES} select path, name, 'low_cohesion' as kind from c where methods >= 10 and attributes >= 8 union all select path, name, 'too_many_methods' from c where methods >= 15")
def responsibilities(spark: SparkSession, d: str) -> DataFrame:
    return resolve.responsibilities(_classes(spark, d))


@query("code_lines", "select path, count(*) as reexports from code_lines where text like 'from .sibling%' group by 1 having count(*) >= 5")
def facades(spark: SparkSession, d: str) -> DataFrame:
    return resolve.facades(rel.code_lines(spark, d))


@query("prev", """, o as (select * from prev where status = 'open' and not suppressed), r as (select id, key as rank from o), m as (select id, unnest(['file::' || split_part(file, '/', 2), 'auto::' || detector || (key % 40)]) as cluster from o where key % 4 <> 0),
  s as (select cluster, count(*) as n from m group by 1 having count(*) >= 2), f as (select id, min(cluster) as cluster from m join s using (cluster) group by 1), j as (select r.id, rank, f.cluster, s.n from r left join f on f.id = r.id left join s on s.cluster = f.cluster)
  select id, rank, cluster, n from j where cluster is null union all select arg_min(id, rank), min(rank), cluster, n from j where cluster is not null group by cluster, n""")
def cluster_collapse(spark: SparkSession, d: str) -> DataFrame:
    o = rel.findings_prev(spark, d).where("status = 'open' and not suppressed")
    names = F.array(F.concat(F.lit("file::"), F.substring_index("file", "/", -1)), F.concat(F.lit("auto::"), "detector", F.col("key") % 40))
    return resolve.collapsed(o.select("id", F.col("key").alias("rank")), o.where("key % 4 <> 0").select("id", F.explode(names).alias("cluster")))


@query("", "select event_type || (event_id % 50) as reminder, event_id as seq, least(row_number() over w, 3)::int as count, row_number() over w > 3 as suppressed from events window w as (partition by event_type || (event_id % 50) order by event_id)")
def reminder_decay(spark: SparkSession, d: str) -> DataFrame:
    return resolve.decayed(rel.table(spark, d, "events").select(F.concat("event_type", F.col("event_id") % 50).alias("reminder"), F.col("event_id").alias("seq")))


_DECISIONS = "x as (select p_partkey as id, (1 + p_partkey % 5) * (1 + p_partkey % 4) * (1 + p_partkey % 3) * (1 + p_partkey % 2) / case when p_size % 12 <= 2 then 1 when p_size % 12 <= 6 then 3 else 10 end as priority from part)"


@query("", f"with {_DECISIONS} select id, priority::double as priority from x where priority >= 8 order by priority desc, id limit 2")
def decisions_top(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return resolve.top_decisions(rel.table(spark, d, "part").select(k.alias("id"), (1 + k % 5).alias("impact"), (1 + k % 4).alias("irreversibility"), (1 + k % 3).alias("divergence"), (1 + k % 2).alias("uncertainty"), (F.col("p_size") % 12).alias("effort")))


@query("", None)
def similar_functions(spark: SparkSession, d: str) -> DataFrame:
    docs = rel.table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.lpad("doc_id", 8, "0")).alias("name"), F.concat("source", F.lit("/"), "doc_id").alias("file"), F.col("text").alias("body"))
    return resolve.similar_bodies(docs, least_lines=3)


@query("prev cur", """select warning from (select count(*) filter (c.id is not null and p.status in ('fixed', 'auto_resolved')) as r, count(*) filter (p.id is null) as n from prev p full join cur c using (id)), (values ('many_reopened'), ('many_new')) w(warning) where case warning when 'many_reopened' then r > 5 else n > 10 end""")
def scan_warnings(spark: SparkSession, d: str) -> DataFrame:
    p, c = rel.findings_prev(spark, d).select("id", "status"), rel.findings_cur(spark, d).select("id", F.lit(True).alias("found"))
    both = p.join(c, "id", "full_outer").agg(F.count(F.when(F.col("found") & F.col("status").isin("fixed", "auto_resolved"), 1)).alias("reopened"), F.count(F.when(F.col("status").isNull(), 1)).alias("new"))
    return summaries.scan_warnings(both.withColumn("chronic", F.lit(0)))
