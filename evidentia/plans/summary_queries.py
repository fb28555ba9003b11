"""Queries on aggregates, reviews, history and queues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import progress, review, summaries
from evidentia.operators.ordering import numbered
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(names: str, sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_relations(names, sql)
        return f

    return add


_OPEN = "o as (select * from prev where status = 'open' and not suppressed)"


@query("prev", f", {_OPEN} select file, list_sort(list(distinct detector)) as detectors, max(loc) as most_loc, count(*) as sources from o group by file having count(distinct detector) >= 2 or max(loc) >= 300")
def concerns(spark: SparkSession, d: str) -> DataFrame:
    return summaries.concerns(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN}, p as (select file, array_to_string(list_sort(list(distinct detector)), ',') as profile, count(distinct detector) as k from o group by 1) select profile, count(*) as files, min(file) as first from p where k >= 2 group by 1 having count(*) >= 3")
def concern_profiles(spark: SparkSession, d: str) -> DataFrame:
    return summaries.shared_profiles(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN} select smell_id as smell, count(distinct file) as files, count(*) as n from o where detector = 'smells' group by 1 having count(distinct file) >= 5")
def systemic_smells(spark: SparkSession, d: str) -> DataFrame:
    return summaries.systemic_smells(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN} select cluster, count(*) as n, min(id) as first, max(id) as last from (select id, unnest(['detector::' || detector || '::' || key, 'file::' || split_part(file, '/', 2), 'auto::' || detector]) as cluster from o) group by 1 having count(*) >= 2")
def auto_clusters(spark: SparkSession, d: str) -> DataFrame:
    return summaries.auto_clusters(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN} select file, count(*) as n, count(distinct detector) as detectors, count(*) * (10 + 3 * count(distinct detector)) as priority from o where file not like '%/3%' group by 1")
def file_priority(spark: SparkSession, d: str) -> DataFrame:
    return summaries.file_priority(rel.findings_prev(spark, d), ["/3"])


@query("prev", f", {_OPEN} select file, count(*) as n from o group by 1 having count(*) >= 2 order by n desc, file limit 10")
def density(spark: SparkSession, d: str) -> DataFrame:
    return summaries.density(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN} select detector, count(*) as n from o group by 1 order by n desc, detector limit 3")
def top_detectors(spark: SparkSession, d: str) -> DataFrame:
    return summaries.top_detectors(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN} select detector, tier, count(*) as n from o group by grouping sets ((detector), (tier), ())")
def analysis_summary(spark: SparkSession, d: str) -> DataFrame:
    return summaries.analysis(rel.findings_prev(spark, d))


@query("prev", "select count(*) filter (status = 'open') as open, count(*) filter (status = 'wontfix') as wontfix, count(*) filter (status = 'open' and reopen_count >= 2) as chronic from prev where not suppressed")
def debt(spark: SparkSession, d: str) -> DataFrame:
    return summaries.debt(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN} select 'security_open' as flag, 'high' as level, count(*) as n from o where detector = 'security' having count(*) > 0 union all select 'reopened', 'medium', count(*) from o where reopen_count >= 3 having count(*) > 0")
def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    return summaries.risks(rel.findings_prev(spark, d))


_ACTION = f"""{_OPEN}, act as (select *, case detector {' '.join(f"when '{k}' then '{v}'" for k, v in summaries.ACTIONS.items())} end as action,
  case confidence when 'high' then 10 when 'medium' then 7 else 3 end * case tier when 1 then 10 when 2 then 15 when 3 then 20 else 30 end + 50 * reopen_count as impact from o)"""


@query("prev", f", {_ACTION} select id, action, impact from act order by list_position(['auto_fix', 'manual_fix', 'refactor', 'reorganize'], action), impact desc, id limit 20")
def actions_top(spark: SparkSession, d: str) -> DataFrame:
    return summaries.actions(rel.findings_prev(spark, d))


@query("prev", f", {_ACTION}, f as (select action, file, count(*) as n from act group by 1, 2), s as (select file, count(*) > 1 as shared from f group by 1) select action, sum(n)::bigint as findings, count(*) as files, count(*) filter (shared) as shared_files, count(*) filter (shared) = 0 as parallel from f join s using (file) group by 1")
def strategy_lanes(spark: SparkSession, d: str) -> DataFrame:
    return summaries.lanes(rel.findings_prev(spark, d))


@query("prev", "select path, count(*) as findings, min(tier) as worst_tier from (select tier, unnest([split_part(file, '/', 1), file]) as path from prev) group by 1")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return summaries.tree(rel.findings_prev(spark, d))


@query("prev", f", {_OPEN} select count(*) filter (file = 'cust/5.py') as inside, count(*) filter (file <> 'cust/5.py') as outside from o")
def scope_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return summaries.scope_breakdown(rel.findings_prev(spark, d), "cust/5.py")


@query("prev", "select id, reopen_count from prev where status = 'open' and reopen_count >= 2")
def chronic_findings(spark: SparkSession, d: str) -> DataFrame:
    return summaries.chronic(rel.findings_prev(spark, d))


def _named_paths(spark: SparkSession, d: str) -> DataFrame:
    p = rel.table(spark, d, "part")
    style = F.when(F.col("p_partkey") % 50 == 0, "my-part").when(F.col("p_partkey") % 67 == 0, "MyPart").otherwise("my_part")
    return p.select(F.concat(F.lit("dir"), F.floor(F.col("p_partkey") / 150), F.lit("/"), style, F.when(style == "my_part", "_x").otherwise(""), F.col("p_partkey") % 5, F.lit(".py")).alias("path"))


@query("", """named as (select 'dir' || (p_partkey // 150) as dir, case when p_partkey % 50 = 0 then 'kebab' when p_partkey % 67 = 0 then 'pascal' else 'snake' end as convention from part),
  b as (select dir, convention, count(*) as n from named group by 1, 2), t as (select dir, sum(n)::bigint as total from b group by 1)
  select dir, convention, n, total from b join t using (dir) where total >= 5 and n >= 2 and n < 5 and n * 100 < total * 15""")
def naming_minority(spark: SparkSession, d: str) -> DataFrame:
    return summaries.naming_minority(_named_paths(spark, d))


ORACLES["naming_minority"] = ORACLES["naming_minority"].replace("with \n", "with ")


@query("files", "select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as files from files group by 1 having count(*) > 12")
def flat_directories(spark: SparkSession, d: str) -> DataFrame:
    return summaries.flat_directories(rel.files(spark, d))


@query("assessments review_findings", """, f as (select * from review_findings qualify row_number() over (partition by identifier order by batch, turn) = 1),
  p as (select dimension, sum(case confidence when 'high' then 10 when 'medium' then 7 else 4 end * case impact_scope when 'codebase' then 10 when 'module' then 5 else 3 end)::bigint as pressure from f group by 1),
  a as (select dimension, count(*) as n, sum(score) as total, min(score) as least from assessments group by 1)
  select dimension, n, least, coalesce(pressure, 0) as pressure, greatest(60.0::double, least(90.0::double, 0.7::double * (total / n) + 0.3::double * least - least(2.2::double * (coalesce(pressure, 0) / 100::double), 24.0::double))) as score from a left join p using (dimension)""")
def review_merge(spark: SparkSession, d: str) -> DataFrame:
    return review.merged_scores(rel.assessments(spark, d), review.first_by_identifier(rel.review_findings(spark, d)))


@query("review_findings", "select identifier, batch, dimension, confidence, impact_scope, fix_scope, turn from review_findings qualify row_number() over (partition by identifier order by batch, turn) = 1")
def review_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return review.first_by_identifier(rel.review_findings(spark, d))


@query("review_findings", """select identifier, turn, case confidence when 'high' then 120 when 'medium' then 100 else 75 end * case impact_scope when 'codebase' then 20 when 'module' then 13 else 10 end
  * case fix_scope when 'architectural_change' then 17 when 'multi_file_refactor' then 13 else 10 end as severity from review_findings""")
def review_severity(spark: SparkSession, d: str) -> DataFrame:
    return review.severity(rel.review_findings(spark, d)).select("identifier", "turn", "severity")


_BATCH = "s as (select dimension, floor(avg(score) + 0.5) as score from assessments group by 1)"


def _per_dimension(spark: SparkSession, d: str) -> DataFrame:
    return rel.assessments(spark, d).groupBy("dimension").agg(F.floor(F.avg("score") + 0.5).cast("double").alias("score"))


@query("assessments", f", {_BATCH} select dimension, score, score = 78 and (select count(*) from s where score = 78) >= 2 as violates, case when score = 78 and (select count(*) from s where score = 78) >= 2 then 0.0 else score end as kept_score from s")
def review_integrity(spark: SparkSession, d: str) -> DataFrame:
    return review.near_target(_per_dimension(spark, d), 78.0)


@query("assessments", """ select dimension, floor(10 * (sum(score) / count(score)) + 0.5) / 10 as score, (array_agg('note ' || doc_id order by batch desc, 'note ' || doc_id desc))[1] as note from assessments group by dimension""")
def review_means(spark: SparkSession, d: str) -> DataFrame:
    return review.mean_scores(rel.assessments(spark, d).withColumn("note", F.concat(F.lit("note "), "doc_id")))


@query("assessments review_findings", f", {_BATCH} select dimension, score from s where score < 85 and dimension not in (select dimension from review_findings where confidence = 'low' and turn > 4 and identifier < 'c3')")
def review_feedback(spark: SparkSession, d: str) -> DataFrame:
    return review.missing_feedback(_per_dimension(spark, d), rel.review_findings(spark, d).where("confidence = 'low' and turn > 4 and identifier < 'c3'"))


@query("review_findings", """, f as (select * from review_findings qualify row_number() over (partition by identifier order by batch, turn) = 1),
  s as (select 'review::c' || o_orderkey as id, case when o_orderkey % 3 = 0 then 'wontfix' else 'open' end as status, 'old' as summary from orders)
  select coalesce(s.id, 'review::' || identifier) as id, coalesce(status, 'open') as status, case when s.id is null or (status = 'open' and identifier is not null) then dimension || ' ' || impact_scope else summary end as summary,
  case when s.id is null then 'inserted' when identifier is not null then 'seen' else 'absent' end as action from s full join f on s.id = 'review::' || identifier""")
def review_import(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = rel.table(spark, d, "orders").select(F.concat(F.lit("review::c"), k).alias("id"), F.when(k % 3 == 0, "wontfix").otherwise("open").alias("status"), F.lit("old").alias("summary"))
    return review.imported(state, review.first_by_identifier(rel.review_findings(spark, d)))


@query("files", """select path, case when doc_id % 3 = 0 then 'unreviewed' when doc_id % 5 = 0 then 'changed' when 100 - doc_id % 90 > 60 then 'stale' else 'fresh' end as state from (select *, split_part(split_part(path, '_', 2), '.', 1)::bigint as doc_id from files)""")
def review_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = rel.table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit(".txt"))
    own = docs.select(path.alias("path"), F.sha2("text", 256).alias("hash"))
    seen = docs.where("doc_id % 3 <> 0").select(path.alias("path"), F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.sha2("text", 256)).alias("hash"), (F.col("doc_id") % 90).alias("day"))
    return review.coverage(own, seen, 100, 60)


_T = "h as (select seq, strict, round(strict * 10)::int as t0, round(lag(strict) over (order by seq) * 10)::int as t1, round(lag(strict, 2) over (order by seq) * 10)::int as t2, lag(strict) over (order by seq) as b from history)"


@query("history", f", {_T} select seq, strict, case when seq <= 1 then 'first_scan' when t1 - t0 > 5 then 'regression' when t0 = t1 and t0 = t2 then 'stagnation' when t0 > 930 then 'maintenance' when t0 > 800 and abs(t0 - t2) < 10 then 'middle_grind' when t0 > 800 then 'refinement' else 'early_momentum' end as phase from h")
def phases(spark: SparkSession, d: str) -> DataFrame:
    return progress.phases(rel.history(spark, d))


@query("history", f", {_T} select seq, level from (select seq, strict, b, unnest([80, 90, 95, 100]) as level from h) where strict >= level and b < level")
def milestones(spark: SparkSession, d: str) -> DataFrame:
    return progress.milestones(rel.history(spark, d))


@query("history", "select seq, t as target, round((t - strict) * 10)::int as missing_tenths from (select *, case when strict < 80 then 80 when strict < 90 then 90 when strict < 95 then 95 else 100 end as t from history)")
def strict_target(spark: SparkSession, d: str) -> DataFrame:
    return progress.next_target(rel.history(spark, d))


@query("files", "select path, (row_number() over (order by path) - 1) // 50 as batch from files")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return progress.batches(rel.files(spark, d), 50)


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = rel.findings_prev(spark, d)
    planned = f.where("key % 101 = 0").select("id", F.col("key").alias("pos"))
    return f, planned, f.where("key % 37 = 0").select("id")


@query("prev", f""", {_OPEN} select id, kind, tier from (select *, case when key % 37 = 0 then 2 when key % 101 = 0 then 0 else 1 end as kind, case when key % 101 = 0 then key end as pos from o)
  order by kind, pos nulls last, tier, detector = 'review', case confidence when 'high' then 0 when 'medium' then 1 else 2 end, reopen_count desc, id limit 60""")
def queue_top(spark: SparkSession, d: str) -> DataFrame:
    return progress.queue(*_plan(spark, d), n=60)


@query("prev cur", "select id, key as pos from prev where key % 101 = 0 and id not in (select id from cur)")
def plan_superseded(spark: SparkSession, d: str) -> DataFrame:
    return progress.superseded(_plan(spark, d)[1], rel.findings_cur(spark, d))


@query("prev cur", "select 'auto::' || detector as cluster, count(*) as n from prev where id in (select id from cur) group by 1 union all select 'file::' || split_part(file, '/', 2), count(*) from prev where id in (select id from cur) group by 1 union all select 'detector::' || id[:length(detector) + 2] || key, count(*) from prev where id in (select id from cur) group by 1")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return progress.live_members(summaries.cluster_keys(rel.findings_prev(spark, d)), rel.findings_cur(spark, d))


@query("", "select o_orderkey as id from orders where o_orderkey % 2 = 0 and (o_orderdate::date)::varchar < '1996-01-01'")
def skips_resurfaced(spark: SparkSession, d: str) -> DataFrame:
    o = rel.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "temporary").otherwise("permanent").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("review_after"))
    return progress.resurfaced(o, "1996-01-01").select("id")


@query("", "select o_orderkey as id from orders where o_orderkey % 7 = 0 or date '1998-01-01' - o_orderdate::date < 90")
def superseded_ttl(spark: SparkSession, d: str) -> DataFrame:
    o = rel.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "not a day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("at"))
    return progress.kept_superseded(o, "1998-01-01").select("id")


@query("", """n as (select o_orderkey as id, row_number() over (order by o_orderdate, o_orderkey) - 1 as p from orders), c as (select max(p) as cur from n where id = 1)
  select id::varchar as id, row_number() over (order by case when p = cur then 999.5 when p > cur then p - 1 else p end) - 1 as pos from n, c""")
def queue_move(spark: SparkSession, d: str) -> DataFrame:
    o = numbered(rel.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey", name="pos")
    return progress.moved(o.select("id", "pos"), "1", 1000)


ORACLES["queue_move"] = ORACLES["queue_move"].replace("with \n", "with ")
for _n in ("skips_resurfaced", "superseded_ttl"):
    ORACLES[_n] = ORACLES[_n].removeprefix("with \n")


@query("assessments", "select dimension, lower(dimension) as name, floor(score / 5 + 0.5)::int as filled, least(greatest(score * 1.5 - 20, 0), 100) as clamped from assessments")
def score_texts(spark: SparkSession, d: str) -> DataFrame:
    a = rel.assessments(spark, d)
    bar = text.score_bar(F.col("score"))
    filled = F.length(F.replace(bar, F.lit("."), F.lit(""))).cast("int")
    return a.select("dimension", text.dimension_name(F.concat(F.lit(" "), F.upper("dimension"), F.lit("_"))).alias("name"), filled.alias("filled"), text.clamp(F.col("score") * 1.5 - 20).alias("clamped"))
