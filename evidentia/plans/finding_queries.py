"""Queries on findings, merges and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import patterns, text
from evidentia.operators import findings as ops
from evidentia.operators import scores
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(names: str, sql: str):
    """Registers a query with its SQL: relations by name, then the statement."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_relations(names, sql)
        return f

    return add


@query("prev", """select id, detector || '::' || file as short_id, key::varchar as entity, split_part(file, '/', 2) as base, regexp_replace(split_part(file, '/', 2), '^(.+)\\.[^.]*$', '\\1') as stem,
  'py' as ext, 'cust' as parent, case confidence when 'high' then 10 when 'medium' then 7 else 3 end as weight, case tier when 1 then 10 when 2 then 15 when 3 then 20 else 30 end as tier_weight,
  case confidence when 'high' then 10 when 'medium' then 7 else 3 end * case tier when 1 then 10 when 2 then 15 when 3 then 20 else 30 end + 50 * reopen_count as impact,
  status as canonical, case when status = 'fixed' then 'fixed' else 'open' end as parsed, greatest(10, tier) as most from prev""")
def scalar_findings(spark: SparkSession, d: str) -> DataFrame:
    f = rel.findings_prev(spark, d)
    c = F.col
    return f.select(
        text.finding_id(c("detector"), c("file"), c("key")).alias("id"), text.finding_id(c("detector"), c("file")).alias("short_id"), text.entity(c("id")).alias("entity"),
        text.basename(c("file")).alias("base"), text.stem(c("file")).alias("stem"), text.extension(c("file")).alias("ext"), text.parent(c("file")).alias("parent"),
        text.confidence_weight(c("confidence")).alias("weight"), text.tier_weight(c("tier")).alias("tier_weight"), text.action_impact(c("confidence"), c("tier"), c("reopen_count")).alias("impact"),
        text.status_canonical(F.when(c("status") == "fixed", "resolved").otherwise(c("status"))).alias("canonical"),
        text.status_parse(F.when(c("status") == "fixed", " Resolved ").otherwise("odd")).alias("parsed"), text.max_findings(c("tier")).alias("most"),
    )


@query("", """select o_orderkey, (o_orderdate::date)::varchar as day,
    (1998 * 365 + 8 * 30 + 2) - (year(o_orderdate) * 365 + month(o_orderdate) * 30 + day(o_orderdate)) > 90 as stale,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') as at from orders""".replace("select", "select", 1))
def scalar_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return rel.table(spark, d, "orders").select("o_orderkey", day.alias("day"), text.is_stale(day, F.lit("1998-08-02"), 90).alias("stale"), text.timestamp_text(F.col("o_orderdate")).alias("at"))


ORACLES["scalar_dates"] = ORACLES["scalar_dates"].removeprefix("with \n")

_RULES = [("vendor", ["/src1/"]), ("generated", ["/src2/"]), ("test", ["/src3/", "doc_7_"]), ("script", ["/src4/", "_9.txt"]), ("config", ["doc_5.txt"]), *patterns.COMMON_ZONES]
_ZONE_SQL = """zoned as (select path, case when path like 'src1/%' then 'vendor' when path like 'src2/%' then 'generated' when path like 'src3/%' then 'test' when path like 'src4/%' or path like '%\\_9.txt' escape '\\' then 'script'
  when path like '%/doc_5.txt' then 'config' else 'production' end as zone from files)"""


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    return rel.files(spark, d).select("path", patterns.zone_of(F.col("path"), _RULES).alias("zone"))


@query("files", f", {_ZONE_SQL} select path, zone, zone not in ('test', 'config', 'generated', 'vendor') as scored from zoned")
def zone_classify(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(spark, d).withColumn("scored", patterns.is_scored(F.col("zone")))


@query("files", f", {_ZONE_SQL} select zone, count(*) as n, count(*) filter (zone = 'production') as production from zoned group by zone")
def zone_counts(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(spark, d).groupBy("zone").agg(F.count("*").alias("n"), F.count(F.when(F.col("zone") == "production", 1)).alias("production"))


@query("files", f", {_ZONE_SQL} select path from zoned where zone not in ('vendor', 'generated')")
def zone_exclude(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(spark, d).where(~F.col("zone").isin("vendor", "generated")).select("path")


@query("files", f", {_ZONE_SQL} select path, zone from zoned where zone in ('test', 'script')")
def zone_only(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(spark, d).where(F.col("zone").isin("test", "script"))


@query("files", """select path, path like 'src1/%' as in_scope, path like '%.txt' as by_end, path like 'src7%' as by_start, path like '%/en/%' and path like '%4.txt' as inside, path like '%de/doc%' as contained,
  regexp_matches(path, '^src.*/en/doc_.*\\.txt$') as glob, regexp_matches(path, '^(.*/)?doc_.\\.txt$') as tree from files""")
def path_patterns(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return rel.files(spark, d).select(
        p, patterns.in_scope(p, "src1/").alias("in_scope"), patterns.excluded(p, "*.txt").alias("by_end"), patterns.excluded(p, "src7*").alias("by_start"), patterns.excluded(p, "/en/*4.txt").alias("inside"),
        patterns.excluded(p, "*de/doc*").alias("contained"), patterns.like_glob(p, "src*/en/doc_*.txt").alias("glob"), patterns.like_tree_glob(p, "**/doc_?.txt").alias("tree"),
    )


@query("prev", """select id, case when regexp_matches(id, '^unused::.*7\\.py::.*$') then 'unused::*7.py::*' when regexp_matches(file, '^cust/1.*$') then 'cust/1*' when starts_with(id, 'cycles::cust/2') then 'cycles::cust/2'
  when file = 'cust/33.py' then 'cust/33.py' end as pattern from prev""")
def ignore_first(spark: SparkSession, d: str) -> DataFrame:
    rules = ["unused::*7.py::*", "cust/1*", "cycles::cust/2", "cust/33.py"]
    return rel.findings_prev(spark, d).select("id", patterns.first_ignore(F.col("id"), F.col("file"), rules).alias("pattern"))


@query("prev", "select id, tier, summary from prev where not suppressed and status = 'open' and detector = 'unused' and file like 'cust/1%' and tier = 2 and (summary ilike '%FINDING 1%' or file ilike '%finding 1%' or id ilike '%finding 1%')")
def show_filter(spark: SparkSession, d: str) -> DataFrame:
    return ops.show(rel.findings_prev(spark, d), detector="unused", prefix="cust/1", tier=2, needle="FINDING 1").select("id", "tier", "summary")


@query("prev", "select id, tier, reopen_count from prev where status = 'open' and tier <= 3 and not suppressed and reopen_count >= 2 and detector = 'coupling'")
def queue_scope(spark: SparkSession, d: str) -> DataFrame:
    return ops.queue_filter(rel.findings_prev(spark, d), most_tier=3, chronic=True, scope="detector:coupling").select("id", "tier", "reopen_count")


@query("prev", "select id from prev where status = 'open' and not suppressed and tier = 1 and detector = 'unused' and (summary like '%2%' or file like '%2%')")
def fix_candidates(spark: SparkSession, d: str) -> DataFrame:
    return ops.fix_candidates(rel.findings_prev(spark, d), "unused", "2").select("id")


_MODES = """failing as (select p.*, mode from prev p join (values ('lenient', 'open'), ('strict', 'open'), ('strict', 'wontfix'), ('verified_strict', 'open'), ('verified_strict', 'wontfix'),
  ('verified_strict', 'fixed'), ('verified_strict', 'false_positive')) m(mode, status) using (status) where not suppressed and coalesce(zone, 'production') not in ('test', 'config', 'generated', 'vendor'))"""


@query("prev", f", {_MODES} select mode, detector, count(*) as failing, count(distinct file) as files from failing group by all")
def mode_failures(spark: SparkSession, d: str) -> DataFrame:
    return ops.modes(ops.candidates(rel.findings_prev(spark, d))).groupBy("mode", "detector").agg(F.count("*").alias("failing"), F.count_distinct("file").alias("files"))


_W = "case confidence when 'high' then 10 when 'medium' then 7 else 3 end"
_STATS = f"""{_MODES}, per_file as (select mode, detector, file, count(*) as n, sum(case when detector = 'test_coverage' then loc_weight * 10 else {_W} end) as w,
  arg_min(case when detector = 'test_coverage' then loc_weight * 10 else {_W} end, id) as first_w from failing group by 1, 2, 3),
failed as (select mode, detector, sum(n)::bigint as issues, sum(case when detector = 'test_coverage' then least(w, first_w) when detector in ('smells', 'security', 'review')
  then least(w, case when n >= 6 then 20 when n >= 3 then 15 else 10 end) else w end)::bigint as w from per_file group by 1, 2),
stats as (select mode, detector, potential, case when potential > 0 and detector <> 'review' then coalesce(issues, 0) else 0 end as issues,
  case when potential > 0 and detector <> 'review' then coalesce(w, 0) else 0 end as weighted_tenths,
  case when potential > 0 and detector <> 'review' then greatest((potential * 10 - coalesce(w, 0)) / (potential * 10), 0.0) else 1.0 end::double as pass_rate
  from potentials cross join (values ('lenient'), ('strict'), ('verified_strict')) m(mode) left join failed using (mode, detector))"""


@query("prev potentials", f", {_STATS} select * from stats")
def detector_stats(spark: SparkSession, d: str) -> DataFrame:
    return scores.detector_stats(rel.findings_prev(spark, d), rel.potentials(spark, d))


_DIMS = f"""{_STATS}, dims as (select mode, dimension, case when dimension in ('Test health', 'Security') then 4 else 3 end as tier, sum(potential)::bigint as checks, sum(issues)::bigint as issues,
  floor(greatest((sum(potential) * 10 - sum(weighted_tenths)) / (sum(potential) * 10), 0.0) * 100 * 10 + 0.5) / 10 as score
  from (select *, case when detector = 'structural' then 'File health' when detector in ('unused', 'smells', 'coupling', 'orphaned', 'naming') then 'Code quality' when detector = 'dupes' then 'Duplication'
    when detector = 'test_coverage' then 'Test health' when detector in ('security', 'cycles') then 'Security' end as dimension from stats where potential > 0) where dimension is not null group by mode, dimension)"""


@query("prev potentials", f", {_DIMS} select * from dims")
def dimension_scores(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: filter, mode expansion, broadcast policy join, two-level capped aggregate."""
    return scores.dimension_scores(rel.findings_prev(spark, d), rel.potentials(spark, d))


_HEALTH = """health as (select mode, sum(round(score * 10)::bigint * s)::double / sum(s) / 10 as mechanical from (select *, (case dimension when 'File health' then 2 else 1 end * least(checks, 200))::bigint as s from dims) group by mode)"""


@query("prev potentials", f", {_DIMS}, {_HEALTH} select mode, mechanical, floor(mechanical * 10 + 0.5) / 10 as overall from health")
def health_bundle(spark: SparkSession, d: str) -> DataFrame:
    return scores.health(dimension_scores(spark, d))


@query("prev potentials assessments", f""", {_DIMS}, {_HEALTH}, subj as (select sum(score * w) / sum(w) as subjective from (select dimension, floor(avg(score) + 0.5) as score, 1 + length(dimension) % 3 as w from assessments group by dimension))
  select mode, mechanical, subjective, floor((mechanical * 0.4 + subjective * 0.6) * 10 + 0.5) / 10 as overall from health, subj""")
def health_with_reviews(spark: SparkSession, d: str) -> DataFrame:
    own = rel.assessments(spark, d).groupBy("dimension").agg(F.floor(F.avg("score") + 0.5).alias("score"))
    return scores.health(dimension_scores(spark, d), own.withColumn("weight", 1 + F.length("dimension") % 3))


@query("prev potentials", f""", {_DIMS}, g as (select dimension, max(score) filter (mode = 'lenient') as lenient, max(score) filter (mode = 'strict') as strict from dims group by 1)
  select *, round(lenient * 10 - strict * 10)::int as gap_tenths from g where round(lenient * 10 - strict * 10) > 10 order by gap_tenths desc, dimension limit 3""")
def mode_gaps(spark: SparkSession, d: str) -> DataFrame:
    return scores.gaps(dimension_scores(spark, d))


@query("prev potentials", f", {_DIMS} select dimension, score, issues from dims where mode = 'strict' and score < 100 order by score, dimension limit 3")
def score_drag(spark: SparkSession, d: str) -> DataFrame:
    return scores.score_drag(dimension_scores(spark, d), 3)


@query("prev potentials", f""", {_DIMS} select n.dimension, n.score, p.score as previous, case when p.score is null then 'new' when n.score - p.score > 0.5 then 'up' when n.score - p.score < -0.5 then 'down' else 'same' end as trend
  from dims n left join dims p on p.dimension = n.dimension and p.mode = 'strict' and p.dimension <> 'Duplication' where n.mode = 'lenient'""")
def dimension_trends(spark: SparkSession, d: str) -> DataFrame:
    s = dimension_scores(spark, d)
    return scores.trends(s.where("mode = 'lenient'"), s.where("mode = 'strict' and dimension <> 'Duplication'"))


_SUSPECT = """before as (select detector, count(*) as b from prev where status = 'open' group by 1), doubt as (select detector from before left join (select detector, count(*) as n from cur group by 1) using (detector)
  left join (select detector, true as ran from potentials) using (detector) where detector = 'review' or (n is null and (ran is null or b >= 3)))"""


@query("prev cur potentials", f", {_SUSPECT} select * from doubt")
def suspect_detectors(spark: SparkSession, d: str) -> DataFrame:
    return ops.suspects(rel.findings_prev(spark, d), rel.findings_cur(spark, d), rel.potentials(spark, d))


_MERGE = f"""{_SUSPECT}, j as (select coalesce(c.id, p.id) as id, coalesce(c.detector, p.detector) as detector, coalesce(c.file, p.file) as file, coalesce(c.tier, p.tier) as tier, coalesce(c.confidence, p.confidence) as confidence,
  coalesce(c.summary, p.summary) as summary, coalesce(c.detail, p.detail) as detail, coalesce(c.zone, p.zone) as zone, coalesce(p.lang, 'python') as lang, coalesce(p.status, 'open') as old, coalesce(p.reopen_count, 0) as reopens,
  coalesce(p.suppressed, false) as hidden, c.id is not null as found, p.id is not null as known, case when coalesce(c.file, p.file) like 'cust/4%' then 'cust/4*' when coalesce(c.id, p.id) like 'unused::cust/5%' then 'unused::cust/5' end as pattern,
  p.lang as plang, p.status as pstatus, p.file as pfile, p.detector as pdet from prev p full join cur c on p.id = c.id),
a as (select *, case when found and pattern is not null then 'suppressed' when found and not known then 'new' when found and pstatus in ('fixed', 'auto_resolved') then 'reopened' when found then 'matched'
  when pstatus = 'auto_resolved' then 'already' when plang <> 'python' then 'other_lang' when pfile like '%/77.py%' then 'excluded' when pdet in (select detector from doubt) then 'suspect'
  when pdet in ('security', 'hardcoded_secrets') then 'protected' else 'resolved' end as action from j),
merged as (select id, detector, file, tier, confidence, summary, detail, zone, lang, case action when 'resolved' then 'auto_resolved' when 'reopened' then 'open' else old end as status, reopens + (action = 'reopened')::int as reopen_count,
  case when action = 'suppressed' then true when action in ('new', 'matched', 'reopened') then false else hidden end as suppressed, case when found then pattern end as suppression_pattern,
  case when action = 'reopened' then 'reopened ' || (reopens + 1) || ' times, was ' || old when action = 'resolved' then case when old = 'wontfix' then 'no longer found; was wontfix' else 'no longer found' end end as note, action from a)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return ops.merge(rel.findings_prev(spark, d), rel.findings_cur(spark, d), rel.potentials(spark, d), "python", exclude=["/77.py"], ignore=["cust/4*", "unused::cust/5"])


@query("prev cur potentials", f", {_MERGE} select * from merged")
def scan_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


@query("prev cur potentials", f""", {_MERGE}, n as (select count(*) as raw_findings from cur) select {', '.join(f"count(*) filter (action = '{x}') as {x}" for x in ('new', 'matched', 'reopened', 'suppressed', 'resolved', 'other_lang', 'out_of_scope', 'suspect', 'protected'))},
  count(*) filter (reopen_count >= 2 and status = 'open') as chronic, count(*) filter (status = 'open' and not suppressed) as open, any_value(raw_findings) as raw_findings,
  floor(1000.0 * count(*) filter (action = 'suppressed') / any_value(raw_findings) + 0.5) / 10 as suppressed_pct from merged, n""")
def scan_diff(spark: SparkSession, d: str) -> DataFrame:
    return ops.diff(_merged(spark, d), rel.findings_cur(spark, d))


@query("prev", f"select tier, count(*) as total, {', '.join(f'''count(*) filter (status = '{s}') as {s}''' for s in text.STATUSES)} from prev group by rollup (tier)")
def status_stats(spark: SparkSession, d: str) -> DataFrame:
    return ops.stats(rel.findings_prev(spark, d))


@query("prev", "select id, case when file like 'cust/9%' and detector = 'dupes' and status = 'open' then 'wontfix' else status end as status, case when file like 'cust/9%' and detector = 'dupes' and status = 'open' then 'agreed' end as note from prev")
def resolve_update(spark: SparkSession, d: str) -> DataFrame:
    return ops.resolve(rel.findings_prev(spark, d), "dupes::cust/9*", "wontfix", "agreed").select("id", "status", "note")


@query("prev", "select id, 'team' || file[5:] as file, detector || '::team' || file[5:] || '::' || key as map_key from prev")
def move_rename(spark: SparkSession, d: str) -> DataFrame:
    return ops.move(rel.findings_prev(spark, d), "cust", "team").select("id", "file", "map_key")


_RANK = "tier, case confidence when 'high' then 0 when 'medium' then 1 else 2 end, id"


@query("prev", f""", r as (select id, detector, tier, confidence, row_number() over (partition by detector order by {_RANK}) as rank from prev where status = 'open' and not suppressed), k as (select * from r where rank <= 10),
  o as (select *, row_number() over (order by {_RANK}) as o from k where detector <> 'security') select id, detector, rank from o where o <= 40 union all select id, detector, rank from k where detector = 'security'""")
def noise_budget(spark: SparkSession, d: str) -> DataFrame:
    return scores.ranked_per_detector(ops.show(rel.findings_prev(spark, d)), 10, 40).select("id", "detector", "rank")


@query("prev potentials assessments", f""", {_DIMS}, o as (select dimension, floor(avg(score) + 0.5) as score from assessments group by 1)
  select dimension, score, null::double as weight, false as subjective from dims where mode = 'strict' and dimension not in (select dimension from o) union all select dimension, score, case dimension when 'src1' then 22.0 else 1.0 end, true from o""")
def subjective_overlay(spark: SparkSession, d: str) -> DataFrame:
    own = rel.assessments(spark, d).groupBy("dimension").agg(F.floor(F.avg("score") + 0.5).cast("double").alias("score"))
    return ops.subjective_overlay(dimension_scores(spark, d).where("mode = 'strict'"), own, {"src1": 22.0})
