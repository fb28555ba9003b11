"""Queries on potentials, facts, decisions, plans and contexts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import patterns, text
from evidentia.operators import review
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import relations as rel

QUERIES: dict = {}
ORACLES: dict = {}


def query(names: str, sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_relations(names, sql) if names else sql
        return f

    return add


@query("prev", "select detector, lang, count(*)::bigint * 3 as potential from prev group by grouping sets ((detector, lang), (detector))")
def potential_merge(spark: SparkSession, d: str) -> DataFrame:
    """Checks per detector and language, and their sum over languages."""
    return rel.findings_prev(spark, d).groupingSets([["detector", "lang"], ["detector"]], "detector", "lang").agg((F.count("*") * 3).alias("potential"))


@query("prev potentials", "select p.detector, p.potential, greatest(p.potential - coalesce(n, 0), 0) as adjusted from potentials p left join (select detector, count(*) as n from prev where zone in ('test', 'config', 'generated', 'vendor') group by 1) using (detector)")
def potential_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """Potentials less what lies outside production, never under 0."""
    outside = rel.findings_prev(spark, d).where(~patterns.is_scored(F.col("zone"))).groupBy("detector").agg(F.count("*").alias("n"))
    return rel.potentials(spark, d).join(outside, "detector", "left").select("detector", "potential", F.greatest(F.col("potential") - F.coalesce("n", F.lit(0)), F.lit(0)).alias("adjusted"))


@query("assessments review_findings", """, f as (select * from review_findings qualify row_number() over (partition by identifier order by batch, turn) = 1),
  p as (select dimension, count(*) as k, sum(case confidence when 'high' then 120 when 'medium' then 100 else 75 end * case impact_scope when 'codebase' then 20 when 'module' then 13 else 10 end
    * case fix_scope when 'architectural_change' then 17 when 'multi_file_refactor' then 13 else 10 end)::bigint as s from f group by 1),
  a as (select dimension, count(*) as n, sum(score) as total, min(score) as least from assessments group by 1),
  j as (select dimension, total / n as mean, least, coalesce(s, 0) / 10000::double as p, greatest(coalesce(k, 0) - 1, 0) as more from a left join p using (dimension)),
  b as (select dimension, 0.7::double * mean + 0.3::double * least - least(2.2::double * p + 0.8::double * more, 24.0::double) as base, greatest(90.0::double - 3.5::double * p - 0.8::double * more, 60.0::double) as cap, p from j)
  select dimension, greatest(0.0::double, least(100.0::double, case when p > 0 then least(base, cap) else base end)) as score from b""")
def review_dimension_score(spark: SparkSession, d: str) -> DataFrame:
    """0.7 mean + 0.3 least, less pressure 2.2 p + 0.8 (n - 1) up to 24, under a cap that sinks with the pressure."""
    found = review.severity(review.first_by_identifier(rel.review_findings(spark, d)))
    per = found.groupBy("dimension").agg(F.count("*").alias("k"), F.sum("severity").alias("s"))
    own = rel.assessments(spark, d).groupBy("dimension").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.min("score").alias("least"))
    p, more = F.coalesce("s", F.lit(0)) / 10000, F.greatest(F.coalesce("k", F.lit(0)) - 1, F.lit(0))
    base = 0.7 * (F.col("total") / F.col("n")) + 0.3 * F.col("least") - F.least(2.2 * p + 0.8 * more, F.lit(24.0))
    cap = F.greatest(90.0 - 3.5 * p - 0.8 * more, F.lit(60.0))
    return own.join(per, "dimension", "left").select("dimension", text.clamp(F.when(p > 0, F.least(base, cap)).otherwise(base), 0.0, 100.0).alias("score"))


@query("prev", "select 'detector:' || detector as fact, count(*) as n from prev where status = 'open' group by 1 union all select 'files', count(distinct file) from prev union all select 'suppressed', count(*) from prev where suppressed")
def fact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a snapshot: open findings by detector, and counts over the repository."""
    f = rel.findings_prev(spark, d)
    per = f.where("status = 'open'").groupBy(F.concat(F.lit("detector:"), "detector").alias("fact")).agg(F.count("*").alias("n"))
    whole = f.agg(F.count_distinct("file").alias("files"), F.count(F.when(F.col("suppressed"), 1)).alias("suppressed"))
    return per.union(whole.select(F.expr("stack(2, 'files', files, 'suppressed', suppressed) as (fact, n)")))


@query("", """with r as (select event_id % 40 as decision, max(event_id) as upto from events where event_type = 'signup' group by 1),
  a as (select event_id % 40 as decision, event_id % 3 as field, event_id, props from events where event_type = 'click')
  select a.decision, field, arg_max(props, event_id) as answer, max(event_id) as seq from a left join r using (decision) where event_id > coalesce(upto, -1) group by 1, 2""")
def decision_fold(spark: SparkSession, d: str) -> DataFrame:
    """Answers after a decision's last ratification, the last one of each field."""
    e = rel.table(spark, d, "events").withColumn("decision", F.col("event_id") % 40)
    ratified = e.where("event_type = 'signup'").groupBy("decision").agg(F.max("event_id").alias("at"))
    answers = e.where("event_type = 'click'").join(ratified, "decision", "left").where(F.col("event_id") > F.coalesce("at", F.lit(-1)))
    return answers.groupBy("decision", (F.col("event_id") % 3).alias("field")).agg(F.max_by("props", "event_id").alias("answer"), F.max("event_id").alias("seq"))


@query("", "select event_id, event_type <> 'view' as exact from events")
def strict_shape(spark: SparkSession, d: str) -> DataFrame:
    """Whether a JSON object has exactly the expected keys."""
    e = rel.table(spark, d, "events")
    body = F.when(F.col("event_type") == "view", '{"k":1,"more":2}').otherwise(F.col("props"))
    return e.select("event_id", (F.array_sort(F.json_object_keys(body)) == F.array(F.lit("k"))).alias("exact"))


@query("prev", "select id, case when key % 37 = 0 and key % 74 <> 0 then 'skipped' else 'queued' end as place from prev where key % 101 = 0 or key % 37 = 0")
def skip_unskip(spark: SparkSession, d: str) -> DataFrame:
    """Queue and skips after some are skipped and some taken back: disjoint, nothing lost."""
    f = rel.findings_prev(spark, d)
    queued, skipped, back = f.where("key % 101 = 0").select("id"), f.where("key % 37 = 0").select("id"), f.where("key % 74 = 0").select("id")
    still = skipped.join(back, "id", "left_anti")
    rest = queued.union(skipped.join(back, "id", "left_semi")).distinct().join(still, "id", "left_anti")
    return still.withColumn("place", F.lit("skipped")).union(rest.withColumn("place", F.lit("queued")))


@query("", "select min(o_orderkey) as place, o_clerkish as pattern from (select o_orderkey, 'p' || (o_custkey % 200) as o_clerkish from orders) group by 2")
def exclude_merge(spark: SparkSession, d: str) -> DataFrame:
    """Ordered distinct: the first place of each pattern."""
    return rel.table(spark, d, "orders").groupBy(F.concat(F.lit("p"), F.col("o_custkey") % 200).alias("pattern")).agg(F.min("o_orderkey").alias("place"))


@query("files", """, s as (select split_part(path, '/', 1) as dir, path, coalesce(length(content), 0) as n from files), r as (select dir, path, n, sum(n) over (partition by dir order by n, path) as upto from s) select dir, count(*) as files, max(upto)::bigint as chars from r where upto <= 50000 group by 1""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Per directory, the smallest files that together keep to 50,000 characters; a file without content has none. Empty files all fit and are only counted. Of the others, which have
    at least one character each, a directory's first 50,000 are enough; each hash bucket of it keeps its own first before they meet."""
    s = rel.files(spark, d).select(F.substring_index("path", "/", 1).alias("dir"), "path", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n"))
    empty = s.where("n = 0").groupBy("dir").agg(F.count("*").alias("files"), F.lit(0).cast("long").alias("chars"))
    salted = Window.partitionBy("dir", F.pmod(F.xxhash64("path"), F.lit(64))).orderBy("n", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = s.where("n > 0").withColumn("own", F.sum("n").over(salted)).where("own <= 50000").drop("own")
    upto = F.sum("n").over(Window.partitionBy("dir").orderBy("n", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = some.withColumn("upto", upto).where("upto <= 50000").groupBy("dir").agg(F.count("*").alias("files"), F.max("upto").alias("chars"))
    return empty.union(full).groupBy("dir").agg(F.sum("files").alias("files"), F.max("chars").alias("chars"))


@query("code_lines", """, x as (select path, count(*) filter (text like 'router.%') as routes, count(*) filter (regexp_matches(text, '(?i)\\b(password|token|secret)\\b')) as auth from code_lines group by 1) select path, routes from x where routes > 0 and auth = 0""")
def routes_without_auth(spark: SparkSession, d: str) -> DataFrame:
    """Files with routes and no sign of authentication."""
    t = F.col("text")
    own = rel.code_lines(spark, d).groupBy("path").agg(F.count(F.when(t.startswith("router."), 1)).alias("routes"), F.count(F.when(t.rlike(r"(?i)\b(password|token|secret)\b"), 1)).alias("auth"))
    return own.where("routes > 0 and auth = 0").select("path", "routes")


@query("prev", "select file, list_sort(list(distinct detector)) as detectors, case when bool_or(detector = 'security') then 'risk' when bool_or(detector = 'dupes') and bool_or(detector = 'structural') then 'bloat' when count(distinct detector) >= 4 then 'mixed' else 'plain' end as class from prev where status = 'open' and not suppressed group by 1")
def concern_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of a file's set of detectors, by ordered rules."""
    own = rel.findings_prev(spark, d).where("status = 'open' and not suppressed").groupBy("file").agg(F.array_sort(F.collect_set("detector")).alias("detectors"))
    has = lambda x: F.array_contains("detectors", x)
    return own.withColumn("class", F.when(has("security"), "risk").when(has("dupes") & has("structural"), "bloat").when(F.size("detectors") >= 4, "mixed").otherwise("plain"))
