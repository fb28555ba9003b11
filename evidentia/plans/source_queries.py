"""Queries on sources, documents and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import jsonpatch
from evidentia.operators import ledger
from evidentia.plans.relation_sql import with_relations
from evidentia.sources import documents as src
from evidentia.sources import relations as rel
from evidentia.sources.written import scratch
from evidentia.streaming import ledger_stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(names: str, sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_relations(names, sql) if names else sql
        return f

    return add


@query("prev", "select id, detector, file, tier, confidence, case when status = 'open' then 'open' else 'fixed' end as status, reopen_count, suppressed from prev")
def state_load(spark: SparkSession, d: str) -> DataFrame:
    """State documents of 500 findings each, one with an older status name and a field that the schema does not know."""
    f = rel.findings_prev(spark, d)
    old = f.withColumn("status", F.when(F.col("status") == "open", "open").otherwise("resolved")).withColumn("future", F.lit(1))
    cols = ["id", "detector", "file", "tier", "confidence", "status", "reopen_count", "suppressed", "future"]
    body = F.map_from_entries(F.collect_list(F.struct("id", F.struct(*cols))))
    docs = old.groupBy(F.floor(F.col("key") / 500)).agg(F.to_json(F.struct(F.lit(1).alias("version"), body.alias("findings"))).alias("value"))
    return src.state_findings(docs).where("extra like '%\"future\":1%'").select(*cols[:-1])


@query("prev", "select id as map_key, '{\"detector\":\"' || detector || '\",\"id\":\"' || id || '\",\"tier\":' || tier || '}' as value from prev")
def state_save(spark: SparkSession, d: str) -> DataFrame:
    return src.as_state(rel.findings_prev(spark, d).select("id", "detector", "tier"))


@query("ledger", "select seq, event_id, kind, payload from ledger where seq <= (select max(seq) - 1 from ledger)")
def ledger_recovery(spark: SparkSession, d: str) -> DataFrame:
    """The chain as JSON lines whose last is torn."""
    e = rel.ledger(spark, d).drop("at")
    last = e.agg(F.max("seq").alias("m"), F.lit(1).alias("_"))
    raw = e.withColumn("_", F.lit(1)).join(F.broadcast(last), "_").select(F.col("seq").alias("number"), F.when(F.col("seq") == F.col("m"), '{"seq": 9, "ev').otherwise(F.to_json(F.struct(*e.columns))).alias("value"))
    return src.recovered(src.ledger_lines(raw)).select("seq", "event_id", "kind", "payload")


@query("", "select 1000 + row_number() over (order by event_id) as seq, 'evt-' || event_id as event_id, coalesce(lag(sha256(props)) over (order by event_id), 'tail') as prev_hash, sha256(props) as payload_hash, event_type as kind from events")
def ledger_append(spark: SparkSession, d: str) -> DataFrame:
    rows = rel.table(spark, d, "events").select(F.col("event_id").alias("number"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    return src.appended(rows, 1000, "tail").select("seq", "event_id", "prev_hash", "payload_hash", "kind")


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """What six tools would say about the orders, one output for each tool and run of 500 order keys."""
    o = rel.table(spark, d, "orders").withColumn("run", F.floor(F.col("o_orderkey") / 500))
    file, line, text = F.concat(F.lit("src/f"), F.col("o_custkey") % 50, F.lit(".py")), F.col("o_orderkey") % 300, F.concat(F.lit("bad thing "), F.col("o_orderkey"))
    quote = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    joined = lambda c, sep: F.array_join(F.collect_list(c), sep)
    return o.groupBy("run").agg(
        F.concat(F.lit("["), joined(quote('{"file":"', file, '","line":', line, ',"message":"', text, '"}'), ","), F.lit("]")).alias("json"),
        joined(quote(file, ":", line, ":7: ", text), "\n").alias("lines_column"),
        joined(quote(file, ":", line, ": warning: ", text), "\nnoise\n").alias("gnu"),
        joined(quote('{"message":{"message":"', text, '","spans":[{"file_name":"', file, '","line_start":', line, "}]}}"), "\nnot json\n").alias("json_lines"),
        F.concat(F.lit('{"files":['), joined(quote('{"path":"', file, '","offenses":[{"message":"', text, '","location":{"line":', line, "}}]}"), ","), F.lit("]}")).alias("nested"),
        F.concat(F.lit('{"Issues":['), joined(quote('{"Text":"', text, '","Pos":{"Filename":"', file, '","Line":', line, "}}"), ","), F.lit("]}")).alias("issues"),
    )


FORMS = ("json", "lines_column", "gnu", "json_lines", "nested", "issues")
_TOOL_SQL = "select '{0}::src/f' || (o_custkey % 50) || '.py::' || (o_orderkey % 300) as id, '{0}' as detector, 'src/f' || (o_custkey % 50) || '.py' as file, (o_orderkey % 300)::int as line, 'bad thing ' || o_orderkey as summary, 'high' as confidence from orders"


@query("", " union all ".join(_TOOL_SQL.format(f) for f in FORMS))
def tool_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs in all six forms, parsed and united."""
    outputs = _outputs(spark, d)
    out = None
    for form in FORMS:
        own = src.tool_findings(outputs, form, form, form)
        out = own if out is None else out.unionByName(own)
    return out


@query("", """select (doc_id % 8)::int as batch, source as dimension, greatest(0.0::double, least(100.0::double, case when doc_id % 3 = 0 then 120.0 else quality * 50.5 end)) as score, doc_id from labels join documents using (doc_id) where source in ('src1', 'src2', 'src3') """)
def review_parse(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs with prose around a JSON object."""
    rows = rel.table(spark, d, "labels").join(rel.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    score = F.when(F.col("doc_id") % 3 == 0, "120").when(F.col("quality") == 1, '"50.5"').otherwise("0")
    said = rows.select("doc_id", (F.col("doc_id") % 8).cast("int").alias("batch"), F.concat(F.lit('Here it is:\n{"assessments":{"'), "source", F.lit('":'), score, F.lit(',"odd":"n/a"},"findings":[]}\nDone.')).alias("output"))
    parsed = src.review_payload(said.select(F.struct("batch", "doc_id").alias("batch"), "output"), ["src1", "src2", "src3"])
    return parsed.select("batch.batch", "dimension", "score", "batch.doc_id")


@query("", """select event_id, case when event_type = 'error' then '{"k":' || json_extract(props, '$.k')::varchar || ',"kind":"error"}' when event_type = 'click' then '{"kind":"click"}' else '{"k":' || json_extract(props, '$.k')::varchar || '}' end as merged from events""")
def json_merge_patch(spark: SparkSession, d: str) -> DataFrame:
    """RFC 7396 on flat objects: null deletes a key, other values replace it."""
    e = rel.table(spark, d, "events")
    patch = F.when(F.col("event_type") == "error", '{"kind":"error"}').when(F.col("event_type") == "click", '{"k":null,"kind":"click"}').otherwise("{}")
    return e.select("event_id", jsonpatch.merged(F.col("props"), patch).alias("merged"))


@query("", None)
def ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """Tampered chains, dealt out of order over files, checked as a stream; verdicts as written by the sink."""
    base = scratch(spark)
    events = rel.ledgers(spark, d)
    files = max(3, rel.tasks(spark, d, "events"))  # three batches, each of files that do not grow with the table
    events.repartition(files, F.col("seq") % 7, "ledger").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{base}/in")
    ledger_stream_run(spark, stream, base)
    return spark.read.parquet(f"{base}/out")


def ledger_stream_run(spark: SparkSession, stream: DataFrame, base: str) -> None:
    from evidentia.streaming import ledger_stream as ls

    ls.run_once(spark, ls.checked(stream), f"{base}/out", f"{base}/state")


ORACLES["ledger_stream"] = """select 'ledger-' || (event_id // 256) as ledger, row_number() over (partition by event_id // 256 order by event_id) as seq,
  case when event_id % 1000 = 7 then 'payload' else 'ok' end as verdict from events"""
__all__ = ["ORACLES", "QUERIES", "ledger"]
