"""Sources and sinks: JSON states, JSON-lines ledgers, tool outputs, file trees, versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import patterns
from evidentia.functions.text import extension, finding_id, relative, status_canonical
from evidentia.sources.written import written
from evidentia.operators.ordering import numbered

FINDING = "struct<id:string,detector:string,file:string,tier:int,confidence:string,summary:string,status:string,note:string,first_seen:string,last_seen:string,resolved_at:string,reopen_count:int,suppressed:boolean,zone:string,lang:string>"
EVENT = "seq long, event_id string, schema int, prev_hash string, payload_hash string, at string, kind string, payload string"
#: Directories that a tree scan never enters.
PRUNED = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".tox", ".mypy_cache", ".pytest_cache", ".eggs"]


def file_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, length, content) below a root, without pruned directories and excluded paths; all extensions if none is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    out = files.select(relative(clean, root).alias("path"), "length", F.col("content").cast("string").alias("content"))
    pruned = F.exists(F.split("path", "/"), lambda part: part.isin(*PRUNED))
    out = out.where(~pruned & ~patterns.any_excluded(F.col("path"), exclude or []))
    return out.where(extension(F.col("path")).isin(*extensions)) if extensions else out


def state_findings(documents: DataFrame, column: str = "value") -> DataFrame:
    """Findings of state documents (one JSON object each): known fields with defaults, the whole object in `extra`, older statuses renamed."""
    items = documents.select(F.explode(F.from_json(F.get_json_object(column, "$.findings"), "map<string,string>")).alias("map_key", "extra"))
    out = items.select("map_key", "extra", F.from_json("extra", FINDING).alias("f")).select("map_key", "extra", "f.*")
    return out.withColumns({
        "status": status_canonical(F.coalesce("status", F.lit("open"))), "tier": F.coalesce("tier", F.lit(3)), "confidence": F.coalesce("confidence", F.lit("low")),
        "reopen_count": F.coalesce("reopen_count", F.lit(0)), "suppressed": F.coalesce("suppressed", F.lit(False)),
    })


def as_state(findings: DataFrame) -> DataFrame:
    """JSON objects of findings, keys in order, one a row; nulls are left out."""
    names = sorted(c for c in findings.columns if c not in ("map_key", "extra"))
    return findings.select(F.col("id").alias("map_key"), F.to_json(F.struct(*names)).alias("value"))


def save_version(table: DataFrame, base: str) -> str:
    """A new version next to the older ones: readers of an older one are not disturbed, and the commit protocol makes it whole or absent."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return path


def ledger_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines (number, value) with `corrupt` for lines that do not parse."""
    parsed = lines.select("number", F.from_json(column, EVENT).alias("e"), F.col(column).alias("raw"))
    return parsed.select("number", "e.*", (F.col("e.seq").isNull() | F.col("e.payload_hash").isNull()).alias("corrupt"), "raw")


def recovered(events: DataFrame) -> DataFrame:
    """Events of a ledger whose last line may be torn: a corrupt last line is left out, any other is an error that the reader meets."""
    last = events.agg(F.max("number").alias("last"), F.lit(1).alias("_"))
    both = events.withColumn("_", F.lit(1)).join(F.broadcast(last), "_").drop("_")
    fatal = F.raise_error(F.concat(F.lit("corrupt ledger line "), F.col("number").cast("string")))
    return both.where(~(F.col("corrupt") & (F.col("number") == F.col("last")))).withColumn("seq", F.when(F.col("corrupt"), fatal.cast("long")).otherwise(F.col("seq"))).drop("last", "corrupt", "raw")


def appended(events: DataFrame, seq: int, tail_hash: str) -> DataFrame:
    """New rows (number, kind, payload) as events that continue a chain after seq, in the order of their numbers; each finds its predecessor's hash by place."""
    hashed = written(numbered(events.withColumn("payload_hash", F.sha2("payload", 256)), "number"))
    before = hashed.select((F.col("place") + 1).alias("place"), F.col("payload_hash").alias("prev_hash"))
    return hashed.join(before, "place", "left").select(
        (F.col("place") + 1 + seq).alias("seq"), F.concat(F.lit("evt-"), "number").alias("event_id"), F.lit(1).alias("schema"),
        F.when(F.col("place") == 0, tail_hash).otherwise(F.col("prev_hash")).alias("prev_hash"), "payload_hash", "kind", "payload",
    )


# ---- tool outputs: (detector, output) to findings


def _finding(out: DataFrame, detector: str, file: Column, line: Column, message: Column) -> DataFrame:
    at = F.coalesce(line.cast("int"), F.lit(0))
    rows = out.select(file.alias("file"), at.alias("line"), message.alias("summary")).where("file is not null and file <> '' and summary is not null and summary <> ''")
    return rows.select(finding_id(F.lit(detector), F.col("file"), F.col("line")).alias("id"), F.lit(detector).alias("detector"), "file", "line", "summary", F.lit("high").alias("confidence"))


def tool_findings(outputs: DataFrame, detector: str, form: str, column: str = "output") -> DataFrame:
    """Findings of tool outputs in one of six forms; what does not parse gives none.

    json: an array of objects with file, line, message; lines_column: `file:line:col: message`; gnu: `file:line: severity: message`; json_lines: an
    object a line with message.message and message.spans; nested: files[].offenses[]; issues: Issues[].Pos.
    """
    text = F.col(column)
    if form == "json":
        rows = outputs.select(F.explode(F.from_json(text, "array<struct<file:string,line:int,message:string>>")).alias("o"))
        return _finding(rows, detector, F.col("o.file"), F.col("o.line"), F.col("o.message"))
    if form in ("lines_column", "gnu"):
        p = r"^(.+?):(\d+):(\d+):\s*(.+)$" if form == "lines_column" else r"^(.+?):(\d+):\s*(\w+):\s*(.+)$"
        rows = outputs.select(F.explode(F.split(text, r"\r?\n")).alias("l")).where(F.col("l").rlike(p))
        return _finding(rows, detector, *(F.regexp_extract("l", p, k) for k in (1, 2, 4)))
    if form == "json_lines":
        rows = outputs.select(F.explode(F.split(text, r"\r?\n")).alias("l"))
        return _finding(rows, detector, *(F.get_json_object("l", x) for x in ("$.message.spans[0].file_name", "$.message.spans[0].line_start", "$.message.message")))
    if form == "nested":
        kind = "struct<files:array<struct<path:string,offenses:array<struct<message:string,location:struct<line:int>>>>>>"
        rows = outputs.select(F.explode(F.from_json(text, kind)["files"]).alias("f")).select("f.path", F.explode("f.offenses").alias("o"))
        return _finding(rows, detector, F.col("path"), F.col("o.location.line"), F.col("o.message"))
    if form == "issues":
        rows = outputs.select(F.explode(F.from_json(text, "struct<Issues:array<struct<Text:string,Pos:struct<Filename:string,Line:int>>>>")["Issues"]).alias("o"))
        return _finding(rows, detector, F.col("o.Pos.Filename"), F.col("o.Pos.Line"), F.col("o.Text"))
    raise ValueError(f"no such form: {form}")


def review_payload(outputs: DataFrame, dimensions: list[str], column: str = "output") -> DataFrame:
    """(batch, dimension, score) of review outputs: the JSON object from the first to the last brace, with `assessments`; scores are numbers or texts,
    held to 0..100; unknown dimensions are dropped."""
    body = F.regexp_extract(column, r"(?s)(\{.*\})", 1)
    scores = F.from_json(F.get_json_object(body, "$.assessments"), "map<string,string>")
    rows = outputs.select("batch", F.explode(scores).alias("dimension", "raw")).where(F.col("dimension").isin(*dimensions))
    number = F.try_to_number("raw", F.lit("999.99"))
    value = F.coalesce(F.col("raw").try_cast("double"), number.cast("double"))
    return rows.select("batch", "dimension", F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)).alias("score")).where("score is not null")
