"""Dependency edges read from source texts: imports are found, resolved against the known files and united into a graph of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import resolve
from evidentia.sources.written import written

#: The forms of imports of scripts (matched over the whole source) and of Python (matched over a trimmed line).
SCRIPT_IMPORTS = [
    r"""(?:import|export)\s+(?:.*?\s+from\s+)?['"]([^'"]+)['"]""",
    r"""import\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
]
PYTHON_IMPORT, PYTHON_FROM = r"^import\s+(\S+)", r"^from\s+(\S+)\s+import\b"


def sources(lines: DataFrame) -> DataFrame:
    """(path, content) of numbered lines; one file's lines meet in one row."""
    own = lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    return own.select("path", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))


def script_edges(files: DataFrame) -> DataFrame:
    """files (path, content) to distinct (src, dst): static and dynamic imports, re-exports and requires, also over several lines. Names of packages (neither
    `.` nor `/` in front) are dropped. A path without content has no imports but can be imported; a file may import itself."""
    found = F.concat(*(F.regexp_extract_all("content", F.lit(f"(?d){p}"), F.lit(1)) for p in SCRIPT_IMPORTS))
    specs = files.select(F.col("path").alias("importer"), F.explode(F.array_distinct(found)).alias("module")).where(F.col("module").rlike("^[./]"))
    # a path from the root takes the place of the importer's folder
    rooted = specs.where("module like '/%'").select("importer", F.concat(F.lit("."), "module").alias("module"), F.lit("").alias("folder"))
    placed = specs.where("module not like '/%'").select("importer", "module", text.parent(F.col("importer")).alias("folder")).union(rooted)
    return resolve.script_targets(placed, files).select(F.col("importer").alias("src"), F.col("target").alias("dst")).distinct()


def indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def in_functions(lines: DataFrame) -> DataFrame:
    """Lines with `deferred`: a `def` opens a function, any other line with text that is indented no deeper than it closes it, comments aside.
    So within the lines that follow a `def`, up to the next one, a line is inside while no line since was indented as little: a running minimum."""
    t = trimmed(F.col("text"))
    marked = lines.select("path", "line", "text", t.alias("t"), indent(F.col("text")).alias("indent"), t.rlike("^(async )?def ").alias("opens"))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = marked.withColumn("part", F.sum(F.col("opens").cast("int")).over(order))
    since = Window.partitionBy("path", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = F.when(~F.col("opens") & (F.col("t") != "") & ~F.col("t").startswith("#"), F.col("indent"))
    closed = F.coalesce(F.min(counts).over(since) <= F.first("indent").over(since), F.lit(False))
    return parts.select("path", "line", "text", "t", ((F.col("part") > 0) & ~closed).alias("deferred"))


def python_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """lines (path, line, text) of Python files to distinct (src, dst, deferred). Deferred: at least one import of the pair stands in a function.
    files (path): what imports can resolve to."""
    own = in_functions(lines).where(~F.col("t").startswith("#"))
    module = F.coalesce(*(F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in (PYTHON_IMPORT, PYTHON_FROM)))
    plain = F.col("t").rlike(PYTHON_IMPORT)
    found = own.select(F.col("path").alias("importer"), module.alias("module"), (~plain & module.startswith(".")).alias("relative"), "deferred").where("module is not null")
    found = written(found.groupBy("importer", "module", "relative").agg(F.max("deferred").alias("deferred")))
    pairs = found.select("importer", "module", "relative").distinct()
    known = resolve.resolve_relative(pairs.where("relative"), files).unionByName(resolve.resolve_absolute(pairs.where("not relative"), files))
    hits = found.join(known, ["importer", "module", "relative"])
    return hits.groupBy(F.col("importer").alias("src"), F.col("target").alias("dst")).agg(F.max("deferred").alias("deferred"))


def graph(scripts: DataFrame, python: DataFrame) -> DataFrame:
    """One graph (src, dst, deferred) of both kinds of files."""
    return scripts.withColumn("deferred", F.lit(False)).unionByName(python)
