"""The fix runner: all fixers of a file in their order, each on the text that the one before it left, in one plan over lines that are dealt by file."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a line that is a console statement.
CONSOLE = r"^\s*console\.(log|warn|error|debug|info|trace)\s*\("


@dataclass(frozen=True)
class Fixer:
    name: str
    detector: str
    lang: str | None = None
    smell: str | None = None
    needs_line: bool = True

    def applicable(self) -> Column:
        """Whether it can fix a finding (detector, lang, detail as JSON)."""
        line, smell = F.get_json_object("detail", "$.line"), F.get_json_object("detail", "$.smell")
        tests = [F.col("detector") == self.detector]
        tests += [F.col("lang") == self.lang] if self.lang else []
        tests += [smell == self.smell] if self.smell else []
        tests += [line.isNotNull()] if self.needs_line else []
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


#: In the order in which they run on a file: by detector.
FIXERS = [
    Fixer("python-debug-logs", "smells", lang="python", smell="debug_print", needs_line=False),
    Fixer("ts-logs", "ts_logs", needs_line=False),
    Fixer("ts-unused-imports", "ts_unused"),
    Fixer("python-unused-imports", "unused", lang="python"),
]


def candidates(findings: DataFrame) -> DataFrame:
    """(path, fixer, n, marks) of the open first-tier findings that a fixer can fix: their number and their (line, import)."""
    own = findings.where("status = 'open' and not suppressed and tier = 1")
    fixer = F.coalesce(*(F.when(f.applicable(), f.name) for f in FIXERS))
    mark = F.struct(F.get_json_object("detail", "$.line").cast("int").alias("line"), F.get_json_object("detail", "$.import").alias("import"))
    return own.select(F.col("file").alias("path"), fixer.alias("fixer"), mark.alias("mark")).where("fixer is not null").groupBy("path", "fixer").agg(F.count("*").alias("n"), F.collect_list("mark").alias("marks"))


def dry_run(findings: DataFrame) -> DataFrame:
    """(path, fixer, lines_changed, findings_fixed, modified) as a dry run tells it: nothing changes."""
    return candidates(findings).select("path", "fixer", F.lit(0).cast("long").alias("lines_changed"), F.col("n").alias("findings_fixed"), F.lit(False).alias("modified"))


def _changes(fixer: Fixer) -> Column:
    """How many lines the fixer says it changes, over the lines of a file with its marks."""
    whole = Window.partitionBy("path")
    if fixer.name == "ts-logs":
        return F.count(F.when(F.col("text").rlike(CONSOLE), 1)).over(whole)
    listed = F.array_distinct(F.filter(F.transform("marks", lambda m: m["line"]), lambda x: x.isNotNull()))
    if fixer.name != "ts-unused-imports":
        return F.size(listed).cast("long")
    # only lines that import nothing but the unused name count, though all listed ones go
    single = F.exists("marks", lambda m: (m["line"] == F.col("line")) & (F.contains("text", F.concat(F.lit("import "), m["import"], F.lit(" from"))) | F.contains("text", F.concat(F.lit("import type "), m["import"], F.lit(" from")))))
    return F.count(F.when(F.coalesce(single, F.lit(False)), 1)).over(whole)


def run(lines: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines (path, line from 1, text) and findings to the files' lines after all fixes (path, line, text), renumbered, and (path, fixer, lines_changed, findings_fixed,
    modified) of each fixer with something to do. A fixer that changes something removes the lines that its findings list; line numbers of later fixers count in the text as it is then. A listed
    file without lines is left alone."""
    todo = candidates(findings)
    every = F.map_from_entries(F.collect_list(F.struct("fixer", F.struct("n", "marks").alias("v"))))
    state = lines.select("path", "line", "text").join(todo.groupBy("path").agg(every.alias("todo")), "path", "left").withColumn("done", F.array().cast("array<struct<fixer:string,lines_changed:bigint,findings_fixed:bigint,modified:boolean>>"))
    order, whole = Window.partitionBy("path").orderBy("line"), Window.partitionBy("path")
    results = []
    for f in FIXERS:
        mine = F.try_element_at("todo", F.lit(f.name))
        state = state.withColumns({"marks": mine["marks"], "n": mine["n"]}).withColumn("changes", F.when(F.col("n").isNotNull(), _changes(f)).otherwise(0))
        fixed = F.when(F.col("changes") > 0, F.col("n") if f.name == "ts-logs" else F.col("changes")).otherwise(0)
        told = F.struct(F.lit(f.name).alias("fixer"), F.col("changes").alias("lines_changed"), fixed.alias("findings_fixed"), (F.col("changes") > 0).alias("modified"))
        state = state.withColumn("done", F.when(F.col("n").isNotNull(), F.concat("done", F.array(told))).otherwise(F.col("done")))
        listed = F.coalesce(F.exists("marks", lambda m: m["line"] == F.col("line")), F.lit(False))
        # a file that loses all its lines keeps one row, without text, that carries what was done
        gone = (F.col("changes") > 0) & listed | F.col("line").isNull()
        state = state.withColumn("line", F.when(~gone, F.col("line"))).withColumn("text", F.when(~gone, F.col("text")))
        kept = F.count("line").over(whole)
        state = state.withColumns({"kept": kept, "first": F.row_number().over(order)}).where("line is not null or (kept = 0 and first = 1)")
        state = state.withColumn("line", F.when(F.col("line").isNotNull(), F.row_number().over(order))).select("path", "line", "text", "todo", "done")
    results = state.where("todo is not null").groupBy("path").agg(F.first("done").alias("done")).select("path", F.inline("done"))
    return state.where("line is not null").select("path", "line", "text"), results
