"""Review context: per project the sections that its open findings make, each cut by a rank of its own, as one JSON document that keeps to a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The budget in characters; of each section the entries that stay at first, and if the document is over the budget.
BUDGET = 50000
SECTIONS = {"complexity_hotspots": (10, 5), "exception_hotspots": (10, 10), "signal_density": (15, 8), "mutable_globals": (10, 10), "high_fan_in": (10, 5), "duplicate_clusters": (10, 5)}
SALTS = 32


def first_rows(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key with their place from 0; every salt of a key keeps its own first rows before they meet, so that a hot key is no single task."""
    salted = Window.partitionBy(*by, F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(SALTS))).orderBy(*order)
    some = rows.withColumn("_own", F.row_number().over(salted)).where(F.col("_own") <= most).drop("_own")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("place") < most)


def entries(findings: DataFrame) -> DataFrame:
    """findings (project, id, detector, file, summary, detail as JSON, status, suppressed) to (project, section, place, item as JSON), at most the first numbers of SECTIONS. A file's
    signals and a function's copies are counted by partial aggregates; a copied function lists its first files by finding id, up to 50."""
    own = findings.where("status = 'open' and not suppressed")
    field = lambda name: F.get_json_object("detail", f"$.{name}")
    item = lambda *columns: F.to_json(F.struct(*columns)).alias("item")
    spot = lambda score: item("file", score.alias("score"), F.col("summary").alias("detail"))
    lowest, none = F.lit(0.0), F.lit("")

    hot = own.where("detector in ('structural', 'smells')").withColumn("score", field("complexity").try_cast("double")).where("score is not null")
    parts = [hot.select("project", F.lit("complexity_hotspots").alias("section"), (-F.col("score")).alias("rank"), F.col("id").alias("then"), spot(F.col("score")))]
    failing = own.where((F.col("detector") == "smells") & F.contains(F.lower("summary"), F.lit("error")))
    parts.append(failing.select("project", F.lit("exception_hotspots"), lowest, "id", spot(F.lit(1.0))))
    dense = own.groupBy("project", "file").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("detector")).alias("detectors")).where("n >= 2")
    parts.append(dense.select("project", F.lit("signal_density"), lowest, "file", item("file", F.size("detectors").alias("detector_count"), "detectors")))
    globals_ = own.where("detector = 'global_mutable_config'")
    parts.append(globals_.select("project", F.lit("mutable_globals"), lowest, "id", item("file", F.col("id").alias("name"), F.col("summary").alias("detail"))))
    fans = own.where("detector = 'coupling'").withColumn("count", field("importer_count").try_cast("long")).where("count >= 0").groupBy("project", "file").agg(F.max_by("count", "id").alias("count"))
    parts.append(fans.select("project", F.lit("high_fan_in"), (-F.col("count")).cast("double"), "file", item("file", "count")))
    copies = own.where("detector in ('dupes', 'boilerplate_duplication')").withColumn("name", field("function_name")).where("name is not null").select("project", "name", "id", "file")
    listed = first_rows(copies, ["project", "name"], ["id"], 50).groupBy("project", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "file"))), lambda x: x["file"]).alias("files")).where(F.size("files") >= 2)
    parts.append(listed.select("project", F.lit("duplicate_clusters"), lowest, "name", item(F.col("name").alias("function_name"), "files")))
    every = reduce(DataFrame.union, parts)
    kept = first_rows(every, ["project", "section"], ["rank", "then", "item"], max(n for n, _ in SECTIONS.values()))
    most = F.coalesce(*(F.when(F.col("section") == s, n) for s, (n, _) in SECTIONS.items()))
    return kept.where(F.col("place") < most).select("project", "section", "place", "item")


def bundles(found: DataFrame, budget: int = BUDGET) -> DataFrame:
    """entries to (project, trimmed, context): one JSON document per project. If it is longer than the budget, every section keeps its second number of entries; no further cut is made."""
    lists = found.groupBy("project").pivot("section", list(SECTIONS)).agg(F.sort_array(F.collect_list(F.struct("place", "item"))))

    def document(which: int) -> F.Column:
        parts = []
        for s, cuts in SECTIONS.items():
            items = F.transform(F.slice(F.coalesce(F.col(s), F.array().cast("array<struct<place:int,item:string>>")), F.lit(1), F.lit(cuts[which])), lambda x: x["item"])
            parts.append(F.concat(F.lit(f'"{s}":['), F.array_join(items, ","), F.lit("]")))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    both = lists.select("project", document(0).alias("whole"), document(1).alias("less"))
    over = F.length("whole") > budget
    return both.select("project", over.alias("trimmed"), F.when(over, F.col("less")).otherwise(F.col("whole")).alias("context"))
