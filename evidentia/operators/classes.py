"""Python classes with their extents and members, read from numbered lines by running values within a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.import_edges import indent

#: The heads of classes and methods, and attributes.
CLASS, METHOD, ATTRIBUTE = r"^(\s*)class\s+(\w+)", r"^\s+(?:async\s+)?def\s+(\w+)", r"self\.(\w+)"
#: A line with text that is no comment.
CODE = r"^\s*[^\s#]"


def extents(lines: DataFrame) -> DataFrame:
    """(path, name, line, end): classes up to the next line of code that is indented no deeper, end exclusive; comments and blank lines end none. A class inside another one's
    extent is no class of its own; one without a path has its own line only. A file's lines meet by windows, never by joins: lines compress to so few bytes that Spark, which goes by a
    table's files, would broadcast millions of them through the driver."""
    text, file = F.col("text"), Window.partitionBy("path")
    marked = lines.select("path", "line", F.when(text.rlike(CODE), indent(text)).alias("depth"), F.when(text.rlike(CLASS), F.regexp_extract("text", CLASS, 2)).alias("name"))
    known = marked.withColumns({"levels": F.collect_set(F.when(F.col("name").isNotNull(), F.col("depth"))).over(file), "after": F.max("line").over(file) + 1})
    # each line of code once for each indent of a class that it can end: there, the line that follows a class ends it
    ends = known.select("path", "line", "depth", "name", "after", F.explode(F.filter("levels", lambda level: level >= F.col("depth"))).alias("level"))
    stops = ends.withColumn("stop", F.lead("line").over(Window.partitionBy("path", "level").orderBy("line"))).where("name is not null and depth = level")
    whole = stops.select("path", "line", "name", F.when(F.col("path").isNull(), F.col("line") + 1).otherwise(F.coalesce("stop", "after")).alias("end"))
    # classes nest or are apart, so a class lies in another one if one that begins before it ends after its line
    before = file.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return whole.withColumn("reach", F.max("end").over(before)).where("reach is null or reach <= line").drop("reach")


def members(lines: DataFrame) -> DataFrame:
    """(path, name, line, loc, methods, prefixes, attributes): of each class its lines, its methods (those of inner functions and classes too), the distinct first words of their names, `test`
    aside, and its distinct attributes."""
    text = F.col("text")
    heads = extents(lines).select("path", "line", F.struct("name", F.col("line").alias("start"), "end").alias("c"))
    parts = lines.where(text.rlike(METHOD) | text.rlike(ATTRIBUTE)).select(
        "path", "line", F.when(text.rlike(METHOD), F.regexp_extract("text", METHOD, 1)).alias("method"), F.regexp_extract_all("text", F.lit(ATTRIBUTE), F.lit(1)).alias("attributes")
    )
    # a file's classes are apart, so a line lies in the last class that begins before it or in none
    last = F.last("c", ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    inside = heads.unionByName(parts, allowMissingColumns=True).withColumn("c", last).where("line < c.end")
    own = {x: F.when(F.col("line") > F.col("c.start"), F.col(x)).alias(x) for x in ("method", "attributes")}
    rows = inside.select("path", "c.name", F.col("c.start").alias("line"), (F.col("c.end") - F.col("c.start")).alias("loc"), *own.values())
    prefix = F.split_part("method", F.lit("_"), F.lit(1))
    return rows.groupBy("path", "name", "line", "loc").agg(
        F.count("method").alias("methods"), F.count_distinct(F.when(~prefix.isin("", "test"), prefix)).alias("prefixes"), F.size(F.array_distinct(F.flatten(F.collect_set("attributes")))).cast("long").alias("attributes")
    )
