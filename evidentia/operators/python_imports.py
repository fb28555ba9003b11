"""Python imports that nothing uses: names bound by imports, less what guards hide, what `__all__` exports and what later lines mention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators.import_edges import PYTHON_IMPORT, indent, trimmed

#: Guards of imports that are for type checkers, files that are import hubs, the start of an export list, quoted names in it.
TYPE_GUARD = r"^if (typing\.|t\.)?TYPE_CHECKING:"
HUBS = ["__init__.py", "conftest.py"]
ALL_STARTS, QUOTED = r"__all__\s*=\s*\[", r""""([^"]+)"|'([^']+)'"""
PYTHON_FROM_NAMES = r"^from\s+(\S+)\s+import\s+(.+)"


def _upto(order: str = "line", end: int = Window.currentRow):
    return Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, end)


def guarded(lines: DataFrame) -> DataFrame:
    """Lines with t (trimmed) and `guarded`. A `try:` guards what follows until a line with text at column 0, other than the parts of a `try` and type guards; a type guard
    guards until a line with text that is indented as little as it. The lines that open or carry on a guard count as guarded."""
    t, depth = trimmed(F.col("text")), indent(F.col("text"))
    marked = lines.select("path", "line", "text", t.alias("t"), depth.alias("indent"))
    is_guard, is_try = F.col("t").rlike(TYPE_GUARD), F.col("t") == "try:"
    carries_on = F.col("t").startswith("except") | (F.col("t") == "finally:")
    ends = (F.col("t") != "") & (F.col("indent") == 0) & ~is_try & ~is_guard
    last = lambda c: F.max(F.when(c, F.col("line"))).over(_upto())
    # outside a try, `except` and `finally:` lines at column 0 end nothing that holds
    tried = marked.withColumns({"tried": last(is_try), "ended": last(ends & ~carries_on), "part": F.sum(is_guard.cast("int")).over(_upto())})
    since = Window.partitionBy("path", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.min(F.when(~is_guard & (F.col("t") != ""), F.col("indent"))).over(since)
    in_type = (F.col("part") > 0) & F.coalesce(least > F.first("indent").over(since), F.lit(True))
    in_try = F.col("tried").isNotNull() & (F.col("ended").isNull() | (F.col("tried") > F.col("ended")))
    return tried.select("path", "line", "text", "t", (in_type | in_try).alias("guarded"))


def exported(lines: DataFrame) -> DataFrame:
    """(path, name): quoted names from a line that begins an `__all__` list up to the first line with a closing bracket."""
    starts = F.max(F.when(F.col("text").rlike(ALL_STARTS), F.col("line"))).over(_upto())
    closed = F.max(F.when(F.contains("text", F.lit("]")), F.col("line"))).over(_upto(end=-1))
    inside = lines.select("path", "text", starts.alias("starts"), closed.alias("closed")).where("starts is not null and (closed is null or closed < starts)")
    names = F.zip_with(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)), F.regexp_extract_all("text", F.lit(QUOTED), F.lit(2)), lambda a, b: F.concat(a, b))
    return inside.select("path", F.explode(names).alias("name")).distinct()


def bindings(lines: DataFrame) -> DataFrame:
    """(path, line, name): names that imports bind outside guards. Modules without a dot, `__future__`, star imports and lines marked noqa bind nothing here."""
    own = guarded(lines).where(~F.col("guarded") & ~F.col("t").startswith("#") & ~F.contains("t", F.lit("# noqa")))
    module = F.rtrim(F.regexp_extract("t", PYTHON_IMPORT, 1), F.lit(","))
    plain = F.when(F.contains(module, F.lit(".")), F.array(F.split_part(module, F.lit("."), F.lit(1))))
    listed = F.split(F.regexp_extract("t", PYTHON_FROM_NAMES, 2), ",")
    clean = lambda s: F.trim(F.btrim(F.trim(F.rtrim(F.trim(F.split_part(s, F.lit("#"), F.lit(1))), F.lit(","))), F.lit("()")))
    bound = lambda s: F.when(F.contains(s, F.lit(" as ")) & (F.trim(F.substring_index(s, " as ", -1)) != ""), F.trim(F.regexp_extract(s, r"^.*? as (.*)$", 1))).otherwise(s)
    starred = F.exists(listed, lambda s: F.trim(s) == "*")
    named = F.when((F.regexp_extract("t", PYTHON_FROM_NAMES, 1) != "__future__") & ~starred, F.transform(listed, lambda s: bound(clean(s))))
    names = F.coalesce(F.when(F.col("t").rlike(PYTHON_IMPORT), plain).otherwise(F.when(F.col("t").rlike(PYTHON_FROM_NAMES), named)), F.array().cast("array<string>"))
    return own.select("path", "line", F.explode(names).alias("name")).where("name <> ''")


def unused(lines: DataFrame) -> DataFrame:
    """(path, line, name): bound names that the file doesn't export and that no later line of code has as a word. A line's words are
    cut down to the names that its file imports before they are counted."""
    own = lines.where((text.extension(F.col("path")) == "py") & ~text.basename(F.col("path")).isin(*HUBS))
    found = bindings(own)
    names = found.groupBy("path").agg(F.collect_set("name").alias("names"))
    code = own.where(~trimmed(F.col("text")).rlike("^(#|import |from |$)")).join(names, "path")
    words = F.array_intersect(F.regexp_extract_all(F.split_part("text", F.lit("#"), F.lit(1)), F.lit(r"(?U)(\w+)"), F.lit(1)), "names")
    last = code.select("path", "line", F.explode(words).alias("name")).groupBy("path", "name").agg(F.max("line").alias("last"))
    left = found.join(exported(own), ["path", "name"], "left_anti").join(last, ["path", "name"], "left")
    return left.where("last is null or last <= line").select("path", "line", "name")
