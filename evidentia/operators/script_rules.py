"""Rules for Dart, GDScript, React and script imports, and private Python imports, over numbered source lines (path, line, text).

Every rule is a test per line, a running window within a file or an equi-join on (path, word); files are never gathered. Null texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import detectors, resolve

#: Patterns.
EMPTY_CATCH = r"catch\s*\(\s*\w+\s*\)\s*\{\s*\}"
PRINT = r"^\s*print\s*\("
ASYNC_WITH_CONTEXT = r"(?:Future|void)\s+\w+\s*\([^)]*BuildContext[^)]*\)\s*async\b"
LOAD, PRELOAD = r"""\bload\s*\(\s*"res://""", r"""\bpreload\s*\(\s*"res://"""
NODE_PATH = r"""get_node\s*\(\s*"|\$\w+(/\w+){2,}"""
EMPTY_EFFECT = r"useEffect\s*\(\s*\(\s*\)\s*=>\s*\{\s*\}\s*"
HOOK, CONDITION = r"\buse[A-Z]\w+\s*\(", r"^\s*(?:if|else|for|while|switch)\b"
NAMED_IMPORT, DEFAULT_IMPORT = r"""import\s+(?:type\s+)?\{\s*([^}]+)\}\s+from\s+['"]""", r"""import\s+(?:type\s+)?(\w+)\s+from\s+['"]"""


def _tested(path: Column, folders: list[str]) -> Column:
    hits = [path.contains(f) for f in folders]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def _counted(lines: DataFrame, rules: dict[str, tuple[Column, int]]) -> DataFrame:
    """Per file, the rules that hold on at least so many lines; they stand at line 0."""
    own = lines.groupBy("path").agg(*(F.count(F.when(test, 1)).alias(name) for name, (test, _) in rules.items()))
    hits = F.array_compact(F.array(*(F.when(F.col(name) >= least, F.struct(F.lit(name).alias("rule"), F.col(name).alias("n"))) for name, (_, least) in rules.items())))
    return own.select("path", F.explode(hits).alias("h")).select("path", "h.rule", F.lit(0).alias("line"), "h.n")


def dart_patterns(lines: DataFrame) -> DataFrame:
    """(path, rule, line, n): empty catch blocks, async functions with a BuildContext that the next 30 lines use beside an await, files with three prints."""
    own = lines.where((text.extension(F.col("path")) == "dart") & ~_tested(F.col("path"), ["_test.dart", "/test/", "/integration_test/"]))
    code = own.where(~F.ltrim("text").startswith("//"))
    after = Window.partitionBy("path").orderBy("line").rowsBetween(1, 30)
    seen = [F.max(F.col("text").rlike(p).cast("int")).over(after) == 1 for p in (r"\bBuildContext\b", r"\bawait\b")]
    gaps = own.withColumn("gap", seen[0] & seen[1]).where(F.col("text").rlike(ASYNC_WITH_CONTEXT) & F.col("gap"))
    one = F.lit(1).cast("long").alias("n")
    catches = code.where(F.col("text").rlike(EMPTY_CATCH)).select("path", F.lit("empty_catch").alias("rule"), "line", one)
    return catches.union(gaps.select("path", F.lit("build_context_async").alias("rule"), "line", one)).union(_counted(code, {"debug_prints": (F.col("text").rlike(PRINT), 3)}))


def gdscript_patterns(lines: DataFrame) -> DataFrame:
    """(path, rule, line, n): loads that could be preloads, and files with many node paths, loads or prints."""
    code = lines.where((text.extension(F.col("path")) == "gd") & ~_tested(F.col("path"), ["/test/", "/tests/"]) & ~F.ltrim("text").startswith("#"))
    loads = F.col("text").rlike(LOAD) & ~F.col("text").rlike(PRELOAD)
    fixed = code.where(loads & F.ltrim("text").rlike("^(var|const) ")).select("path", F.lit("prefer_preload").alias("rule"), "line", F.lit(1).cast("long").alias("n"))
    return fixed.union(_counted(code, {"deep_node_paths": (F.col("text").rlike(NODE_PATH), 5), "excessive_load": (loads, 3), "debug_prints": (F.col("text").rlike(PRINT), 3)}))


def empty_effects(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("text").rlike(EMPTY_EFFECT)).select("path", "line")


def hooks_in_conditions(lines: DataFrame) -> DataFrame:
    """Hook calls inside the braces of a condition or loop. A condition holds from its line until the depth of braces is back at what it was
    before it; a later condition takes its place. So a line is inside if no depth since the last condition line was as low as that."""
    order = Window.partitionBy("path").orderBy("line")
    deep = lines.join(detectors.brace_depth(lines), ["path", "line"])
    before = F.coalesce(F.lag("depth").over(order), F.lit(0))
    marked = deep.withColumns({"before": before, "starts": F.col("text").rlike(CONDITION).cast("int")}).withColumn("part", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy("path", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("part") > 0) & (F.min("depth").over(since) > F.first("before").over(since))
    return marked.withColumn("inside", inside).where(F.col("inside") & F.col("text").rlike(HOOK)).select("path", "line")


def script_imports(lines: DataFrame) -> DataFrame:
    """(path, line, name, type_only): names bound by braces (aliases count, a leading `type` does not) or, without braces, by default."""
    named, default = F.regexp_extract("text", NAMED_IMPORT, 1), F.regexp_extract("text", DEFAULT_IMPORT, 1)
    alias = F.transform(F.split(named, ","), lambda s: F.trim(F.when(F.contains(F.trim(s), F.lit(" as ")), F.split_part(F.trim(s), F.lit(" as "), F.lit(2))).otherwise(F.regexp_replace(F.trim(s), "^type ", ""))))
    names = F.when(named != "", alias).when(default != "", F.array(default)).otherwise(F.array().cast("array<string>"))
    return lines.select("path", "line", F.explode(names).alias("name"), F.col("text").rlike(r"import\s+type\b").alias("type_only")).where("name <> ''")


def unused_script_imports(lines: DataFrame) -> DataFrame:
    """Imported names that no later line holds as a word, lines that begin with // or * aside; React in .tsx and .jsx counts as used."""
    code = lines.where(~F.ltrim("text").rlike(r"^(//|\*)"))
    words = code.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    last = words.groupBy("path", "name").agg(F.max("line").alias("last"))
    implicit = (F.col("name") == "React") & F.col("path").rlike(r"\.(tsx|jsx)$")
    return script_imports(lines).where(~implicit).join(last, ["path", "name"], "left").where("last is null or last <= line").select("path", "line", "name", "type_only")


def private_imports(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, private_name, resolved): the first import in a file of a private module or name (a leading underscore, `__init__` and `__main__`
    aside) that resolves to a known file of another folder."""
    t = F.trim("text")
    words = lambda s: F.transform(F.split(s, ","), lambda x: F.btrim(F.split_part(F.trim(x), F.lit(" "), F.lit(1)), F.lit("(),")))
    private = lambda s: s.startswith("_") & ~s.isin("__init__", "__main__")
    first = lambda m: F.filter(F.split(F.regexp_replace(m, r"^\.+", ""), r"\."), private)
    plain = F.when(t.rlike(r"^import\s"), words(F.regexp_extract(t, r"^import\s+(.+)$", 1))).otherwise(F.array().cast("array<string>"))
    base, items = F.regexp_extract(t, r"^from\s+([.\w]+)\s+import\s+(.+)$", 1), words(F.regexp_extract(t, r"^from\s+([.\w]+)\s+import\s+(.+)$", 2))
    pair = lambda m, n: F.struct(m.alias("module"), n.alias("name"))
    of_plain = F.transform(F.filter(plain, lambda m: F.size(first(m)) > 0), lambda m: pair(m, first(m)[0]))
    of_base = F.transform(F.slice(first(base), 1, 1), lambda n: pair(base, n))
    of_items = F.when(base != "", F.transform(F.filter(items, private), lambda n: pair(F.when(base.endswith("."), F.concat(base, n)).otherwise(F.concat(base, F.lit("."), n)), n))).otherwise(F.filter(of_base, lambda _: F.lit(False)))
    found = lines.where(text.extension(F.col("path")) == "py").select(F.col("path").alias("importer"), "line", F.explode(F.concat(of_plain, of_base, of_items)).alias("c")).select("importer", "line", "c.module", "c.name")
    tried = found.select("importer", "module").distinct()
    relative = F.col("module").startswith(".")
    known = resolve.resolve_relative(tried.where(relative), files).union(resolve.resolve_absolute(tried.where(~relative), files))
    hits = found.join(known, ["importer", "module"]).where(text.parent(F.col("importer")) != text.parent(F.col("target")))
    return hits.groupBy(F.col("importer").alias("path"), F.col("name").alias("private_name"), F.col("target").alias("resolved")).agg(F.min("line").alias("line"))
