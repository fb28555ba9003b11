"""Detectors over numbered source lines (path, line, text): rule scans, running scopes, look-ahead, per-file counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

#: Fixed values: (name, confidence, pattern).
SECURITY = [
    ("hardcoded_api_key", "high", r"""(?i)(api[_-]?key|apikey)\s*[:=]\s*["'][a-zA-Z0-9_\-]{20,}"""),
    ("hardcoded_token", "high", r"""(?i)(token|bearer|jwt)\s*[:=]\s*["'][a-zA-Z0-9_\-.]{20,}"""),
    ("hardcoded_password", "medium", r"""(?i)(password|passwd|pwd)\s*[:=]\s*["'][^"']{8,}"""),
    ("secret_variable", "high", r"""(?i)(secret|private[_-]?key|aws[_-]?secret)\s*[:=]\s*["'][^"']+["']"""),
    ("insecure_random", "low", r"\brandom\.(random|randint|choice|randrange)\b"),
    ("math_random", "low", r"\bMath\.random\(\)"),
    ("weak_hash_md5", "medium", r"(?i)\b(md5|sha1)\s*\("),
    ("ssl_verify_disabled", "high", r"(?i)(verify\s*=\s*False|CERT_NONE|SSL_VERIFY_NONE)"),
    ("logging_sensitive", "medium", r"(?i)(log|print|console\.log|logger)\s*\(.*\b(password|secret|token|api[_-]?key)\b"),
    ("sql_format_string", "high", r"""(?i)(execute|query|raw)\s*\(\s*(f"|f'|"[^"]*%|"[^"]*\{|`[^`]*\$\{)"""),
    ("eval_usage", "high", r"\beval\s*\("),
    ("shell_injection", "low", r"(?i)(subprocess|os\.system|os\.popen|exec|shell_exec)\s*\("),
    ("pickle_load", "medium", r"\bpickle\.(load|loads)\s*\("),
    ("yaml_unsafe_load", "medium", r"\byaml\.(load|unsafe_load)\s*\("),
]
#: Fixed values of the same form.
TS_SECURITY = [
    ("eval_usage", "high", r"\beval\s*\("),
    ("innerhtml", "high", r"\.innerHTML\s*="),
    ("dangerously_set_innerhtml", "high", r"dangerouslySetInnerHTML"),
    ("hardcoded_secret", "medium", r"""(?i)(?:api[_-]?key|secret|token|password|auth)\s*[:=]\s*['"][^'"]{8,}['"]"""),
    ("open_redirect", "medium", r"""window\.location\s*=\s*[^'";\n]*(?:req|params|query|input)"""),
    ("document_write", "high", r"document\.write\s*\("),
    ("new_function", "high", r"new\s+Function\s*\("),
]
TS_SMELLS = [
    ("empty_catch", "high", r"catch\s*\([^)]*\)\s*\{\s*\}"),
    ("any_type", "high", r":\s*any\b"),
    ("ts_ignore", "high", r"@ts-ignore|@ts-nocheck"),
    ("non_null_assert", "medium", r"\w+!\.\w+"),
    ("todo_fixme", "medium", r"(?i)//\s*(TODO|FIXME|HACK|XXX)\b"),
    ("magic_number", "low", r"(?:if|while|for|===|!==|>|<|>=|<=)\s*(?:\d{3,}|0x[0-9a-f]{3,})"),
]
CS_SECURITY = [
    ("sql_injection", "high", r"""(?i)new\s+SqlCommand\s*\(\s*(\$"|"[^"]*"\s*\+|string\.Format)"""),
    ("sql_injection_exec", "high", r"""(?i)\.CommandText\s*=\s*(\$"|"[^"]*"\s*\+|string\.Format)"""),
    ("binary_formatter", "high", r"(?i)\b(BinaryFormatter|SoapFormatter)\b"),
    ("javascript_serializer", "medium", r"\bJavaScriptSerializer\b"),
    ("tls_bypass", "high", r"(?i)ServerCertificateValidationCallback\s*[+=]"),
    ("insecure_rng", "medium", r"(?i)new\s+Random\(\).*(?:token|password|secret|key|salt|nonce|iv)"),
    ("hardcoded_connstr", "medium", r"""(?i)(Password|Pwd)\s*=\s*[^;"]+"""),
]
GO_PATTERNS = [("ignored_error", "medium", r"^\s*\w+(?:,\s*_)\s*[:=]=?\s*\w+"), ("discarded_error", "medium", r"^\s*_\s*=\s*\w+.*\("), ("goroutine", "low", r"^\s*go\s+func\s*\(")]
#: Fixed values: (signal, weight in tenths, least count, pattern).
COMPLEXITY = [
    ("nested_control", 15, 3, r"^(\s{12,})(if |for |while |elif )"),
    ("long_functions", 5, 0, r"^\s{0,4}(def |fn |func |function )"),
    ("boolean_chains", 20, 2, r"\b(and|or|&&|\|\|)\b.*\b(and|or|&&|\|\|)\b"),
    ("exception_handlers", 10, 5, r"^\s*(except|catch|rescue)\b"),
]


def lines_of(files: DataFrame) -> DataFrame:
    """Numbered lines of (path, content), from 1; a last line break ends the last line."""
    body = F.regexp_replace("content", r"\r?\n$", "")
    return files.where("content <> ''").select("path", F.posexplode(F.split(body, r"\r?\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^(#|//|\*|/\*)")


def rule_hits(lines: DataFrame, rules: list[tuple[str, str, str]], skip_comments: bool = True) -> DataFrame:
    """One row per rule and line: all rules are tested in one pass over the lines, without a join."""
    kept = lines.where(~is_comment(F.col("text"))) if skip_comments else lines
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(c).alias("confidence"))) for n, c, p in rules)))
    return kept.withColumn("h", F.explode(hits)).select("path", "line", "h.rule", "h.confidence")


def security(lines: DataFrame, test_paths: Column) -> DataFrame:
    """Security rules on lines that are no comment; in tests the confidence is low."""
    return rule_hits(lines, SECURITY).withColumn("confidence", F.when(test_paths, "low").otherwise(F.col("confidence")))


def counted_hits(lines: DataFrame, rules: list[tuple[str, str, str]], least: int = 1) -> DataFrame:
    """Per file and rule: count and first line."""
    return rule_hits(lines, rules).groupBy("path", "rule").agg(F.count("*").alias("n"), F.min("line").alias("first_line")).where(F.col("n") >= least)


def large_files(lines: DataFrame, most: int = 300) -> DataFrame:
    return lines.groupBy("path").agg(F.count("*").alias("loc")).where(F.col("loc") > most)


def complexity(lines: DataFrame, least_loc: int = 50, least_score: int = 200) -> DataFrame:
    """Files of 50 lines or more with a score (in tenths): each signal that occurs often enough adds count x weight."""
    counts = [F.count(F.when(F.col("text").rlike(p), 1)).alias(n) for n, _, _, p in COMPLEXITY]
    own = lines.groupBy("path").agg(F.count("*").alias("loc"), *counts).where(F.col("loc") >= least_loc)
    score = sum((F.when(F.col(n) >= k, F.col(n) * w).otherwise(0) for n, w, k, _ in COMPLEXITY), F.lit(0))
    return own.withColumn("score", score).where(F.col("score") >= least_score)


def deepest_indent(lines: DataFrame, more_than: int = 1) -> DataFrame:
    """Per file, the deepest indent in steps of four and the first line that has it."""
    depth = F.floor((F.length("text") - F.length(F.ltrim("text"))) / 4)
    own = lines.where(F.trim("text") != "").withColumn("depth", depth)
    best = own.groupBy("path").agg(F.max(F.struct("depth", (-F.col("line")).alias("back"))).alias("m"))
    return best.select("path", F.col("m.depth").alias("depth"), (-F.col("m.back")).alias("line")).where(F.col("depth") > more_than)


def long_parameters(lines: DataFrame, most: int = 5) -> DataFrame:
    """Single-line Python functions with more than five parameters."""
    params = F.regexp_extract("text", r"^\s*def \w+\((.*)\)\s*:", 1)
    names = F.filter(F.transform(F.split(params, ","), lambda x: F.trim(F.regexp_replace(x, r"[:=].*$", ""))), lambda x: ~x.isin("", "self", "cls", "/", "*"))
    return lines.where(F.col("text").rlike(r"^\s*def \w+\(.*\)\s*:")).select("path", "line", F.size(names).alias("params")).where(F.col("params") > most)


def functions(lines: DataFrame) -> DataFrame:
    """Single-line Python functions: name, file, line, number of parameters."""
    params = F.regexp_extract("text", r"^\s*def \w+\((.*)\)\s*:", 1)
    kept = F.filter(F.split(params, ","), lambda x: ~F.trim(x).isin("", "self", "cls"))
    return lines.where(F.col("text").rlike(r"^\s*def \w+\(.*\)\s*:")).select(F.regexp_extract("text", r"def (\w+)", 1).alias("name"), F.col("path").alias("file"), "line", F.size(kept).alias("params"))


def mutable_globals(lines: DataFrame) -> DataFrame:
    """Names bound to an empty container at column 0, unless written as a constant."""
    name = F.regexp_extract("text", r"^([A-Za-z]\w*)\s*=\s*(?:\[\]|\{\}|set\(\)|dict\(\)|list\(\))", 1)
    return lines.select("path", "line", name.alias("name")).where((F.col("name") != "") & ~F.col("name").rlike(r"^[A-Z0-9_]*_[A-Z0-9_]*$"))


def imports(lines: DataFrame) -> DataFrame:
    """Python imports: module, imported name, and whether they stand inside a function (then they are deferred)."""
    t = F.col("text")
    module = F.coalesce(F.nullif(F.regexp_extract(t, r"^\s*from\s+([.\w]+)\s+import", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^\s*import\s+([.\w]+)", 1), F.lit("")))
    name = F.nullif(F.regexp_extract(t, r"^\s*from\s+[.\w]+\s+import\s+(\w+)", 1), F.lit(""))
    return lines.withColumns({"module": module, "name": name}).where("module is not null").select("path", "line", "module", "name", (F.length(t) > F.length(F.ltrim(t))).alias("deferred"))


def unused_imports(lines: DataFrame) -> DataFrame:
    """From-imports whose name no later line uses: a range anti join on (path, line), done as one maximum per file and word."""
    code = F.regexp_replace("text", r"#.*$", "")
    words = lines.where(~F.col("text").rlike(r"^\s*(from|import)\b")).select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all(code, F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    last = words.groupBy("path", "name").agg(F.max("line").alias("last"))
    found = imports(lines).where("name is not null")
    return found.join(last, ["path", "name"], "left").where("last is null or last < line").select("path", "line", "name")


def uncalled(lines: DataFrame) -> DataFrame:
    """Functions whose name is called on no line that is neither a comment nor their definition."""
    calls = lines.where(~is_comment(F.col("text")) & ~F.col("text").rlike(r"^\s*def ")).select(F.explode(F.regexp_extract_all("text", F.lit(r"\b(\w+)\("), F.lit(1))).alias("name")).distinct()
    return functions(lines).join(calls, "name", "left_anti").select("name", "file", "line")


def scopes(lines: DataFrame) -> DataFrame:
    """Each line with the line of the function it lies in (null outside): the last `def` above it, unless a line at column 0 came between."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_def = F.col("text").rlike(r"^def ")
    top = F.col("text").rlike(r"^\S") & ~is_def
    out = lines.withColumns({"last_def": F.max(F.when(is_def, F.col("line"))).over(w), "last_top": F.max(F.when(top, F.col("line"))).over(w)})
    inside = F.col("last_def").isNotNull() & (F.col("last_top").isNull() | (F.col("last_def") > F.col("last_top")))
    return out.select("path", "line", F.when(inside, F.col("last_def")).alias("def_line"))


def class_blocks(lines: DataFrame) -> DataFrame:
    """Classes at column 0 with their length: up to the line before the next one at column 0 that is not blank."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    top = F.min(F.when(F.col("text").rlike(r"^\S"), F.col("line"))).over(w)
    end = F.max("line").over(Window.partitionBy("path"))
    return lines.select("path", "line", "text", (F.coalesce(top, end + 1) - F.col("line")).alias("loc")).where(F.col("text").rlike(r"^class ")).select("path", "line", F.regexp_extract("text", r"^class (\w+)", 1).alias("name"), "loc")


def brace_depth(lines: DataFrame) -> DataFrame:
    """Depth of braces after each line, never under 0: the running sum less its running minimum below 0."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    net = F.length(F.translate("text", "}", "")) - F.length(F.translate("text", "{", ""))  # opened less closed
    summed = lines.select("path", "line", F.sum(net).over(w).alias("s"))
    return summed.select("path", "line", (F.col("s") - F.least(F.lit(0), F.min("s").over(w))).cast("long").alias("depth"))


def nested_closures(lines: DataFrame, least: int = 3) -> DataFrame:
    return brace_depth(lines).groupBy("path").agg(F.max("depth").alias("depth")).where(F.col("depth") >= least)


def without_follower(lines: DataFrame, start: str, wanted: str, within: int) -> DataFrame:
    """Lines that match `start` where none of the lines from there to `within` on matches `wanted`."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(0, within - 1)
    seen = F.max(F.col("text").rlike(wanted).cast("int")).over(w)
    return lines.withColumn("seen", seen).where(F.col("text").rlike(start) & (F.col("seen") == 0)).select("path", "line")


def console_logs(lines: DataFrame) -> DataFrame:
    """Per file: console calls, the first line, the distinct tags."""
    own = lines.where(F.col("text").rlike(r"console\.(log|warn|error|debug|info|trace)\s*\("))
    tag = F.nullif(F.regexp_extract("text", r"""console\.\w+\s*\(\s*['"`]\[([^\]]+)\]""", 1), F.lit(""))
    return own.groupBy("path").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.array_join(F.sort_array(F.collect_set(tag)), ",").alias("tags"))


def inline_handlers(lines: DataFrame, least: int = 3) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"(on[A-Z]\w+\s*=\s*\{\s*\(\s*\)\s*=>\s*)"), F.lit(1)))
    return lines.groupBy("path").agg(F.sum(n).alias("n")).where(F.col("n") >= least)


def dict_keys(lines: DataFrame, least: int = 4) -> DataFrame:
    """Per file: distinct literal subscripts."""
    key = F.explode(F.regexp_extract_all("text", F.lit(r"""\w\[["'](\w+)["']\]"""), F.lit(1)))
    return lines.select("path", key.alias("key")).groupBy("path").agg(F.count_distinct("key").alias("keys")).where(F.col("keys") >= least)


def debt_signals(lines: DataFrame) -> DataFrame:
    """Files of 30 lines or more: comment share over .3, more than three log calls a function, TODO marks."""
    t = F.col("text")
    own = lines.groupBy("path").agg(
        F.count("*").alias("loc"), F.count(F.when(is_comment(t), 1)).alias("comments"), F.count(F.when(t.rlike(r"\b(logger|console|log)\.\w+\("), 1)).alias("logs"),
        F.count(F.when(t.rlike(r"^\s*(def|function|func) "), 1)).alias("functions"), F.count(F.when(t.rlike("(?i)deprecat"), 1)).alias("deprecated"), F.count(F.when(t.rlike(r"\bTODO\b"), 1)).alias("todos"),
    )
    return own.where("loc >= 30").select("path", (F.col("comments") * 10 > F.col("loc") * 3).alias("comment_heavy"), (F.col("logs") > 3 * F.col("functions")).alias("log_heavy"), ((F.col("deprecated") >= 3) | (F.col("todos") >= 2)).alias("migrating"))


def uncovered(paths: DataFrame) -> DataFrame:
    """Production files (path, zone) without a test file that is named after them."""
    stem = F.lower(text.stem(F.col("path")))
    prod = paths.where("zone = 'production'").select("path", stem.alias("stem"))
    forms = F.array(F.concat(F.lit("test_"), "stem"), F.concat("stem", F.lit("_test")), F.concat("stem", F.lit(".test")), F.concat("stem", F.lit(".spec")), F.concat("stem", F.lit("_spec")), F.concat("stem", F.lit("test")))
    tests = paths.where("zone <> 'production'").select(stem.alias("form")).distinct()
    covered = prod.select("path", F.explode(forms).alias("form")).join(tests, "form", "left_semi").select("path")
    return prod.join(covered, "path", "left_anti").select("path")


def without_lines(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """The fixer: files (path, content) rebuilt without the listed (path, line)."""
    kept = lines.join(gone.select("path", "line"), ["path", "line"], "left_anti")
    built = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    return built.select("path", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("content"))
