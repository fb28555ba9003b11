"""Import resolution, project markers, registries and similar function bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators.asof import sum_before
from evidentia.sources.written import written

#: Fixed values, in the order in which a project is tested for them: (language, extensions, depth, large-file lines, complexity threshold, marker files; `*` stands for a name before an extension).
LANGUAGES = [
    ("python", "py", "Full", 300, 20, "setup.py pyproject.toml requirements.txt Pipfile"),
    ("typescript", "ts tsx", "Standard", 300, 20, "tsconfig.json package.json"),
    ("javascript", "js jsx mjs", "Standard", 300, 20, "package.json"),
    ("go", "go", "Full", 400, 20, "go.mod go.sum"),
    ("csharp", "cs", "Standard", 400, 25, "global.json *.csproj *.sln"),
    ("dart", "dart", "Standard", 300, 20, "pubspec.yaml pubspec.lock"),
    ("rust", "rs", "Standard", 400, 20, "Cargo.toml Cargo.lock"),
    ("java", "java", "Standard", 400, 25, "pom.xml build.gradle build.gradle.kts"),
    ("kotlin", "kt kts", "Shallow", 350, 20, "build.gradle.kts build.gradle settings.gradle.kts"),
    ("ruby", "rb", "Standard", 300, 20, "Gemfile Rakefile .ruby-version"),
    ("php", "php", "Standard", 300, 20, "composer.json composer.lock"),
    ("swift", "swift", "Shallow", 400, 20, "Package.swift *.xcodeproj *.xcworkspace"),
    ("scala", "scala", "Standard", 400, 20, "build.sbt project/build.properties"),
    ("bash", "sh bash", "Shallow", 200, 15, ""),
    ("lua", "lua", "Shallow", 300, 20, ".luarc.json .luacheckrc"),
    ("perl", "pl pm", "Minimal", 300, 20, "Makefile.PL cpanfile"),
    ("haskell", "hs", "Shallow", 300, 20, "stack.yaml cabal.project *.cabal"),
    ("elixir", "ex exs", "Shallow", 300, 20, "mix.exs"),
    ("erlang", "erl hrl", "Minimal", 300, 20, "rebar.config rebar.lock"),
    ("fsharp", "fs fsx", "Minimal", 300, 20, "*.fsproj"),
    ("ocaml", "ml mli", "Minimal", 300, 20, "dune-project *.opam"),
    ("nim", "nim", "Minimal", 300, 20, "*.nimble"),
    ("zig", "zig", "Shallow", 400, 20, "build.zig"),
    ("solidity", "sol", "Shallow", 400, 20, "foundry.toml hardhat.config.js hardhat.config.ts truffle-config.js"),
    ("powershell", "ps1 psm1", "Minimal", 200, 15, ""),
    ("r", "R r", "Minimal", 300, 20, "DESCRIPTION .Rproj"),
    ("gdscript", "gd", "Standard", 300, 20, "project.godot"),
    ("cpp", "cpp cc cxx hpp h", "Standard", 500, 25, "CMakeLists.txt Makefile meson.build"),
    ("c", "c h", "Shallow", 500, 25, "CMakeLists.txt Makefile"),
    ("clojure", "clj cljs cljc", "Minimal", 300, 20, "project.clj deps.edn"),
]


def languages(spark: SparkSession) -> DataFrame:
    rows = [(n, k, e.split(), d, lines, c, m.split()) for n, (k, e, d, lines, c, m) in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "priority int, language string, extensions array<string>, depth string, large_lines int, complexity int, markers array<string>")


def detected(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files (project, path): the first language, in order, of which a marker file lies at the place that its name says."""
    names = F.array("path", F.concat(F.lit("*."), F.regexp_extract("path", r"^[^/]+\.([^./]+)$", 1)))
    top = files.select("project", F.explode(names).alias("path"))
    known = languages(spark).select("priority", "language", F.explode("markers").alias("path"))
    return top.join(F.broadcast(known), "path").groupBy("project").agg(F.min_by("language", "priority").alias("language"))  # one row per marker


def extension_counts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files by known extension, with their language."""
    known = languages(spark).select("language", F.explode("extensions").alias("ext"))
    return files.select(text.extension(F.col("path")).alias("ext")).join(F.broadcast(known), "ext").groupBy("ext", "language").agg(F.count("*").alias("files"))


def _first_known(imports: DataFrame, keys: list[str], candidates: Column, files: DataFrame) -> DataFrame:
    """The first candidate path that exists: one equi-join on candidates, the least place wins. Candidates follow from the keys, so each set of keys is tried once, however many
    importers share it."""
    tried = imports.select(*keys).distinct().select(*keys, F.posexplode(candidates).alias("place", "target"))
    hits = tried.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return imports.join(hits.groupBy(*keys).agg(F.min_by("target", "place").alias("target")), keys).select(*imports.columns, "target")


def resolve_absolute(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer, module): a/b.py, a/b/__init__.py, then ever shorter prefixes of the module."""
    parts = F.split("module", r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    both = F.flatten(F.transform(prefixes, lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    return _first_known(imports.distinct(), ["module"], both, files)


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer, module with leading dots): n dots climb n - 1 directories; without a tail it is the package itself."""
    dots = F.length(F.regexp_extract("module", r"^(\.+)", 1))
    tail = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    dirs = F.split("importer", "/")
    base = F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - dots, F.lit(0))), "/")
    at = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
    named = F.array(F.concat("_at", "_tail", F.lit(".py")), F.concat("_at", "_tail", F.lit("/__init__.py")))
    candidates = F.when(F.col("_tail") == "", F.array(F.concat("_at", F.lit("__init__.py")))).otherwise(named)
    return _first_known(imports.distinct().withColumns({"_at": at, "_tail": tail}), ["_at", "_tail"], candidates, files).drop("_at", "_tail")


def normalised(path: Column) -> Column:
    """Folds `.` and `..`: a fold over the parts."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            F.array().cast("array<string>"),
            lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))),
        ),
        "/",
    )


def script_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer, module, folder): the path itself, then with .ts .tsx .js .jsx, then its index files."""
    joined = normalised(F.concat("folder", F.lit("/"), "module"))
    tails = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
    return _first_known(imports.distinct(), ["folder", "module"], F.transform(F.array(*map(F.lit, tails)), lambda t: F.concat(joined, t)), files)


def resolve_script(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer, module) of scripts: relative specifiers only."""
    relative = imports.where(F.col("module").startswith(".")).withColumn("folder", text.parent(F.col("importer")))
    return script_targets(relative, files).drop("folder")


def god_classes(classes: DataFrame) -> DataFrame:
    """classes (path, name, methods, loc, prefixes): at least two of: 20 methods, 500 lines, over 15 methods with over 5 name prefixes."""
    rules = {"too_many_methods": F.col("methods") >= 20, "too_many_lines": F.col("loc") >= 500, "low_cohesion": (F.col("methods") > 15) & (F.col("prefixes") > 5)}
    out = classes.withColumn("rules", F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items()))))
    return out.where(F.size("rules") >= 2).select("path", "name", F.array_join("rules", ",").alias("rules"))


def responsibilities(classes: DataFrame) -> DataFrame:
    """classes (path, name, methods, attributes): low_cohesion from 10 methods and 8 attributes on, too_many_methods from 15 on."""
    kinds = F.array_compact(F.array(F.when((F.col("methods") >= 10) & (F.col("attributes") >= 8), "low_cohesion"), F.when(F.col("methods") >= 15, "too_many_methods")))
    return classes.select("path", "name", F.explode(kinds).alias("kind"))


def facades(lines: DataFrame, least: int = 5) -> DataFrame:
    """Files with five relative re-export lines or more."""
    return lines.where(F.col("text").rlike(r"^from \.\w* import")).groupBy("path").agg(F.count("*").alias("reexports")).where(F.col("reexports") >= least)


def collapsed(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """ranked (id, rank), members (cluster, id): a finding's first cluster by name, of two or more, is shown by its first finding."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2")
    own = members.join(sizes, "cluster").groupBy("id").agg(F.min(F.struct("cluster", "n")).alias("c")).select("id", "c.*")
    rows = ranked.join(own, "id", "left")
    single = rows.where("cluster is null").select("id", "rank", "cluster", "n")
    shown = rows.where("cluster is not null").groupBy("cluster", "n").agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank")).select("id", "rank", "cluster", "n")
    return single.unionByName(shown)


def decayed(events: DataFrame, most: int = 3) -> DataFrame:
    """events (reminder, seq): each with its count so far; from the fourth on it is suppressed."""
    counted = sum_before(events.select("reminder", "seq", F.lit(1).alias("one")), ["reminder"], "one", "n")  # by ranges of seq
    n = F.col("n") + 1
    return counted.select("reminder", "seq", F.least(n, F.lit(most)).cast("int").alias("count"), (n > most).alias("suppressed"))


def priorities(decisions: DataFrame) -> DataFrame:
    """impact x irreversibility x divergence x uncertainty over the nearest effort of 1, 3, 10."""
    effort = F.when(F.col("effort") <= 2, 1).when(F.col("effort") <= 6, 3).otherwise(10)
    return decisions.withColumn("priority", F.col("impact") * F.col("irreversibility") * F.col("divergence") * F.col("uncertainty") / effort)


def top_decisions(decisions: DataFrame, least: float = 8.0, n: int = 2) -> DataFrame:
    return priorities(decisions).where(F.col("priority") >= least).orderBy(F.desc("priority"), "id").limit(n).select("id", "priority")


def similar_bodies(functions: DataFrame, least_lines: int = 15, similarity: float = 0.9) -> DataFrame:
    """(a, b, similarity): functions (name, file, body) of different files whose normalised lines have 2 LCS / (n + m) of 0.9 or more.

    Equal bodies are one class, and lines are known by 128 bits of their digest, so no text is shuffled and a pair of bodies is compared once, however many functions share them.
    Lossless candidates: lines are numbered by occurrence and ordered by rarity; a pair that similar shares a line among the first
    n - ceil(9 n / 11) + 1 of both. Lines that one body alone holds come first and are counted only. Candidates are an equi-join on the others, lengths are compared before any line,
    and only then is the LCS taken, in batches.
    Lines that very many bodies share sort last and hardly ever become keys.
    """
    members, bodies = _body_classes(functions, least_lines)
    each = bodies.select("id", "n", F.explode(_numbered(F.col("lines"))).alias("key"))
    held = each.groupBy("key").agg(F.count("*").alias("held_by")).where("held_by > 1")
    ranked = each.join(held, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held_by", "key"))).alias("shared"))  # the lines of one body
    first = F.col("n") - F.ceil(F.col("n") * 9 / 11) + 1 - (F.col("n") - F.size("shared"))
    keys = written(ranked.where(first > 0).select("id", "n", F.explode(F.array_distinct(F.slice("shared.key", F.lit(1), first.cast("int")))).alias("key")))
    a, b = keys.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "key"), keys.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "key")
    bound = 2 * F.least("n_a", "n_b") >= similarity * (F.col("n_a") + F.col("n_b"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & bound).select("a", "b").distinct()
    side = lambda s: bodies.select(F.col("id").alias(s), F.col("lines").alias(f"lines_{s}"))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2.0 * _lcs(list(p), list(q)) / (len(p) + len(q)) for p, q in zip(x, y, strict=True)])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", ratio("lines_a", "lines_b").alias("similarity")).where(F.col("similarity") >= similarity)
    x, y = (members.select(F.col("id").alias(f"id_{s}"), F.col("name").alias(s), F.col("file").alias(f"file_{s}")) for s in "xy")
    alike = both.select(F.col("a").alias("id_x"), F.col("b").alias("id_y"), "similarity").join(x, "id_x").join(y, "id_y").where("x <> y")
    equal = x.join(y, F.col("id_x") == F.col("id_y")).where("x < y").withColumn("similarity", F.lit(1.0)).where(F.col("similarity") >= similarity)
    found = alike.where("file_x <> file_y").select("x", "y", "similarity").union(equal.where("file_x <> file_y").select("x", "y", "similarity"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _digest(x: Column) -> Column:
    return F.substring(F.unhex(F.sha2(x, 256)), 1, 16)


def _body_classes(functions: DataFrame, least_lines: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, name, file) and bodies (id, lines, n), written: a body's digest and the digests of its lines. A body's lines go by its digest once."""
    whole = text.body_normalised(F.col("body"))
    read = functions.select("name", "file", whole.alias("whole")).withColumn("lines", F.split("whole", "\n")).where(F.size("lines") >= least_lines)
    own = written(read.select("name", "file", _digest(F.col("whole")).alias("id"), F.transform("lines", _digest).alias("lines")))
    bodies = own.groupBy("id").agg(F.first("lines").alias("lines"))
    return own.select("id", "name", "file"), written(bodies.withColumn("n", F.size("lines")))


def _numbered(lines: Column) -> Column:
    """A name for each of the lines with its number among its equals: places in sorted order, less the place where the run of equals starts."""
    def names(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(ordered)))
        named = lambda start, end: F.transform(F.sequence(F.lit(0), end - start - 1), lambda k: F.xxhash64(F.get(ordered, start), k))
        return F.flatten(F.zip_with(starts, ends, named))

    # the sorted lines are an array's element, so that they are sorted once
    return F.transform(F.array(F.array_sort(lines)), names)[0]


def _lcs(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, all places of x at once as the bits of one number: a zero is a place that a subsequence uses."""
    where: dict[str, int] = {}
    for i, line in enumerate(x):
        where[line] = where.get(line, 0) | 1 << i
    full = (1 << len(x)) - 1
    free = full
    for line in y:
        met = free & where.get(line, 0)
        free = (free + met | free - met) & full
    return len(x) - free.bit_count()
