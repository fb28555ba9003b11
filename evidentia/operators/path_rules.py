"""Many globs against many paths: each glob is looked up by the literal part of it that the fewest globs share, so that globs x paths is an equi-join and a test of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text

#: Globs without a literal part meet every path; the paths are dealt over so many salts.
SALTS = 64
#: Up to so many globs that share `by` are tested one by one, which is less than a path's own keys.
FEW = 32
#: A piece of a path or a literal (digits, or what is neither digit nor mark), and the most characters of it that are looked up.
PIECE, WIDTH = r"([0-9]+|[^0-9/._*?\-]+)", 12
#: Characters that a glob must not hold.
UNSUPPORTED = r"[\[\]{}\\]"


def regex(glob: Column, spanning: bool = False) -> Column:
    """`*` is any run, slashes included, `?` one character, a leading `**/` may be left out; spanning: so may one between slashes."""
    kept = F.regexp_replace(glob, r"([.^$|()+\\\[\]{}])", r"\\$1")
    kept = F.regexp_replace(kept, r"^\*\*/", "\u0001")
    if spanning:
        kept = F.regexp_replace(kept, r"/\*\*/", "/\u0001")
    kept = F.regexp_replace(F.regexp_replace(kept, r"\*+", ".*"), r"\?", ".")
    return F.concat(F.lit("(?s)^"), F.replace(kept, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("$"))


def _needs(glob: Column) -> tuple[Column, Column]:
    """What a path that the glob matches surely holds, its longest piece without wildcards, and what it surely ends in: two tests that are cheaper than an expression made anew for each pair.
    A slash after `**` may be left out with it."""
    pieces = F.split(F.regexp_replace(glob, r"\*\*/", "*"), r"[*?]")
    return F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("text"))))["text"], F.regexp_replace(glob, r"(?s)^.*[*?]/?", "")


def _glob_keys(glob: Column) -> Column:
    """What a path must have for the glob to match it: the folder before the first wildcard, a literal base name, a literal extension, and pieces of names."""
    folder = F.regexp_extract(glob, r"^([^*?]*/)", 1)
    base = F.regexp_extract(glob, r"^(?:.*/)?([^*?/]+)$", 1)
    whole = F.when(F.contains(glob, F.lit("/")) | ~glob.rlike(r"[*?]"), base).otherwise("")
    ext = F.regexp_extract(glob, r"(\.[^*?/.]+)$", 1)
    named = F.array(*(F.when(value != "", F.concat(F.lit(kind), value)) for kind, value in (("d:", folder), ("b:", whole), ("e:", ext))))
    pieces = F.transform(F.regexp_extract_all(glob, F.lit(PIECE), F.lit(1)), lambda x: F.concat(F.lit("p:"), F.substring(x, 1, WIDTH)))
    return F.array_distinct(F.concat(F.array_compact(named), pieces))


def _path_keys(path: Column) -> Column:
    """All keys by which a glob can find the path; of its pieces, every run of up to WIDTH characters."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    above = F.when(F.size(folders) > 0, F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(folders, F.lit(1), n), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    ext = F.regexp_extract(path, r"(\.[^/.]+)$", 1)
    runs = lambda x: F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(WIDTH), F.length(x) - at + 1)), lambda n: F.concat(F.lit("p:"), x.substr(at, n)))))
    pieces = F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(path, F.lit(PIECE), F.lit(1))), runs))
    return F.array_distinct(F.concat(above, F.array(F.concat(F.lit("b:"), text.basename(path)), F.concat(F.lit("e:"), ext), F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("string")), pieces))


def matches(paths: DataFrame, globs: DataFrame, by: list[str], spanning: bool = False) -> DataFrame:
    """paths (by..., path) and globs (by..., glob) to distinct (by..., path, glob) that match.

    A few globs to each of `by` are tested one by one. Of many, each is looked up by that key of it which the fewest globs have (of equals the longest): with c globs to a key, a path
    meets at most c times its own keys, however many paths there are."""
    patterns, own = globs.select(*by, "glob").distinct(), paths.select(*by, "path").distinct()
    fits = F.expr("contains(path, held) and endswith(path, tail) and path rlike regex")
    held, tail = _needs(F.col("glob"))
    tests = [held.alias("held"), tail.alias("tail"), regex(F.col("glob"), spanning).alias("regex")]
    if by and (patterns.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= FEW:
        return own.join(patterns.select(*by, "glob", *tests), by).where(fits).select(*by, "path", "glob")
    keyed = patterns.select(*by, "glob", F.explode_outer(_glob_keys(F.col("glob"))).alias("key"))
    shared = keyed.groupBy(*by, "key").agg(F.count("*").alias("globs"))
    rarest = F.min_by("key", F.struct("globs", -F.length("key"), "key"))
    chosen = keyed.where("key is not null").join(shared, [*by, "key"]).groupBy(*by, "glob").agg(rarest.alias("key"))
    free = keyed.where("key is null").select(*by, "glob", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<string>")).alias("key"))
    indexed = chosen.unionByName(free).select(*by, "glob", F.xxhash64("key").alias("hash"), *tests)
    hashes = F.array_distinct(F.transform(_path_keys(F.col("path")), lambda x: F.xxhash64(x)))
    found = own.select(*by, "path", F.explode(hashes).alias("hash"))
    return found.join(indexed, [*by, "hash"]).where(fits).select(*by, "path", "glob")


def violations(paths: DataFrame, writes: DataFrame, protected: DataFrame, by: list[str]) -> DataFrame:
    """(by..., path, outside, blocked): changed paths that no write glob matches, or that a protected glob does."""
    marked = lambda globs, name: matches(paths, globs, by, spanning=True).select(*by, "path").distinct().withColumn(name, F.lit(True))
    out = paths.select(*by, "path").distinct().join(marked(writes, "written"), [*by, "path"], "left").join(marked(protected, "guarded"), [*by, "path"], "left")
    return out.select(*by, "path", F.col("written").isNull().alias("outside"), F.col("guarded").isNotNull().alias("blocked")).where("outside or blocked")


def intersections(files: DataFrame, writes: DataFrame, protected: DataFrame, by: list[str]) -> DataFrame:
    """writes and protected (by..., place, glob) to one row (by..., problem, what) per key with a problem: an unsupported glob, else, in the order of writes and then protected globs,
    a guard that meets a literal write or is a literal that the write meets, or the first file that both match."""
    bad = (F.col("glob") == "") | F.col("glob").rlike(UNSUPPORTED)
    both = writes.select(*by, F.lit(0).alias("side"), "place", "glob").union(protected.select(*by, F.lit(1), "place", "glob"))
    first = lambda df, *order: df.groupBy(*by).agg(F.min(F.struct(*order)).alias("m"))
    invalid = first(both.where(bad), "side", "place", "glob").select(*by, F.lit("unsupported").alias("problem"), F.col("m.glob").alias("what"))
    w, g = (df.where(~bad).groupBy(*by, "glob").agg(F.min("place").alias("place")) for df in (writes, protected))
    named = lambda df, name: df.select(*by, F.col("glob").alias(name), F.col("place").alias(f"at_{name}"))
    literal = lambda df: df.where(~F.col("glob").rlike(r"[*?]")).select(*by, F.col("glob").alias("path"))
    met = matches(literal(w), g, by).select(*by, F.col("path").alias("w"), F.col("glob").alias("g")).union(matches(literal(g), w, by).select(*by, F.col("glob").alias("w"), F.col("path").alias("g")))
    direct = met.join(named(w, "w"), [*by, "w"]).join(named(g, "g"), [*by, "g"]).select(*by, "at_w", "at_g", F.lit(0).alias("kind"), F.col("g").alias("what"))
    # of a file's pairs the first is that of its first write and its first guard
    least = lambda df, name: matches(files, df, by).join(df, [*by, "glob"]).groupBy(*by, "path").agg(F.min("place").alias(f"at_{name}"))
    shared = least(w, "w").join(least(g, "g"), [*by, "path"]).select(*by, "at_w", "at_g", F.lit(1).alias("kind"), F.col("path").alias("what"))
    hits = first(direct.union(shared), "at_w", "at_g", "kind", "what").select(*by, F.lit("protected").alias("problem"), F.col("m.what").alias("what"))
    return invalid.union(hits.join(invalid.select(*by), by, "left_anti"))
