"""Fuzzy line dedup by MinHash, DataFrame functions only: character-shingle signatures, high-recall banding, exact Jaccard
verification, then distributed union-find keeping one line per component.

A line with a word has as its set the shingles of up to 9 characters that begin at a word's start, or anywhere in a word
with 8 or more characters to come (so that long words, and text without spaces, are covered too). Its signature is the bottom-12 MinHash sketch: the 12
least shingle hashes, in order. Bands are runs of 3 neighbours in the sketch, at most 10 a line, and for sets of 4 and 5 one more, the
whole set or the set without its middle; two lines are candidates if they share a band. Pairs whose union has up to 19 shingles are all found at
similarity 0.8 (every case was tried). Beyond that recall falls to 0.98 where one line holds the other's set, and to 0.99 where both have as much of their own; by size in the README. Candidates are linked if the exact Jaccard index of their sets is 0.8 or more; buckets are
worked off by leaders (`buckets`), components by contraction. Of a component, equal lines included, the first line in (doc_id,
row, place) order stays; the others are removed from their texts.

Lines are named by a 64-bit hash. Blank lines are layout: they stay and are never compared. Null and empty texts stay as
empty texts. A row is named by a hash of its id and text: rows equal in both share their decisions by place, and different texts
with one id, or without one, are decided on each by itself. A null doc_id comes before all others. An empty
table gives an empty result. Other columns, whatever their names, are kept by `dedup`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.buckets import linked_components

PERCENT = 80
SKETCH, BAND = 12, 3
#: Lines that a join compares with each other in one go.
BLOCK_ROWS = 4096
WITHOUT_ID = -(1 << 63)
#: Each match captures a shingle ahead, then moves on to the next word, or by one character while more than 8 of the word are left.
SHINGLES = r"regexp_extract_all(line, '(?s)(?=(\\S.{0,8}+))(?:\\S{1,8}+(?!\\S)\\s*+|\\S)', 1)"
#: What lines without a word consist of.
SPACES = " \t\n\v\f\r"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, name, pos, line, lid) of lines with a word."""
    split = docs.select("doc_id", "name", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.where(F.btrim("line", F.lit(SPACES)) != "").withColumn("lid", F.xxhash64("line"))


def _set() -> F.Column:
    return F.sort_array(F.array_distinct(F.transform(F.expr(SHINGLES), lambda x: F.xxhash64(x))))


def _bands() -> F.Column:
    def runs(sketch: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(sketch) - (BAND - 1), F.lit(1))), lambda i: F.xxhash64(*(F.try_element_at(sketch, i + k) for k in range(BAND))))

    # 4 common shingles of 5 share no run if the middle one is extra
    middle = F.when(F.size("set") == 4, F.xxhash64("set")).when(F.size("set") == 5, F.xxhash64(F.concat(F.slice("set", 1, 2), F.slice("set", 4, 2))))
    # the sketch is an array's element, so that it is made once and not for every run
    of_sketch = F.transform(F.array(F.slice("set", 1, SKETCH)), lambda sketch: F.array_distinct(runs(sketch)))[0]
    return F.when(F.size("set").between(4, 5), F.array_append(of_sketch, middle)).otherwise(of_sketch)


def shared_bands(banded: DataFrame) -> DataFrame:
    """Distinct (key, rep) of the bands that several lines hold. Bands are dealt by key once; the count, the join and the distinct rows all read that deal."""
    keyed = banded.select(F.explode("bands").alias("key"), F.col("lid").alias("rep")).where("key is not null").repartition("key")
    shared = keyed.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("key")
    # shared keys are unique, so this is a semi-join; as one it would be moved below the deal
    return keyed.join(shared.hint("shuffle_hash"), "key").distinct()


def removed_places(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(name, removed array<int>): the places of lines that go. docs: (doc_id, name, text), with equal names for rows equal in the others."""
    # one row per line of every text, without a shuffle; equal lines meet below, as partial aggregates
    banded = _lines(docs).select("doc_id", "name", "pos", "lid", _set().alias("set")).select("doc_id", "name", "pos", "lid", _bands().alias("bands"))
    banded = tables.written(banded)
    active = tables.written(shared_bands(banded))
    distinct = tables.written(banded.groupBy("lid").agg(F.min(F.struct("doc_id", "name", "pos")).alias("place"), F.count("*").alias("n")))
    # the sets of candidate lines, from the row that holds each first
    wanted = distinct.join(active.select(F.col("rep").alias("lid")).distinct(), "lid", "left_semi").select("place.*", "lid")
    of_row = wanted.groupBy("name").agg(F.collect_list("pos").alias("places"))
    texts = docs.select("name", "text").join(of_row.hint("shuffle_hash"), "name")
    # the lines are an array's element, so that a text is split once
    held = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.transform("places", lambda pos: F.get(lines, pos)))[0]
    # a line is wanted at one place, so its copies are those of equal rows, which lie together
    own = texts.select("name", F.explode(held).alias("line")).withColumn("rep", F.xxhash64("line")).dropDuplicates(["name", "rep"])
    # bit k: whether the set holds an odd number of elements that end in k; sets differ in as many elements as their parities do, at least
    parity = F.expr("aggregate(set, 0L, (bits, h) -> bits ^ shiftleft(1L, cast(h & 63L as int)))")
    sets = tables.written(own.select("rep", _set().alias("set")).select("rep", "set", F.size("set").alias("n"), parity.alias("parity")))

    def judge(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("set").alias(f"set_{side}")), side)
        common = F.size(F.array_intersect("set_a", "set_b"))
        both = pairs.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
        return both.select("a", "b", (100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).alias("linked"))

    def allowed(a: str, b: str) -> str:
        return f"""least({a}.n, {b}.n) * 100 >= {percent} * greatest({a}.n, {b}.n)
            and {100 + percent} * bit_count({a}.parity ^ {b}.parity) <= {100 - percent} * ({a}.n + {b}.n)"""

    def judge_blocks(blocks: DataFrame) -> DataFrame:
        a, b, at = blocks.where("half <> 2").alias("a"), blocks.where("half <> 1").alias("b"), ["key", "i", "j"]
        # (100 + percent) * common >= percent * (sizes), behind bounds of the difference by the sizes and by the parities; only linked pairs leave the join
        linked = F.expr(f"""(a.half = 0 and b.half = 0 and a.root < b.root or a.half = 1 and b.half = 2 and a.root <> b.root)
            and {allowed("a.payload", "b.payload")}
            and {100 + percent} * size(array_intersect(a.payload.set, b.payload.set)) >= {percent} * (a.payload.n + b.payload.n)""")
        met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in at] + [linked])
        return met.select(F.least("a.root", "b.root").alias("a"), F.greatest("a.root", "b.root").alias("b"))

    def tokens(reps: DataFrame) -> DataFrame:
        return sets.join(reps, "rep", "left_semi").select("rep", F.explode("set").alias("token"))

    payload = sets.select("rep", (8 * F.col("n")).alias("size"), F.struct("set", "n", "parity").alias("payload"))
    bounds = sets.select("rep", "n", "parity"), allowed("a", "b")
    roots = linked_components(active, judge, judge_blocks, payload, tokens, percent, BLOCK_ROWS, bounds=bounds).select(F.col("node").alias("lid"), "root")
    rooted = distinct.select("lid", "place", "n").join(roots, "lid", "left").where("n > 1 or root is not null").select("lid", "place", F.coalesce("root", "lid").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min("place").alias("keeper"))
    decided = rooted.join(keepers, "root").select("lid", "keeper")
    gone = banded.select("lid", "name", "pos").join(decided, "lid").where((F.col("name") != F.col("keeper.name")) | (F.col("pos") != F.col("keeper.pos")))
    return gone.groupBy("name").agg(F.collect_set("pos").alias("removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, counts: bool = False) -> DataFrame:
    """docs with the text less its removed lines, all other columns kept; with counts, also n_lines (with a word) and n_removed."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(WITHOUT_ID))
    name = F.xxhash64(key, text)
    removed = tables.written(removed_places(docs.select(key.alias("doc_id"), name.alias("name"), text.alias("text")), percent))
    rows = docs.select(F.struct(*docs.columns).alias("row"), name.alias("name"))
    body = F.coalesce(F.col("row")[text_col], F.lit(""))
    joined = rows.join(removed.hint("shuffle_hash"), "name", "left").withColumn("lines", F.split(body, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    left = F.when(F.col("removed").isNull(), body).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    out = [left.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if counts:
        out += [F.size(F.filter("lines", lambda x: x.rlike(r"\S"))).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


def query(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
