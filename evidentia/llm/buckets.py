"""Links among the members of candidate buckets, without emitting all pairs of a bucket.

Where the caller gives cheap bounds of its similarity, buckets of a few members come first: all their pairs that the bounds allow are judged
at once, a number of pairs in proportion to the members, and those buckets are done.

Then, twice, leaders are picked in every bucket (one, then up to four), compared with the members of other components, and
let go: they have met every member. Components are contracted after each round, and buckets left with one component are done; that
settles small buckets and most members of large groups, with a number of pairs in proportion to the members.

What is left are buckets whose members are alike but not all linked. Those of up to block_rows members are compared exactly, each by
itself. The members of larger ones get new keys by an exact prefix filter: a set of n elements, ordered from the element that fewest of
these sets hold to the commonest, shares one of its first n - ceil(t * n) + 1 elements with every set at similarity t or more. A member that
is not linked to its group differs in rare elements, which nobody shares, so it meets few others or none, and no pair of blocks is made of
the group. Leaders then work on these keys in the same way.

What even that leaves is compared exactly in blocks: a bucket is dealt into blocks of bounded rows and bytes, every pair of blocks is one
unit of bounded size, and a unit yields only the pairs of components that it links. So hot buckets spread over tasks, and nothing of the size of a
bucket is ever held or emitted as pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.components import components

ROUNDS = (1, 4)
#: Members of a bucket, if not more than a block's, whose pairs are all judged at once, where there are bounds.
FEW = 32


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Rows of keyed (key, rep) whose key at least two rows hold: partial counts, then a join that can split hot keys."""
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi")


def _several(active: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, rep, root) of the buckets that hold several components."""
    if roots is None:
        return active.select("key", "rep", F.col("rep").alias("root"))
    placed = active.select("key", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    keys = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return placed.join(keys, "key", "left_semi")


def _blocks(active: DataFrame, payload: DataFrame, block_rows: int, block_bytes: int | None) -> DataFrame:
    """The members (rep, root, half, payload) of each pair (key, i, j) of blocks of a bucket; half: 1 and 2 name the two blocks, 0 stands for one block with itself.
    Without block_bytes, blocks are bounded by rows only, for judges that hold one pair at a time."""
    need = F.col("n") / block_rows
    if block_bytes:
        counts = active.join(payload.select("rep", "size"), "rep").groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        need = F.greatest(need, F.col("bytes") / block_bytes)
    else:
        counts = active.groupBy("key").agg(F.count("*").alias("n"))
    dealt = active.join(counts.select("key", F.ceil(need).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    half = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    placed = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "root", half.alias("half"))
    return placed.join(payload.select("rep", "payload"), "rep")


def prefix_keys(left: DataFrame, tokens: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(key, rep) of the members of left, so that any two at similarity percent / 100 or more share a key."""
    held = tables.written(tokens(left.select("rep").distinct()))
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    ranked = held.join(counts, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("set"))
    first = F.size("set") - F.expr(f"({percent} * size(set) + 99) div 100").cast("int") + 1
    keys = ranked.select("rep", F.explode(F.slice("set", F.lit(1), first)).alias("key")).where("key.n > 1")
    return tables.written(keys.select(F.col("key.token").alias("key"), "rep"))


class _Links:
    """What is known so far: pairs tested in vain, and the components of the linked ones."""

    def __init__(self, judge: Callable[[DataFrame], DataFrame]):
        self.judge = judge
        self.tested: DataFrame | None = None
        self.roots: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        """Components of components: only the roots of new pairs take part."""
        if self.roots is None:
            self.roots = components(pairs)
            return
        for side in ("a", "b"):
            pairs = pairs.join(self.roots.select(F.col("node").alias(side), F.col("root").alias("r")), side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
        joined = components(pairs)
        up = joined.select(F.col("node").alias("root"), F.col("root").alias("up"))
        moved = self.roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        self.roots = tables.written(moved.union(joined.join(self.roots.select("node"), "node", "left_anti")))

    def small_buckets(self, active: DataFrame, bounds: DataFrame, allowed: str, most: int) -> DataFrame:
        """Judges the pairs of all buckets of up to most members that are allowed by bounds (rep, ...), an expression over a and b; what is left are the larger buckets."""
        dealt = active.join(bounds, "rep").repartition("key")
        few = dealt.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") <= most).select("key")
        own = dealt.join(few.hint("shuffle_hash"), "key")
        met = own.alias("a").join(own.alias("b").hint("shuffle_hash"), (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & F.expr(allowed))
        judged = tables.written(self.judge(met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()))
        self.tested = judged.where("not linked").select("a", "b")
        self.add(judged.where("linked").select("a", "b"))
        many = active.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > most).select("key")
        return tables.written(active.join(many, "key", "left_semi"))

    def rounds(self, active: DataFrame, rounds: tuple[int, ...] = ROUNDS) -> DataFrame | None:
        """Leaders meet the members of their buckets; what is left with several components, None if nothing is."""
        for leaders in rounds:
            active = tables.written(_several(active, self.roots))
            if active.isEmpty():
                return None
            salt = F.pmod(F.xxhash64("rep"), F.lit(leaders))
            lead = active.groupBy("key", salt.alias("salt")).agg(F.min(F.struct("rep", "root")).alias("lead")).select("key", F.col("lead.rep").alias("lead"), F.col("lead.root").alias("lead_root"))
            met = active.join(lead, "key").where("root <> lead_root")
            pairs = met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
            if self.tested is not None:
                pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
            judged = tables.written(self.judge(pairs))
            fails = judged.where("not linked").select("a", "b")
            self.tested = fails if self.tested is None else self.tested.union(fails)
            self.add(judged.where("linked").select("a", "b"))
            active = active.join(lead.select("key", F.col("lead").alias("rep")), ["key", "rep"], "left_anti").select("key", "rep")
        left = tables.written(_several(active, self.roots))
        return None if left.isEmpty() else left


def linked_components(
    active: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    judge_blocks: Callable[[DataFrame], DataFrame],
    payload: DataFrame,
    tokens: Callable[[DataFrame], DataFrame],
    percent: int,
    block_rows: int,
    block_bytes: int | None = None,
    bounds: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """(node, root) of reps with a link.

    active: a written table of distinct (key, rep). judge: pairs (a, b) to (a, b, linked), where pairs that are surely not linked
    may be left out. judge_blocks: members of pairs of blocks (`_blocks`) to pairs (a, b) of linked roots. payload: (rep, size in bytes, payload).
    tokens: (rep) to (rep, token), the elements of its set, once each; linked pairs have a Jaccard index of percent / 100 or more.
    bounds: columns (rep, ...) of every rep and an expression over a and b that holds for every linked pair.
    """
    links = _Links(judge)
    if bounds is not None:
        active = links.small_buckets(active, *bounds, most=min(FEW, block_rows))
    left = links.rounds(active)
    if left is not None:
        hot = left.join(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("key").hint("shuffle_hash"), "key", "left_semi")
        hot = tables.written(hot)
        if not hot.isEmpty():
            small = left.join(hot.select("key").distinct(), "key", "left_anti")
            rest = links.rounds(prefix_keys(hot, tokens, percent), ROUNDS[-1:])
            left = small if rest is None else tables.written(_several(small.select("key", "rep").union(rest.select("key", "rep")), links.roots))
        links.add(tables.written(judge_blocks(_blocks(left, payload, block_rows, block_bytes)).distinct()))
    return links.roots if links.roots is not None else active.select(F.col("rep").alias("node"), F.col("rep").alias("root")).limit(0)
