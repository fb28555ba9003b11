"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's words (runs of bytes other than ASCII white space, A-Z lowered) make 3-word shingles, repeats included, joined by a space; a shorter
text is one shingle. A fingerprint bit is set if it is set in over half the shingles' XXH64 (seed 42). Two fingerprints are linked if at most 3 bits differ.

The bits are grouped into partitions, bits that vary together in the same one, by a 64 x 64 table of co-occurrences over all fingerprints. If each
partition i of a fingerprint is probed up to t_i errors and the sum of t_i + 1 is 4, every fingerprint within 3 bits agrees with it in
some partition up to t_i errors; t_i = -1 leaves a partition out. Each fingerprint gets the thresholds that cost least, by dynamic programming over the
partitions: what it costs to probe the values within t errors, and how many fingerprints hold them. These counts come from a histogram
of each block of 16 bits over all fingerprints (4 x 65536 numbers at every size); for partitions of two blocks they are combined as if the blocks
were independent. A bad estimate costs time and never a link. Up to 2**22 distinct fingerprints there are 4 partitions of 16 bits, beyond that 2 of 32 bits, so that the values stay selective.

Documents with equal fingerprints form a class, and only classes are joined. Where few fingerprints hold a probed value, an equi-join meets them and keeps those within
3 bits. A value that many hold is a hot bucket: leaders link its members and components are contracted; then bounded blocks of probes meet
bounded blocks of holders, and each pair of blocks yields the pairs of components that it links. So no pairs within a group are emitted.

A null or empty text, or one of white space, has fingerprint zero, linked like any other. The component is named by the least doc_id in it; rows without an id take part,
and a component of only such rows has no name. Rows with the same id have their own results each. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.bytesets import LOWERED, U64, Words, slices, utf8
from evidentia.llm.components import components

SHINGLE, SEED, BITS, ERRORS = 3, 42, 64, 3
BLOCK, BLOCKS = 16, 4
#: Distinct fingerprints up to which partitions are single blocks.
FEW = 1 << 22
#: Cost of a probe's row, in compared candidates.
PROBE = 10.0
#: A value with more holders is a hot bucket; rows of a block there.
HOT, BLOCK_ROWS = 512, 4096
_LOWERED = LOWERED.astype(np.uint8)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    words = Words(data, offsets)
    n, lengths = len(words.starts), words.ends - words.starts
    joined = np.full(int(lengths.sum()) + n, 32, np.uint8)
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(n), lengths)] = _LOWERED[data[words.inside]]
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    # the last word of the shingle that begins at each word; none where the row ends before, but for short rows
    last = np.arange(n) + SHINGLE - 1
    first_word = np.cumsum(words.counts) - words.counts
    of_row = first_word[words.row] + words.counts[words.row] - 1
    short = (words.counts[words.row] < SHINGLE) & (np.arange(n) == first_word[words.row])
    at = np.flatnonzero((last <= of_row) | short)
    last = np.where(short, of_row, last)[at]
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), U64, len(at))
    out = np.zeros(len(offsets) - 1, U64)
    if len(at):
        row = words.row[at]
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        ones = np.add.reduceat(bits_of(hashes), begins, axis=0, dtype=np.int32)
        out[row[begins]] = packed(2 * ones > np.diff(begins, append=len(row))[:, None])
    return out


def bits_of(values: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1, the lowest bit first."""
    return np.unpackbits(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").reshape(-1).view("<u8").astype(U64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(*utf8(batch.column("text"))).view(np.int64))], ["doc_id", "rep"])


def _values(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("rep").to_numpy().view(U64)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, n): how often bits i and j are both set, summed over a task."""
    total = np.zeros((BITS, BITS))
    for batch in batches:
        b = bits_of(_values(batch)).astype(np.float32)
        total += b.T @ b
    i, j = (x.reshape(-1).astype(np.int32) for x in np.indices(total.shape))
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1).astype(np.int64))], ["i", "j", "n"])


def grouped_bits(together: np.ndarray, n: int) -> np.ndarray:
    """An order of the bits; each run of BLOCK bits holds those most correlated with one another, found greedily."""
    p = np.diag(together) / n
    spread = np.sqrt(p * (1 - p))
    c = np.abs(together / n - np.outer(p, p)) / np.maximum(np.outer(spread, spread), 1e-12)
    np.fill_diagonal(c, 0)
    left, order = list(range(BITS)), []
    while left:
        mine = [max(left, key=lambda k: c[k, left].sum())]
        left.remove(mine[0])
        while len(mine) < BLOCK:
            mine.append(max(left, key=lambda k: c[k, mine].sum()))
            left.remove(mine[-1])
        order += mine
    return np.array(order)


def blocks_of(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(n, BLOCKS) values of the blocks of 16 bits."""
    return packed(bits_of(values)[:, order]).view("<u2").reshape(-1, BLOCKS)


def masks(width: int, errors: int) -> np.ndarray:
    """All values of `width` bits with up to `errors` bits set, fewest first."""
    return np.array([sum(1 << b for b in which) for k in range(errors + 1) for which in combinations(range(width), k)], U64)


def _histograms(order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BLOCKS, 1 << BLOCK), np.int64)
        for batch in batches:
            v = blocks_of(_values(batch), order)
            for b in range(BLOCKS):
                counts[b] += np.bincount(v[:, b], minlength=1 << BLOCK)
        block, value = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(value.astype(np.int32)), pa.array(counts[block, value])], ["block", "value", "n"])

    return run


def neighbour_counts(histograms: np.ndarray) -> np.ndarray:
    """[block, errors, value]: how many fingerprints differ from the value in exactly so many bits of the block."""
    out = np.zeros((BLOCKS, ERRORS + 1, 1 << BLOCK), np.float32)
    at = np.arange(1 << BLOCK)
    for mask in masks(BLOCK, ERRORS).astype(np.int64).tolist():
        out[:, mask.bit_count()] += histograms[:, at ^ mask]
    return out


def thresholds(cost: np.ndarray) -> np.ndarray:
    """(n, partitions) units t + 1, ERRORS + 1 in all, of least cost[n, partition, units]; by dynamic programming over the partitions."""
    n, partitions, _ = cost.shape
    best = np.full((n, ERRORS + 2), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((partitions, n, ERRORS + 2), np.int64)
    for i in range(partitions):
        options = np.full((n, ERRORS + 2, ERRORS + 2), np.inf)  # [row, units so far, units here]
        for here in range(ERRORS + 2):
            options[:, here:, here] = best[:, : ERRORS + 2 - here] + cost[:, i, here, None]
        chosen[i] = options.argmin(axis=2)
        best = options.min(axis=2)
    units, left = np.zeros((n, partitions), np.int64), np.full(n, ERRORS + 1)
    for i in range(partitions - 1, -1, -1):
        units[:, i] = chosen[i, np.arange(n), left]
        left -= units[:, i]
    return units


class Partitions:
    """Where fingerprints meet: the order of bits, the number of partitions and what probes are expected to meet."""

    def __init__(self, order: np.ndarray, near: np.ndarray, n: int, few: int = FEW):
        self.order, self.near, self.n = order, near, n
        self.count = BLOCKS if n <= few else BLOCKS // 2
        self.width = BITS // self.count
        self.masks = [masks(self.width, e) for e in range(ERRORS + 1)]

    def values(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks, and the values of the partitions."""
        v = blocks_of(fingerprints, self.order)
        return v, v.astype(U64) if self.count == BLOCKS else np.ascontiguousarray(v).view("<u4").astype(U64)

    def costs(self, blocks: np.ndarray) -> np.ndarray:
        exact = [self.near[b][:, blocks[:, b]].astype(float) for b in range(BLOCKS)]
        if self.count < BLOCKS:
            exact = [np.stack([sum(exact[2 * i][s] * exact[2 * i + 1][t - s] for s in range(t + 1)) / self.n for t in range(ERRORS + 1)]) for i in range(self.count)]
        cost = np.zeros((len(blocks), self.count, ERRORS + 2))
        for i, e in enumerate(exact):
            cost[:, i, 1:] = (np.cumsum(e, axis=0) + np.array([[PROBE * len(m)] for m in self.masks])).T
        return cost

    def keys(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, rep, probe): each partition's value as a holder, and the values to probe."""
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                f = _values(whole.slice(first, 4096))
                blocks, v = self.values(f)
                units = thresholds(self.costs(blocks))
                name = np.arange(self.count, dtype=U64) << U64(self.width)
                key, rep, probe = [(v + name).reshape(-1)], [np.repeat(f, self.count)], [np.zeros(v.size, bool)]
                for i in range(self.count):
                    for u in range(1, ERRORS + 2):
                        at = np.flatnonzero(units[:, i] == u)
                        key.append(((v[at, i, None] ^ self.masks[u - 1]) + name[i]).reshape(-1))
                        rep.append(np.repeat(f[at], len(self.masks[u - 1])))
                        probe.append(np.ones(len(key[-1]), bool))
                arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (key, rep)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(probe))], ["key", "rep", "probe"])


def partitions(classes: DataFrame, few: int = FEW) -> Partitions | None:
    """None without fingerprints. The driver gets at most 64 x 64 and 4 x 65536 counts."""
    together = np.zeros((BITS, BITS))
    for r in classes.select("rep").mapInArrow(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        together[r.i, r.j] = r.n
    n = classes.count()
    if not n:
        return None
    order, histograms = grouped_bits(together, n), np.zeros((BLOCKS, 1 << BLOCK), np.int64)
    counts = classes.select("rep").mapInArrow(_histograms(order), "block int, value int, n long").groupBy("block", "value").agg(F.sum("n").alias("n")).toArrow()
    histograms[counts["block"].to_numpy(), counts["value"].to_numpy()] = counts["n"].to_numpy()
    return Partitions(order, neighbour_counts(histograms), n, few)


_NEAR = f"bit_count(a ^ b) <= {ERRORS}"


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of components that a block of probes and a block of holders link."""
    for batch in batches:
        out: set[tuple[int, int]] = set()
        for members in batch.column("members"):
            rows = members.values
            rep, root, probe = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "root", "probe"))
            rep = rep.view(U64)
            holders, roots = rep[~probe], root[~probe]
            for first in range(0, int(probe.sum()), 512):
                p, r = rep[probe][first : first + 512], root[probe][first : first + 512]
                x, y = np.nonzero((np.bitwise_count(p[:, None] ^ holders[None, :]) <= ERRORS) & (r[:, None] != roots[None, :]))
                out |= {*zip(*(k.tolist() for k in np.unique(np.stack([r[x], roots[y]]), axis=1)), strict=True)}
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _hot_links(holders: DataFrame, probes: DataFrame, block_rows: int) -> DataFrame:
    """Links among the members of hot buckets: by leaders, then by blocks between the components that these leave."""
    led = []
    for leaders in (1, 4):
        lead = holders.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(leaders)).alias("salt")).agg(F.min("rep").alias("b")).select("key", "b")
        led.append(holders.select("key", F.col("rep").alias("a")).join(lead, "key").where("a <> b and " + _NEAR).select("a", "b").distinct())
    stars = tables.written(components(tables.written(led[0].union(led[1]).distinct())))
    roots = stars.select(F.col("node").alias("rep"), "root")

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        sized = rows.join(counts, "key").withColumn(mine, F.pmod(F.xxhash64("rep", "key"), F.col(f"n_{mine}")).cast("int"))
        sized = sized.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        return sized.join(roots, "rep", "left").select("key", "i", "j", F.struct("rep", F.coalesce("root", "rep").alias("root"), F.lit(mine == "i").alias("probe")).alias("member"))

    blocks = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    counts = blocks(probes, "n_i").join(blocks(holders, "n_j"), "key")
    units = dealt(probes, "i", "j").union(dealt(holders, "j", "i").select("key", "i", "j", "member"))
    linked = units.groupBy("key", "i", "j").agg(F.collect_list("member").alias("members")).select("members").mapInArrow(_block_links, "a long, b long")
    return stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(linked)


def links(classes: DataFrame, few: int = FEW, hot: int = HOT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): pairs of fingerprints whose components are those of all pairs within ERRORS bits."""
    where = partitions(classes, few)
    if where is None:
        return classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    keyed = tables.written(classes.select("rep").mapInArrow(where.keys, "key long, rep long, probe boolean"))
    holders, probes = keyed.where("not probe").select("key", "rep"), keyed.where("probe").select("key", "rep")
    many = tables.written(holders.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"))
    cold = lambda df, name: df.join(many, "key", "left_anti").select("key", F.col("rep").alias(name))
    met = cold(probes, "a").join(cold(holders, "b"), "key").where("a < b and " + _NEAR).select("a", "b")
    if many.isEmpty():
        return met
    crowded = [tables.written(df.join(many, "key", "left_semi")) for df in (holders, probes)]
    return met.union(_hot_links(*crowded, block_rows))


def near_duplicates(docs: DataFrame, few: int = FEW, hot: int = HOT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable by links)."""
    signed = tables.written(tables.texts(docs).mapInArrow(_fingerprints, "doc_id long, rep long"))
    classes = tables.written(signed.groupBy("rep").agg(F.min("doc_id").alias("least")))
    found = components(tables.written(links(classes, few, hot, block_rows).distinct()))
    rooted = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "least", F.coalesce("root", "rep").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("rep", "component_id")
    return signed.join(named, "rep").select("doc_id", F.lower(F.lpad(F.hex("rep"), 16, "0")).alias("fingerprint"), "component_id")
