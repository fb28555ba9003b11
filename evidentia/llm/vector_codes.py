"""Product-quantisation codes of vectors, their entries found by LAESA pivots.

Vectors are cut into equal parts; each part position has a codebook. Some of its first entries, far from each other, are its pivots for
good. The distances of every part to its pivots are computed once and stored beside the vector. A round computes the distances of
the entries to the pivots; by the triangle inequality the largest difference of the two is a lower bound of the distance of
a part to an entry. Entries are tried in the order of their bounds, and only while the bound does not exceed the best exact distance so far.
Exact distances are integers; bounds are doubles, rounded down, so that an entry at an equal distance is always tried and ties go to the lower index.

A round is one pass over the written table: tasks add up the parts of each entry, Spark adds the tasks' sums, and the driver divides them:
parts x entries x width numbers at every size of the table. No entry's members are gathered anywhere.

Vectors that are null or hold null, non-finite (or, see `vectors`, too large) components are left out, and so are vectors of another length than the commonest one that the
parts divide (of equally common ones the shortest): they have no codes. Rows with equal vec_id are vectors of their own; the first vectors are ordered by vec_id, a missing one
last, then by components. With fewer vectors than entries the codebooks are as short; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.vectors import matrix, own_squared, squared, whole

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 1024, 4, 256, 4, 16
BLOCK = 2048
#: Entries that are tried at a time, in the order of their bounds.
WAVES = (1, 3, 8, 16, 32, 64, 128)
_SALTS = 16


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Indexes of up to n different entries: the first one, then always the one farthest from those chosen."""
    chosen = [0]
    nearest = squared(entries, entries[:1])[:, 0]
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(entries, entries[chosen[-1:]])[:, 0])
    return np.array(chosen)


def nearest_entries(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each row, and the number of exact distances that it took."""
    bound = np.zeros((len(x), len(entries)))
    for j in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, j, None] - entry_to_pivots[None, :, j]), out=bound)
    bound -= 1e-9 * (to_pivots.max(initial=0) + entry_to_pivots.max(initial=0) + 1)
    order = np.argsort(bound, axis=1)
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    limit = np.full(len(x), np.inf)
    tried = first = 0
    for size in [*WAVES, *[WAVES[-1]] * (len(entries) // WAVES[-1])]:
        wave = order[:, first : first + size]
        if not wave.shape[1]:
            break
        row, k = np.nonzero(np.take_along_axis(bound, wave, axis=1) <= limit[:, None])
        if not len(row):
            break
        entry = wave[row, k]
        d = own_squared(x[row], entries[entry])
        tried += len(d)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rows = row[starts]
        least = np.minimum.reduceat(d, starts)
        tied = d == np.repeat(least, np.diff(starts, append=len(row)))
        index = np.minimum.reduceat(np.where(tied, entry, len(entries)), starts)
        better = (least < best[rows]) | ((least == best[rows]) & (index < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], index[better]
        limit = np.sqrt(best.astype(float))
        first += size
    return at, best, tried


class Codebooks:
    """One codebook per part, and the pivots, which stay."""

    def __init__(self, first: np.ndarray, parts: int, pivots: int):
        self.parts, self.width = parts, first.shape[1] // parts if first.size else 0
        self.entries = [first[:, p * self.width : (p + 1) * self.width].copy() for p in range(parts)]
        self.pivots = [e[far_apart(e, pivots)] for e in self.entries] if first.size else []

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, p * self.width : (p + 1) * self.width] for p in range(self.parts)]

    def to_pivots(self, p: int, x: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(x, self.pivots[p]).astype(float))

    def measured(self):
        """Adds the distances of every part to its pivots, in part order."""
        n = sum(len(p) for p in self.pivots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("parts"), self.parts * self.width)
                d = np.concatenate([self.to_pivots(p, part) for p, part in enumerate(self.cut(x))], axis=1) if len(x) else np.zeros((0, n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(d.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "to_pivots"])

        return run

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
        """Rows with their parts, nearest entries and squared distances."""
        near = [self.to_pivots(p, e) for p, e in enumerate(self.entries)]
        cuts = np.cumsum([0, *(len(p) for p in self.pivots)])
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(first, BLOCK)
                x = self.cut(matrix(batch.column("parts"), self.parts * self.width))
                stored = batch.column("to_pivots").flatten().to_numpy().reshape(len(x[0]), -1)
                found = [nearest_entries(x[p], stored[:, cuts[p] : cuts[p + 1]], self.entries[p], near[p]) for p in range(self.parts)]
                yield batch, x, [f[0] for f in found], [f[1] for f in found]

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, entry, position, amount) summed over a task's rows; the position behind the last one counts them."""
        n, w = len(self.entries[0]), self.width + 1
        total = np.zeros((self.parts, n, w), np.int64)
        for _, x, at, _ in self.blocks(batches):
            for p in range(self.parts):
                order = np.argsort(at[p], kind="stable")
                starts = np.flatnonzero(np.diff(at[p][order], prepend=-1))
                total[p, at[p][order][starts]] += np.add.reduceat(np.pad(x[p], ((0, 0), (0, 1)), constant_values=1)[order], starts)
        part, entry, position = (i.reshape(-1).astype(np.int32) for i in np.indices(total.shape))
        used = np.repeat(total[:, :, -1].reshape(-1) > 0, w)
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in (part, entry, position, total.reshape(-1))], ["part", "entry", "position", "amount"])

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexes = np.array([f"{k:02x}" for k in range(len(self.entries[0]))], object)
        for batch, _, at, d in self.blocks(batches):
            code = hexes[at[0]]
            for p in range(1, self.parts):
                code = code + hexes[at[p]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d))], ["vec_id", "label", "code", "error"])

    def update(self, measured: DataFrame) -> None:
        """Each used entry becomes the floor of its parts' mean."""
        rows = measured.mapInArrow(self.sums, "part int, entry int, position int, amount long").groupBy("part", "entry", "position").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect()
        amount = {(r.part, r.entry, r.position): int(r.amount) for r in rows}
        for (p, e, k), s in amount.items():
            if k < self.width:
                self.entries[p][e, k] = s // amount[p, e, self.width]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.reshape(-1).tolist()).encode()).hexdigest()


def compress(df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every kept vector, and the final codebooks. Codes have two hex digits a part: up to 256 entries."""
    tables.bound_batches(df.sparkSession)
    kept = tables.written(whole(df, scale, label=True).withColumn("length", F.size("parts")).where((F.col("length") > 0) & (F.col("length") % parts == 0)))
    commonest = kept.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1)  # one row
    length = next((r.length for r in commonest.collect()), 0)
    kept = kept.where(F.col("length") == length).drop("length")
    first = kept.select("vec_id", "parts").orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).collect()
    books = Codebooks(np.array([r.parts for r in first], np.int64).reshape(len(first), length), parts, pivots)
    label = kept.schema["label"].dataType.simpleString()
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    measured = tables.written(kept.mapInArrow(books.measured(), f"vec_id long, label {label}, parts array<int>, to_pivots array<double>"))
    for _ in range(rounds):
        books.update(measured)
    return measured.mapInArrow(books.codes, f"vec_id long, label {label}, code string, error long"), books


def query(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (null if it fits no long), codebooks_sha256; one row per kept vector."""
    coded, books = compress(df)
    coded = tables.written(coded)
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    # labels may be many and one of them hot: their rows are dealt over salts
    salted = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("at"))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
    out = rows.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
