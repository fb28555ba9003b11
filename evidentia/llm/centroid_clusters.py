"""K-means on integer vectors with heap-ordered bounds.

When a vector is scanned exactly, the gap between its distance to the second nearest centroid and to its own is known. From then on each
update of the centroids can close that gap by at most the drift of its own centroid plus the largest drift of another one. These
amounts are summed per cluster, so a gap is stored once, offset by its cluster's sum at that time, as the key at which it expires;
nothing is touched while the sum is below it. A cluster's vectors in order of their keys are its heap: a round pops the keys that the
cluster's sum has reached and scans only those vectors exactly.

On Spark a heap is a set of runs: tables sorted by cluster and key inside each file. Sums only grow, so what has been popped from a run stays
below the sum: the filter `key > sum of its cluster` gives the live vectors of every run, each vector in exactly one, and nothing is rewritten. The filter of
a round is pushed into the scan, where sorted row groups without an expired key are skipped. What was popped and scanned is written as
a new run. Sums of members change only by what moved, and are exact integers. The driver holds centroids, sums and drifts:
clusters x components numbers, at every size of the table. No cluster is ever gathered in a task, so a hot one does no harm.

Distances are exact integers; bounds are doubles, rounded so that an equal or nearly equal distance is scanned.

Vectors that are null, of another length, or hold null, non-finite (or, see `vectors`, too large) components are left out; rows with equal vec_id are vectors of their
own. A missing vec_id is kept and seeds come from it last. With fewer vectors than clusters there are as many centroids as vectors; an empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.vectors import ROWS, matrix, own_squared, squared, whole

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
_RUN = "vec_id long, parts array<int>, cluster int, was int, distance long, key double"
#: Widens a bound by far more than a double's rounding.
_SLACK = 1e-9


def _scan(centroids: np.ndarray, passed: np.ndarray):
    """Exact nearest centroids (ties: the smaller number), and the keys at which they may change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(first, ROWS)
                x = matrix(batch.column("parts"), centroids.shape[1])
                d = squared(x, centroids)
                at = d.argmin(axis=1)
                rows = np.arange(len(at))
                nearest = d[rows, at]
                if len(centroids) > 1:
                    d[rows, at] = np.iinfo(np.int64).max
                    second, own = np.sqrt(d.min(axis=1).astype(float)), np.sqrt(nearest.astype(float))
                    key = second * (1 - _SLACK) - own * (1 + _SLACK) - _SLACK + passed[at]
                    key = np.maximum(key, np.nextafter(passed[at], np.inf))  # of ties: live until the next drift
                else:
                    key = np.full(len(at), np.inf)
                columns = [batch.column("vec_id"), batch.column("parts"), pa.array(at, pa.int32()), batch.column("cluster"), pa.array(nearest), pa.array(key)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "parts", "cluster", "was", "distance", "key"])

    return run


def _moves(width: int):
    """(cluster, position, amount, n) of what joined and left each cluster, summed over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column("parts"), width)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(at[at >= 0]):
                    mine = x[at == c]
                    sums.setdefault(int(c), np.zeros(width + 1, np.int64))
                    sums[int(c)] += sign * np.append(mine.sum(axis=0), len(mine))
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * (width + 1), pa.int32()), pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(s)], ["cluster", "position", "amount"])

    return run


def seeds(kept: DataFrame, clusters: int, width: int) -> np.ndarray:
    """The vectors with the smallest sha256 of `2:<vec_id>`; ties (repeated vec_ids) by their components, missing vec_ids last."""
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "parts").orderBy(F.asc_nulls_last("name"), "parts").limit(clusters).collect()
    return np.array([r.parts for r in rows], np.int64).reshape(len(rows), width)


def _keys_in(after: np.ndarray, upto: np.ndarray | None = None) -> str:
    """Keys above their cluster's `after`, up to `upto`; one range per cluster, which the scan compares with its row groups."""
    ranges = [f"cluster = {c} AND key > {a!r}D" + (f" AND key <= {float(upto[c])!r}D" if upto is not None else "") for c, a in enumerate(after.tolist())]
    return "(" + ") OR (".join(ranges) + ")"


class Clustering:
    """Runs of scanned vectors with the centroids' state; `rounds` tells how many vectors each round scanned."""

    def __init__(self, kept: DataFrame, clusters: int, width: int):
        self.kept = tables.written(kept)
        self.centroids = seeds(self.kept, clusters, width)
        k = len(self.centroids)
        self.sums, self.counts, self.passed = np.zeros((k, width), object), np.zeros(k, object), np.zeros(k)
        self.runs: list[DataFrame] = []
        self.scanned: list[int] = []

    def live(self) -> DataFrame:
        return reduce(DataFrame.union, [r.where(_keys_in(self.passed)) for r in self.runs])

    def assign(self) -> None:
        """Pops what has expired since the last round, all vectors in the first one, scans it and writes it as a new run."""
        if self.runs:
            popped = reduce(DataFrame.union, [r.where(_keys_in(self.before, self.passed)) for r in self.runs]).select("vec_id", "parts", "cluster")
        else:
            popped = self.kept.withColumn("cluster", F.lit(-1))
        run = popped.mapInArrow(_scan(self.centroids, self.passed), _RUN).sortWithinPartitions("cluster", "key")
        run = tables.written(run)
        moves = run.where("cluster <> was").select("parts", "cluster", "was").mapInArrow(_moves(self.centroids.shape[1]), "cluster int, position int, amount long")
        width = self.centroids.shape[1]
        for r in moves.groupBy("cluster", "position").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount")).collect():
            if r.position < width:
                self.sums[r.cluster, r.position] += int(r.amount)
            else:
                self.counts[r.cluster] += int(r.amount)
        self.runs.append(run)
        self.before = self.passed.copy()

    def update(self) -> None:
        new = self.centroids.copy()
        for c in np.flatnonzero(self.counts):
            new[c] = [int(s) // int(self.counts[c]) for s in self.sums[c]]
        drift = np.sqrt(own_squared(new, self.centroids).astype(float)) * (1 + _SLACK)
        self.centroids = new
        if len(drift) > 1:
            most = int(drift.argmax())
            others = np.full(len(drift), drift[most])
            others[most] = np.delete(drift, most).max()
            self.passed = self.passed + (drift + others) * (1 + _SLACK)


def cluster(df: DataFrame, width: int = WIDTH, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, Clustering]:
    """(vec_id, cluster, distance) after `rounds` rounds and a last assignment, and the clustering with its centroids."""
    tables.bound_batches(df.sparkSession)
    state = Clustering(whole(df, scale).where(F.size("parts") == width), clusters, width)
    if not len(state.centroids):
        return state.kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), state
    for _ in range(rounds):
        state.assign()
        state.update()
    state.assign()
    centroids = state.centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("cluster").to_numpy()
            d = own_squared(matrix(batch.column("parts"), width), centroids[at])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    return state.live().select("vec_id", "parts", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"), state


def query(df: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; one row per kept vector. An inertia that fits no long is null."""
    placed, state = cluster(df)
    placed = tables.written(placed)
    # at most CLUSTERS rows, whatever the table's size
    sums = {r.cluster: int(r.inertia) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(str(int(v)) for v in x).encode()).hexdigest() for x in state.centroids]
    fits = lambda v: v if v < 1 << 63 else None
    facts = df.sparkSession.createDataFrame([(c, fits(s), fits(sum(sums.values())), names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
