"""Repeated byte strings by prefix-free parsing: rolling-hash triggers create phrases, and the order of phrases and of the parse
decides which 400-byte strings occur twice.

Triggers. The trigger of a place i is the place of the least 16-byte rolling hash among i .. i+127 (the last one at ties).
It depends on the bytes from i to i+142 only, so equal 400-byte strings have their trigger at the same distance from their starts.
Triggers cut a text into phrases; the places i that share a trigger c form an interval lo..hi.

Dictionary. The 273 bytes from c on lie inside every 400-byte string with trigger c: the phrase head. Heads that occur
once rule out all their places at once; on ordinary text that is nearly everything, and only repeated heads
enter the dictionary.

Parse. For the places lo..hi of a repeated head the whole context, bytes lo .. hi+399, is named. A context that
occurs twice settles all its places. What is left, mostly the two ends of each repeated passage, is ordered by single places:
each 400-byte string there is named and counted, together with those of one witness of each settled context with the same head.

Only the equality of neighbours to depth 400 in corpus order matters here, so phrases, contexts and strings are named by 128-bit digests
(heads by 64 bits: a chance match costs work, not correctness) and the orders of dictionary and parse are kept as Spark
groupings of these names, not as one array: every step is a map over texts, a grouped count with partial sums or an equi-join.
Texts are shuffled once, for those that hold a repeated head.

Null and empty texts, and texts under 400 bytes, lose nothing. Repeated rows repeat each other: all their bytes of 400-byte
strings go. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.bytesets import Prefixes, slices, splitmix, utf8

LEAST = 400
WINDOW, GRAM = 128, 16
HEAD = LEAST - WINDOW + 1
_GEAR = (splitmix(np.arange(9000, 9256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
U64 = np.uint64


def triggers(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last start, and row of every trigger, over the starts of `least`-byte strings inside rows."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none
    h = _GEAR[data]
    for s in (1, 2, 4, 8):  # then h[i] covers the 16 bytes up to i; shifts of 2 keep all of them
        h[s:] += h[:-s] << np.uint32(2 * s)
    v = (h[GRAM - 1 :].astype(U64) << U64(32)) | (U64(0xFFFFFFFF) - np.arange(len(h) - GRAM + 1, dtype=U64))
    for s in (1, 2, 4, 8, 16, 32, 64):
        v = np.minimum(v[:-s], v[s:])
    place = 0xFFFFFFFF - (v[: len(data) - least + 1] & U64(0xFFFFFFFF)).astype(np.int64)
    room = np.zeros(len(data) + 1, np.int64)  # the starts that leave `least` bytes in their row
    some = np.diff(offsets) >= least
    np.add.at(room, offsets[:-1][some], 1)
    np.add.at(room, offsets[1:][some] - least + 1, -1)
    starts = np.flatnonzero(np.cumsum(room[: len(place)]) > 0)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    lo, hi, at = starts[first], starts[last], place[first]
    return at, lo, hi, np.searchsorted(offsets, lo, "right") - 1


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = utf8(batch.column("text"))
        at, _, _, row = triggers(data, offsets)
        keys = batch.column("row_key").to_numpy(zero_copy_only=False)[row]
        head = Prefixes(data).hashes(at, at + HEAD).view(np.int64) if len(at) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(keys, pa.int64()), pa.array(at - offsets[row], pa.int32())], ["head", "row_key", "at"])


def _names(raw: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    view = memoryview(raw)
    return [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts, ends, strict=True)]


def _held_triggers(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, lo, hi, row and place in its row of the triggers listed in a column of places."""
    data, offsets = utf8(batch.column("text"))
    at, lo, hi, row = triggers(data, offsets)
    listed = batch.column(column).to_pylist()
    wanted = np.concatenate([np.zeros(0, np.int64), *(np.array(x or [], np.int64) + offsets[k] for k, x in enumerate(listed))])
    mine = np.isin(at, wanted)
    return data, offsets, lo[mine], hi[mine], row[mine], (at - offsets[row])[mine]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets, lo, hi, row, at = _held_triggers(batch, "places")
        names = _names(data.tobytes(), lo.tolist(), (hi + LEAST).tolist())
        head = Prefixes(data).hashes(at + offsets[row], at + offsets[row] + HEAD).view(np.int64) if len(at) else np.zeros(0, np.int64)
        keys = batch.column("row_key").to_numpy(zero_copy_only=False)[row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(head), pa.array(keys, pa.int64()), pa.array(at, pa.int32())], ["name", "head", "row_key", "at"]
        )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 20):
        data, offsets, lo, hi, row, _ = _held_triggers(batch, "open")
        n = hi - lo + 1
        starts = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        names = _names(data.tobytes(), starts.tolist(), (starts + LEAST).tolist())
        rows = np.repeat(row, n)
        keys = batch.column("row_key").to_numpy(zero_copy_only=False)[rows]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(keys, pa.int64()), pa.array(starts - offsets[rows], pa.int32())], ["name", "row_key", "start"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets, lo, hi, row, at = _held_triggers(batch, "double")
        steps = np.zeros(len(data) + 1, np.int64)
        np.add.at(steps, lo, 1)
        np.add.at(steps, hi + LEAST, -1)
        for k, starts in enumerate(batch.column("starts").to_pylist()):
            if starts:
                own = np.array(starts, np.int64) + offsets[k]
                np.add.at(steps, own, 1)
                np.add.at(steps, own + LEAST, -1)
        gone = np.cumsum(steps[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = gone[inner]
        sums = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
        removed, spans = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_key"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["row_key", "n_removed", "n_spans", "kept_bytes"]
        )


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose name occurs twice or more: partial counts, then an equi-join that splits hot names."""
    return rows.join(rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name), name, "left_semi")


def removals(keyed: DataFrame) -> DataFrame:
    """(row_key, n_removed, n_spans, kept_bytes) of texts (row_key, text) that lose something or hold a repeated head."""
    heads = keyed.where(F.octet_length("text") >= LEAST).mapInArrow(_heads, "head long, row_key long, at int")
    places = _repeated(heads, "head").groupBy("row_key").agg(F.collect_set("at").alias("places"))
    held = tables.written(keyed.join(places, "row_key"), bytes_heavy=True)
    contexts = tables.written(held.mapInArrow(_contexts, "name binary, head long, row_key long, at int"))
    names = contexts.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "at")).alias("first"))
    twice, first = F.col("n") > 1, F.struct("row_key", "at") == F.col("first")
    counted = tables.written(contexts.join(names, "name").select("head", "row_key", "at", twice.alias("twice"), first.alias("witness")))
    loose = counted.where("not twice").select("head").distinct().withColumn("loose", F.lit(True))
    roles = counted.join(loose, "head", "left").select("row_key", "at", "twice", (F.col("loose") & (~F.col("twice") | F.col("witness"))).alias("open"))
    sorted_out = roles.groupBy("row_key").agg(F.collect_set(F.when(F.col("twice"), F.col("at"))).alias("double"), F.collect_set(F.when(F.col("open"), F.col("at"))).alias("open"))
    settled = tables.written(held.drop("places").join(sorted_out, "row_key"), bytes_heavy=True)
    # named once for the counts and once for the join: that is cheaper than keeping them all
    strings = settled.where(F.size("open") > 0).mapInArrow(_strings, "name binary, row_key long, start int")
    starts = tables.written(_repeated(strings, "name").groupBy("row_key").agg(F.collect_set("start").alias("starts")))
    some = settled.where("size(double) > 0").select("row_key").union(starts.select("row_key")).distinct()
    lossy = settled.drop("open").join(some, "row_key", "left_semi").join(starts, "row_key", "left")
    return lossy.mapInArrow(_remove, "row_key long, n_removed long, n_spans long, kept_bytes binary")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """Rows that agree in id and text share a key; they lose the same bytes."""
    return tables.texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))


def query(docs: DataFrame) -> DataFrame:
    keyed = keyed_texts(docs)
    # copies of a row lose the same bytes: one of them stays
    lost = removals(keyed.select("row_key", "text")).dropDuplicates(["row_key"]).select("row_key", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept"))
    whole = keyed.select("doc_id", "row_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    zero = F.lit(0).cast("long")
    return whole.join(tables.written(lost), "row_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")
    )
