"""Content-defined payload chunking: rolling gear hash cuts, chunk digests deduplicated by Spark joins, ordered chunk lists
reconstruct verified media.

The payload is the text's UTF-8 bytes with zero bytes up to a positive multiple of 64. A gear hash over the last 32 bytes
cuts it where its upper bits vanish (chunks of 256 to 8192 bytes, about 1.3 KB on average). Payloads with the same digest
form a class, of which one is stored. Each distinct chunk is stored once, in the container row of the least (document, place)
that holds it. The store is a Parquet table in the shared folder. Read back, a payload is put together from its own chunks and, by joins on
digests, from chunks that others own; its digest is verified before features are taken.

A chunk is stored as a frame: its length (unsigned 32 bits, little endian) and its bytes. A container row holds `CDC1` and the frames of the chunks
that it owns. The stored form of one payload ("media") is `CDC1` and the frames of its chunk list in order; media_bytes and media_sha256 are of
these bytes as read back.

Texts move through one shuffle (to meet their chunk owners), in PASSES passes, each over the texts of one residue of a hash: so the disk holds the
store and the shuffle files of one pass only, for as many more scans. Shared chunks move through another.

Null and empty texts give 64 zero bytes. Equal texts, repeated rows included, get equal values. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.bytesets import slices, splitmix

UNIT = 64
LEAST, MOST = 256, 8192
#: One place in 1024 passes.
CUTS = np.uint32(0x3FF << 22)
#: Passes in which the store is written.
PASSES = 4
HEAD = b"CDC1"
GEAR = (splitmix(np.arange(5000, 5256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over j < 32, by doubling the window."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)  # numpy buffers overlapping operands
    return h


def cut_ends(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    places = np.flatnonzero((gear_hashes(data) & CUTS) == 0) + 1
    out, base = [], 0
    for p in payloads:
        mine = (places[np.searchsorted(places, base) : np.searchsorted(places, base + len(p), "right")] - base).tolist()
        ends, last = [], 0
        for c in [*mine, len(p)]:
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST or c == len(p) > last:
                last = c
                ends.append(c)
        out.append(ends)
        base += len(p)
    return out


def frame(chunk: bytes) -> bytes:
    return len(chunk).to_bytes(4, "little") + chunk


def _payload() -> F.Column:
    raw = F.col("text").cast("binary")
    pad = F.when(F.octet_length("text") == 0, UNIT).otherwise(F.pmod(-F.octet_length("text"), F.lit(UNIT)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def payloads(docs: DataFrame) -> DataFrame:
    """at: the id, or the least number where it is null, for joins."""
    out = tables.texts(docs).select(
        "doc_id", F.expr("coalesce(doc_id, -9223372036854775807)").alias("at"), F.octet_length("text").cast("long").alias("n_bytes"), _payload().alias("payload")
    )
    return out.withColumn("payload_key", F.unhex(F.sha2("payload", 256)))


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        raw = batch.column("payload").to_pylist()
        ends = cut_ends(raw)
        digests = [[hashlib.sha256(p[a:b]).digest() for a, b in zip([0, *e], e, strict=False)] for p, e in zip(raw, ends, strict=True)]
        keep = ["doc_id", "at", "n_bytes", "payload_key"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ends, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))], [*keep, "ends", "digests"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Container rows."""
    for batch in slices(batches, "payload"):
        rows = []
        for p, ends, own in zip(*(batch.column(c).to_pylist() for c in ("payload", "ends", "own")), strict=True):
            rows.append(HEAD + b"".join(frame(p[a:b]) for a, b, o in zip([0, *ends], ends, own, strict=False) if o))
        keep = ["payload_key", "digests", "own", "shared"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.binary())], [*keep, "bytes"])


def _own_frames(own: list[bool], data: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and frame of the chunks that a container row holds."""
    at = len(HEAD)
    for k, mine in enumerate(own):
        if mine:
            end = at + 4 + int.from_bytes(data[at : at + 4], "little")
            yield k, data[at:end]
            at = end


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owned chunks that other payloads, or other places of the same one, refer to."""
    for batch in slices(batches, "bytes"):
        digests, frames = [], []
        for names, own, shared, data in zip(*(batch.column(c).to_pylist() for c in ("digests", "own", "shared", "bytes")), strict=True):
            for k, framed in _own_frames(own, data):
                if shared[k]:
                    digests.append(names[k])
                    frames.append(framed)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(frames, pa.binary())], ["digest", "frame"])


def feature(data: bytes) -> str:
    """Sum of the samples, total variation and crossings of the middle value, of 8-bit samples."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    return f"{int(x.sum())}:{int(np.abs(np.diff(x)).sum())}:{int(np.count_nonzero(np.diff(x >= 128)))}"


FEATURES = "payload_key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "bytes"):
        out = []
        others = batch.column("others").to_pylist() if "others" in batch.schema.names else [[]] * batch.num_rows
        for key, own, data, more in zip(*(batch.column(c).to_pylist() for c in ("payload_key", "own", "bytes")), others, strict=True):
            frames = dict(_own_frames(own, data)) | {x["seq"]: x["frame"] for x in more or []}
            parts = [frames[k] for k in range(len(own))]
            payload = b"".join(f[4:] for f in parts)
            digest = hashlib.sha256(payload)
            if digest.digest() != key:
                raise ValueError(f"payload {key.hex()} was read back as {digest.hexdigest()}")
            media = data[: len(HEAD)] + b"".join(parts)
            out.append((key, len(payload), digest.hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), len(parts)))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*out, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in FEATURES.split(", ")])


def store(docs: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(recipes of all documents, the written store of distinct payloads and chunks)."""
    source = payloads(docs)
    recipes = tables.written(source.mapInArrow(_recipes, "doc_id long, at long, n_bytes long, payload_key binary, ends array<int>, digests array<binary>"), bytes_heavy=True)
    classes = recipes.groupBy("payload_key").agg(F.min("at").alias("at"), F.first("ends").alias("ends"), F.first("digests").alias("digests"))
    chunks = classes.select("payload_key", F.posexplode("digests").alias("seq", "digest"))
    owners = chunks.groupBy("digest").agg(F.min(F.struct("payload_key", "seq")).alias("first"), F.count("*").alias("n"))
    own = (F.col("payload_key") == F.col("first.payload_key")) & (F.col("seq") == F.col("first.seq"))
    placed = chunks.join(owners, "digest").select("payload_key", F.struct("seq", own.alias("own"), (F.col("n") > 1).alias("shared")).alias("c"))
    flags = placed.groupBy("payload_key").agg(F.sort_array(F.collect_list("c")).alias("c")).select("payload_key", F.col("c.own").alias("own"), F.col("c.shared").alias("shared"))
    plan = tables.written(classes.join(flags, "payload_key"), bytes_heavy=True)
    schema = "payload_key binary, digests array<binary>, own array<boolean>, shared array<boolean>, bytes binary"
    parts = []
    for k in range(passes):
        mine = payloads(docs.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(passes)) == k)).select("payload_key", "at", "payload")
        # on both columns, so that copies of one text do not meet in one task
        held = mine.join(plan.hint("shuffle_hash"), ["payload_key", "at"]).dropDuplicates(["payload_key", "at"])
        parts.append(tables.written(held.mapInArrow(_store, schema), bytes_heavy=True))
    return recipes, functools.reduce(DataFrame.union, parts)


def features(stored: DataFrame) -> DataFrame:
    """Reads every payload back and measures it."""
    complete = F.forall("own", lambda x: x)
    parts = stored.where(~complete)
    refs = parts.select("payload_key", F.posexplode(F.arrays_zip("digests", "own")).alias("seq", "c")).where("not c.own").select("payload_key", "seq", F.col("c.digests").alias("digest"))
    chunks = stored.where(F.exists("shared", lambda x: x)).mapInArrow(_shared, "digest binary, frame binary")
    others = refs.join(chunks, "digest").groupBy("payload_key").agg(F.collect_list(F.struct("seq", "frame")).alias("others"))
    return stored.where(complete).mapInArrow(_rebuild, FEATURES).union(parts.join(others, "payload_key").mapInArrow(_rebuild, FEATURES))


def query(docs: DataFrame) -> DataFrame:
    recipes, stored = store(docs)
    return recipes.select("doc_id", "n_bytes", "payload_key").join(tables.written(features(stored)), "payload_key").drop("payload_key")
