"""MinHash near-duplicates by a multi-index Hamming join.

A text's set holds its distinct 5-word shingles (words are runs of bytes other than ASCII white space, A-Z lowered; with
fewer words the whole sequence is the one shingle). Its signature has 42 b-bit MinHash symbols (b = 16), cut into 7 chunks of
6. Two signatures at Hamming distance 13 or less agree in some chunk up to one symbol (pigeonhole: 14 errors are needed to put
two into each of 7 chunks). So the allowed chunk errors are enumerated as masks: each chunk gives 6 keys, each leaving one symbol out,
and an equi-join on the keys meets every pair within that distance. At similarity 0.85 a chunk has at most one error with
probability 0.77, so a pair is missed with probability 0.23**7, about 3 in 100000, and less above it.

Texts with the same set form a class first; only class representatives (the first row) are joined. Pairs of a bucket are not all
emitted: leaders meet members and components are contracted, then what is left gets the keys of an exact prefix filter (`buckets`). Links are
confirmed on the full shingle sets.

A row is named by a hash of its id and text, so different texts may share an id: each has its own result. Rows are ordered by id, a missing
id last, then by name, then, without an id, by their place in the table. The first row of a component is kept, and its id is the component's: the least
doc_id, or null where no row has one. Rows with the same id and text get the same result each; rows without an id are documents of
their own, so that of equal ones at most one is kept.

Null and empty texts have an empty set and no links: all are kept, with or without an id. An empty table gives an empty result;
other columns are ignored by `near_duplicates` and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.buckets import linked_components, shared_keys
from evidentia.llm.bytesets import U64, Words, slices, splitmix, utf8

SHINGLE = 5
CHUNKS, WIDTH = 7, 6
SYMBOLS = CHUNKS * WIDTH
#: Pairs at a larger distance are not verified: at similarity 0.85 the distance is 6.3 +- 2.3.
MOST_ERRORS = 20
#: Of the texts of a block; a row compares two.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20

_XOR = splitmix(np.arange(1, SYMBOLS + 1, dtype=U64))
_MUL = splitmix(np.arange(1001, SYMBOLS + 1001, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes with their rows, by row then hash."""
    words = Words(data, offsets)
    h, row, _ = words.grams(SHINGLE)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        first = np.searchsorted(words.row, short)
        whole = np.zeros(len(short), U64)
        for k in range(SHINGLE - 1):
            has = words.counts[short] > k
            whole[has] = splitmix(whole[has] ^ words.hashes[first[has] + k])
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        h, row = shingle_sets(*utf8(batch.column("text")))
        n = np.bincount(row, minlength=batch.num_rows)
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        set_hash = np.zeros((2, batch.num_rows), U64)
        signature = np.zeros((len(some), SYMBOLS), np.uint16)
        if len(some):
            for k in range(2):
                set_hash[k, some] = np.add.reduceat(splitmix(h ^ U64(77 + k)), starts)
            for k in range(SYMBOLS):
                signature[:, k] = splitmix(np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], starts)) & U64(0xFFFF)
        raw: list[bytes | None] = [None] * batch.num_rows
        for k, i in enumerate(some):
            raw[i] = signature[k].tobytes()
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["doc_id", "name", "place"]).columns, pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in set_hash), pa.array(raw, pa.binary())],
            ["doc_id", "name", "place", "n_shingles", "set_a", "set_b", "signature"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk keys with one symbol left out."""
    for batch in batches:
        ids = batch.column("rep").to_numpy(zero_copy_only=False)
        signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(len(ids), SYMBOLS).astype(U64)
        out = np.empty((len(ids), SYMBOLS), U64)
        for c in range(CHUNKS):
            for mask in range(WIDTH):
                key = np.full(len(ids), c * WIDTH + mask + 1, U64)
                for k in range(WIDTH):
                    if k != mask:
                        key = splitmix(key ^ signature[:, c * WIDTH + k])
                out[:, c * WIDTH + mask] = key
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, SYMBOLS), pa.int64())], ["key", "rep"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most MOST_ERRORS symbols."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
        yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= MOST_ERRORS))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "text_b"):
                (ha, ra), (hb, rb) = (shingle_sets(*utf8(batch.column(c))) for c in ("text_a", "text_b"))
                n = np.bincount(ra, minlength=batch.num_rows) + np.bincount(rb, minlength=batch.num_rows)
                key = np.concatenate([splitmix(h ^ splitmix(r.astype(U64))) for h, r in ((ha, ra), (hb, rb))])
                row = np.concatenate([ra, rb])
                order = np.argsort(key, kind="stable")
                same = np.flatnonzero(key[order][1:] == key[order][:-1])
                inter = np.bincount(row[order[same]], minlength=batch.num_rows)
                linked = (inter > 0) & (100 * inter >= percent * (n - inter))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        h, row = shingle_sets(*utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(row)), pa.array(h.view(np.int64))], ["rep", "token"])


def _confirm_blocks(percent: int):
    """Exact comparison of all members of a row, by products of 0/1 matrices over runs of shingles; yields the roots that it links."""
    run_of = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for members in batch.column("members"):
                rows = members.values
                root, half = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("root", "half"))
                h, row = shingle_sets(*utf8(rows.field("payload")))
                n = np.bincount(row, minlength=len(root))
                _, column, held_by = np.unique(h, return_inverse=True, return_counts=True)
                keep = held_by[column] > 1
                names, column = np.unique(column[keep], return_inverse=True)
                row = row[keep]
                order = np.argsort(column, kind="stable")
                column, row = column[order], row[order]
                inter = np.zeros((len(root), len(root)), np.float32)
                for first in range(0, len(names), run_of):
                    a, b = np.searchsorted(column, (first, first + run_of))
                    part = np.zeros((len(root), run_of), np.float32)
                    part[row[a:b], column[a:b] - first] = 1
                    inter += part @ part.T
                linked = (inter > 0) & (100 * inter.astype(np.int64) >= percent * (n[:, None] + n[None, :] - inter.astype(np.int64)))
                linked &= (root[:, None] < root[None, :]) & ((half[:, None] != half[None, :]) | (half[:, None] == 0))
                x, y = np.nonzero(linked)
                out += {*zip(root[x].tolist(), root[y].tolist(), strict=True)}
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, name): equal names for rows with the same id and text."""
    return tables.texts(docs).withColumn("name", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, place, n_shingles, set_a, set_b) of every text, and (set_a, set_b, first, rep, signature) of every distinct set: its first row and that row's name."""
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)).alias("place")
    schema = "doc_id long, name long, place long, n_shingles long, set_a long, set_b long, signature binary"
    signed = tables.written(named(docs).select("doc_id", "text", "name", place).mapInArrow(_signatures, schema))
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "name", "place")
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(order).alias("first"), F.first("signature").alias("signature"))
    return signed.drop("signature"), tables.written(classes.withColumn("rep", F.col("first.name")))


def links(docs: DataFrame, classes: DataFrame, percent: int = 85) -> DataFrame:
    """(node, root): components of representatives that have a link."""
    reps = classes.select("rep", "signature")
    active = tables.written(shared_keys(reps.mapInArrow(_keys, "key long, rep long")))
    names = active.select(F.col("rep").alias("name")).distinct()
    held = tables.written(named(docs).join(names, "name", "left_semi").groupBy("name").agg(F.first("text").alias("text")), bytes_heavy=True)

    def judge(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("rep").alias(side), F.col("signature").alias(f"sig_{side}")), side)
        near = pairs.mapInArrow(_close, "a long, b long")
        for side in ("b", "a"):
            near = near.join(held.select(F.col("name").alias(side), F.col("text").alias(f"text_{side}")), side)
        return near.mapInArrow(_confirm(percent), "a long, b long, linked boolean")

    def judge_blocks(blocks: DataFrame) -> DataFrame:
        members = blocks.groupBy("key", "i", "j").agg(F.collect_list(F.struct("rep", "root", "half", "payload")).alias("members"))
        return members.select("members").mapInArrow(_confirm_blocks(percent), "a long, b long")

    def tokens(reps: DataFrame) -> DataFrame:
        texts = held.join(reps.select(F.col("rep").alias("name")), "name", "left_semi")
        return texts.mapInArrow(_tokens, "rep long, token long")

    payload = held.select(F.col("name").alias("rep"), F.octet_length("text").alias("size"), F.col("text").alias("payload"))
    return linked_components(active, judge, judge_blocks, payload, tokens, percent, BLOCK_ROWS, BLOCK_BYTES)


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, name, n_shingles, component_id, kept), one row per document."""
    signed, classes = classes_of(docs)
    roots = links(docs, classes, percent)
    firsts = roots.join(classes.select(F.col("rep").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(firsts, "root").select(F.col("node").alias("rep"), "least")
    of_class = classes.join(linked, "rep", "left").select("set_a", "set_b", F.coalesce("least", "first").alias("least"))
    out = signed.join(of_class, ["set_a", "set_b"], "left")
    some = F.col("n_shingles") > 0
    component = F.when(some, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    kept = F.when(some, (F.col("name") == F.col("least.name")) & (F.col("place") == F.col("least.place"))).otherwise(F.lit(True)).alias("kept")
    return out.select("doc_id", "name", "n_shingles", component, kept)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept."""
    return _decided(docs, percent).drop("name")


def dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The kept rows of docs, with all columns."""
    kept = tables.written(_decided(docs, percent).where("kept").select("name", (F.col("n_shingles") > 0).alias("some")).distinct())
    no_id = F.col("doc_id").cast("long").isNull()

    def stay(which: F.Column, how: str) -> DataFrame:
        name = F.xxhash64(no_id, F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
        return docs.where(which).select(F.struct(*docs.columns).alias("row"), name.alias("name")).join(kept, "name", how)

    # equal texts without an id have one name, and one of them stays
    without = stay(no_id, "inner")
    one = without.where("some").groupBy("name").agg(F.first("row").alias("row"))
    return stay(~no_id, "left_semi").select("row.*").union(one.select("row.*")).union(without.where("not some").select("row.*"))
