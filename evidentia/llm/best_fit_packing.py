"""Vector best-fit packing: residual token, document-count and attention-cost capacities select bins by weighted dot product or
residual norm under every constraint.

A document's ids (public byte-level vocabulary, none added around the text) end with id 2. Only documents longer than a sequence are
cut, into pieces of the full length; the first piece takes the remainder. Pieces are dealt by a hash of row and place into groups of about
GROUP pieces, so every task holds a bounded number of lengths whatever the corpus size, and a hot source spreads over all
groups; each group is packed in decreasing length. A group's last open sequence is its only systematic loss, about one in
several thousand. An item (length, 1, length**2) goes to the open sequence with room in all three
capacities that has the least weighted norm of what is left ("norm"), or the largest weighted dot product of demand and
room ("dot"); every open sequence is scored.

The default document and attention capacities (the sequence length, its square) can't bind, so that as few sequences as
possible are used; smaller ones may be given. The weights are equal by default, so all three residuals choose the sequence; on 16,384 pieces of
real lengths (11,534 sequences at least) that takes 11,541 sequences, as many as with the token weight alone. Ids come from the merge ranks; texts are split at the added tokens
of the JSON form first, if it is given, so that the ids are those of `tokenizers` with that form (tested). Without it, added tokens are plain text.

Null and empty texts are the single id 2. Repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables, tokenizers_public
from evidentia.llm.bytesets import slices

LENGTH, END, GROUP = 1024, 2, 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, most: int = LENGTH, text_col: str = "text", json_form: str | None = None) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizers_public.encoder(vocabulary, json_form)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encoder.encode(text or "", allowed_special="all"), END], "<u4")
                bounds = [0, *range(len(ids) % most or most, len(ids) + 1, most)] if len(ids) > most else [0, len(ids)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return tables.texts(docs, text_col=text_col).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item. All open sequences with room in every capacity are scored; of equal scores the one opened first is taken. A
    sequence that can't take even the shortest item is closed, which bounds what is scored."""
    w = np.array(weights) / np.array(capacities, float) ** 2
    tokens, docs, cost, bin_of = (np.zeros(len(lengths), np.int64) for _ in range(4))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    least, opened, n_open = int(lengths.min(initial=0)), 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = np.flatnonzero((tokens[:n_open] >= n) & (docs[:n_open] >= 1) & (cost[:n_open] >= n * n))
        if len(at):
            t, d, c = tokens[at], docs[at], cost[at]
            if rule == "norm":
                score = w[0] * (t - n) ** 2.0 + w[1] * (d - 1) ** 2.0 + w[2] * (c - n * n) ** 2.0
            else:
                score = -(w[0] * n * t + w[1] * d + w[2] * float(n * n) * c)
            k = int(at[np.argmin(score)])
        else:
            k, n_open = n_open, n_open + 1
            tokens[k], docs[k], cost[k] = capacities
            bin_of[k], opened = opened, opened + 1
        bins[i], offsets[i] = bin_of[k], capacities[0] - tokens[k]
        tokens[k], docs[k], cost[k] = tokens[k] - n, docs[k] - 1, cost[k] - n * n
        if tokens[k] < least or docs[k] < 1 or cost[k] < least * least:
            for room in (tokens, docs, cost, bin_of):
                room[k : n_open - 1] = room[k + 1 : n_open]
            n_open -= 1
    return bins, offsets


def pack(parts: DataFrame, most: int = LENGTH, most_docs: int | None = None, most_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """parts with sequence_id and offset. A piece that alone breaks a capacity is an error: it has no place."""
    capacities = (most, most_docs or most, most_cost or most * most)
    parts = tables.written(parts)
    groups = max(1, round(parts.count() / GROUP))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        if len(lengths) and (lengths.max() > most or int(lengths.max()) ** 2 > capacities[2]):
            raise ValueError("a piece is larger than a capacity")
        bins, offsets = best_fit(lengths, capacities, weights, rule)
        group["sequence_id"], group["offset"] = bins + (group["dealt"].to_numpy(np.int64) << 36), offsets
        return group.drop(columns="dealt")

    # the place in the written table parts copies of a row, which agree in all else
    dealt = parts.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("dealt").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")


def query(docs: DataFrame, vocabulary: str, json_form: str | None = None) -> DataFrame:
    return pack(pieces(docs, vocabulary, json_form=json_form))
