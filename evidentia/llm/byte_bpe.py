"""Byte-level BPE by a sentencepiece model that is serialised directly from the ranks of a public vocabulary.

Every token's bytes are mapped one to one to printable characters; the piece's score is its negative rank, so that
sentencepiece merges the pair of least rank first, as the rank tables ask; normalisation is the identity. Text is split by
the public pattern, each match encoded by itself (a match that is a token as a whole is that token); decoding maps pieces back to bytes.

Null and empty texts have no ids. Rows are independent: ties, repeated rows and extra columns do not matter; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from evidentia.llm import tables
from evidentia.llm.bytesets import slices
from evidentia.llm.tokenizers_public import PATTERN, ranks

#: Matches whose ids a worker remembers before it forgets them all: bounds memory, not results.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is visible, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: a message or text, a varint, or a float."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(by_rank: list[bytes]) -> bytes:
    """The model file: pieces in rank order, so that ids are ranks; the unknown piece comes last."""
    chars = byte_characters()
    pieces = b"".join(_field(1, _field(1, "".join(chars[b] for b in token)) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(by_rank))
    pieces += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class Codec:
    def __init__(self, path: str):
        self.ranks = ranks(path)
        by_rank = sorted(self.ranks, key=self.ranks.__getitem__)
        assert [self.ranks[t] for t in by_rank] == list(range(len(by_rank))), "ranks must be dense"
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(by_rank))
        self.mapped = dict(enumerate(byte_characters()))
        self.split = regex.compile(PATTERN).findall
        self.decimal = [str(i) for i in range(len(by_rank))]
        self.sizes = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(by_rank), np.uint8)
        self.known: dict[str, bytes] = {}

    def _learn(self, matches: set[str]) -> None:
        """Encodes the matches that are not remembered, in one call."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [m for m in matches if m not in self.known]
        raw = [m.encode() for m in new]
        ids = self.model.encode([r.decode("latin-1").translate(self.mapped) for r in raw], num_threads=1)
        for m, r, i in zip(new, raw, ids, strict=True):
            whole = self.ranks.get(r)
            self.known[m] = np.array(i if whole is None else [whole], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        matches = [self.split(t) for t in texts]
        self._learn(set().union(*matches))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, m)), "<u4") for m in matches]

    def decode(self, ids: np.ndarray) -> bytes:
        """Piece bytes one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def text_of(self, ids: np.ndarray) -> str:
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in slices(batches, most=1 << 20):
            ids = c.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return tables.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in slices(batches, most=1 << 20):
            ids = c.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(c.text_of(i).encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return tables.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
