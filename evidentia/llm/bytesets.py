"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, lines and substring hashes.

The hash of bytes [s, e) is a polynomial modulo 2**64 over pseudo-random byte values, taken from prefix sums,
so any substring costs two lookups; `finish` mixes it. Base and byte values come from a rule (splitmix64).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of each element."""
    with np.errstate(over="ignore"):
        x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_VALUES = splitmix(np.arange(256, dtype=U64))
LOWERED = np.arange(256)
LOWERED[65:91] += 32
BYTE_VALUES_LOWERED = BYTE_VALUES[LOWERED]
#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; grown by doubling and kept in the process."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Prefixes:
    """Hashes of substrings of one byte array."""

    def __init__(self, data: np.ndarray, lowered: bool = False):
        powers, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((BYTE_VALUES_LOWERED if lowered else BYTE_VALUES)[data] * powers[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return splitmix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about `most` bytes of text, so that memory per step is bounded by that and one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(lengths)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, (at[first - 1] if first else 0) + most, "right"))
            last = max(last, first + 1)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Words (runs of bytes other than ASCII white space) of a slice: spans, rows and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lowered: bool = True):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        inside = ~IS_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.hashes = Prefixes(data, lowered).hashes(self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every run of n words inside one row, by its first word's index (returned third)."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(m, U64)
        for k in range(n):
            h = h * U64(BASE) + self.hashes[k : k + m]
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        return splitmix(h[at]), self.row[at], at
