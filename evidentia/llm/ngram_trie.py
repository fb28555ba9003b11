"""Language-model scores from an Elias-Fano n-gram trie: monotone pointers and quantised smoothed probabilities in compact
memory-mapped levels, queried by context-relative successor search.

Tokens are words (runs of bytes other than ASCII white space, A-Z lowered) named by a 64-bit hash, and one end per text.
Training texts are those whose crc32(doc_id as text) mod 5 is not 1. The model is a bigram model with Dirichlet smoothing:
P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU), P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); the context of a text's first token is the end of the one before.

Level 1 is the sorted vocabulary with exact counts, cut into ranges of the hash; a word's place over all ranges is its number.
Level 2 holds the bigrams, dealt to shards by a hash of the pair, so that a frequent context spreads over all shards. A
shard has three Elias-Fano sequences: its contexts, for each the pointer to its first successor, and the successors, made monotone by adding the last value of
the context before; a bigram is found by the least element from (successor + base) on inside the context's range.
Its smoothed probability is quantised to 16 bits, linearly in log10 between the shard's bounds.

Counting pre-aggregates in every slice and ships each shard's counts as one compact row per slice; the shard's task merges them slice by
slice. Numbers of ranges and shards grow with the data. Model files lie in the shared folder; tasks map them into memory and
never hold them, nor does the driver.

Null and empty texts are their end only. Repeated rows are learned and scored each. A null id is never held out (it has no remainder).
An empty table gives an empty result; with no training text every probability is that of an unseen token under V = N = 0. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.bytesets import Words, slices, splitmix, utf8

U64 = np.uint64
#: The name of the end token; no word is named so but by chance (1 in 2**64).
END = U64(0x5EED5EED5EED5EED)
MU = 3.0
HELD_OUT = 1
#: Rows of level 1 in a range, and bigram occurrences in a shard, about.
RANGE_ROWS, SHARD_TOKENS = 2_000_000, 6_000_000
LEVELS = 65535


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A monotone sequence: low bits packed plainly, high parts as a bit vector in unary. Arrays may be memory-mapped."""

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (values & U64((1 << width) - 1)).astype(U64)
        high = (values >> U64(width)).astype(np.int64)
        packed = np.zeros(n * width // 64 + 2, U64)
        if width:
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(packed, word, low << shift)
            over = (shift + U64(width)) > U64(64)
            np.bitwise_or.at(packed, word[over] + 1, low[over] >> (U64(64) - shift[over]))
        bits = np.zeros((n + (int(high[-1]) if n else 0)) // 64 * 64 + 128, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(U64)
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        return {"low": packed, "high": words, "ones": ones, "shape": np.array([n, width], np.int64)}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.n, self.width = map(int, parts["shape"])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        got = self.low[word] >> shift
        over = (shift + U64(self.width)) > U64(64)
        got[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return got & U64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i: select of the i-th one."""
        word = np.searchsorted(self.ones, i, "right")
        before = np.where(word > 0, self.ones[np.maximum(word - 1, 0)], 0)
        bit = _select_in_word(self.high[word], i - before)
        return ((word * 64 + bit - i).astype(U64) << U64(self.width)) | self._lows(i)

    def _high_start(self, h: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is below h: select of the h-th zero, less the zeros before it."""
        zeros = self._zero_sums()
        word = np.searchsorted(zeros, h - 1, "right")
        before = np.where(word > 0, zeros[np.maximum(word - 1, 0)], 0)
        inside = np.minimum(word, len(self.high) - 1)
        bit = _select_in_word(~self.high[inside], np.maximum(h - 1 - before, 0))
        return np.where(h <= 0, 0, np.where(word >= len(self.high), self.n, word * 64 + bit - (h - 1)))

    def _zero_sums(self) -> np.ndarray:
        if not hasattr(self, "_zeros"):
            self._zeros = np.arange(1, len(self.ones) + 1, dtype=np.int64) * 64 - self.ones
        return self._zeros

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first element >= x, n if there is none: the bucket of its high part, then a search over its low bits."""
        h = (x >> U64(self.width)).astype(np.int64)
        lo, hi = self._high_start(h), self._high_start(h + 1)
        low = x & U64((1 << self.width) - 1)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at]) >> 1
            less = self._lows(mid) < low[at]
            lo[at[less]] = mid[less] + 1
            hi[at[~less]] = mid[~less]


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in 64-bit words, by halving."""
    at = np.zeros(len(word), np.int64)
    word, k = word.copy(), k.copy()
    for half in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(word & U64((1 << half) - 1)).astype(np.int64)
        right = k >= count
        k[right] -= count[right]
        word[right] >>= U64(half)
        at[right] += half
    return at


# ---------------------------------------------------------------- model files


def _folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def save(uri: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays, in place at once by a rename: a task that runs twice leaves one whole file."""
    fs, path = _folder(uri)
    fs.create_dir(path, recursive=True)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [str(a.dtype), len(a), at]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    tmp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        out.write(len(text).to_bytes(8, "little") + text + bytes(-len(text) % 8))
        for a in arrays.values():
            raw = np.ascontiguousarray(a).tobytes()
            out.write(raw + bytes(-len(raw) % 8))
    fs.move(tmp, f"{path}/{name}")


@functools.lru_cache(4096)
def load(uri: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. A file in a store that can't be mapped is first copied to the worker's own folder."""
    fs, path = _folder(uri)
    local = f"{path}/{name}"
    if not isinstance(fs, pa.fs.LocalFileSystem):
        local = os.path.join(tempfile.mkdtemp(), name)
        pa.fs.copy_files(f"{path}/{name}", local, source_filesystem=fs, destination_filesystem=pa.fs.LocalFileSystem())
    raw = np.memmap(local, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = 8 + size + -size % 8
    return {k: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}


class Vocabulary:
    """Level 1: word hashes in ranges. Numbers run over all ranges."""

    def __init__(self, uri: str, ranges: int, bases: list[int]):
        self.uri, self.ranges, self.bases = uri, ranges, bases

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and training count of sorted hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = range_of(hashes, self.ranges)
        bounds = np.searchsorted(part, np.arange(self.ranges + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            if self.bases[k] == self.bases[k + 1]:
                continue
            a, b = bounds[k], bounds[k + 1]
            own = load(self.uri, f"words-{k}")
            at = np.minimum(np.searchsorted(own["hashes"], hashes[a:b]), len(own["hashes"]) - 1)
            hit = own["hashes"][at] == hashes[a:b]
            number[a:b] = np.where(hit, at + self.bases[k], -1)
            count[a:b] = np.where(hit, own["counts"][at], 0)
        return number, count


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the 64-bit hash, by its upper 32 bits."""
    return ((hashes >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def shard_of(v: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    return (splitmix(splitmix(v.astype(U64)) ^ w.astype(U64)) >> U64(32)).astype(np.int64) * shards >> 32


class Shard:
    """Level 2: contexts, pointers, successors, quantised probabilities."""

    @staticmethod
    def build(v: np.ndarray, w: np.ndarray, log10: np.ndarray) -> dict[str, np.ndarray]:
        """From bigrams sorted by (v, w)."""
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        counts = np.diff(np.append(first, len(v)))
        ends = w[first + counts - 1].astype(U64) + U64(1)
        bases = np.cumsum(ends) - ends
        monotone = w.astype(U64) + np.repeat(bases, counts)
        least, most = float(log10.min()), float(log10.max())
        step = (most - least) / LEVELS or 1.0
        out = {"quantised": np.rint((log10 - least) / step).astype(np.uint16), "bounds": np.array([least, step])}
        for name, values in (("contexts", v[first].astype(U64)), ("pointers", np.append(first, len(v)).astype(U64)), ("successors", monotone)):
            out |= {f"{name}.{k}": a for k, a in EliasFano.encode(values).items()}
        return out

    def __init__(self, arrays: dict[str, np.ndarray]):
        of = lambda name: EliasFano({k.partition(".")[2]: a for k, a in arrays.items() if k.startswith(f"{name}.")})
        self.contexts, self.pointers, self.successors = of("contexts"), of("pointers"), of("successors")
        self.quantised, (self.least, self.step) = arrays["quantised"], arrays["bounds"]

    def log10(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Of bigrams sorted by (v, w); NaN where the shard has none."""
        out = np.full(len(v), np.nan)
        contexts, inverse = np.unique(v, return_inverse=True)
        place = self.contexts.successor(contexts.astype(U64))
        known = place < self.contexts.n
        known[known] &= self.contexts.get(place[known]) == contexts[known].astype(U64)
        start, end, base = (np.zeros(len(contexts), t) for t in (np.int64, np.int64, U64))
        start[known] = self.pointers.get(place[known]).astype(np.int64)
        end[known] = self.pointers.get(place[known] + 1).astype(np.int64)
        inner = known & (start > 0)
        base[inner] = self.successors.get(start[inner] - 1) + U64(1)
        at = np.flatnonzero(known[inverse])
        of = inverse[at]
        x = w[at].astype(U64) + base[of]
        found = self.successors.successor(x)
        hit = found < end[of]
        hit[hit] &= self.successors.get(found[hit]) == x[hit]
        out[at[hit]] = self.least + self.step * self.quantised[found[hit]]
        return out


# ---------------------------------------------------------------- training


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token names and rows of a batch, hashed in smaller slices."""
    names, rows, first = [], [], 0
    for part in slices(iter([batch])):
        n, r = tokens(*utf8(part.column("text")))
        names.append(n)
        rows.append(r + first)
        first += part.num_rows
    return np.concatenate(names), np.concatenate(rows)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token names and rows: each row's words, then its end."""
    words = Words(data, offsets)
    rows = len(offsets) - 1
    ends = np.cumsum(words.counts + 1) - 1
    names = np.empty(len(words.hashes) + rows, U64)
    is_word = np.ones(len(names), bool)
    is_word[ends] = False
    names[is_word], names[ends] = words.hashes, END
    return names, np.repeat(np.arange(rows), words.counts + 1)


def _with_context(names: np.ndarray, row: np.ndarray) -> np.ndarray:
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[np.concatenate([[True], row[1:] != row[:-1]])[: len(names)]] = END
    return before


def _blob(*arrays: np.ndarray) -> bytes:
    """Sorted or small numbers, as differences, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.diff(a.view(np.int64), prepend=np.int64(0)).tobytes() for a in arrays))


def _unblob(raw: bytes, n: int) -> tuple[np.ndarray, ...]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)
    return tuple(np.cumsum(flat[k * n : (k + 1) * n]) for k in range(len(flat) // max(n, 1)))


def _split_rows(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    for a, b in zip(first, np.append(first[1:], len(part)), strict=False):
        yield int(part[a]), tuple(x[order[a:b]] for x in arrays)


def _rows_out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, n, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["part", "n", "counts"])


ROWS = "part long, n long, counts binary"


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (int64 views of sorted unsigned numbers below 2**63, or any) with summed counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], np.add.reduceat(count, first) if len(first) else count


def merge_runs(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Merges the compact rows of one part, compacting whenever what is pending has grown to the merged size."""
    keys, counts, pending, size = [], [], 0, 0
    for frame in frames:
        for n, raw in zip(frame["n"], frame["counts"], strict=True):
            key, count = _unblob(raw, n)
            keys.append(key)
            counts.append(count)
            pending += n
            if pending > max(1_000_000, size):
                key, count = _summed(keys, counts)
                keys, counts, pending, size = [key], [count], 0, len(key)
    return _summed(keys, counts)


def _slice_counts(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.unique(names, return_counts=True)
    return key, count.astype(np.int64)


def train(training: DataFrame) -> dict:
    """Builds the model from (text) rows; returns what tasks need to open it (a few numbers per range)."""
    spark = training.sparkSession
    uri = tables.scratch(spark)
    # an upper bound of tokens: bytes, half of them at most words, and one end each
    size = training.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0)).alias("n")).first()["n"]
    ranges = int(max(1, size // (RANGE_ROWS * 16)))
    shards = int(max(1, size // (SHARD_TOKENS * 2)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            names, count = _slice_counts(tokens_of(batch)[0])
            yield _rows_out([(k, len(a), _blob(a, c)) for k, (a, c) in _split_rows(range_of(names, ranges), names, count)])

    def level_1(part: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count = merge_runs(frames)
        key = key.view(U64)
        order = np.argsort(key)  # names are unsigned
        key, count = key[order], count[order]
        save(uri, f"words-{part[0]}", {"hashes": key, "counts": count})
        yield pd.DataFrame({"part": [part[0]], "words": [len(key)], "tokens": [int(count.sum())]})

    sizes = training.mapInArrow(words, ROWS).groupBy("part").applyInPandas(level_1, "part long, words long, tokens long").collect()  # one row per range
    per = {r.part: r for r in sizes}
    bases = np.cumsum([0, *(per[k].words if k in per else 0 for k in range(ranges))]).tolist()
    model = {"uri": uri, "ranges": ranges, "bases": bases, "shards": shards, "V": bases[-1], "N": sum(r.tokens for r in sizes)}

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(uri, ranges, bases)
        for batch in slices(batches, most=8 << 20):
            names, row = tokens_of(batch)
            distinct, inverse = np.unique(names, return_inverse=True)
            number, _ = vocabulary.find(distinct)
            w = number[inverse]
            v = _with_context(w.view(U64), row).view(np.int64)
            v[v == np.int64(END.view(np.int64))] = number[np.searchsorted(distinct, END)]
            key, count = _slice_counts(v << 32 | w) if bases[-1] < 1 << 31 else _wide(v, w)
            yield _rows_out([(k, len(a), _blob(a, c)) for k, (a, c) in _split_rows(shard_of(key >> 32, key & 0xFFFFFFFF, shards), key, count)])

    def level_2(part: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count = merge_runs(frames)
        v, w = key >> 32, key & 0xFFFFFFFF
        counts = lambda x: _counts_by_number(uri, bases, x)
        p = (counts(w) + 0.5) / (model["N"] + 0.5 * (model["V"] + 1))
        save(uri, f"bigrams-{part[0]}", Shard.build(v, w, np.log10((count + MU * p) / (counts(v) + MU))))
        yield pd.DataFrame({"part": [part[0]], "bigrams": [len(key)]})

    built = training.mapInArrow(bigrams, ROWS).groupBy("part").applyInPandas(level_2, "part long, bigrams long").collect()  # one row per shard
    return model | {"has": sorted(r.part for r in built)}


def _wide(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raise ValueError("more than 2**31 words: numbers no longer fit one key")


def _counts_by_number(uri: str, bases: list[int], number: np.ndarray) -> np.ndarray:
    """Training counts of word numbers, range by range."""
    out = np.zeros(len(number), np.int64)
    part = np.searchsorted(bases, number, "right") - 1
    for k in np.unique(part):
        mine = np.flatnonzero(part == k)
        out[mine] = load(uri, f"words-{k}")["counts"][number[mine] - bases[k]]
    return out


# ---------------------------------------------------------------- scoring

SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """One row per text. Memory per task: a slice of texts, and mapped pages of the model."""
    big_n, big_v = model["N"], model["V"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model["uri"], model["ranges"], model["bases"])
        has, known_shards = set(model["has"]), {}
        for batch in slices(batches, most=8 << 20):
            names, row = tokens_of(batch)
            distinct, inverse = np.unique(names, return_inverse=True)
            number, count = vocabulary.find(distinct)
            p = (count + 0.5) / (big_n + 0.5 * (big_v + 1))
            w = inverse
            v = _with_context(names, row)
            v = np.where(v == END, np.searchsorted(distinct, END), np.roll(w, 1))
            pairs, of = np.unique(v << 32 | w, return_inverse=True)
            pv, pw = pairs >> 32, pairs & 0xFFFFFFFF
            logs = np.log10(MU * p[pw] / (count[pv] + MU))
            both = np.flatnonzero((number[pv] >= 0) & (number[pw] >= 0))
            for k, (at,) in _split_rows(shard_of(number[pv[both]], number[pw[both]], model["shards"]), both):
                if k not in has:
                    continue
                if k not in known_shards:
                    known_shards[k] = Shard(load(model["uri"], f"bigrams-{k}"))
                got = known_shards[k].log10(number[pv[at]], number[pw[at]])
                logs[at] = np.where(np.isnan(got), logs[at], got)
            n = np.bincount(row, minlength=batch.num_rows)
            sums = [np.bincount(row, x, batch.num_rows) for x in (count[w] > 0, np.log10(p)[w], logs[of])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array([big_n] * batch.num_rows, pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                [f.split()[0] for f in SCORES.split(", ")],
            )

    return docs.mapInArrow(run, SCORES)


def query(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == HELD_OUT, F.lit(False))
    source = tables.texts(docs)
    model = train(source.where(~held_out).select("text"))
    return scores(source, model).withColumn("held_out", held_out)
