"""Payload chunks by an exact round trip, repeated strings against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import payload_chunks, repeat_removal

SMALL = "/root/testdata/sf0.001"
RNG = np.random.default_rng(3)
NOISE = ["".join(chr(c) for c in RNG.integers(97, 123, 30000)) for _ in range(4)]
TEXTS = [
    None, "", "a", "a\x00", "é" * 32, NOISE[0][:9000], NOISE[0][:9000], NOISE[1][:500] + NOISE[0][3000:6000] + NOISE[2][:500],
    NOISE[2][700:1100] + "-", "+" + NOISE[2][700:1100], NOISE[2][5000:5399] + "-", "+" + NOISE[2][5000:5399],
    "=" * 5000, "ab" * 300, NOISE[3][:800] + NOISE[3][:800], NOISE[3][900:1299], NOISE[3][2000:2600], NOISE[1][9000:9100] + NOISE[3][2100:2500] + NOISE[1][9200:9300],
    NOISE[3][2300:3000], NOISE[0][8000:9500] + NOISE[0][8500:9900], "x" * 400, "x" * 401, "y" * 400, NOISE[1],
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = list(enumerate(TEXTS)) + [(None, NOISE[2][:2000]), (None, None), (23, NOISE[1])]
    return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, payload string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("table", ["odd", "small"])
def test_round_trip(request, table):
    docs = request.getfixturevalue(table)
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), payload_chunks.feature(full)))
    got = payload_chunks.query(docs).collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature)) for r in got)
    by = {}
    for r in got:
        assert r.media_bytes == r.payload_bytes + 4 + 4 * r.n_chunks
        assert by.setdefault(r.payload_sha256, r.media_sha256) == r.media_sha256


def test_chunks_are_stored_once(spark, odd):
    _, stored = payload_chunks.store(odd)
    digests = [d for r in stored.collect() for d, own in zip(r.digests, r.own) if own]
    assert len(digests) == len(set(digests))
    refs = [d for r in stored.collect() for d in r.digests]
    assert set(refs) == set(digests) and len(refs) > len(digests)


def test_cuts_follow_content():
    a, b = (NOISE[0] * 2).encode(), (NOISE[1][:777] + NOISE[0] * 2).encode()
    ea, eb = payload_chunks.cut_ends([a, b])
    assert ea[-1] == len(a) and all(256 <= y - x <= 8192 for x, y in zip([0, *ea[:-2]], ea[:-1]))
    assert len({x + 777 for x in ea} & set(eb)) > 0.8 * len(ea)
    h = payload_chunks.gear_hashes(np.frombuffer(a, np.uint8))
    i = 1234
    assert int(h[i]) == sum(int(payload_chunks.GEAR[a[i - j]]) << j for j in range(32)) % 2**32


def brute_repeats(rows, n=400):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(raw[i : i + n] for raw in raws for i in range(len(raw) - n + 1))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("table", ["odd", "small"])
def test_repeats(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_removal.query(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_repeats(rows)))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert payload_chunks.query(none).count() == 0
    assert repeat_removal.query(none).count() == 0
