"""Byte-level BPE and packing against the tokenizer libraries and by their contracts."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from evidentia.llm import best_fit_packing, byte_bpe, queries
from evidentia.llm.tokenizers_public import default_path, encoder

SMALL = "/root/testdata/sf0.001"
RANKS = default_path("byte_bpe_50k.tiktoken")
JSON_FORM = default_path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "  two  spaces\n\n\t end ", "don't we'll", "x" * 3000, "é😀 日本語 ١٢٣   　z", "\x00\x01▁_ <|endoftext|>", "=" * 999 + "12345 " * 700, "ab" * 2000, "İıſK…", "w " * 1023, "w " * 1024]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a")]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    return odd.union(spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text"))


def test_bpe(docs):
    enc = encoder(RANKS)
    rows = docs.collect()
    want = sorted((r.doc_id, enc.encode_ordinary(r.text or ""), r.text or "") for r in rows)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.query(docs, RANKS).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(i, len(ids), sha(" ".join(map(str, ids))), sha(t)) for i, ids, t in want]
    assert sorted((r.doc_id, r.ids) for r in byte_bpe.encoded(docs, RANKS).collect()) == [(i, ids) for i, ids, _ in want]


def test_packing(docs):
    json_form = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    json_form.encode_special_tokens = True
    out = best_fit_packing.query(docs, RANKS).toPandas()
    rows = docs.dropDuplicates().collect()
    for r in rows:
        ids = [*json_form.encode(r.text or "", add_special_tokens=False).ids, 2]
        mine = out[out.doc_id == r.doc_id].drop_duplicates("piece").sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine)))
        assert mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist() and mine.length.sum() == len(ids)
        assert len(mine) == -(-len(ids) // 1024) and (mine.length[1:] == 1024).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= 1024
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.offset == out.groupby("sequence_id").length.cumsum() - out.length).all()
    assert len(sizes) <= 1.01 * -(-out.length.sum() // 1024) + 1
    assert (out.doc_id == 3).sum() == 2


def test_added_tokens(spark, tmp_path):
    """The registered query gives the ids of the JSON form as it is loaded."""
    json_form = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n<|endoftext| >", "<|endoftext|>" * 1500]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op8_best_fit_packing(spark, str(tmp_path)).toPandas()
    for i, text in enumerate(texts):
        ids = [*json_form.encode(text or "", add_special_tokens=False).ids, 2]
        own = out[out.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert json_form.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_capacities(spark, rule):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 60, 900)
    bins, offsets = best_fit_packing.best_fit(n, (100, 4, 5000), (1.0, 0.5, 0.5), rule)
    for b in np.unique(bins):
        own = n[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 5000
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == (own[order].cumsum() - own[order]).tolist()
    with pytest.raises(Exception, match="larger than a capacity"):
        parts = spark.createDataFrame([(1, 0, 0, 90, 0)], best_fit_packing.PIECES)
        best_fit_packing.pack(parts, 100, 4, 5000).collect()


def brute_fit(lengths, capacities, weights, rule):
    """Every item, longest first, into the open sequence of least score among all that have room."""
    w = [x / c**2 for x, c in zip(weights, capacities, strict=True)]
    rooms, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = int(lengths[i])
        need = (n, 1, n * n)
        fits = [b for b, room in enumerate(rooms) if all(r >= x for r, x in zip(room, need, strict=True))]
        score = lambda b: sum(v * (r - x) ** 2 for v, r, x in zip(w, rooms[b], need, strict=True)) if rule == "norm" else -sum(v * r * x for v, r, x in zip(w, rooms[b], need, strict=True))  # noqa: B023, E731
        if not fits:
            rooms.append(list(capacities))
            fits = [len(rooms) - 1]
        out[i] = min(fits, key=lambda b: (round(score(b), 9), b))
        rooms[out[i]] = [r - x for r, x in zip(rooms[out[i]], need, strict=True)]
    return out, len(rooms)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_looks_at_every_open_sequence(rule):
    rng = np.random.default_rng(2)
    cases = [(np.array([2, 4, 2, 1, 3, 6, 4, 5, 10, 7, 9]), (20, 4, 127))]
    cases += [(rng.integers(1, 11, rng.integers(1, 40)), (20, int(rng.integers(2, 7)), int(rng.integers(100, 260)))) for _ in range(400)]
    for lengths, capacities in cases:
        weights = tuple(rng.choice([0.0, 0.5, 1.0], 3)) if rng.random() < 0.5 else (1.0, 1.0, 1.0)
        bins, _ = best_fit_packing.best_fit(lengths, capacities, weights, rule)
        want, opened = brute_fit(lengths, capacities, weights, rule)
        assert bins.tolist() == want and bins.max() + 1 == opened


CLASHES = "doc_id long, text string, piece string, length string, start int, ids string, dealt int, n_tokens string"


def test_null_ids_and_other_columns(spark):
    rows = [(None, "one two three"), (None, "one two three"), (None, None), (5, "x" * 40000), (5, "x" * 40000), (6, "")]
    docs = spark.createDataFrame([(*r, "a", "b", 1, "c", 2, "d") for r in rows], CLASHES)
    parts = best_fit_packing.query(docs, RANKS, JSON_FORM).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in parts if r.doc_id != 5) == [(0, 0, 1), (0, 0, 4), (0, 0, 4), (6, 0, 1)]
    assert len({(r.sequence_id, r.offset) for r in parts}) == len(parts) and len({r.ids_crc32 for r in parts if r.length == 4}) == 1
    encoded = byte_bpe.query(docs, RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in encoded if r.doc_id != 5) == [(0, 0), (0, 3), (0, 3), (6, 0)]
    assert len(encoded) == len(rows) and all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, t in zip(sorted((r for r in encoded if r.doc_id == 5), key=str), ["x" * 40000] * 2, strict=True))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.query(none, RANKS).count() == 0
    assert best_fit_packing.query(none, RANKS).count() == 0
