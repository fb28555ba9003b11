"""The trie against plain counts, its sequences against sorted arrays."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import ngram_trie
from evidentia.llm.ngram_trie import EliasFano

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 10**12), (1000, 50), (5000, 10**9), (70000, 2**40), (300, 2**62)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
    ef = EliasFano(EliasFano.encode(x))
    if n:
        assert (ef.get(np.arange(n)) == x).all()
    probes = np.concatenate([x, x + np.uint64(1), rng.integers(0, top + 2, 500).astype(np.uint64), np.array([0], np.uint64)])
    assert (ef.successor(probes) == np.searchsorted(x, probes)).all()


def brute(rows):
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
    toks = [(i, [*WORD.findall(lower(t)), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in toks]
    uni, bi = Counter(), Counter()
    for (_, t), h in zip(toks, held):
        if not h:
            uni.update(t)
            bi.update(zip([None, *t], t))
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for (i, t), h in zip(toks, held):
        base = math.fsum(math.log10(p(w)) for w in t)
        score = math.fsum(math.log10((bi[a, w] + ngram_trie.MU * p(w)) / (uni[a] + ngram_trie.MU)) for a, w in zip([None, *t], t))
        out.append((i, h, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], abs=1e-9 + 1e-4 * g[2])


def test_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    compare(ngram_trie.query(docs).collect(), want)
    monkeypatch.setattr(ngram_trie, "RANGE_ROWS", 1000)
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", 20000)
    compare(ngram_trie.query(docs).collect(), want)


def test_held_out_texts_are_more_likely_in_context(spark):
    """The context helps on texts that were not learned."""
    r = ngram_trie.query(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (3, "The cat sat"), (3, "The cat sat"), (4, "the CAT ran é"), (None, "null id the cat"), (5, "w " * 50000), (6, "x" * 90000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    compare(ngram_trie.query(docs).collect(), brute(rows))


def test_empty(spark):
    assert ngram_trie.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    compare(ngram_trie.query(spark.createDataFrame(held, "doc_id long, text string")).collect(), brute(held))
