"""Hot buckets: with blocks of a few members, groups that are alike but not all linked go through the prefix filter; against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import buckets, line_dedup, near_dedup

RNG = np.random.default_rng(11)
WORDS = ["".join(chr(c) for c in RNG.integers(97, 123, 5)) for _ in range(4000)]


def _variants(n: int, words: int, edits: range) -> list[str]:
    """Texts of one origin with different numbers of words exchanged, near and far from each other."""
    origin = list(RNG.choice(WORDS, words))
    out = []
    for k in range(n):
        mine = list(origin)
        for at in RNG.choice(words, edits[k % len(edits)], replace=False):
            mine[at] = WORDS[int(RNG.integers(len(WORDS)))]
        out.append(" ".join(mine))
    return out


TEXTS = _variants(40, 300, range(0, 9)) + _variants(20, 300, range(6, 9)) + ["short text", "short text"]


def _roots(sets: list[frozenset], linked) -> list[int]:
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if linked(len(sets[a] & sets[b]), len(sets[a] | sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(sets))]


@pytest.fixture
def counted(monkeypatch):
    """Small blocks, and how many rows the prefix filter has given keys to."""
    seen, own = [], buckets.prefix_keys

    def spy(left, tokens, percent):
        seen.append(left.count())
        return own(left, tokens, percent)

    monkeypatch.setattr(buckets, "prefix_keys", spy)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 3)
    return seen


def test_near_duplicates_of_hot_buckets(spark, counted):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in TEXTS)]
    want = _roots(sets, lambda both, either: 100 * both >= 85 * either)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(TEXTS))] == want
    assert sum(counted) > 0 and len(set(want)) > 4


def test_lines_of_hot_buckets(spark, counted):
    lines = _variants(40, 60, range(0, 7)) + _variants(20, 60, range(4, 7))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    rows = docs.withColumn("line", F.col("text")).select("doc_id", line_dedup._set().alias("set")).collect()
    sets = [frozenset(r.set) for r in sorted(rows, key=lambda r: r.doc_id)]
    want = _roots(sets, lambda both, either: 100 * both >= 80 * either)
    kept = {r.doc_id for r in line_dedup.dedup(docs).where("text <> ''").collect()}
    # candidates of lines may be missed by the bands now and then, never the other way round
    assert kept >= set(want) and len(kept - set(want)) <= 2
    assert sum(counted) > 0 and len(set(want)) > 4


def test_bands_are_dealt_once(spark):
    rows = [(1, [10, 11, 11]), (2, [11, 12]), (3, [12, 13, None]), (1, [10]), (4, [14]), (5, None)]
    found = line_dedup.shared_bands(spark.createDataFrame(rows, "lid long, bands array<long>"))
    assert sorted(tuple(r) for r in found.collect()) == [(11, 1), (11, 2), (12, 2), (12, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count(" Exchange hashpartitioning") <= 2  # the deal, named once more by its reuse


def test_pairs_of_small_buckets_are_judged_at_once(spark, monkeypatch):
    """Leaders get the buckets of more members only; the links are those of brute force."""
    left, own = [], buckets._Links.rounds
    monkeypatch.setattr(buckets._Links, "rounds", lambda self, active, *rounds: left.append(active.count()) or own(self, active, *rounds))
    lines = _variants(14, 60, range(0, 7)) + _variants(9, 40, range(2, 5))
    docs = spark.createDataFrame(list(enumerate(lines)) + [(3, lines[3])], "doc_id long, text string")
    sets = [frozenset(r.set) for r in docs.select("doc_id", F.col("text").alias("line")).dropDuplicates().orderBy("doc_id").select(line_dedup._set().alias("set")).collect()]
    want = _roots(sets, lambda both, either: 100 * both >= 80 * either)
    kept = {r.doc_id for r in line_dedup.dedup(docs).where("text <> ''").collect()}
    assert kept >= set(want) and len(kept - set(want)) <= 1 and 1 < len(set(want)) < len(lines)
    assert left == [0]
    monkeypatch.setattr(buckets, "FEW", 1)  # all of them by leaders
    assert {r.doc_id for r in line_dedup.dedup(docs).where("text <> ''").collect()} == kept and left[1] > 0
