"""SimHash near-duplicates against brute force: fingerprints, thresholds, components with and without hot buckets and wide partitions."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from evidentia.llm import sim_dedup

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
RNG = np.random.default_rng(3)
BASE = [f"w{k}" for k in range(400)]
FORMS = [{}, {"few": 1}, {"hot": 2, "block_rows": 3}, {"few": 1, "hot": 2, "block_rows": 3}]
LONG = " ".join(f"t{k}" for k in range(60000))
ODD = [
    (1, None, "x", 1, 1),
    (2, "", "x", 1, 1),
    (3, " \t\n\x0b\x0c\r", None, 1, 1),
    (4, "One two", "x", 1, 1),
    (4, "one  TWO", "x", 1, 1),
    (5, "three", "x", None, 1),
    (None, "éÉ ß 漢字 words Éa", "x", 1, None),
    (None, "one two", "x", 1, 1),
    (None, None, "x", 1, 1),
    (6, " ".join(BASE), "x", 1, 1),
    (7, " ".join([*BASE, "more"]), "x", 1, 1),
    (8, "\n".join(BASE).upper(), "x", 1, 1),
    (9, LONG, "x", 1, 1),
    (10, LONG + " end", "x", 1, 1),
    (11, "z" * 300000, "x", 1, 1),
    (12, "a\x00b \x00 c", "x", 1, 1),
    (13, "a a a a a a a a b", "x", 1, 1),
] + [(100 + k, " ".join([*BASE[:k], "new", *BASE[k + 1 :]]), "x", 1, 1) for k in range(0, 400, 9)]


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(b)] = find(a)
    least = {}
    for i, f in zip(ids, prints, strict=True):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in prints]


def rows_of(df):
    return sorted(map(str, map(tuple, df.select("doc_id", "fingerprint", "component_id").collect())))


def brute(rows):
    ids, prints = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    return sorted(str((i, f"{f:016x}", c)) for i, f, c in zip(ids, prints, brute_components(ids, prints), strict=True))


@pytest.mark.parametrize("form", FORMS)
def test_odd_rows(spark, form):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, rep string, key int, least int")
    assert rows_of(sim_dedup.near_duplicates(odd, **form)) == brute(ODD)
    assert sim_dedup.near_duplicates(odd.limit(0), **form).collect() == []


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(sim_dedup.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("form", FORMS)
def test_dense_groups(spark, form):
    """Balls of fingerprints that share hot values, with members near and just out of reach."""
    prints = [int(x) for x in RNG.integers(0, 1 << 63, 300)]
    for base in prints[:4]:
        for _ in range(60):
            prints.append(base)
            for b in RNG.choice(64, int(RNG.integers(1, 7)), replace=False):
                prints[-1] ^= 1 << int(b)
    signed = [(k, int(np.uint64(f).astype(np.int64))) for k, f in enumerate(prints)]
    classes = spark.createDataFrame(signed, "least long, rep long").groupBy("rep").min("least")
    found = {r.node: r.root for r in sim_dedup.components(sim_dedup.links(classes.select("rep"), **form)).collect()}
    least = {}
    for k, f in signed:
        root = found.get(f, f)
        least[root] = min(k, least.get(root, k))
    assert [least[found.get(f, f)] for _, f in signed] == brute_components([k for k, _ in signed], prints)


def test_thresholds_are_the_cheapest():
    for partitions in (2, 4):
        cost = np.concatenate([np.zeros((200, partitions, 1)), np.cumsum(RNG.random((200, partitions, 4)) ** 3, axis=2)], axis=2)
        units = sim_dedup.thresholds(cost)
        assert (units.sum(axis=1) == 4).all()
        options = [u for u in itertools.product(range(5), repeat=partitions) if sum(u) == 4]
        for k in range(200):
            price = lambda u: sum(cost[k, i, u[i]] for i in range(partitions))  # noqa: B023, E731
            assert price(units[k]) == pytest.approx(min(map(price, options)))


def test_hot_values_are_avoided():
    """A fingerprint whose first block is shared by many others is not probed there."""
    near = np.ones((4, 4, 1 << 16), np.float32)
    near[0] = 1e6
    where = sim_dedup.Partitions(np.arange(64), near, 1000)
    units = sim_dedup.thresholds(where.costs(sim_dedup.blocks_of(np.arange(5, dtype=np.uint64), np.arange(64))))
    assert (units[:, 0] == 0).all() and (units.sum(axis=1) == 4).all()


def test_correlated_bits_are_grouped():
    source = RNG.integers(0, 2, (5000, 4))
    owner = RNG.permutation(64) % 4
    bits = np.where(RNG.random((5000, 64)) < 0.1, RNG.integers(0, 2, (5000, 64)), source[:, owner]).astype(np.float64)
    order = sim_dedup.grouped_bits(bits.T @ bits, 5000)
    assert sorted(order.tolist()) == list(range(64))
    assert all(len({owner[b] for b in order[k : k + 16]}) == 1 for k in range(0, 64, 16))


def test_neighbours_are_counted():
    histograms = np.zeros((4, 1 << 16), np.int64)
    histograms[:, [0, 1, 3, 7, 15]] = [1, 2, 4, 8, 16]
    near = sim_dedup.neighbour_counts(histograms)
    assert near[2, :, 0].tolist() == [1, 2, 4, 8] and near[0, :, 15].tolist() == [16, 8, 4, 2]
