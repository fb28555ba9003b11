"""Vector codes and centroid clusters against brute force, on the smallest table and on odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import centroid_clusters, vector_codes
from evidentia.llm.oracles import CLUSTERS, CODES
from evidentia.llm.vectors import MOST, squared

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, parts string, code string, cluster string, key int, salt int"
RNG = np.random.default_rng(7)


def _odd():
    rows = [(k, [float(x) for x in np.float32(RNG.normal(size=64))], k % 3 if k % 4 else None) for k in range(90)]
    rows += [(200 + k, rows[5][1], 1) for k in range(30)]  # one vector many times
    rows += [(300, rows[6][1], None), (300, rows[6][1], None), (300, rows[7][1], 2)]  # repeated rows, one id twice
    rows += [(None, rows[8][1], 2), (None, [0.25] * 64, None)]
    rows += [(-5, [0.0] * 64, 0), (-6, [-0.001] * 64, 0), (-7, [1000.0] + [0.0] * 63, 0)]
    bad = [None, [], [1.0, 2.0], [1.0] * 63, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [float("-inf")] + [0.0] * 63, [3e38] * 64]
    return rows + [(400 + k, v, 5) for k, v in enumerate(bad)]


ODD = _odd()


def kept(rows, scale):
    """Rows of 64 finite components, as integers, by vec_id (missing last), then components."""
    fine = [(i, tuple(math.floor(x * scale) for x in v), label) for i, v, label in rows if v is not None and len(v) == 64 and all(x is not None and abs(x) <= MOST / scale for x in v)]
    return sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def nearest(x, entries):
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def moved(x, at, entries):
    out = entries.copy()
    for c in np.unique(at):
        out[c] = [sum(col) // int((at == c).sum()) for col in x[at == c].T.tolist()]
    return out


def brute_codes(rows):
    rows = kept(rows, 1024)
    x = np.array([r[1] for r in rows], np.int64)
    books = [x[:256, 16 * p : 16 * p + 16].copy() for p in range(4)]
    for turn in range(5):
        found = [nearest(x[:, 16 * p : 16 * p + 16], books[p]) for p in range(4)]
        if turn < 4:
            books = [moved(x[:, 16 * p : 16 * p + 16], found[p][0], books[p]) for p in range(4)]
    errors = [int(sum(found[p][1][k] for p in range(4))) for k in range(len(rows))]
    by_label: dict = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    name = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    return [(str(r[0]), "".join(f"{found[p][0][k]:02x}" for p in range(4)), errors[k], by_label[r[2]], name) for k, r in enumerate(rows)]


def brute_clusters(rows):
    rows = kept(rows, 256)
    x = np.array([r[1] for r in rows], np.int64)
    named = sorted((r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1], k) for k, r in enumerate(rows))
    c = x[[n[-1] for n in named[:40]]].copy()
    for _ in range(5):
        c = moved(x, nearest(x, c)[0], c)
    at, d = nearest(x, c)
    of = {k: int(d[at == k].sum()) for k in range(len(c))}
    return [(str(r[0]), int(at[k]), int(d[k]), of[int(at[k])], int(d.sum()), hashlib.sha256(",".join(map(str, c[at[k]])).encode()).hexdigest()) for k, r in enumerate(rows)]


def rows_of(df, *columns):
    return sorted((str(r[0]), *r[1:]) for r in df.select(*columns).collect())


CODE_COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, 2) for r in ODD], SCHEMA)


@pytest.mark.parametrize(("query", "brute", "columns"), [(vector_codes.query, brute_codes, CODE_COLUMNS), (centroid_clusters.query, brute_clusters, CLUSTER_COLUMNS)])
def test_odd_rows(spark, odd, query, brute, columns):
    assert rows_of(query(odd), *columns) == sorted(brute(ODD))
    assert query(odd.limit(0)).collect() == []
    assert query(odd.where("vec_id >= 400")).collect() == []
    few = [r for r in ODD if r[0] in (3, 200, 201)]
    assert rows_of(query(odd.where("vec_id in (3, 200, 201)")), *columns) == sorted(brute(few))


@pytest.mark.parametrize(("query", "sql", "columns"), [(vector_codes.query, CODES, CODE_COLUMNS), (centroid_clusters.query, CLUSTERS, CLUSTER_COLUMNS)])
def test_sql(spark, query, sql, columns):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = sorted((str(r[0]), *r[1:]) for r in con.execute(f"select {', '.join(columns)} from ({sql})").fetchall())
    assert rows_of(query(spark.read.parquet(f"{SMALL}/embeddings.parquet")), *columns) == want


def test_distances_are_exact():
    for most in (3, 1 << 20, 1 << 24, MOST):
        x, y = RNG.integers(-most, most, (50, 16)), RNG.integers(-most, most, (20, 16))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in y] for u in x]
        assert squared(x, y).tolist() == want


def test_pivots_prune_and_ties_go_to_the_lower_index():
    entries = np.repeat(RNG.integers(-1000, 1000, (30, 4)), 2, axis=0)  # each twice
    x = np.concatenate([entries[RNG.permutation(60)], RNG.integers(-1000, 1000, (300, 4))])
    for n in (1, 3, 12):
        pivots = entries[vector_codes.far_apart(entries, n)]
        to = lambda v: np.sqrt(squared(v, pivots).astype(float))  # noqa: B023, E731
        at, d, tried = vector_codes.nearest_entries(x, to(x), entries, to(entries))
        want, least = nearest(x, entries)
        assert at.tolist() == want.tolist() and d.tolist() == least.tolist() and (at % 2 == 0).all()
        assert tried < (0.9 if n == 1 else 0.5) * len(x) * len(entries)
    assert len(vector_codes.far_apart(np.zeros((9, 4), np.int64), 5)) == 1


def test_only_expired_gaps_are_scanned(spark):
    """Groups far from each other: after the first rounds nearly no gap expires, and the result stays exact."""
    centres = RNG.normal(size=(40, 64)) * 20
    x = np.float32(centres[np.arange(2000) % 40] + RNG.normal(size=(2000, 64)) * 0.05)
    rows = [(k, [float(v) for v in r], None) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    placed, state = centroid_clusters.cluster(df, rounds=8)
    scanned = [r.count() for r in state.runs]
    assert scanned[0] == 2000 and scanned[-1] < 200
    ints = np.floor(x.astype(float) * 256).astype(np.int64)
    at, d = nearest(ints, state.centroids)
    assert {(r.vec_id, r.cluster, r.distance) for r in placed.collect()} == {*zip(range(2000), at.tolist(), d.tolist(), strict=True)}
    assert "PushedFilters: [Or(" in state.runs[0].where(centroid_clusters._keys_in(state.before, state.passed))._jdf.queryExecution().toString()


def test_other_lengths(spark):
    rows = [(k, [float(k + j) for j in range(8)], 1) for k in range(9)] + [(20, [1.0] * 12, 1), (21, [1.0] * 6, 1)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int"), entries=4, rounds=2)
    assert coded.select("vec_id").orderBy("vec_id").collect() == [(k,) for k in range(9)] and books.width == 2
    assert coded.where(F.length("code") != 8).count() == 0
