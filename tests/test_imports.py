"""Edges read from sources, and strong components of long chains and random graphs."""

import random

import pytest

from evidentia.operators import graph, import_edges


def script_edges(spark, files):
    return {tuple(r) for r in import_edges.script_edges(spark.createDataFrame(files, "path string, content string")).collect()}


def test_script_edges(spark):
    files = [
        ("src/main.ts", "import { foo } from './utils';\nimport React from 'react';\nexport * from \"./components\"\nconsole.log(foo);"),
        ("src/utils.ts", "export const foo = 1;\nconst m = await import( '../lib/x' )\nconst y = require('./main')\nimport\n  './side'"),
        ("src/side.js", "import '/src/utils'\nimport a from './missing'\nimport b from './side'"),
        ("src/components/index.ts", "import u from '../utils'; import v from '../../src/main.ts'"),
        ("src/components.tsx", None),
        ("lib/x/index.tsx", ""),
    ]
    assert script_edges(spark, files) == {
        ("src/main.ts", "src/utils.ts"), ("src/main.ts", "src/components.tsx"), ("src/utils.ts", "lib/x/index.tsx"), ("src/utils.ts", "src/main.ts"), ("src/utils.ts", "src/side.js"),
        ("src/side.js", "src/utils.ts"), ("src/side.js", "src/side.js"), ("src/components/index.ts", "src/utils.ts"), ("src/components/index.ts", "src/main.ts"),
    }
    assert script_edges(spark, files[-2:]) == set()


PYTHON = """import pkg.a
from pkg.b import thing
def outer():
    import pkg.c
# import pkg.d

    def inner():
\timport pkg.e
    from . import late
import pkg.late.attr
async def go(): pass
  import pkg.c
x = 1
import pkg.b
class K:
    import pkg.d"""


def test_python_edges(spark):
    lines = spark.createDataFrame([("pkg/m.py", k, t) for k, t in enumerate(PYTHON.split("\n"))], "path string, line int, text string")
    files = spark.createDataFrame([(f"pkg/{n}.py",) for n in ("a", "b", "c", "d", "late", "__init__")] + [("pkg/e/__init__.py",)], "path string")
    got = {r.dst: r.deferred for r in import_edges.python_edges(lines, files).collect()}
    # `\t` is one column, so the line after `inner` is no deeper than it and closes the function; so is the one after that
    assert got == {"pkg/a.py": False, "pkg/b.py": False, "pkg/c.py": True, "pkg/d.py": False, "pkg/e/__init__.py": False, "pkg/__init__.py": False, "pkg/late.py": False}


def brute(edges):
    reach = {n: {b for a, b in edges if a == n} for e in edges for n in e}
    for k in reach:
        for n in reach:
            if k in reach[n]:
                reach[n] |= reach[k]
    comps = {n: {n} | {m for m in reach[n] if n in reach[m]} for n in reach}
    return {(n, min(c), len(c)) for n, c in comps.items() if len(c) > 1}


def components(spark, edges, finish=0):
    return {tuple(r) for r in graph.strong_components(spark.createDataFrame(edges, "src long, dst long"), finish).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_components(spark, seed):
    rng = random.Random(seed)
    n = [6, 25, 60, 60][seed]
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * [1.5, 1.2, 1.1, 2][seed]))]
    assert components(spark, edges) == components(spark, edges, 20) == components(spark, edges, 1000) == brute(edges)


def test_small_components(spark):
    assert components(spark, []) == components(spark, [(1, 1), (1, 2), (2, 3)]) == set()
    assert components(spark, [(0, 1), (1, 0), (1, 1)]) == {(0, 0, 2), (1, 0, 2)}
    eight = [(9, 1), (1, 2), (2, 9), (9, 3), (3, 4), (4, 9), (4, 7), (7, 8)]
    assert components(spark, eight) == components(spark, eight, 100) == brute(eight)
    named = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in graph.strong_components(named).collect()} == {("a", "a", 2), ("b", "a", 2)}


def test_long_chains(spark):
    """10,000 nodes in a ring, in an order that is not that of their ids, with a tail in and a tail out."""
    ring = list(range(10000))
    random.Random(1).shuffle(ring)
    edges = [*zip(ring, ring[1:] + ring[:1], strict=True)] + [(20000 + k, 20001 + k) for k in range(2000)] + [(22000, ring[0]), (ring[5], 30000)] + [(30000 + k, 30001 + k) for k in range(2000)]
    assert components(spark, edges) == components(spark, edges, 1 << 20) == {(n, 0, 10000) for n in range(10000)}
