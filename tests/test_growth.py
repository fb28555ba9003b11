"""What keeps a query's cost in step with its input: rows that are dealt by their number, keys that are tried once, lines that are numbered once."""

import random
import re
from collections import Counter

import duckdb
import pytest
from conftest import SMALL

from evidentia.operators import classes, event_rules, graph, path_rules, resolve
from evidentia.plans import code_queries, edge_queries, event_queries, phase_queries, source_queries
from evidentia.sources import relations as rel

stream_run = source_queries.ledger_stream_run


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_modules_are_tried_once(spark):
    imports = spark.createDataFrame([(f"x/{k}.py", m) for k in range(4) for m in ("a.b", "a.c.d", "none")], "importer string, module string")
    found = resolve.resolve_absolute(imports, spark.createDataFrame([("a/b.py",), ("a/c/__init__.py",)], "path string"))
    assert {tuple(r) for r in found.collect()} == {(f"x/{k}.py", m, t) for k in range(4) for m, t in (("a.b", "a/b.py"), ("a.c.d", "a/c/__init__.py"))}
    assert re.search(r"Aggregate \[module#\d+\], \[module#\d+\]", optimised(found))


def test_edges_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(rel, "DEALT", 200)
    rows = rel.table(spark, SMALL, "lineitem").count()
    assert rel.tasks(spark, SMALL, "lineitem") == -(-rows // 200)
    assert rel.edges(spark, SMALL).rdd.getNumPartitions() == -(-rows // 200)


def test_lines_are_numbered_once(spark):
    for found in (edge_queries.python_import_edges(spark, SMALL), edge_queries.script_import_edges(spark, SMALL), edge_queries.source_metrics(spark, SMALL), phase_queries._scan(spark, SMALL, r"\.py$").lines):
        assert "row_number" not in optimised(found)


def test_classes_read_written_lines(spark):
    assert "row_number" not in optimised(phase_queries.class_members(spark, SMALL))


def test_class_lines_are_not_broadcast(spark):
    """Written lines are small as files and large as rows: whatever Spark takes them for, none go through the driver."""
    found = phase_queries.class_members(spark, SMALL)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in optimised(found)


def test_classes_of_odd_files(spark):
    """Nested, indented, empty and last classes, comments and blank lines that end none, lines without text, without a path, and files without classes, against the SQL."""
    rng = random.Random(5)
    kinds = ["class A(B):", "class  C_1:", "def f(self): self.a", "async def test_b(): self.b, self.c", "def _x(): pass", "x = self.d + self.a", "# self.e class D:", "", "   ", "classy = 1", "class E(self.g):", "class"]
    rows = [(f"f{k}" if k else None, n + 1, None if rng.random() < 0.03 else " " * rng.choice([0, 0, 2, 4, 4, 6]) + rng.choice(kinds)) for k in range(60) for n in range(rng.randrange(1, 40))]
    rows += [("none", 1, "x = 1"), ("none", 2, "  self.a"), ("only", 1, "class A: self.a"), ("last", 1, "self.a"), ("last", 2, "  class Z:")]
    con = duckdb.connect()
    con.execute("create table code_lines (path varchar, line int, text varchar)")
    con.executemany("insert into code_lines values (?, ?, ?)", rows)
    want = con.execute(f"with o as (select 1){phase_queries._MEMBERS.format('code_lines')} select path, name, line, loc, methods, prefixes, attributes from g").fetchall()
    found = classes.members(spark.createDataFrame(rows, "path string, line int, text string").repartition(3))
    assert Counter(tuple(r) for r in found.collect()) == Counter(want) and len(want) > 100
    assert any(r[0] is None for r in want) and any(r[6] > 2 for r in want) and any(r[5] for r in want)


def _reachable(pairs):
    ways = {}
    for a, b in pairs:
        ways.setdefault(a, set()).add(b)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, new = set(), {n}
        while new:
            new = {y for x in new for y in ways.get(x, ())} - seen
            seen |= new
        out[n] = seen
    return out


def _strong(pairs):
    reach, out = _reachable(pairs), {}
    for n, to in reach.items():
        own = {m for m in to if n in reach[m]}
        if len(own) > 1:
            out[n] = (min(own), len(own))
    return out


def test_separate_components_take_no_rounds(spark, monkeypatch):
    """Copies of a dense graph, as many as there may be: labels need not be spread hop by hop over all of them."""
    monkeypatch.setattr(graph, "_taken_out", lambda e: pytest.fail("labels were spread"))
    rng = random.Random(4)
    own = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)}
    pairs = [(a + 12 * k, b + 12 * k) for k in range(6) for a, b in own if a != b]
    found = graph.strong_components(spark.createDataFrame(pairs, "src long, dst long"), finish=60)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == _strong(pairs)


def test_one_large_class_is_contracted(spark):
    """A class that is larger than what one task finishes, with few ways back."""
    rng = random.Random(0)
    pairs = {(a, b) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(400))} | {tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(2)}
    found = graph.strong_components(spark.createDataFrame(sorted(pairs), "src long, dst long"), finish=20)
    assert {r[0]: (r[1], r[2]) for r in found.collect()} == _strong(pairs)


def test_ledger_is_numbered_once(spark, monkeypatch):
    assert "row_number" not in optimised(code_queries.ledger_violations(spark, SMALL))
    monkeypatch.setattr(rel, "DEALT", 50)
    assert rel.ledger(spark, SMALL).rdd.getNumPartitions() == -(-rel.table(spark, SMALL, "events").count() // 50)


def test_refusals_are_found_once(spark):
    """What the rules find is read twice, for the rows and for the first of each ledger."""
    assert "Window" not in optimised(event_queries.ledger_refusals(spark, SMALL))


def test_rules_look_up_narrow_rows(spark):
    e = event_rules.decoded(event_queries.ledger_events(spark, SMALL))
    assert set(event_rules.lane_states(e).schema["p"].dataType.names) == {"lane_path", "base_head", "base_tree", "outcome", "reason"}


def test_stream_files_are_dealt_by_rows(spark, monkeypatch):
    bases = []
    monkeypatch.setattr(rel, "DEALT", 100)
    monkeypatch.setattr(source_queries, "ledger_stream_run", lambda session, stream, base: (bases.append(base), stream_run(session, stream, base)))
    found = source_queries.ledger_stream(spark, SMALL)
    assert found.count() == rel.table(spark, SMALL, "events").count()
    assert len(spark.read.parquet(f"{bases[0]}/in").inputFiles()) > 3


def test_literals_are_tested_before_expressions(spark):
    """Both forms of the look-up; optional folders at a glob's start and inside it, and a name that ends in a mark."""
    paths = spark.createDataFrame([(1, p) for p in ("b.py", "a/b.py", "a/x/b.py", "a/xb.py", "ab.py", "a/b.pyc", "")], "lane int, path string")
    globs = spark.createDataFrame([(1, g) for g in ("**/b.py", "a/**/b.py", "a/**", "a/?b.*", "*", "b.py")], "lane int, glob string")
    want = {("b.py", "**/b.py"), ("a/b.py", "**/b.py"), ("a/x/b.py", "**/b.py"), ("a/b.py", "a/**/b.py"), ("a/x/b.py", "a/**/b.py"), ("a/xb.py", "a/?b.*"), ("b.py", "b.py")}
    want |= {(p, "*") for p in ("b.py", "a/b.py", "a/x/b.py", "a/xb.py", "ab.py", "a/b.pyc", "")} | {(p, "a/**") for p in ("a/b.py", "a/x/b.py", "a/xb.py", "a/b.pyc")}
    for by, p, g in ((["lane"], paths, globs), ([], paths.drop("lane"), globs.drop("lane"))):
        found = path_rules.matches(p, g, by, spanning=True)
        assert {(r.path, r.glob) for r in found.collect()} == want
        assert "EndsWith" in optimised(found)


def test_equal_bodies_are_compared_once(spark):
    base = [f"line {k % 13}" for k in range(20)]
    bodies = [base, base[:-1] + ["own"], base[:9] + ["x"] + base[9:], ["y"] * 3 + base[3:], [f"other {k}" for k in range(15)], ["few"]]
    rows = [(f"f{7 * k % 24:02d}", f"file{k % 5}", "\n".join(bodies[k % 6])) for k in range(24)]
    found = resolve.similar_bodies(spark.createDataFrame(rows, "name string, file string, body string"))
    lines = {n: (f, b.split("\n")) for n, f, b in rows if b.count("\n") >= 14}
    ratio = {(a, b): 2 * resolve._lcs(x, y) / (len(x) + len(y)) for a, (f, x) in lines.items() for b, (g, y) in lines.items() if a < b and f != g}
    want = {(a, b, r) for (a, b), r in ratio.items() if r >= 0.9}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and {r for _, _, r in want} > {1.0}
    # neither texts nor rows of lines are sorted by window
    assert "row_number" not in optimised(found)


def test_lines_are_numbered_among_their_equals(spark):
    lines = spark.createDataFrame([(["b", "a", "b", "b"],)], "lines array<string>")
    want = {("a", 0), ("b", 0), ("b", 1), ("b", 2)}
    named = spark.createDataFrame(sorted(want), "line string, k int").selectExpr("xxhash64(line, k)")
    assert sorted(lines.select(resolve._numbered(lines.lines)).first()[0]) == sorted(r[0] for r in named.collect())
