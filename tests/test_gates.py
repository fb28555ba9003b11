"""Guards of imports, globs against many paths, gates, and hashes on small rows."""

import fnmatch
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import hashes, jsonpatch, patterns
from evidentia.operators import event_rules, gates, graph, path_rules, python_imports, resolve


def lines_of(spark, source, path="pkg/m.py"):
    return spark.createDataFrame([(path, k, t) for k, t in enumerate(source.split("\n"))], "path string, line int, text string")


SOURCE = """from __future__ import annotations
import os, sys
import a.b
try:
    from fast import one
except ImportError:
    from slow import one
from two import two as deux, (three),
if TYPE_CHECKING:
    from types import four
    # a note
    if x:
        from types import five
from six import six
if t.TYPE_CHECKING: pass
    from types import hidden
__all__ = ["seven",
  'eight']
from seven import seven, eight, nine
from ten import *
from noisy import eleven  # noqa
# deux and three
use(nine)
try:
    pass
finally:
    from late import twelve
from end import thirteen # nine
import c.d as e"""


def test_unused_names(spark):
    got = {(r.name, r.line) for r in python_imports.unused(lines_of(spark, SOURCE)).collect()}
    assert got == {("a", 2), ("deux", 7), ("three", 7), ("six", 13), ("thirteen", 27), ("c", 28)}
    assert python_imports.unused(lines_of(spark, SOURCE, "pkg/conftest.py")).count() == 0
    assert {r.name for r in python_imports.exported(lines_of(spark, SOURCE)).collect()} == {"seven", "eight"}


def dp(path, pattern):
    """The rule by its own recursion."""
    if pattern.startswith("**/") and dp(path, pattern[3:]):
        return True
    return re.fullmatch(fnmatch.translate(pattern.replace("[", "[[]").replace("**", "*")), path, re.DOTALL) is not None


def test_globs(spark):
    rng = random.Random(2)
    parts = ["src", "a", "b.py", "c.ts", "x+y", "d", ".env", "b.test.py"]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(200)})
    globs = ["*", "", "*.py", "**/b.py", "src/*", "src/**", "src/a/*.ts", "?.ts", "**/*.py", "s*c/a/**/b.py", "src/a/b.py", "x+y/*", "*b*", ".env", "**/.env", "d/?.ts", "**/", "a*/c.ts", "*/b.*", "src/a/"]
    found = path_rules.matches(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g,) for g in globs], "glob string"), [])
    assert {(r.path, r.glob) for r in found.collect()} == {(p, g) for p in paths for g in globs if dp(p, g)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_many_globs(spark, monkeypatch):
    """Globs that are looked up by pieces: equal to testing each; none without a literal meets more than its share, and no piece that all share is a key."""
    paths = [f"pkg{k % 3}/{'mod_' * (k % 2)}é{k * 37 % 211}x{k}.{'py' if k % 2 else 'go'}" for k in range(90)] + ["1", "", "a-b/.env", "m" * 30 + "7.ts", "pkg1/12"]
    kinds = ["*{}*", "p*/mod_?{}*", "*_é{}?*.go", "**/*x{}.py", "pkg?/*{}.*", "{}", "*{}", "é*{}*x*", "pkg1/{}*", "?" * 12 + "{}*"]
    globs = [g.format(k) for k in range(40) for g in kinds] + ["*", "**/", "?", "*-*", "m" * 14 + "*", "*" + "m" * 29 + "7*", "*.?s", ""]
    monkeypatch.setattr(path_rules, "FEW", 0)
    found = [(r.path, r.glob) for r in path_rules.matches(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(g,) for g in globs], "glob string"), []).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(p, g) for p in paths for g in globs if dp(p, g)}
    names = spark.createDataFrame([(f"*{k}*",) for k in range(100, 140)], "glob string").select(F.explode(path_rules._glob_keys(F.col("glob"))))
    assert names.distinct().count() == 40


def test_few_globs_to_a_key(spark):
    """A path is not multiplied by its own keys where its lane has a few globs."""
    paths = spark.createDataFrame([(1, "src/a.py"), (2, "src/b.py")], "lane int, path string")
    found = path_rules.matches(paths, spark.createDataFrame([(1, "src/*"), (2, "*a*"), (2, "**/b.py")], "lane int, glob string"), ["lane"])
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(1, "src/a.py", "src/*"), (2, "src/b.py", "**/b.py")}


def test_write_sets(spark):
    paths = spark.createDataFrame([(1, "src/a.py"), (1, "src/x/b.py"), (1, "top.md"), (2, "src/a.py"), (3, "a/b")], "lane int, path string")
    writes = spark.createDataFrame([(1, "src/**"), (2, "docs/*"), (3, "a/**/b")], "lane int, glob string")
    protected = spark.createDataFrame([(1, "**/b.py"), (3, "z")], "lane int, glob string")
    assert {tuple(r) for r in path_rules.violations(paths, writes, protected, ["lane"]).collect()} == {(1, "src/x/b.py", False, True), (1, "top.md", True, False), (2, "src/a.py", True, False)}


@pytest.mark.parametrize(
    ("writes", "protected", "want"),
    [
        (["src/*.py"], ["docs/*"], None),
        (["src/*.py", "docs/a"], ["docs/*"], ("protected", "docs/*")),
        (["docs/*"], ["src/x", "docs/q"], ("protected", "docs/q")),
        (["src/*.py", "lib/*"], ["lib/z", "**/b.py"], ("protected", "src/b.py")),
        (["src/*.py"], ["src/a*", "src/b*"], ("protected", "src/a.py")),
        (["src/*"], [""], ("unsupported", "")),
        (["src/{a}", "src/b.py"], ["src/b.py"], ("unsupported", "src/{a}")),
    ],
)
def test_protected(spark, writes, protected, want):
    rules = lambda globs: spark.createDataFrame([("p", k, g) for k, g in enumerate(globs)], "project string, place int, glob string")
    files = spark.createDataFrame([("p", f) for f in ("src/a.py", "src/b.py", "lib/y")], "project string, path string")
    got = [(r.problem, r.what) for r in path_rules.intersections(files, rules(writes), rules(protected), ["project"]).collect()]
    assert got == ([want] if want else [])


RULES = {"purpose": "p", "verifier_commands": ["make"], "risk_ceiling": "R1", "budget": {"attempts": 1, "wall_secs": 1, "subprocesses": 1}}
PLAN = {"id": "c", "base": {"head": "h", "tree": "t"}, "brief": "b", "brief_hash": "3e23e8160039594a33894f6564e1b1348bbd7a0088d42c4acb73eeaed59c009d", "status": "planned"}
MOVE = lambda s: ("change_status", {"change_id": "c", "status": s})
LANE = ("lane_opened", {"change_id": "c", "lane_path": "/l"})
KEEP = ("lane_closed", {"change_id": "c", "lane_path": "/l", "outcome": "retained"})


@pytest.fixture(scope="module")
def lineage(spark):
    return lambda rules: spark.range(1).select(event_rules.ruleset_hash(F.lit(json.dumps(rules)))).first()[0]


def state(spark, ledgers):
    rows = [(name, k, kind, json.dumps(p)) for name, events in ledgers.items() for k, (kind, p) in enumerate(events)]
    return gates.State(spark.createDataFrame(rows, "ledger string, seq long, kind string, payload string"))


def test_climb(spark, lineage):
    plan, more = ("change_planned", PLAN | {"lineage": lineage(RULES)}), ("ruleset_ratified", RULES)
    ledgers = {
        "ready": [more, plan], "dirty": [more, plan], "head": [more, plan], "tree": [more, plan], "ruleset_file": [more, plan], "active_lane": [more, plan, LANE], "failed_lane": [more, plan, LANE, KEEP, MOVE("discarded")],
        "open_decisions": [more, plan, ("decision_opened", {"id": "d"})], "no_ruleset": [plan], "unratified": [("ruleset_ratified", RULES | {"purpose": "UNRATIFIED x"}), plan], "no_verifiers": [("ruleset_ratified", RULES | {"verifier_commands": []}), plan],
        "too_many_verifiers": [("ruleset_ratified", RULES | {"verifier_commands": ["a", "b"]}), plan], "planned_changes": [more, plan, ("change_planned", PLAN | {"id": "k"})], "ruleset_ratified": [more, plan, ("ruleset_ratified", RULES | {"purpose": "q"})],
        "brief": [more, ("change_planned", plan[1] | {"brief": "other"})],
    }
    repos = [(n, n == "dirty", "x" if n == "head" else "h", "x" if n == "tree" else "t", "{}" if n == "ruleset_file" else json.dumps(RULES)) for n in ledgers]
    got = gates.climbable(state(spark, ledgers), spark.createDataFrame(repos, "ledger string, dirty boolean, head string, tree string, rules string")).collect()
    assert {r.ledger: r.verdict for r in got} == {n: n for n in ledgers} and {r.change for r in got} == {None, "c"}


def test_land(spark):
    plan, done = ("change_planned", PLAN), ("verification_recorded", {"change": "c", "result_tree": "r"})
    kept = [plan, LANE, MOVE("verified"), done, KEEP]
    other = [(k, json.loads(json.dumps(p).replace('"c"', '"k"'))) for k, p in kept]
    ledgers = {
        "landable": kept, "dirty": kept, "nothing_verified": [plan], "no_retained_lane": kept[:-1], "wrong_base": kept, "several": kept + other, "lane_missing": kept, "not_verified": [plan, LANE, MOVE("verified"), KEEP], "result_tree": kept,
    }
    repos = [(n, n == "dirty", "x" if n == "wrong_base" else "h", "t", n != "lane_missing", "x" if n == "result_tree" else "r") for n in ledgers]
    got = gates.landable(state(spark, ledgers), spark.createDataFrame(repos, "ledger string, dirty boolean, head string, tree string, lane_exists boolean, result_tree string")).collect()
    assert {r.ledger: r.verdict for r in got} == {n: n for n in ledgers} and [r.change for r in got if r.change] == ["c"]


def test_language_order(spark):
    files = {"a": ["Cargo.toml", "go.mod"], "b": ["pubspec.yaml", "Cargo.toml", "x.csproj"], "c": ["package.json", "setup.py"], "d": ["package.json", "go.mod"], "e": ["sub/setup.py", "Gemfile", "composer.json"], "f": ["README.md"]}
    rows = spark.createDataFrame([(p, f) for p, names in files.items() for f in names], "project string, path string")
    assert {r.project: r.language for r in resolve.detected(spark, rows).collect()} == {"a": "go", "b": "csharp", "c": "python", "d": "typescript", "e": "ruby"}


def test_fnv(spark):
    """Published test vectors of the hash."""
    known = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8", "é": None, None: None}
    got = {r.x: r.h for r in spark.createDataFrame([(k,) for k in known], "x string").select("x", hashes.fnv1a64(F.col("x")).alias("h")).collect()}
    h = 0xCBF29CE484222325
    for b in "é".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert got == known | {"é": f"{h:016x}"}


def test_zone_skips(spark):
    cases = {("test", "naming"): True, ("test", "smells"): False, ("config", "smells"): True, ("vendor", "security"): True, ("production", "cycles"): False, (None, "cycles"): False, ("script", "dict_keys"): False, ("generated", None): True}
    got = spark.createDataFrame([*cases], "zone string, detector string").select("zone", "detector", patterns.is_skipped(F.col("zone"), F.col("detector")).alias("s")).collect()
    assert {(r.zone, r.detector): r.s for r in got} == cases


def test_tool_coupling(spark):
    paths = {1: "shared/a.py", 2: "shared/b.py", 3: "tools/x/c.py", 4: "tools/y/d.py", 5: "tools/top.py", 6: "app/e.py", 7: "tools/x/f.py"}
    edges = [(1, 2), (1, 3), (3, 4), (3, 7), (3, 5), (5, 3), (6, 3), (3, 1), (1, 3)]
    found = graph.tool_coupling(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([*paths.items()], "node int, path string"), "shared/", "tools/")
    assert {tuple(r) for r in found.collect()} == {(1, 2, "shared", None, None, False), (1, 3, "shared", None, "x", True), (3, 4, "tools", "x", "y", True), (3, 7, "tools", "x", "x", False), (3, 5, "tools", "x", "top.py", True)}


def test_patches(spark):
    cases = {"{}": None, "[1]": "not an object", '{"zeal":1,"apex":2}': "apex", '{"budget":{"calls":1},"apex":2}': "apex", '{"budget":{"calls":1,"bytes":2},"zeal":2}': "budget.bytes", '{"budget":3,"hash":null}': None, None: "not an object"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", jsonpatch.patch_problem(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == cases
