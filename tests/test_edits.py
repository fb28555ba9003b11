"""Fixers one after another, typed settings, edit logs, contexts under a budget, and the longest common subsequence, against plain loops."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators import config, context, edits, fixes, resolve

FINDINGS = "id string, detector string, file string, tier int, status string, suppressed boolean, lang string, detail string"


def finding(n, detector, file, line=None, lang="python", tier=1, status="open", suppressed=False, **detail):
    return (f"f{n}", detector, file, tier, status, suppressed, lang, json.dumps({"line": line, **detail} if line is not None else detail))


def brute_fix(files, findings):
    """Each fixer in turn on the text that is there by then."""
    files, told = {k: list(v) for k, v in files.items()}, []
    for fixer in fixes.FIXERS:
        for path in sorted({f[2] for f in findings}):
            mine = [json.loads(f[7]) for f in findings if f[2] == path and f[1] == fixer.detector and f[3] == 1 and f[4] == "open" and not f[5]
                    and (not fixer.lang or f[6] == fixer.lang) and (not fixer.smell or json.loads(f[7]).get("smell") == fixer.smell) and (not fixer.needs_line or "line" in json.loads(f[7]))]
            if not mine or not files.get(path):
                continue
            lines = {d["line"] for d in mine if "line" in d}
            if fixer.name == "ts-logs":
                n = sum(bool(re.search(fixes.CONSOLE, x)) for x in files[path])
            elif fixer.name == "ts-unused-imports":
                at = lambda d: files[path][d["line"] - 1] if 0 < d["line"] <= len(files[path]) else ""  # noqa: B023, E731
                n = len({d["line"] for d in mine if "import" in d and (f"import {d['import']} from" in at(d) or f"import type {d['import']} from" in at(d))})
            else:
                n = len(lines)
            told.append((path, fixer.name, n, (len(mine) if fixer.name == "ts-logs" else n) if n else 0, n > 0))
            if n:
                files[path] = [x for k, x in enumerate(files[path], 1) if k not in lines]
    return {(p, k, x) for p, xs in files.items() for k, x in enumerate(xs, 1)}, set(told)


def test_fix_runner(spark):
    rng = random.Random(5)
    forms = ["console.log(1)", "  console.warn(2)", "import A from 'a'", "import type B from 'b'", "import { c } from 'c'", "x = 1", "", "print(3)"]
    files = {f"d/{k}.{'py' if k % 2 else 'ts'}": [rng.choice(forms) for _ in range(rng.randint(1, 12))] for k in range(24)}
    rows, n = [finding(0, "unused", "gone.py", 1), finding(1, "unused", "d/1.py", 99)], 1
    for path, lines in files.items():
        for k in range(1, len(lines) + 1):
            for detector in ("smells", "ts_logs", "ts_unused", "unused"):
                if rng.random() < 0.3:
                    more = {"smell": rng.choice(["debug_print", "other"])} if detector == "smells" else {"import": rng.choice("AB")} if detector == "ts_unused" else {}
                    rows.append(finding(n := n + 1, detector, path, k if rng.random() < 0.9 else None, rng.choice(["python", "python", "typescript"]), rng.choice([1, 1, 1, 2]), rng.choice(["open", "open", "open", "fixed"]), rng.random() < 0.1, **more))
    rows += [finding(n + 100 + k, "unused", "d/3.py", k) for k in range(1, len(files["d/3.py"]) + 1)]  # all of a file
    lines = spark.createDataFrame([(p, k, x) for p, xs in files.items() for k, x in enumerate(xs, 1)], "path string, line int, text string")
    found = spark.createDataFrame(rows, FINDINGS)
    after, told = fixes.run(lines, found)
    want, want_told = brute_fix(files, rows)
    assert {tuple(r) for r in after.collect()} == want and {tuple(r) for r in told.collect()} == want_told
    dry = fixes.dry_run(found).collect()
    assert {(r.path, r.fixer) for r in dry} >= {(p, f) for p, f, *_ in want_told} and not any(r.modified or r.lines_changed for r in dry)


def test_settings(spark):
    configs = spark.createDataFrame([("a", '{"target_strict_score": 70, "future": {"x": [1, 2]}, "badge_path": "b.png"}'), ("b", None), ("c", "not json")], "project string, config string")
    log = [("a", 1, "set", "target_strict_score", "101"), ("a", 2, "set", "target_strict_score", "80"), ("a", 3, "set", "target_strict_score", "x"), ("a", 4, "unset", "badge_path", None), ("b", 1, "set", "needs_rescan", "YES"), ("b", 2, "set", "exclude", "x"), ("b", 3, "unset", "nothing", ""), ("b", 4, "drop", "ignore", ""), ("z", 1, "set", "props_threshold", "1"), ("c", 1, "set", "badge_path", "dir/"), ("c", 2, "set", "review_max_age_days", "never")]
    changes = spark.createDataFrame(log, "project string, seq long, op string, key string, raw string")
    errors = {(r.project, r.seq): r.error for r in config.judged(changes).where("error is not null").collect()}
    assert errors == {("a", 1): "must be 0-100", ("a", 3): "expected integer", ("b", 2): "unknown or non-settable key", ("b", 3): "unknown key", ("b", 4): "unknown operation", ("c", 1): "must be a filename"}
    docs = {r.project: json.loads(r.config) for r in config.documents(config.settings(configs, changes)).collect()}
    defaults = {k: json.loads(v) for k, _, v in config.SETTINGS}
    assert docs == {"a": defaults | {"target_strict_score": 80, "future": {"x": [1, 2]}}, "b": defaults | {"needs_rescan": True}, "c": defaults | {"review_max_age_days": 0}}
    again = spark.createDataFrame([(p, json.dumps(c)) for p, c in docs.items()], "project string, config string")  # a round trip changes nothing
    assert {r.project: json.loads(r.config) for r in config.documents(config.settings(again, changes.limit(0))).collect()} == docs


def test_edit_logs(spark):
    rng = random.Random(3)
    rows = [(f"l{rng.randrange(4)}", s, rng.choice(["create", "add", "add", "remove", "delete"]), f"k{rng.randrange(3)}", f"n{s}", [f"m{rng.randrange(4)}" for _ in range(rng.randrange(3))]) for s in range(300)]
    state, refused = {}, set()
    for log, seq, op, key, name, members in rows:
        own = state.get((log, key))
        if op == "create":
            state[log, key] = (name, set(members))
        elif own is None:
            refused.add((log, seq, op, key))
        elif op == "delete":
            del state[log, key]
        else:
            own[1].update(members) if op == "add" else own[1].difference_update(members)
    df = spark.createDataFrame(rows, "log string, seq long, op string, key string, name string, members array<string>")
    want = {(log, key, name, m) for (log, key), (name, ms) in state.items() for m in (ms or {None})}
    assert {(r.log, r.key, r.name, r.member) for r in edits.clusters(df).collect()} == want
    assert {tuple(r) for r in edits.refused_cluster_edits(df).collect()} == refused
    puts = spark.createDataFrame([("s", 1, "remove", "d", None), ("s", 2, "put", "d", "1"), ("s", 3, "put", "e", "2"), ("s", 4, "remove", "d", None), ("s", 5, "put", "e", "3")], "log string, seq long, op string, dimension string, value string")
    assert [tuple(r) for r in edits.assessments(puts).collect()] == [("s", "e", "3")]
    assert {tuple(r) for r in edits.removals(puts).collect()} == {("s", 1, "d", False), ("s", 4, "d", True)}


@pytest.mark.parametrize(("budget", "trimmed", "spots"), [(50000, False, 10), (2000, True, 5)])
def test_context_budget(spark, budget, trimmed, spots):
    rows = [("p", f"structural::src/file{k:03d}.py", "structural", f"src/file{k:03d}.py", "x" * 200, json.dumps({"complexity": k}), "open", False) for k in range(100)]
    rows += [("p", f"smells::{k}", "smells", "src/file001.py", "an Error here", "{}", "open", k == 0) for k in range(3)] + [("p", "z", "smells", "b.py", "error", "{}", "fixed", False)]
    rows += [("p", f"dupes::{k}", "dupes", f"d{k}.py", "", json.dumps({"function_name": f"f{k // 2}"}), "open", False) for k in range(5)]
    df = spark.createDataFrame(rows, "project string, id string, detector string, file string, summary string, detail string, status string, suppressed boolean")
    row = context.bundles(context.entries(df), budget).first()
    doc = json.loads(row.context)
    assert row.trimmed is trimmed and [h["score"] for h in doc["complexity_hotspots"]] == [99.0 - k for k in range(spots)]
    assert len(doc["exception_hotspots"]) == 2 and doc["signal_density"] == [{"file": "src/file001.py", "detector_count": 2, "detectors": ["smells", "structural"]}]
    assert doc["duplicate_clusters"] == [{"function_name": "f0", "files": ["d0.py", "d1.py"]}, {"function_name": "f1", "files": ["d2.py", "d3.py"]}] and doc["high_fan_in"] == []


def test_common_subsequence():
    def plain(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            last = 0
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(150))] for _ in range(2))
        assert resolve._lcs(x, y) == plain(x, y)
    assert resolve._lcs(["a", "b"] * 20000, ["b", "a"] * 20000) == 39999


def test_hot_reminder(spark):
    got = resolve.decayed(spark.range(10000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("reminder"), F.col("id").alias("seq"))).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r.seq):
        seen[r.reminder] = seen.get(r.reminder, 0) + 1
        assert (r["count"], r.suppressed) == (min(seen[r.reminder], 3), seen[r.reminder] > 3)
