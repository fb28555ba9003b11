"""Rules on small rows: globs, exclusions, zones, merge order, caps, components, saturating depth, ledger faults, similar bodies."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import jsonpatch, patterns, text
from evidentia.operators import detectors, findings, graph, ledger, ordering, progress, resolve, review, scores
from evidentia.sources import documents


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("path,pattern,want", [("a/b.py", "b.p", True), ("a/b.py", "*.py", True), ("a/b.py", "a/*", True), ("x/a/b.py", "a/*.py", True), ("a/b.pyc", "a/*.py", False), ("a/mid/b", "*mid*", True)])
def test_excluded(spark, path, pattern, want):
    assert one(spark, patterns.excluded(F.lit(path), pattern)) is want


@pytest.mark.parametrize("path,pattern,want", [("src/a/x.py", "src/*.py", True), ("src/x.pyc", "src/*.py", False), ("x.py", "**/x.py", True), ("d/x.py", "**/x.py", True), ("ab.py", "a?.py", True)])
def test_tree_glob(spark, path, pattern, want):
    assert one(spark, patterns.like_tree_glob(F.lit(path), pattern)) is want


@pytest.mark.parametrize("path,zone", [("vendor/tests/a.py", "vendor"), ("a/tests/b.py", "test"), ("bin/run", "script"), ("a/b.py", "production"), ("a/conf_x.py", "config"), ("a/x_pb2.py", "generated")])
def test_zones(spark, path, zone):
    rules = [*patterns.COMMON_ZONES, ("config", ["conf_"]), ("generated", ["_pb2.py"])]
    assert one(spark, patterns.zone_of(F.lit(path), rules)) == zone


def test_text_functions(spark):
    assert one(spark, text.entity(F.lit("d::f::k::more"))) == "k::more"
    assert one(spark, text.entity(F.lit("d::f"))) is None
    assert one(spark, text.stem(F.lit("a/.env"))) == ".env" and one(spark, text.stem(F.lit("a/x.test.ts"))) == "x.test"
    assert one(spark, text.is_stale(F.lit("soon"), F.lit("2024-01-01"), 9)) is True
    assert one(spark, text.score_bar(F.lit(50.0), 10)) == "#####....."
    assert one(spark, jsonpatch.merged(F.lit('{"b":1,"a":"x"}'), F.lit('{"b":null,"c":[1]}'))) == '{"a":"x","c":[1]}'
    assert [one(spark, text.convention(F.lit(n))) for n in ("a-b", "Ab", "a_b", "aB", "ab", "A-b")] == ["kebab", "pascal", "snake", "camel", "flat", "other"]


FINDING = "id string, key long, detector string, file string, tier int, confidence string, summary string, detail string, status string, reopen_count int, suppressed boolean, zone string, lang string"


def finding(id_, status="open", detector="smells", file="a.py", confidence="high", lang="python", suppressed=False, detail="{}"):
    return (id_, 0, detector, file, 3, confidence, "s", detail, status, 0, suppressed, None, lang)


def test_merge_rules(spark):
    prev = spark.createDataFrame([
        finding("fixed", "fixed"), finding("wont", "wontfix"), finding("gone"), finding("gone_wont", "wontfix"), finding("ts", lang="typescript"), finding("sec", detector="security"),
        finding("auto", "auto_resolved"), finding("rev", detector="review"), finding("off", detector="off"),
    ], FINDING)
    cur = spark.createDataFrame([finding("fixed"), finding("wont"), finding("new"), finding("ign", file="gen/x.py")], FINDING)
    ran = spark.createDataFrame([("smells",), ("security",)], "detector string")
    got = {r.id: r for r in findings.merge(prev, cur, ran, "python", ignore=["gen/*"]).collect()}
    assert {k: r.action for k, r in got.items()} == {
        "fixed": "reopened", "wont": "matched", "gone": "resolved", "gone_wont": "resolved", "ts": "other_lang", "sec": "protected", "auto": "already", "rev": "suspect", "off": "suspect", "new": "new", "ign": "suppressed",
    }
    assert got["fixed"].reopen_count == 1 and got["fixed"].status == "open" and got["wont"].status == "wontfix"
    assert got["gone"].status == "auto_resolved" and "wontfix" in got["gone_wont"].note and got["ign"].suppressed
    none = prev.limit(0)
    assert findings.merge(none, cur, None, "python").count() == 4 and findings.merge(none, none, None, "python").count() == 0


@pytest.mark.parametrize("n,want", [(1, 10), (2, 10), (3, 15), (6, 20), (9, 20)])
def test_file_caps(spark, n, want):
    rows = spark.createDataFrame([finding(f"i{k}") for k in range(n)], FINDING)
    pot = spark.createDataFrame([("smells", 10)], "detector string, potential long")
    got = scores.detector_stats(rows, pot).where("mode = 'strict'").first()
    assert got.weighted_tenths == want and got.issues == n and got.pass_rate == pytest.approx((100 - want) / 100)


def test_score_details(spark):
    rows = [finding("a", file=".", detail='{"holistic":true}'), finding("b", "wontfix"), finding("c", "auto_resolved"), finding("d", suppressed=True)]
    pot = spark.createDataFrame([("smells", 100), ("review", 9), ("naming", 0)], "detector string, potential long")
    got = {(r["mode"], r.detector): r.weighted_tenths for r in scores.detector_stats(spark.createDataFrame(rows, FINDING), pot).collect()}
    assert got["lenient", "smells"] == 100 and got["strict", "smells"] == 110 and got["verified_strict", "review"] == 0 and got["strict", "naming"] == 0


def test_noise_budget(spark):
    rows = [finding(f"i{k:03}") for k in range(100)] + [finding(f"s{k}", detector="security") for k in range(5)]
    got = scores.ranked_per_detector(spark.createDataFrame(rows, FINDING), 10, 4)
    assert sorted(r.id for r in got.collect()) == [f"i{k:03}" for k in range(4)] + [f"s{k}" for k in range(5)]


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 8), (9, 9), (5, 6), (20, 21), (21, 22), (22, 23), (23, 20), (22, 20)]
    got = {r.node: (r.component, r.size) for r in graph.strong_components(spark.createDataFrame([(*e, False) for e in edges], "src long, dst long, deferred boolean")).collect()}
    assert got == {**{n: (1, 6) for n in (1, 2, 3, 4, 5, 6)}, **{n: (20, 4) for n in (20, 21, 22, 23)}}
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long, deferred boolean")).count() == 0


def test_saturating_depth(spark):
    lines = ["}}", "{", "{{", "}", "}}}}", "{"]
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "path string, line int, text string")
    want, depth = [], 0
    for x in lines:
        depth = max(0, depth + x.count("{") - x.count("}"))
        want.append(depth)
    assert [r.depth for r in detectors.brace_depth(rows).orderBy("line").collect()] == want


def test_ledger_faults(spark):
    rows = [(1, "e1", "0" * 64, "a"), (2, "e2", None, "b"), (4, "e2", "x", "c")]
    e = spark.createDataFrame(rows, "seq long, event_id string, prev_hash string, payload string").withColumn("payload_hash", F.sha2("payload", 256))
    e = e.withColumn("prev_hash", F.when(F.col("seq") == 2, F.sha2(F.lit("a"), 256)).otherwise(F.col("prev_hash")))
    assert {tuple(r) for r in ledger.violations(e).collect()} == {(4, "gap"), (4, "repeated_id")}


def test_queue_move(spark):
    plan = spark.createDataFrame([(k, str(k)) for k in range(6)], "pos int, id string")
    for id_, place in (("4", 1), ("1", 4), ("0", 99), ("5", 0), ("2", 2)):
        want = [str(k) for k in range(6) if str(k) != id_]
        want.insert(min(place, len(want)), id_)
        assert [r.id for r in progress.moved(plan, id_, place).orderBy("pos").collect()] == want


def test_queue_move_of_an_absent_id(spark):
    plan = spark.createDataFrame([(k, str(k)) for k in range(4)], "pos int, id string")
    assert [r.id for r in progress.moved(plan, "x", 1).orderBy("pos").collect()] == list("0123")


def test_numbered(spark):
    words = ["hot"] * 40 + [f"w{k:03d}" for k in range(60)]
    rows = spark.createDataFrame([(w, k) for k, w in enumerate(reversed(words))], "word string, k long").repartition(7)
    got = ordering.numbered(rows, "word", "k").orderBy("place").collect()
    assert [r.place for r in got] == list(range(100))
    assert [(r.word, r.k) for r in got] == sorted((r.word, r.k) for r in got)
    assert ordering.numbered(rows.limit(0), "word").count() == 0


def test_appended_continues_the_chain(spark):
    rows = spark.createDataFrame([(n, "k", f"p{n}") for n in (9, 3, 5, 40)], "number long, kind string, payload string")
    got = documents.appended(rows, 7, "tail").orderBy("seq").collect()
    assert [(r.seq, r.event_id) for r in got] == [(8, "evt-3"), (9, "evt-5"), (10, "evt-9"), (11, "evt-40")]
    assert [r.prev_hash for r in got] == ["tail", *(r.payload_hash for r in got[:-1])]


def test_a_long_chain_is_one_cluster(spark):
    chain = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert {tuple(r) for r in graph.clusters(chain).collect()} == {(k, 0) for k in range(401)}


def test_components_against_closure(spark):
    pairs = [(k, (k * 7 + 3) % 60) for k in range(60) if k % 4] + [(k, (k * 11 + 5) % 60) for k in range(0, 60, 5)] + [(100 + k, 101 + k) for k in range(12)]
    pairs = [(a, b) for a, b in pairs if a != b]
    ways = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]

    def closure(edges):
        reach = {a: {b for x, b in edges if x == a} for a in {n for e in edges for n in e}}
        while True:
            grown = {a: bs.union(*(reach[b] for b in bs)) for a, bs in reach.items()}
            if grown == reach:
                return reach
            reach = grown

    both = closure(ways)
    got = {r.node: r.cluster for r in graph.clusters(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {a: min(bs | {a}) for a, bs in both.items()}
    one_way = closure(pairs)
    strong = {a: {b for b in bs if a in one_way[b] and b != a} | {a} for a, bs in one_way.items()}
    got = {r.node: (r.component, r.size) for r in graph.strong_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {a: (min(m), len(m)) for a, m in strong.items() if len(m) > 1}


def test_similar_bodies_against_all_pairs(spark):
    base = [f"line {k} of it" for k in range(30)]
    bodies = {f"f{k}": [x if (j + 3 * k) % 31 else f"own {k} {j}" for j, x in enumerate(base[: 30 - k % 3])] for k in range(12)}
    rows = [(n, f"file{n}", "\n".join(b)) for n, b in bodies.items()]
    got = {(r.a, r.b) for r in resolve.similar_bodies(spark.createDataFrame(rows, "name string, file string, body string")).collect()}
    want = {(a, b) for a in bodies for b in bodies if a < b and 2 * resolve._lcs(bodies[a], bodies[b]) / (len(bodies[a]) + len(bodies[b])) >= 0.9}
    assert got == want and want


def test_review_scores(spark):
    a = spark.createDataFrame([(0, "x", 80.0), (1, "x", 90.0), (0, "y", 20.0)], "batch int, dimension string, score double")
    f = spark.createDataFrame([(0, "i", "x", "high", "codebase", "other", 1)], "batch int, identifier string, dimension string, confidence string, impact_scope string, fix_scope string, turn int")
    got = {r.dimension: r.score for r in review.merged_scores(a, f).collect()}
    assert got == {"x": pytest.approx(0.7 * 85 + 0.3 * 80 - 2.2), "y": 60.0}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
