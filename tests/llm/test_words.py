"""Quality rules, near-duplicates and token counts against brute force, on the smallest table and on odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.llm import near_dedup, quality_rules, token_counts
from evidentia.llm.components import components
from evidentia.llm.tokenizers_public import default_path, encoder

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \t\n\x0b\x0c\r", "x"),
    (4, "One two", "x"),
    (5, "one  TWO", "x"),
    (6, "a b c d éÉ e f g", "x"),
    (7, BASE, "x"),
    (8, BASE.upper(), None),
    (9, BASE + " more", "x"),
    (10, "w " * 60, "x"),
    (11, "line a b c d e f g h\nline a b c d e f g h\n\n  \nline a b c d e f g h", "x"),
    (12, "long " + "z" * 70000 + " end", "x"),
    (13, " ".join(f"t{i}" for i in range(30000)), "x"),
    (14, " ".join(f"t{i}" for i in range(29999)), "x"),
    (15, "Home | About | Contact | Help\n" + BASE + ".", "x"),
    (15, "Home | About | Contact | Help\n" + BASE + ".", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, kept string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_near(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    inter = Counter((a, b) for ids in by.values() for k, a in enumerate(sorted(set(ids))) for b in sorted(set(ids))[k + 1 :])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in inter.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("table", ["small", "odd"])
def test_near_duplicates(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    assert set(got) == brute_near(rows)


def test_near_duplicates_chain_and_group(spark):
    """A large group of variants of one text, chains whose ends are not similar, and moderately similar texts."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:i % 100] + [f"x{i}"] + words[i % 100 + 1 :])) for i in range(150)]
    rows += [(1000 + i, " ".join(f"c{k}" for k in range(i * 8, i * 8 + 140))) for i in range(12)]
    rows += [(2000 + i, " ".join((f"m{k}" if (k + i) % 9 else f"m{k}_{i}") for k in range(200))) for i in range(9)]
    got = {tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_without_ids(spark):
    """Rows without an id, alone, copied and alike others; texts that share an id; empty texts all stay."""
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"z{i}" for i in range(60))
    rows = [(None, BASE), (None, other), (None, other), (None, other + " end"), (None, ""), (None, ""), (None, None), (4, third), (None, third), (7, "quite another text under one id"), (7, "and one more text under this id"), (8, ""), (9, "a text twice"), (9, "a text twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    none = [r for r in got if r[0] is None]
    assert sorted(map(str, none)) == sorted(map(str, [(None, 16, None, True), (None, 0, None, True), (None, 0, None, True), (None, 0, None, True), (None, 56, 4, False)] + [r for r in none if r[1] in (56, 57) and r[2] is None]))
    assert sum(r[3] for r in none if r[1] in (56, 57)) == 1
    assert {r for r in got if r[0]} == {(4, 56, 4, True), (7, 2, 7, True), (7, 3, 7, True), (8, 0, 8, True), (9, 1, 9, True)}
    kept = [tuple(r) for r in near_dedup.dedup(docs).collect()]
    alike = [r for r in kept if r[1] and r[1].startswith("v0")]
    assert len(alike) == 1
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], *alike, *rows[4:8], *rows[9:]]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (30, 20), (20, 30), (20, 10)] + [(100, 200 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 10, 100: 100} | {200 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


@pytest.mark.parametrize("table", ["small", "odd"])
def test_quality_rules(request, table):
    docs = request.getfixturevalue(table)
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = quality_rules.measures(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(rows[r.doc_id])
        text, total, failed, lost = quality_rules.clean_text(rows[r.doc_id] or "")
        assert (r.clean_text, r.n_lines, r.n_failed_lines, r.lost_chars) == (text, total, failed, lost)
        assert r.kept == (not r.base_failed and lost <= 0.5 * r.word_chars)


def test_line_rules():
    fails = quality_rules.line_fails
    assert fails("Home | About | Contact | Help") == "navigation"
    assert fails("Copyright. All rights reserved.") == "boilerplate"
    assert fails("Read more") == "punctuation"
    assert fails("big### sale$$$ now%%% here&&& x") == "punctuation"
    assert fails("A plain sentence that was cut off after the last") is None
    assert fails("It ended well.") is None
    assert quality_rules.clean_text("Good line here.\nA | B | C | D |\n\nMore of it.") == ("Good line here.\n\nMore of it.", 3, 1, 8)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_token_histogram(spark, request, table):
    docs = request.getfixturevalue(table)
    path = default_path("byte_bpe_50k.tiktoken")
    n = sorted(len(encoder(path).encode_ordinary(r.text or "")) for r in docs.collect())
    answers = token_counts.query(docs, path)
    got = {r.n_tokens: r for r in answers.collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert (r.n_docs, r.docs_from, r.tokens_from) == (n.count(limit), sum(x >= limit for x in n), sum(x for x in n if x >= limit))
        assert r.truncated_total == sum(min(x, limit) for x in n)
        assert r.quantile == pytest.approx(sum(x <= limit for x in n) / len(n))
    for limit in (0, 7, 500, 10**6):
        assert token_counts.truncated_total(answers, limit).first().truncated_total == sum(min(x, limit) for x in n)
    assert token_counts.quantile(answers, 0.5).first().n_tokens == n[(len(n) + 1) // 2 - 1]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    assert quality_rules.measures(none).count() == 0
    assert token_counts.query(none, default_path("byte_bpe_50k.tiktoken")).count() == 0
