"""The pipeline stage by stage against brute force, on the smallest table."""

import re
import sys

import pytest

import corpus_pipeline
from evidentia.llm import quality_rules

sys.path.insert(0, __file__.rpartition("/")[0])
from test_native import brute, brute_lines  # noqa: E402
from test_words import brute_base, brute_near  # noqa: E402

SMALL = "/root/testdata/sf0.001"
KEY = lambda r: str((r.doc_id, r.text))


def redacted(text):
    out, at = "", 0
    for a, b in (tuple(map(int, s.split(":")[1:])) for s in brute(text)[4].split(",") if s):
        out += text[at:a] + "[SECRET]" if a >= at else ""
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, SMALL).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_schemas(stages):
    for docs, out in stages[:-1]:
        assert out.dtypes == docs.dtypes
        assert all(r.n_chars == len(r.text) for r in out.collect())


def test_quality(stages):
    docs, out = stages[0]
    want = []
    for r in docs.collect():
        base = brute_base(r.text)
        text, _, _, lost = quality_rules.clean_text(r.text)
        if not base[5] and lost <= 0.5 * base[1]:
            want.append(str((r.doc_id, text)))
    assert sorted(map(KEY, out.collect())) == sorted(want)
    assert 0 < len(want) < docs.count()


def test_lines(stages):
    docs, out = stages[1]
    assert sorted(map(KEY, out.collect())) == sorted(str((i, t)) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in docs.collect()]))


def test_near(stages):
    docs, out = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {i for i, _, _, k in brute_near(rows) if k}
    assert sorted(map(KEY, out.collect())) == sorted(str(r) for r in rows if r[0] in kept)


def test_secrets(stages):
    docs, out = stages[3]
    assert sorted(map(KEY, out.collect())) == sorted(str((r.doc_id, redacted(r.text))) for r in docs.collect())


def test_pack(spark, stages):
    docs, out = stages[4]
    rows = out.toPandas()
    assert set(rows.doc_id) == {r.doc_id for r in docs.collect()}
    assert rows.groupby("sequence_id").length.sum().max() <= 1024
    again = corpus_pipeline.run(spark, SMALL).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again[cols].values)) == sorted(map(tuple, rows[cols].values))


def test_odd_rows(spark):
    rows = [(1, None, "en", None), (None, "", "en", 0), (2, "word " * 30, None, 9), (3, "Plain words here make one good line number one. It has many more of them after the first few, so that no rule finds fault with it.", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert re.search("Plain", corpus_pipeline.quality(spark, docs, SMALL).first().text)
