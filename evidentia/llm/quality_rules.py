"""Quality rules, line first: lines are judged one by one, failures removed, then texts that lost too much are rejected.

Line rules, on lines that hold a word (blank lines are layout and never count):
* navigation: at least 3 separators `| > » • ·` standing alone, and at least one such for every five words;
* boilerplate: a fixed phrase of the list below, in a line of at most 40 words;
* punctuation: no closing mark at its end, and it is a stub (under 5 words) or symbol-ridden: at least half of its words
  end in two or more of `# * $ % & !`.
The text is rejected when failing lines hold more than `max_lost` of its word characters, or when a base rule fails
(under 20 words; over 30 % of words in repeated 8-word windows).

Null and empty texts have no words, fail the base rule and are rejected. Ties and repeated rows are judged alike, row by
row; an empty table gives an empty result; extra columns are ignored by `measures` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables
from evidentia.llm.bytesets import IS_SPACE, Prefixes, Words, slices, splitmix, utf8

MAX_LOST = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset("| > » • ·".split())
BOILERPLATE = re.compile(
    r"(?i)all rights reserved|privacy policy|terms of (?:use|service)|cookie (?:policy|settings)|accept (?:all )?cookies|"
    r"enable javascript|click here|subscribe to our|sign up for|lorem ipsum|skip to (?:main )?content|share this"
)
CLOSED = re.compile(r"""[.!?…:;]["'”’»)\]]*\s*$""")
RIDDEN = re.compile(r"[#*$%&!]{2,}$")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_failed_lines long, lost_chars long, clean_text string"
)


def line_fails(line: str) -> str | None:
    """The rule that a line with words fails, if any."""
    words = line.split()
    alone = sum(w in SEPARATORS for w in words)
    if alone >= 3 and alone * 5 >= len(words):
        return "navigation"
    if len(words) <= 40 and BOILERPLATE.search(line):
        return "boilerplate"
    if not CLOSED.search(line) and (len(words) < 5 or sum(bool(RIDDEN.search(w)) for w in words) * 2 >= len(words)):
        return "punctuation"
    if words and sum(bool(RIDDEN.search(w)) for w in words) * 2 >= len(words):
        return "punctuation"
    return None


_SPACES = re.compile(r"[ \t-\r]+")


def _word_chars(line: str) -> int:
    return len(_SPACES.sub("", line))


def clean_text(text: str) -> tuple[str, int, int, int]:
    """Text without failing lines, number of lines with words, number that fail, word characters lost."""
    kept, total, failed, lost = [], 0, 0, 0
    for line in text.split("\n"):
        chars = _word_chars(line)
        if chars:
            total += 1
            if line_fails(line):
                failed += 1
                lost += chars
                continue
        kept.append(line)
    return "\n".join(kept), total, failed, lost


def _per_row(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(words: Words, n: int = WINDOW) -> np.ndarray:
    """Per row, the words inside n-word windows that the row holds twice or more."""
    h, row, at = words.grams(n)
    key = splitmix(h ^ splitmix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words.hashes) + 1, np.int64)
    steps[at[twice]] += 1  # the starts are distinct
    steps[at[twice] + n] -= 1
    return np.bincount(words.row[np.cumsum(steps[:-1]) > 0], minlength=words.rows)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row, lines with a word that equal an earlier line of the row."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(rows, np.int64)
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    inside = np.concatenate([[0], np.cumsum(~IS_SPACE[data])])
    some = inside[ends] > inside[starts]
    starts, ends = starts[some], ends[some]
    row = np.searchsorted(offsets, starts, "right") - 1
    key = splitmix(Prefixes(data).hashes(starts, ends) ^ splitmix(row.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = utf8(batch.column("text"))
        words = Words(data, offsets, lowered=False)
        chars = _per_row(offsets, words.inside & ((data & 0xC0) != 0x80))
        repeats = repeated_words(words)
        failed = (words.counts < 20) | (100 * repeats > 30 * words.counts)
        cleaned = [clean_text(t or "") for t in batch.column("text").to_pylist()]
        lost = np.array([c[3] for c in cleaned], np.int64)
        kept = ~failed & (lost <= MAX_LOST * chars)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                *(pa.array(x, pa.int64()) for x in (words.counts, chars, _per_row(offsets, _SYMBOL[data]), duplicate_lines(data, offsets), repeats)),
                *(pa.array(x, pa.bool_()) for x in (failed, kept)),
                *(pa.array([c[k] for c in cleaned], pa.int64()) for k in (1, 2, 3)),
                pa.array([c[0] for c in cleaned], pa.string()),
            ],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars", "clean_text"],
        )


def measures(docs: DataFrame) -> DataFrame:
    """One row per document with base counts, verdict and the cleaned text; a narrow pass, no shuffle."""
    return tables.texts(docs).mapInArrow(_measure, SCHEMA)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that the rules keep, all columns, with the cleaned text; a narrow pass over rows of any schema."""
    spark = docs.sparkSession
    tables.bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            only = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], ["doc_id", "text"])
            for judged in _measure(iter([only])):
                at = batch.schema.get_field_index(text_col)
                out = batch.set_column(at, batch.schema.field(at), judged.column("clean_text").cast(batch.schema.field(at).type))
                yield out.filter(judged.column("kept"))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return measures(docs).withColumn("clean_sha256", F.sha2(F.col("clean_text").cast("binary"), 256)).drop("clean_text")
