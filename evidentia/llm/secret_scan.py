"""Secret scans, DataFrame functions only: three base patterns, and sliding-window Shannon entropy per character class over
candidate strings, computed by incremental counts, with allow-list suppression.

Base kinds: assign (a secret's name, `:` or `=`, a value of 12 or more), access (`AKIA` and upper-case letters or digits, 18
or more in all), hex (16 or more of 0-9a-f). Matches are leftmost and do not overlap within a kind.

Entropy kinds: a candidate is a run of 20 or more of `A-Za-z0-9+/_=-` with a letter and a digit. Its class is the narrowest that
holds it: hexadecimal, alphanumeric or base64, with a least entropy in bits of 3.0, 3.5, 3.7. A window of 20 characters slides over it; the
counts of characters follow by one addition and one removal a step, and with them sum(c log2 c), so that the window's
entropy log2(20) - sum / 20 needs no recount. The span runs from the first to the last window at or above the limit. The allow-list
suppresses entropy spans only. The words example, sample, dummy, placeholder, test and changeme, where no letter or digit adjoins them, and 4 equal characters in a row
end a candidate, so that the windows that overlap them go and the others stay; UUIDs and digit runs with separators go as a whole.

Offsets are code points, ends exclusive. Positions are prefix sums over the lengths of matches and of the gaps between them, taken in blocks of about the square root
of their number, and the redacted text is put together from pieces once, so that a text with very many matches takes little more than its share. Each row
is worked off by itself, without a shuffle. Null and empty texts have no spans; repeated rows are alike; an empty table gives an empty
result; other columns, whatever their names, are kept by `redact` and ignored by `scan`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import tables

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the least lengths inside: runs are maximal, so a shorter match leaves no longer one behind it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LIMITS = {"entropy_hex": 3.0, "entropy_alnum": 3.5, "entropy_base64": 3.7}
ALLOWED = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[0-9+/_=-]+$"
ALLOWED_WORDS = ("example", "sample", "dummy", "placeholder", "test", "changeme")
#: Either is replaced by as many spaces before candidates are looked for.
ALONE = r"(?i)(?<![A-Za-z0-9])(?:{})(?![A-Za-z0-9])"
REPEATED = r"([A-Za-z0-9+/_=-])\1{3}"
#: shift: bytes less code points before the start; a span itself is ASCII.
SPAN = "struct<start:int,kind:int,end:int,shift:int>"
EPSILON = 1e-9


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """body with the value under a name, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _prefix(values: str, op: str) -> str:
    """Inclusive prefixes of an int array under `+` or `greatest`: within blocks, then with what the blocks before carry over. Appending to an
    array copies it, so blocks of the square root of the number of values keep that small."""
    join = "({} + {})" if op == "+" else "greatest({}, {})"
    last = lambda acc: f"coalesce(try_element_at({acc}, -1), 0)"
    block = f"aggregate(slice(v, i * n + 1, n), cast(array() as array<int>), (acc, x) -> concat(acc, array({join.format(last('acc'), 'x')})))"
    carried = f"aggregate(blocks, array(0), (acc, b) -> concat(acc, array({join.format('element_at(acc, -1)', 'element_at(b, -1)')})))"
    moved = f"flatten(zip_with(blocks, slice({carried}, 1, size(blocks)), (b, c) -> transform(b, x -> {join.format('x', 'c')})))"
    cut = f"transform(sequence(0, cast(ceil(size(v) / n) as int) - 1), i -> {block})"
    return _let(values, "v", f"if(size(v) = 0, v, {_let('cast(ceil(sqrt(size(v))) as int)', 'n', _let(cut, 'blocks', moved))})")


def _spans(kind: str, pattern: str, text: str, least: int = 0, group: int = 0) -> str:
    """Spans of one kind: matches and the gaps before them become positions. SQL, as lambdas nest."""
    p = _quoted(pattern)
    whole, part = (f"regexp_extract_all({text}, {p}, {g})" for g in (0, group))
    pairs = _let(whole, "m", f"zip_with(slice(split({text}, {p}, -1), 1, size(m)), m, (g, w) -> named_struct('gap', g, 'whole', w))")
    parts = f"zip_with({pairs}, {part}, (x, v) -> named_struct('gap', x.gap, 'size', length(x.whole), 'value', length(v)))"
    ends = _prefix("transform(found, x -> length(x.gap) + x.size)", "+")
    shifts = _prefix("transform(found, x -> octet_length(x.gap) - length(x.gap))", "+")
    span = f"named_struct('start', y.end - y.size, 'kind', {KINDS.index(kind)}, 'end', y.end, 'shift', h)"
    placed = f"zip_with(zip_with(found, {ends}, (x, e) -> named_struct('size', x.size, 'value', x.value, 'end', e)), {shifts}, (y, h) -> if(y.value >= {least}, {span}, null))"
    return f"if({text} rlike {p}, filter({_let(parts, 'found', placed)}, s -> s is not null), cast(array() as array<{SPAN}>))"


def _entropy(word: str) -> str:
    """struct(first, last): ends of the first and last window of a candidate that reach the limit of its class, 0 if none does."""
    clog = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(WINDOW + 2)) + ")"
    limit = lambda k: f"{WINDOW * (math.log2(WINDOW) - LIMITS[k]) + EPSILON!r}D"
    most = f"case {word}.kind when {KINDS.index('entropy_hex')} then {limit('entropy_hex')} when {KINDS.index('entropy_alnum')} then {limit('entropy_alnum')} else {limit('entropy_base64')} end"
    code = lambda i: f"ascii({word}.chars[{i}]) - 43"
    out = f"if(i >= {WINDOW}, {code(f'i - {WINDOW}')}, -1)"
    step = f"""aggregate(array({code('i')}), named_struct('in', 0, 'out', {out}), (z, y) -> named_struct('in', y, 'out', z.out), z ->
        named_struct(
            'counts', if(z.in = z.out, acc.counts, transform(acc.counts, (c, k) -> c + if(k = z.in, 1, 0) - if(k = z.out, 1, 0))),
            'sum', if(z.in = z.out, acc.sum, acc.sum + tab[acc.counts[z.in] + 1] - tab[acc.counts[z.in]]
                + if(z.out < 0, 0D, tab[acc.counts[z.out] - 1] - tab[acc.counts[z.out]])),
            'first', acc.first, 'last', acc.last))""".replace("tab[", f"{clog}[")
    ended = f"""aggregate(array({step}), acc, (z, s) -> named_struct('counts', s.counts, 'sum', s.sum,
        'first', if(acc.first = 0 and i >= {WINDOW - 1} and s.sum <= {most}, i + 1, acc.first),
        'last', if(i >= {WINDOW - 1} and s.sum <= {most}, i + 1, acc.last)))"""
    return f"""aggregate(sequence(0, size({word}.chars) - 1),
        named_struct('counts', array_repeat(0, 80), 'sum', 0D, 'first', 0, 'last', 0),
        (acc, i) -> {ended}, acc -> named_struct('first', acc.first, 'last', acc.last))"""


def _masked(text: str) -> str:
    """The text with allow-listed words and runs as spaces."""
    alone = lambda *w: _quoted(ALONE.format("|".join(w)))
    out = f"regexp_replace({text}, {_quoted(REPEATED)}, '    ')"
    for word in ALLOWED_WORDS:
        out = f"regexp_replace({out}, {alone(word)}, '{' ' * len(word)}')"
    return f"if({text} rlike {alone(*ALLOWED_WORDS)} or {text} rlike {_quoted(REPEATED)}, {out}, {text})"


def spans(text: str) -> list[tuple[str, str]]:
    """(name, expression) of the columns to add in turn; the last, `_spans`, has all spans of the text column, sorted."""
    found = f"regexp_extract_all(_masked, {_quoted(CANDIDATE)}, 0)"
    kind = f"case when w rlike '^[0-9a-fA-F]+$' then {KINDS.index('entropy_hex')} when w rlike '^[0-9a-zA-Z]+$' then {KINDS.index('entropy_alnum')} else {KINDS.index('entropy_base64')} end"
    suspect = f"w rlike '[A-Za-z]' and w rlike '[0-9]' and not w rlike {_quoted(ALLOWED)}"
    words = f"transform({found}, w -> if({suspect}, named_struct('kind', {kind}, 'chars', split(w, '')), null))"
    placed = _spans("entropy_hex", CANDIDATE, "_masked")  # the candidates' positions; kinds follow
    return [
        ("_base", f"concat({_spans('assign', ASSIGN, text, 12, 1)}, {_spans('access', ACCESS, text)}, {_spans('hex', HEX, text)})"),
        ("_masked", f"if({text} rlike {_quoted(CANDIDATE)}, {_masked(text)}, '')"),
        ("_words", f"if(_masked rlike {_quoted(CANDIDATE)}, {words}, null)"),
        ("_some", "exists(_words, w -> w is not null)"),
        ("_places", f"if(_some, {placed}, null)"),
        ("_windows", f"if(_some, transform(_words, w -> if(w is null, null, {_entropy('w')})), null)"),
        (
            "_more",
            f"""if(_some, transform(filter(arrays_zip(_places, _words, _windows), x -> x._windows.last > 0),
                x -> named_struct('start', x._places.start + x._windows.first - {WINDOW}, 'kind', x._words.kind, 'end', x._places.start + x._windows.last, 'shift', x._places.shift)), cast(array() as array<{SPAN}>))""",
        ),
        ("_base", "array_sort(_base)"),
        ("_spans", f"array_sort(concat(_base, coalesce(_more, cast(array() as array<{SPAN}>))))"),
    ]


HELPERS = ("_base", "_masked", "_words", "_some", "_places", "_windows", "_more", "_spans")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _base and _spans: arrays of (start, kind number, end)."""
    for name, expression in spans(text_col):
        docs = docs.withColumn(name, F.expr(expression))
    return docs.drop("_masked", "_words", "_some", "_places", "_windows", "_more")


def _told(spans_col: str) -> F.Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans_col}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by a mark; overlapping spans share one. A null text stays null."""
    found = scan(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")))
    # a span is replaced unless it begins inside one before it; offsets in bytes make each piece a copy of its own length
    at, ends = "if(i = 0, 0, element_at(ends, i))", _prefix("transform(_spans, s -> s.end + s.shift)", "greatest")
    piece = f"if(s.start + s.shift >= {at}, concat(decode(substring(raw, {at} + 1, s.start + s.shift - {at}), 'UTF-8'), '{mark}'), '')"
    folded = _let(ends, "ends", _let("cast(text as binary)", "raw", f"concat(array_join(transform(_spans, (s, i) -> {piece}), ''), decode(substring(raw, element_at(ends, -1) + 1), 'UTF-8'))"))
    left = F.expr(f"if(size(_spans) > 0, {folded}, text)")
    return found.select(*(left.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    found = scan(tables.texts(docs))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_told("_base").cast("binary"), 256).alias("base_sha256"),
        _told("_spans").alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_entropy"),
    )
