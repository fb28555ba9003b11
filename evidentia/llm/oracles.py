"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from evidentia.llm.quality_rules import BOILERPLATE, SEPARATORS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^ \t\n\v\f\r]+"

REPEATS = """with h as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
w as (select rid, i, md5(substr(x, (2 * i + 1)::int, 800)) as m from (select rid, x, unnest(range(0, n - 399)) as i from h where n >= 400)),
starts as (select rid, i from (select rid, i, count(*) over (partition by m) as c from w) where c > 1),
marked as (select rid, i, case when i > coalesce(lag(i) over (partition by rid order by i) + 400, -1) then 1 else 0 end as new from starts),
numbered as (select rid, i, sum(new) over (partition by rid order by i) as span from marked),
spans as (select rid, span, min(i) as a, max(i) + 400 as b from numbered group by 1, 2),
pieces as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before from spans),
lossy as (select rid, sum(b - a)::bigint as removed, count(*) as n_spans, string_agg(substr(x, (2 * before + 1)::int, (2 * (a - before))::int), '' order by a) || substr(any_value(x), (2 * max(b) + 1)::int) as kept from pieces join h using (rid) group by rid)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from h left join lossy using (rid)"""

NEAR = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') as ws from documents),
s as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
least_of as (select a as doc_id, min(b) as m from reach group by 1)
select doc_id, len(sh) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, least(doc_id, coalesce(m, doc_id)) = doc_id as kept from s left join least_of using (doc_id)"""

_ALONE = "(" + ", ".join(f"'{s}'" for s in sorted(SEPARATORS)) + ")"
_RIDDEN = "len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&!]{2,}$')))"
QUALITY = f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, regexp_extract_all(text, '{_WORD}') as ws from d),
g as (select rid, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) >= 8),
k as (select rid, i, count(*) over (partition by rid, array_to_string(ws[i:i + 7], ' ')) as c from g),
r as (select rid, count(distinct i + j) as n_repeat from (select rid, i, unnest(range(0, 8)) as j from k where c > 1) group by 1),
l as (select rid, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from d),
lw as (select rid, line, p, regexp_extract_all(line, '{_WORD}') as ws from l),
j as (select rid, line, p, len(ws) > 0 as has, length(array_to_string(ws, '')) as chars, len(ws) > 0 and (
    len(list_filter(ws, lambda x: x in {_ALONE})) >= 3 and len(list_filter(ws, lambda x: x in {_ALONE})) * 5 >= len(ws)
    or len(ws) <= 40 and regexp_matches(line, '{BOILERPLATE.pattern}')
    or {_RIDDEN} * 2 >= len(ws)
    or len(ws) < 5 and not regexp_matches(line, '[.!?…:;]["''”’»)\\]]*\\s*$')) as fails from lw),
c as (select rid, count(*) filter (has) as n_lines, count(*) filter (fails) as n_failed, coalesce(sum(chars) filter (fails), 0)::bigint as lost, coalesce(string_agg(line, chr(10) order by p) filter (not fails), '') as clean,
    (count(*) filter (has) - count(distinct line) filter (has)) as dups from j group by 1),
b as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, dups as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words, n_lines, n_failed as n_failed_lines, lost as lost_chars, sha256(clean) as clean_sha256
    from w join c using (rid) left join r using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost_chars * 2 <= word_chars as kept, n_lines, n_failed_lines, lost_chars, clean_sha256 from b"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _rounds(rounds: int, group: str) -> str:
    """a<k>: nearest of the entries c<k>, at first c0, for each row and `group`; c<k+1>: floors of the means."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""d{k} as materialized (select rid, x.{group}, c, sum((x - y) * (x - y)) as d from x join c{k} using (p) group by 1, 2, 3),
a{k} as materialized (select rid, {group}, c, d from d{k} qualify row_number() over (partition by rid, {group} order by d, c) = 1)""")
        if k < rounds:
            out.append(f"""c{k + 1} as materialized (select c, p, {group}, coalesce(m, y) as y from c{k} left join (select c, p, floor(sum(x) / count(*))::bigint as m from x join a{k} using (rid, {group}) group by 1, 2) using (c, p))""")
    return ",\n".join(out)


CODES = f"""with k as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings where {_FINITE}),
x as materialized (select rid, p, (p - 1) * 4 // n as g, x from (select rid, len(v) as n, unnest(v) as x, generate_subscripts(v, 1) as p from k)),
s as (select rid, row_number() over (order by vec_id) - 1 as c from k order by vec_id limit 256),
c0 as materialized (select c, p, g, x as y from x join s using (rid)),
{_rounds(4, "g")},
e as (select rid, string_agg(format('{{:02x}}', c), '' order by g) as code, sum(d)::bigint as error from a4 group by rid),
h as (select sha256(string_agg(y::varchar, ',' order by g, c, p)) as codebooks_sha256 from c4)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from k join e using (rid), h"""

CLUSTERS = f"""with k as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and {_FINITE}),
x as materialized (select rid, 0 as g, unnest(v) as x, generate_subscripts(v, 1) as p from k),
s as (select rid, row_number() over (order by sha256('2:' || vec_id)) - 1 as c from k order by sha256('2:' || vec_id) limit 40),
c0 as materialized (select c, p, g, x as y from x join s using (rid)),
{_rounds(5, "g")},
h as (select c, sha256(string_agg(y::varchar, ',' order by p)) as centroid_sha256 from c5 group by c)
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256 from k join a5 using (rid) join h using (c)"""

ORACLES = {"op4_repeat_removal": REPEATS, "op9_near_dedup": NEAR, "op10_quality_rules": QUALITY, "op11_vector_codes": CODES, "op13_centroid_clusters": CLUSTERS}
