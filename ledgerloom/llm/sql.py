r"""DuckDB SQL with the same rows as the queries that SQL can express."""

#: Raw turns cost their text; a turn with a control string costs its escaped form.
OP3 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-1::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'),
                        (-1::bigint, 1::bigint, 'assistant', '</s>[INST] ok [/INST]'))
), flagged as (
  select *, regexp_matches(role, '</?s>|\[/?INST\]') or regexp_matches(text, '</?s>|\[/?INST\]') as clash from turns
), sized as (
  select *, case when clash then
      length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g'))
      + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\])', '\1\\\2', 'g'))
    else length(role) + length(text) end + length('<s>[INST]0[/INST]</s>') as chars
  from flagged
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""


def _op4_level(level: int) -> str:
    node = ", ".join(["host", *(f"g{k}" for k in range(1, level))])
    before = "counts" if level == 1 else f"level{level - 1}"
    return f"""
children{level} as (
  select {node}, s{level}, sum(pages) as pages, sum(allowed) as allowed, sum(blocked) as blocked from {before} group by all
), nodes{level} as (
  select {node}, count(*) as kids, sum(pages) as node_pages, sum(allowed) as node_allowed, sum(blocked) as node_blocked
  from children{level} group by all
), rates{level} as (
  select *, (node_blocked + 1)::double / (node_allowed + node_blocked + 2)::double as rate, (allowed + blocked)::double as labelled
  from children{level} join nodes{level} using ({node})
), named{level} as (
  select {node}, s{level},
    case when s{level} = '' then ''
         when kids > 8 and pages * 8 < node_pages or abs(blocked::double - labelled * rate) <= 2.0 * sqrt(labelled * rate * (1.0 - rate)) then '*'
         else s{level} end as g{level}
  from rates{level}
), level{level} as (
  select * from {before} join named{level} using ({node}, s{level})
)"""


#: The same tree, level by level.
OP4 = r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages
), hosts as (
  select page_id, coalesce(r, '') as r, regexp_extract(coalesce(r, ''), '^[^/?#]*') as h from rest
), parsed as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(r, length(h) + 1), '^[^?#]*') as path
  from hosts
), ruled as (
  select *,
    case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
         when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule,
    list_filter(string_split(path, '/'), lambda s: s <> '') as parts
  from parsed
), urls as (
  select page_id, host, path, rule,
    case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as said,
    coalesce(regexp_replace(parts[1], '[0-9]+', '#', 'g'), '') as s1,
    coalesce(regexp_replace(parts[2], '[0-9]+', '#', 'g'), '') as s2,
    coalesce(regexp_replace(parts[3], '[0-9]+', '#', 'g'), '') || case when len(parts) > 3 then '/**' else '' end as s3
  from ruled
), counts as (
  select host, s1, s2, s3, count(*) as pages, count(*) filter (said = 'allow') as allowed, count(*) filter (said = 'block') as blocked
  from urls group by all
), """ + ", ".join(_op4_level(k) for k in (1, 2, 3)) + r""", templates as (
  select host, g1, g2, g3, sum(allowed)::double as allowed, sum(blocked)::double as blocked from level3 group by all
), by_host as (
  select host, sum(allowed) as a, sum(blocked) as b from templates group by host
), base as (
  select (coalesce(sum(a), 0) + 1.0::double) / (coalesce(sum(a), 0) + coalesce(sum(b), 0) + 2.0::double) as base from by_host
), host_purity as (
  select host, (a + 2.0::double * base) / (a + b + 2.0::double) as purity from by_host, base
), judged as (
  select t.*, (allowed + 2.0::double * purity) / (allowed + blocked + 2.0::double) as pure from templates t join host_purity using (host)
)
select page_id, host, path, rule,
  coalesce(said, case when pure >= 0.5 then 'allow' else 'block' end) as verdict,
  host || case when g1 = '' then '' else '/' || g1 end || case when g2 = '' then '' else '/' || g2 end
       || case when g3 = '' then '' else '/' || g3 end as template
from urls left join (select host, s1, s2, s3, g1, g2, g3, pure from level3 join judged using (host, g1, g2, g3)) using (host, s1, s2, s3)
"""

#: Brute force over all pairs of a query and a candidate.
OP6 = r"""
with fine as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from fine q join fine c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 5
"""

#: All windows of up to ten non-blank lines with ten words or more, by their text.
OP5 = r"""
with split as (
  select doc_id, text, string_split(text, chr(10)) as parts from documents
), lines as (
  select doc_id, unnest(parts) as line, unnest(range(len(parts))) as ln from split
), counted as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from lines
), filled as (
  select *, row_number() over (partition by doc_id order by ln) as t from counted where words > 0
), windows as (
  select f.doc_id, f.t, s.n,
    sha256(string_agg(g.line, chr(10) order by g.t)) as body, min(g.ln) as first_line, max(g.ln) as last_line, sum(g.words) as words, count(*) as have
  from filled f, (select unnest(range(1, 11)) as n) s, filled g
  where g.doc_id = f.doc_id and g.t between f.t and f.t + s.n - 1
  group by all
), fit as (
  select *, row_number() over (partition by n, body order by doc_id, t) as copy from windows where have = n and words >= 10
), later as (
  select doc_id, t, n from fit where copy > 1
), gone_lines as (
  select distinct f.doc_id, f.t, f.ln from filled f join later l on f.doc_id = l.doc_id and f.t between l.t and l.t + l.n - 1
), islands as (
  select *, t - row_number() over (partition by doc_id order by t) as island from gone_lines
), runs as (
  select doc_id, min(ln) as a, max(ln) as b from islands group by doc_id, island
), gone as (
  select distinct c.doc_id, c.ln from counted c join runs r on c.doc_id = r.doc_id and c.ln between r.a and r.b
), per_doc as (
  select c.doc_id, count(*) as n_lines, count(g.ln) as n_removed,
    sha256(coalesce(string_agg(c.line, chr(10) order by c.ln) filter (g.ln is null), '')) as kept_sha256
  from counted c left join gone g using (doc_id, ln) group by c.doc_id
)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  (select count(*) from runs r where r.doc_id = d.doc_id) as n_runs, coalesce(kept_sha256, sha256('')) as kept_sha256
from documents d left join per_doc using (doc_id)
"""

#: The same without the floor: a repeated run is a row of repeated lines, so single lines tell.
OP5_WHOLE = r"""
with counted as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as ln from documents
), filled as (
  select *, row_number() over (partition by doc_id order by ln) as t, row_number() over (partition by line order by doc_id, ln) as copy
  from counted where regexp_matches(line, '[^\x20\x09-\x0D]')
), islands as (
  select doc_id, ln, t - row_number() over (partition by doc_id order by t) as island from filled where copy > 1
), runs as (
  select doc_id, min(ln) as a, max(ln) as b from islands group by doc_id, island
), gone as (
  select c.doc_id, c.ln from counted c join runs r on c.doc_id = r.doc_id and c.ln between r.a and r.b
), per_doc as (
  select c.doc_id, count(*) as n_lines, count(g.ln) as n_removed,
    sha256(coalesce(string_agg(c.line, chr(10) order by c.ln) filter (g.ln is null), '')) as kept_sha256
  from counted c left join gone g using (doc_id, ln) group by c.doc_id
)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  (select count(*) from runs r where r.doc_id = d.doc_id) as n_runs, coalesce(kept_sha256, sha256('')) as kept_sha256
from documents d left join per_doc using (doc_id)
"""

OP12 = r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), split as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, doc_id > min(doc_id) over (partition by text) as late from texts
), said as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), flagged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(late, false)} as fails
  from split left join said using (doc_id)
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as letter
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps as (
  select filter_order, step::int as step, filter_order[step] as letter, left(filter_order, step - 1) as earlier
  from orders, range(1, 6) as r(step)
), long as (
  select row_number() over () as doc, * from flagged
), each as (
  select doc, part, good, toxic, letter, case letter when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end as bad
  from long, letters
), failed as (
  select doc, string_agg(letter, '') filter (bad) as bad from each group by doc
), patterns as (
  select part, coalesce(bad, '') as bad, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from long join failed using (doc) group by all
), placed as (
  select *, contains(bad, letter) as fails, len(translate(earlier, bad, '')) < len(earlier) as before from patterns, steps
), counted as (
  select part, filter_order, step, letter,
    sum(n) filter (not fails and not before) as kept, sum(n) filter (fails and not before) as removed, sum(n) filter (fails and before) as redundant,
    sum(n) filter (bad = letter) as unique_fails, sum(good) filter (fails and not before) as good_lost, sum(toxic) filter (fails and not before) as toxic_lost
  from placed group by all
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, letter), 0)::bigint as shapley
from counted
"""

OP13 = r"""
with recursive bytes as (
  select distinct doc_id, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint) as bytes from documents where doc_id is not null
), checks as (
  select doc_id, xor(list_reduce(bytes, lambda crc, byte:
    list_reduce(range(8), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(crc, byte)), 4294967295), 4294967295) as crc32
  from bytes
), fields as (
  select doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head, text,
    case when crc32 % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as touched
  from documents left join checks using (doc_id)
), leaves as (
  select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(touched) || ':' || touched, '-')) as changed
  from fields
), ordered as (
  select row_number() over () as doc, *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n
  from leaves
), nodes as (
  select 0 as level, lang, place, n, leaf as h from ordered
  union all
  select level + 1, lang, place // 8, (n + 7) // 8, sha256(string_agg(h, '' order by place)) from nodes where n > 1 group by level, lang, place // 8, n
), runs as (
  select level + 1 as level, lang, place // 8 as place, string_agg(h, '' order by place) as run from nodes where n > 1 group by level, lang, place // 8
), langs as (
  select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from nodes where n = 1
), tops as (
  select 0 as level, place, n, subroot as h from langs
  union all
  select level + 1, place // 8, (n + 7) // 8, sha256(string_agg(h, '' order by place)) from tops where n > 1 group by level, place // 8, n
), top_runs as (
  select level + 1 as level, place // 8 as place, string_agg(h, '' order by place) as run from tops where n > 1 group by level, place // 8
), climb as (
  select 0 as level, doc, lang, place, n, changed as cur, '' as sib from ordered
  union all
  select c.level + 1, doc, c.lang, r.place, (n + 7) // 8, sha256(left(run, 64 * (c.place % 8)::int) || cur || substr(run, 64 * (c.place % 8 + 1)::int + 1)),
    sib || left(run, 64 * (c.place % 8)::int) || substr(run, 64 * (c.place % 8 + 1)::int + 1)
  from climb c join runs r on r.level = c.level + 1 and r.lang is not distinct from c.lang and r.place = c.place // 8
), climb_tops as (
  select 0 as level, doc, l.place, l.n, subroot, cur, sib from climb c join langs l on l.lang is not distinct from c.lang where c.n = 1
  union all
  select c.level + 1, doc, r.place, (n + 7) // 8, subroot, sha256(left(run, 64 * (c.place % 8)::int) || cur || substr(run, 64 * (c.place % 8 + 1)::int + 1)),
    sib || left(run, 64 * (c.place % 8)::int) || substr(run, 64 * (c.place % 8 + 1)::int + 1)
  from climb_tops c join top_runs r on r.level = c.level + 1 and r.place = c.place // 8
)
select doc_id, leaf, subroot, h as root, sha256(sib) as proof_sha256, cur as folded_root, cur = h as verified
from climb_tops c join ordered using (doc), (select h from tops where n = 1) where c.n = 1
"""

OP11 = r"""
with recursive words as (
  select row_number() over () as doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc, doc_id, list_distinct(case when len(w) between 1 and 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as shingles
  from words
), entries as (
  select doc, len(shingles) as n, unnest(shingles) as shingle from sets
), pairs as (
  select a.doc as a, b.doc as b from entries a join entries b on a.shingle = b.shingle and a.doc < b.doc and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc, b.doc, a.n, b.n having 185 * count(*) >= 85 * (a.n + b.n)
), links as (
  select a, b from pairs union all select b, a from pairs
), reached as (
  select doc, doc as other from sets
  union
  select r.doc, l.b from reached r join links l on l.a = r.other
), least as (
  select r.doc, min(s.doc_id) as component_id from reached r join sets s on s.doc = r.other group by r.doc
), counts as (
  select a as doc, count(*) as n_links from links group by a
)
select doc_id, len(shingles)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
from sets join least using (doc) left join counts using (doc)
"""
