"""SQL fragments that the queries' DuckDB texts share: the driver's tables as a catalog."""

from __future__ import annotations

PATH = "source || '/' || lpad(doc_id::varchar, 8, '0') || ['.py', '.js', '.md', '.gz', '', '.YAML'][(doc_id % 6 + 1)::int]"
FILES = f"files as (select doc_id, {PATH} as path, text as content from documents)"
LINES = "case when content = '' then 0 else len(regexp_split_to_array(content, '\\r\\n|\\r|\\n')) - (ends_with(content, chr(10)) or ends_with(content, chr(13)))::int end::bigint"
LANGUAGE = "['python', 'javascript', 'markdown', 'plain', 'plain', 'yaml'][(doc_id % 6 + 1)::int]"
INVENTORY = f"{FILES}, inventory as (select doc_id, path, strlen(content)::bigint as size, sha256(content) as sha256, {LANGUAGE} as language, {LINES} as line_count from files)"
HASH = "sha256(string_agg(path || chr(0) || sha256 || chr(10), '' order by path))"
STEPS = """steps as (
  select conv_id as workflow_id, turn::int as step, (turn + 1)::int as number, role as title,
    case when role = 'system' then 2 when length(text) % 5 = 0 then 3 else 0 end as n from conversations
)"""
EVIDENCE = f"""{FILES}, cited as (
  select path as file, content, string_split(content, chr(10)) as l, split_part(string_split(content, chr(10))[-1], ' ', 1) as symbol from files
), located as (
  select *, symbol = '' or contains(array_to_string(l[2:3], chr(10)), symbol) or coalesce(list_position(list_transform(l, lambda x: contains(x, symbol)), true), 0) = 0 as stays,
    list_position(list_transform(l, lambda x: contains(x, symbol)), true) as hit from cited
), placed as (
  select file, symbol, case when stays then 2 else hit end::bigint as start, case when stays then 3 else hit end::bigint as "end", not stays as relocated, l from located
)"""


def nodes(vertical: bool) -> str:
    """Closed forms of the layout."""
    process, decision = ("204.0", "452.0") if vertical else ("340.0", "651.0")
    along = f"coalesce(sum(case when n > 0 then {decision} else {process} end) over (partition by workflow_id order by step rows between unbounded preceding and 1 preceding), 0.0)::double"
    if vertical:
        main = "case when n > 0 then -105.0 else -115.0 end::double as x, cur as y, case when n > 0 then 210.0 else 230.0 end::double as w"
        option = "(-(230 * n + 42 * (n - 1)) / 2.0 + 272 * o)::double as x, (cur + 220)::double as y, 230.0::double as w"
    else:
        main = "cur as x, case when n > 0 then -63.0 else -56.0 end::double as y, case when n > 0 then 190.0 else 230.0 end::double as w"
        option = "(cur + 296)::double as x, (-(112 * n + 34 * (n - 1)) / 2.0 + 146 * o)::double as y, 230.0::double as w"
    return f"""{STEPS}, placed as (select *, {along} as cur from steps), nodes as (
  select workflow_id, step, -1 as option, case when n > 0 then 'decision' else 'process' end as kind, number::varchar as display_number, {main}, case when n > 0 then 126.0 else 112.0 end::double as h from placed
  union all
  select workflow_id, step, o::int, 'process', number || '.' || chr((97 + o)::int), {option}, 112.0::double from placed, (values (0), (1), (2)) t(o) where o < n
)"""


EDGES = """edges as (
  select workflow_id, step as from_step, -1 as from_option, step as to_step, o::int as to_option, 'option ' || (o + 1) as label, true as branch, false as merge
  from steps, (values (0), (1), (2)) t(o) where o < n
  union all
  select workflow_id, step, o::int, nxt, -1, null, false, true
  from (select *, lead(step) over (partition by workflow_id order by step) as nxt from steps), (values (0), (1), (2)) t(o) where o < n and nxt is not null
  union all
  select workflow_id, step, -1, nxt, -1, null, false, false
  from (select *, lead(step) over (partition by workflow_id order by step) as nxt from steps) where n = 0 and nxt is not null
)"""
BOUNDS = "bounds as (select workflow_id, min(x) as min_x, max(x + w) as max_x, min(y) as min_y, max(y + h) as max_y from nodes group by 1)"
FEATURES = "features as (select c_custkey as id, c_nationkey as area_id, c_name as title, case when c_custkey % 3 = 0 then 'pending' when c_custkey % 3 = 1 then 'generated' else 'partial' end as status, c_mktsegment as summary from customer)"
AREAS = "areas as (select n_nationkey as id, n_name as title, case when n_regionkey % 2 = 0 then 'technical' else 'product' end as perspective, n_nationkey % 5 as ord from nation)"
ESCAPED = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
