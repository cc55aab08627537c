"""DuckDB SQL with the same rows as the queries of :mod:`ledgerloom.plans.queries`."""

from __future__ import annotations

from ledgerloom.plans.fragments import AREAS, BOUNDS, EDGES, ESCAPED, EVIDENCE, FEATURES, FILES, HASH, INVENTORY, STEPS, nodes
from ledgerloom.plans.jobs_sql import JOBS_SQL
from ledgerloom.plans.views_sql import VIEWS_SQL

ORACLE_SQL: dict[str, str] = {
    "inventory_documents": f"with {INVENTORY} select path, size, sha256, language, line_count from inventory",
    "filtered_inventory": f"with {INVENTORY} select path, size, language from inventory where not ends_with(path, '.gz')",
    "snapshot_fingerprint": f"with {INVENTORY} select {HASH} as source_hash from inventory",
    "snapshot_files": f"with {INVENTORY} select {HASH} as source_hash, count(*) as files, min(path) as first_path from inventory",
    "python_sources": f"with {INVENTORY} select path, line_count from inventory where ends_with(path, '.py')",
    "language_classes": f"with {INVENTORY} select language, count(*) as files, sum(size)::bigint as bytes from inventory group by 1",
    "line_counts": f"with {INVENTORY} select doc_id, line_count from inventory",
    "source_lines": f"with {FILES}, l as (select path, string_split(content, chr(10)) as x from files) select path, unnest(range(1, len(x) + 1))::bigint as number, unnest(x) as line from l",
    "relocate_symbol": f'with {EVIDENCE} select file, symbol, start, "end", relocated from placed',
    "highlighted_lines": f'with {EVIDENCE}, x as (select file as path, unnest(range(1, len(l) + 1))::bigint as number, start, "end" as stop from placed) select path, count(*) as active, min(number) as first_active from x where number between start and stop group by 1',
    "evidence_labels": f"""with {FILES}, r as (select *, (1 + doc_id % 3) as a, (1 + doc_id % 4) as b from files)
        select doc_id, path || ':' || a || case when a <> b then '–' || b else '' end as label, 'vscode://file/srv/repo/' || path || ':' || a as link,
          a || ' ' || case when a = 1 then 'source reference' else 'source references' end as "references" from r""",
    "evidence_range_violations": f"with {INVENTORY} select path as file, doc_id % 3 + 1 as code_start, doc_id % 3 + 5 as code_end, line_count from inventory where doc_id % 3 + 5 > line_count",
    "known_file_semi": f"with {FILES} select doc_id, path from files semi join labels using (doc_id)",
    "unknown_file_anti": f"with {FILES} select doc_id, path from files anti join labels using (doc_id)",
    "orphan_features": f"with {FEATURES}, {AREAS} select id, area_id, title from features where area_id not in (select id from areas where ord <> 3)",
    "status_counts": f"with {FEATURES} select count(*) filter (status = 'generated') as ready_count, count(*) filter (status = 'partial') as partial_count, count(*) filter (status = 'pending') as pending_count from features",
    "last_area_wins": 'select n_regionkey as id, max(n_nationkey) as "at", max_by(n_name, n_nationkey) as title from nation group by 1',
    "catalog_search": "select doc_id, source from documents where contains(lower(text), 'license') or contains(lower(lang), 'license') or contains(lower(source), 'license')",
    "catalog_summary": f"with {FEATURES} select count(*) filter (status = 'generated') as complete, count(*) as total, count(*) filter (contains(lower(title), 'build') or contains(lower(summary), 'build')) as shown from features",
    "area_ordering": f"with {AREAS} select id, perspective, row_number() over (order by case perspective when 'product' then 0 else 1 end, ord, id) as place from areas",
    "catalog_sections": f"""with {FEATURES}, {AREAS} select a.id, a.title, perspective, count(*) as n_cards, string_agg(f.id::varchar, ',' order by f.id) as card_ids
        from areas a join features f on a.id = f.area_id where contains(lower(f.title), 'auto') or contains(lower(summary), 'auto') group by 1, 2, 3""",
    "first_and_selected": "select c_custkey as id, c_name as title from customer where c_custkey = (select min(c_custkey) from customer) union all select c_custkey, c_name from customer where c_custkey = 7",
    "duplicate_keys": "select * from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as copy from lineitem) where copy > 1",
    "step_numbering": "select conv_id, bool_and(fine) as numbered, count(*) as step_count from (select conv_id, turn + 1 = row_number() over (partition by conv_id order by turn) as fine from conversations) group by 1",
    "flow_edges": f"with {STEPS}, {EDGES} select * from edges",
    "vertical_layout": f"with {nodes(True)} select * from nodes",
    "horizontal_layout": f"with {nodes(False)} select * from nodes",
    "flow_bounds": f"with {nodes(True)}, {BOUNDS} select * from bounds",
    "flow_fit": f"""with {nodes(True)}, {BOUNDS}, sized as (select *, greatest(230.0::double, max_x - min_x) as bw, greatest(112.0::double, max_y - min_y) as bh from bounds),
        scaled as (select *, least(1.15::double, greatest(0.3::double, least(1100.0::double / bw, 660.0::double / bh))) as scale from sized)
        select workflow_id, scale, (1200.0::double - bw * scale) / 2 - min_x * scale as x, 170.0::double + (660.0::double - bh * scale) / 2 - min_y * scale as y from scaled""",
    "flow_first_view": f"with {nodes(True)} select workflow_id, 0.5::double as scale, 600.0::double - (x + w / 2) * 0.5::double as x, 182.0::double - y * 0.5::double as y from nodes where step = 0 and option = -1",
    "flow_connectors": f"""with {nodes(True)}, {EDGES}, ends as (
          select e.*, a.x + a.w / 2 as x0, a.y + a.h as y0, b.x + b.w / 2 as x3, b.y as y3 from edges e
          join nodes a on a.workflow_id = e.workflow_id and a.step = from_step and a.option = from_option
          join nodes b on b.workflow_id = e.workflow_id and b.step = to_step and b.option = to_option)
        select workflow_id, from_step, from_option, to_step, to_option, x0, y0, x0 as x1, (y0 + y3) / 2 as y1, x3 as x2, (y0 + y3) / 2 as y2, x3, y3 from ends""",
    "hit_test": f"""with {nodes(True)}, points as (
          select conv_id * 100 + turn as point_id, conv_id as workflow_id, ((conv_id * 37 + turn * 13) % 400 - 200.0 - 40.0)::double / 0.5::double as px, (turn * 170.0 + conv_id % 90 + 20.0)::double / 0.5::double as py from conversations),
        met as (select point_id, p.workflow_id, step, option from points p join nodes n on p.workflow_id = n.workflow_id
          where case when kind = 'decision' then abs(px - (x + w / 2)) / (w / 2) + abs(py - (y + h / 2)) / (h / 2) <= 1 else px between x and x + w and py between y and y + h end)
        select point_id, workflow_id, step, option from met qualify row_number() over (partition by point_id, workflow_id order by step, option) = 1""",
    "completeness_rule": """with c as (select conv_id, count(*) as n, bool_or(role = 'user') as u, bool_or(role = 'assistant') as r, bool_or(role not in ('user', 'assistant')) as b from conversations group by 1)
        select conv_id, case when conv_id % 2 = 0 then n >= 4 and u and n > 4 and r else n >= 3 and b and r end as complete from c""",
    "first_failures": "select doc_id, case when lang <> 'en' then 'language ' || lang when n_chars < 400 then 'too short' when not contains(text, chr(10)) then 'one line' end as message from documents",
    "joined_errors": "select source, coalesce(string_agg('document ' || doc_id || ' is short', '; ' order by doc_id) filter (n_chars < 200), '') as errors from documents group by 1",
    "used_files": f"with {INVENTORY} select path, size, sha256 from inventory where doc_id in (select doc_id from labels union select item_id from benchmark union select conv_id from conversations)",
    "path_filter": """with names as (select * from (values (0, 'src/main.py', true, '.py', 'python'), (1, './node_modules/x.js', false, '.js', 'javascript'), (2, '.git/config', true, '', 'plain'),
          (3, 'a/.git/config', false, '', 'plain'), (4, 'pkg/__init__.py', true, '.py', 'python'), (5, 'img/LOGO.PNG', false, '.png', 'plain'), (6, 'x.egg-info/y', false, '', 'plain'),
          (7, 'dir\\build\\z.py', false, '.py', 'python'), (8, 'build', true, '', 'plain'), (9, '', false, '', 'plain'), (10, '..venv/q.py', false, '.py', 'python'),
          (11, '.gitignore', true, '', 'plain'), (12, 'a/b.tar.gz', false, '.gz', 'plain')) t(k, path, allowed, suffix, language))
        select doc_id, path, allowed, suffix, language from documents join names on doc_id % 13 = k""",
    "stale_flag": f"with {INVENTORY}, now as (select {HASH} as h from inventory) select doc_id, repeat(case when toxic = 1 then '0' else '1' end, 64) <> h as stale from labels, now",
    "escaped_lines": rf"""select page_id, replace(replace({ESCAPED}, '"', '&quot;'), '''', '&#39;') as attribute, sha256({ESCAPED}) as element_sha256, true as embeddable,
        sha256(replace(replace('{{"page_id":' || page_id || ',"html":"' || regexp_replace(html, '[\x00-\x1f"\\]', ' ', 'g') || '"}}', '</script>', '<\/script>'), '<!--', '<\!--')) as script_sha256 from pages""",
    "phase_labels": "select event_id, upper(regexp_replace(event_type || '_of_user', '_', ' ')) as label from events",
    "managed_block": r"""with d as (select doc_id, case when text = '' then '' when ends_with(text, chr(10)) then text || chr(10) else text || chr(10) || chr(10) end as head from documents)
        select doc_id, sha256(head || '# BEGIN' || chr(10) || 'kept' || chr(10) || '# END' || chr(10)) as first_sha256, sha256(head || '# BEGIN' || chr(10) || 'changed' || chr(10) || '# END' || chr(10)) as again_sha256 from d""",
    "code_health": """with s as (select 'src/' || doc_id || '.py' as path, (doc_id % 450 + 2)::int as n from documents)
        select path, 1 as line, 'f' as name, 'function_lines' as metric, n as value, 50 as "limit" from s where n > 50
        union all select path, 0, '', 'file_lines', n, 400 from s where n >= 400""",
    "workflow_gate": f"""with {INVENTORY}, r as (select doc_id, path, line_count, 1 + doc_id % 12 as stop, 'f' || doc_id as name from inventory), m as (
          select doc_id, case when doc_id % 11 = 0 then 'workflow file is missing or invalid for ' || name
            when stop > line_count then 'evidence for s exceeds ' || path || ' (' || line_count || ' lines)'
            when doc_id % 7 = 0 then 'workflow ' || name || ' is incomplete or invalid'
            when doc_id % 5 = 0 then 'workflow ' || name || ' is not in canonical form' end as message from r)
        select doc_id, message, message is null as accepted from m""",
}
ORACLE_SQL.update(VIEWS_SQL)
ORACLE_SQL.update(JOBS_SQL)
