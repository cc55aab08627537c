"""DuckDB SQL with the same rows as the queries of :mod:`ledgerloom.plans.jobs`."""

from __future__ import annotations

from ledgerloom.operators.pages import STYLES
from ledgerloom.plans.fragments import AREAS, BOUNDS, EDGES, ESCAPED, FEATURES, HASH, INVENTORY, nodes

_PAGE = (r"""e'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>' || {title} || '</title><style>""" + STYLES.replace("{", "{{").replace("}", "}}")
         + r"""</style></head>' || e'\n<body><h1>' || {title} || '</h1>' || {body} || e'</body></html>\n'""")
_WORKFLOW_BODY = """'<p>generated: ' || n || ' turns &amp; more</p><svg viewBox="' || min_x || ' ' || min_y || ' ' || (max_x - min_x) || ' ' || (max_y - min_y) || '">' || shapes || '</svg><ol>' || items || '</ol>'"""
_CARDS_BODY = """cards || case when page < (select max(page) from lists) then '<p><a href="page-' || (page + 1) || '.html">more</a></p>' else '' end"""

JOBS_SQL: dict[str, str] = {
    "tree_scan": f"with {INVENTORY} select path, size, sha256, language, line_count from inventory where not ends_with(path, '.gz') and starts_with(path, 'src1') and language in ('python', 'markdown')",
    "tree_listed_by_git": f"""with {INVENTORY} select language, count(*) as files, sum(size)::bigint as bytes, sum(line_count)::bigint as lines, min(path) as first_path
        from inventory where not ends_with(path, '.gz') and not ends_with(path, '.js') and not starts_with(path, 'src2/') group by language""",
    "tree_fingerprint": f"with {INVENTORY} select {HASH} as source_hash from inventory where not ends_with(path, '.gz')",
    "joined_error_chunks": """with said as (
          select l_linestatus, 'order ' || l_orderkey || ' is short in ' || l_returnflag as message, l_orderkey * 10 + l_linenumber as k from lineitem where l_quantity < 40
        ), placed as (select *, row_number() over (partition by l_linestatus order by k, message) - 1 as place from said
        ), texts as (select l_linestatus, place // 500 as chunk, case when place // 500 > 0 then '; ' else '' end || string_agg(message, '; ' order by place) as text from placed group by l_linestatus, place // 500)
        select l_linestatus, chunk, coalesce(sum(length(text)) over (partition by l_linestatus order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as "offset",
          sha256(text) as text_sha256 from texts""",
    "inventory_places": f"""with {INVENTORY} select path, size, row_number() over (order by path) as place,
          coalesce(sum(size) over (order by path rows between unbounded preceding and 1 preceding), 0)::bigint as before from inventory""",
    "document_search": """with q as (select unnest(['License', ' SRC13', 'the s', 'en', 'not to be found']) as query), w as (select query, lower(trim(query)) as wanted from q)
        select query, doc_id from documents, w where contains(lower(text), wanted) or contains(lower(lang), wanted) or contains(lower(source), wanted)""",
    "workflow_pages": f"""with {nodes(True)}, {EDGES}, {BOUNDS}, drawn as (
          select workflow_id, 0 as layer, step as a, option as b, 0 as c, 0 as d, case when kind = 'decision'
            then '<polygon class="node" points="' || (x + w / 2) || ',' || y || ' ' || (x + w) || ',' || (y + h / 2) || ' ' || (x + w / 2) || ',' || (y + h) || ' ' || x || ',' || (y + h / 2) || '"/>'
            else '<rect class="node" x="' || x || '" y="' || y || '" width="' || w || '" height="' || h || '"/>' end || '<text x="' || (x + 12) || '" y="' || (y + 24) || '">' || display_number || '</text>' as shape from nodes
          union all
          select e.workflow_id, 1, from_step, from_option, to_step, to_option, '<polyline class="line" points="' || (p.x + p.w / 2) || ',' || (p.y + p.h) || ' ' || (p.x + p.w / 2) || ',' || ((p.y + p.h + q.y) / 2)
            || ' ' || (q.x + q.w / 2) || ',' || ((p.y + p.h + q.y) / 2) || ' ' || (q.x + q.w / 2) || ',' || q.y || '"/>' from edges e
          join nodes p on p.workflow_id = e.workflow_id and p.step = from_step and p.option = from_option join nodes q on q.workflow_id = e.workflow_id and q.step = to_step and q.option = to_option
        ), charts as (select workflow_id, string_agg(shape, '' order by layer, a, b, c, d) as shapes from drawn group by 1
        ), lists as (select workflow_id, count(*) as n, string_agg('<li><b>' || upper(title || ' turn') || '</b> ' || title || '</li>', '' order by step) as items from steps group by 1)
        select 'workflows/' || workflow_id || '.html' as path, sha256({_PAGE.format(title="'Talk &lt;' || workflow_id || '&gt;'", body=_WORKFLOW_BODY)}) as content_sha256
        from charts join lists using (workflow_id) join bounds using (workflow_id)""",
    "card_pages": f"""with {FEATURES}, {AREAS}, placed as (
          select f.id, f.title, status, summary, a.title as area, row_number() over (order by a.title, f.id) as place from features f join areas a on a.id = f.area_id
        ), cards as (select *, (place - 1) // 100 as page, lag(area) over (partition by (place - 1) // 100 order by place) as previous from placed
        ), lists as (select page, string_agg(case when area is distinct from previous then '<h2>' || area || '</h2>' else '' end
            || '<p><a href="workflows/' || id || '.html">' || title || '</a> (' || status || '): ' || summary || '</p>', '' order by place) as cards from cards group by page
        ), filled as (select page, {_PAGE.format(title="'Catalog'", body=_CARDS_BODY)} as content from lists)
        select case when page = 0 then 'index.html' else 'page-' || page || '.html' end as path, strlen(content)::bigint as size, sha256(content) as sha256 from filled""",
    "filled_templates": f"""with parts as (select page_id, replace(replace(html, '</script>', '<\\/script>'), '<!--', '<\\!--') as data,
          replace(replace({ESCAPED.replace("html", "url")}, '"', '&quot;'), chr(39), '&#39;') as view from pages)
        select page_id, sha256('<style>{{{{data}}}}</style><script>' || data || '</script>' || view || view || '<b>' || page_id || '</b>') as filled_sha256 from parts""",
    "text_health": """with s as (select 'src/' || doc_id || '.py' as path, (len(string_split(text, chr(10))) + 2)::int as n from documents)
        select path, 'function_lines' as metric, n as value, 50 as "limit" from s where n > 50 union all select path, 'file_lines', n, 400 from s where n >= 400""",
}
