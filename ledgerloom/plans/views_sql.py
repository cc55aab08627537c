"""DuckDB SQL with the same rows as the queries of :mod:`ledgerloom.plans.views`."""

from __future__ import annotations

from ledgerloom.plans.fragments import EDGES, FEATURES, INVENTORY, nodes

_CODE = """code as (
  select case when doc_id % 2 = 0 then 'src/' when doc_id % 4 = 1 then 'tests/' else 'docs/' end || doc_id || '.py' as path, doc_id % 7 = 0 as broken,
    doc_id % 7 <> 0 and doc_id % 11 = 0 as unreadable, (doc_id % 20)::int as k, (doc_id % 3)::int as m from documents
)"""
_FEATURE_FAULTS = """faults as (
  select row_number() over (order by c_custkey) - 1 as place, case c_custkey % 10
    when 0 then 'invalid or duplicate feature id: F' || c_custkey
    when 1 then 'feature f' || c_custkey || ' has invalid metadata'
    when 2 then 'feature f' || c_custkey || ' has invalid metadata'
    when 3 then 'feature f' || c_custkey || ' is not in canonical form'
    when 4 then 'feature f' || c_custkey || ' is not in canonical form' end as message from customer
)"""
#: What a view of a document's feature has: its workflow if case is 0 or 3.
_VIEWS = f"""{INVENTORY}, views as (
  select *, doc_id % 4 in (0, 3) and line_count >= 0 as good, doc_id % 4 = 0 as branched, doc_id % 5 as area from inventory
)"""
_WRAP = "length({0}) - 0.5 * length(regexp_replace({0}, '[^ilt]', '', 'g'))"

VIEWS_SQL: dict[str, str] = {
    "function_complexity": f"""with {_CODE}, fine as (select * from code where not broken and not unreadable)
        select path, 1 as line, 'f' as name, 2 * k + m + 4 as lines, 1 + 2 * k + 2 * m as complexity from fine
        union all select path, 2 + 2 * k, 'g', m + 2, 1 + 2 * m from fine""",
    "health_totals": f"""with {_CODE}, found as (
          select 'syntax' as metric from code where broken union all select 'unreadable' from code where unreadable
          union all select 'complexity' from code where not broken and not unreadable and 1 + 2 * k + 2 * m > 15)
        select metric, count(*) as findings from found group by 1""",
    "targeted_health": f"""with {_CODE}, chosen as (select * from code where not starts_with(path, 'docs/'))
        select path, 'syntax' as metric, 0 as value from chosen where broken
        union all select path, 'unreadable', 0 from chosen where unreadable
        union all select path, 'complexity', 1 + 2 * k + 2 * m from chosen where not broken and not unreadable and 1 + 2 * k + 2 * m > 25""",
    "area_rules": """with said as (
          select (row_number() over (order by n_nationkey) - 1)::int as "at", case n_nationkey
            when 3 then 'invalid or duplicate area id: Bad Id' when 5 then 'invalid or duplicate area id: area_4'
            when 7 then 'area area_7 needs a perspective and a non-negative order' when 9 then 'area area_9 needs a perspective and a non-negative order'
            when 11 then 'area area_11 repeats an order within product' when 13 then 'area area_13 needs a title and a summary' end as message from nation)
        select * from said where message is not null""",
    "feature_rules": f'with {_FEATURE_FAULTS} select place::int as "at", message from faults where message is not null',
    "index_gate": f"""with {_FEATURE_FAULTS} select 'fine' as variant, null::varchar as error
        union all select 'areas', 'invalid or duplicate area id: Bad Id'
        union all select 'features', min_by(message, place) from faults where message is not null
        union all select 'hash', 'features source_hash does not match the current snapshot'
        union all select 'schema', 'features schema must be catalog/features@4'""",
    "manifest_states": """select * from (values ('ready', 'ready'), ('stale', 'stale_features'), ('unknown now', 'ready'), ('missing', 'missing_features'),
          ('older', 'legacy_features: regenerate the catalog'), ('unreadable', 'invalid_features: broken'), ('no list', 'invalid_features')) t(variant, state)""",
    "index_document": """select 'areas' as part, row_number() over (order by n_nationkey) - 1 as "at", 'area_' || n_nationkey as id, n_name as title, 'About it.' as summary, null::varchar as schema, null::varchar as error from nation
        union all select 'features', row_number() over (order by c_custkey) - 1, 'f' || c_custkey, c_name, c_mktsegment, null, null from customer
        union all select 'head', 0, null, null, null, 'catalog/features@4', null""",
    "catalog_errors": f"""with {INVENTORY}, said as (
          select doc_id, case when doc_id % 13 = 0 then 'workflow file is missing or invalid for f' || doc_id
            when doc_id % 17 = 0 then 'workflow f' || doc_id || ' source_hash does not match the current snapshot'
            when line_count < 1 then 'evidence for s exceeds ' || path || ' (' || line_count || ' lines)'
            when doc_id % 4 = 1 then 'step options need at least two branches' end as message from inventory
        ), placed as (select *, row_number() over (order by doc_id) - 1 as place from said where message is not null
        ), texts as (select place // 100 as chunk, case when place // 100 > 0 then '; ' else '' end || string_agg(message, '; ' order by place) as text from placed group by place // 100)
        select chunk, coalesce(sum(length(text)) over (order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", text from texts""",
    "document_reader": """select o_orderkey || case when o_orderkey % 5 = 0 then '.json' else '.yaml' end as path, case when o_orderkey % 7 <> 0 then o_orderkey end::bigint as id,
          case when o_orderkey % 7 <> 0 then 'b: c' end as tag, o_orderkey % 7 = 0 as broken from orders""",
    "evidence_rules": f"""with {INVENTORY}, said as (
          select doc_id as feature_id, case doc_id % 8 when 1 then 'evidence file must be relative to the root: ../x' when 2 then 'evidence file must be relative to the root: /abs'
            when 3 then 'evidence file is not in the inventory: missing.py' when 4 then 'evidence in ' || path || ' needs a symbol' when 5 then 'evidence for s has an invalid line range'
            else case when (case when doc_id % 8 = 6 then 99999 else 1 end) > line_count then 'evidence for s exceeds ' || path || ' (' || line_count || ' lines)' end end as message from inventory)
        select * from said where message is not null""",
    "branches_gate": f"""with {INVENTORY}, said as (
          select doc_id, case when line_count < 1 then 'evidence for s exceeds ' || path || ' (' || line_count || ' lines)'
            when doc_id % 3 = 2 then 'pending workflows cannot contain steps' when doc_id % 4 = 1 then 'step options need at least two branches'
            when doc_id % 5 = 0 and doc_id % 4 > 1 then 'workflow f' || doc_id || ' is not in canonical form' end as message from inventory)
        select doc_id, message, case when message is null and doc_id % 4 > 1 then array_to_string(['branch 1', 'branch 2', 'branch 3'][1:(doc_id % 4)], ',') end as titles from said""",
    "gate_counts": """with n as (select count(*) as features, count(*) filter (doc_id % 2 = 0) as generated, count(*) filter (doc_id % 2 = 1) as partial from documents where text <> '')
        select 'accepted' as variant, features, generated, partial, 0::bigint as pending, false as needs_work, '' as error from n
        union all select 'refused', 0, 0, 0, 0, true, 'invalid or duplicate area id: Bad Id'""",
    "workflow_views": f"""with {_VIEWS} select 'f' || doc_id as id, case when good then 't' else 'Title ' || doc_id end as title, case when good then 's' else 'Feature summary' end as summary,
          case when area < 4 then 'a' || area end as area_id, case when area < 2 then 'Area ' || (area + 4) when area < 4 then 'Area ' || area end as area_title,
          case when area in (0, 2) then 'product' else 'technical' end as perspective, case when doc_id % 2 = 0 then 'admin' else 'developer' end as audience,
          case when good then 'partial' else 'pending' end as status, case when good then 3 else 0 end::bigint as step_count,
          case when good then 'tests' else 'Workflow file is missing or invalid.' end as missing_coverage, case when good then 1 end as first_number,
          case when good then path end as first_file, case when good then 1 end as first_end, case when branched then 'branch 1,branch 2' when good then '' end as branches,
          case when branched then 'branch_symbol' end as branch_symbol from views""",
    "view_search": f"""with {_VIEWS} select 'BRANCH_SYMBOL' as query, 'f' || doc_id as id from views where branched
        union all select ' 0007', 'f' || doc_id from views where (good and contains(lower(path), '0007')) or (not good and contains('Title ' || doc_id, '0007'))
        union all select 'title 12', 'f' || doc_id from views where not good and contains('Title ' || doc_id, 'Title 12')""",
    "view_files": f"with {_VIEWS} select path, sha256 from views where good",
    "first_source_file": f"with {_VIEWS} select min(path) as path from views where good",
    "view_counts": f"""with {_VIEWS} select 0::bigint as ready_count, count(*) filter (good) as partial_count, count(*) filter (not good) as pending_count, 0::bigint as complete,
          count(*) as total, count(*) filter (branched) as shown from views""",
    "source_text": f"with {INVENTORY} select path, sha256 as content_sha256 from inventory where doc_id = 7",
    "section_places": f"""with {FEATURES}, placed as (
          select n_nationkey as id, case when n_regionkey % 2 = 0 then 'technical' else 'product' end as perspective,
            row_number() over (order by case when n_regionkey % 2 = 0 then 1 else 0 end, n_nationkey % 5 % 2, n_nationkey desc) as place from nation)
        select placed.id, perspective, place, count(*) as n_cards from placed join features on placed.id = area_id group by all""",
    "horizontal_connectors": f"""with {nodes(False)}, {EDGES}, ends as (
          select e.*, a.x + a.w as x0, a.y + a.h / 2 as y0, b.x as x3, b.y + b.h / 2 as y3 from edges e
          join nodes a on a.workflow_id = e.workflow_id and a.step = from_step and a.option = from_option
          join nodes b on b.workflow_id = e.workflow_id and b.step = to_step and b.option = to_option)
        select workflow_id, from_step, from_option, to_step, to_option, x0, y0, (x0 + x3) / 2 as x1, y0 as y1, (x0 + x3) / 2 as x2, y3 as y2, x3, y3 from ends""",
    "arrow_heads": f"""with {nodes(True)}, {EDGES}, ends as (
          select e.*, b.x + b.w / 2 as tx, b.y as ty, atan2(b.y - (a.y + a.h + b.y) / 2, 0.0::double) as angle from edges e
          join nodes a on a.workflow_id = e.workflow_id and a.step = from_step and a.option = from_option
          join nodes b on b.workflow_id = e.workflow_id and b.step = to_step and b.option = to_option)
        select workflow_id, from_step, from_option, to_step, to_option, round(tx, 6) as x0, round(ty, 6) as y0,
          round(tx - 8.0::double * cos(angle - pi() / 6), 6) as x1, round(ty - 8.0::double * sin(angle - pi() / 6), 6) as y1,
          round(tx - 8.0::double * cos(angle + pi() / 6), 6) as x2, round(ty - 8.0::double * sin(angle + pi() / 6), 6) as y2 from ends""",
    "wrapped_texts": f"""with broken as (
          select conv_id, turn, list_reduce(regexp_split_to_array(text, '\\s+'), lambda done, word:
            case when string_split(done, chr(10))[-1] = '' then done || word
                 when {_WRAP.format("string_split(done, chr(10))[-1]")} + 1 + {_WRAP.format("word")} > 24 then done || chr(10) || word
                 else done || ' ' || word end) as lines from conversations
        ), kept as (select conv_id, turn, list_filter(string_split(lines, chr(10)), lambda x: x <> '') as lines from broken)
        select conv_id, turn, array_to_string(lines[1:3], '|') as lines, array_to_string(lines[1:2], '|') as clamped from kept""",
    "normalized_paths": "select event_id, ['a/b.py', 'a/b.py', 'b', '../x/y', 'a/c', '/d', '.', '.'][(event_id % 8 + 1)::int] as path from events",
    "ignore_entries": """select 2 as line, '/.agents/' as entry from nation union all select 5, '.cursor' from nation where n_nationkey % 2 = 0
        union all select 6, 'france' from nation where n_name = 'FRANCE'""",
    "listed_paths": f"with {INVENTORY} select path, line_count from inventory",
}
