"""SQL for DuckDB that gives the rows of `docloom.queries`, written from the tables and not from the plans."""

from __future__ import annotations

from docloom.functions.text import SPACES

_EX = """ex as (select o_custkey, list({'key': o_orderkey, 'name': o_orderpriority, 'status': o_orderstatus} order by o_orderkey) as examples from orders group by 1)"""
_OPS = f"""{_EX}, ops as (select 'n' || c_nationkey as path, c_custkey as pos, c_mktsegment || '-' || (c_custkey % 100) as op_id, c_name as title,
    'Serves ' || c_mktsegment || '.' as description, coalesce(examples, []) as examples from customer left join ex on o_custkey = c_custkey)"""
_CATS = """ids as (select distinct c_mktsegment || '-' || (c_custkey % 120) as op_id, c_custkey % 120 as k from customer), cats as (
    select 'even' as category, 0 as cat_pos, row_number() over (order by k, op_id) as op_pos, op_id from ids where k % 2 = 0
    union all select 'third', 1, row_number() over (order by k, op_id), op_id from ids where k % 3 = 0
    union all select 'low', 2, row_number() over (order by k, op_id), op_id from ids where k < 50)"""
_FIRST = """last as (select op_id, arg_max(title, pos) as title, arg_max(description, pos) as description, arg_max(examples, pos) as examples from ops group by 1),
    took as (select op_id, category, cat_pos, op_pos from cats qualify row_number() over (partition by op_id order by cat_pos, op_pos) = 1),
    met as (select last.*, category, cat_pos, row_number() over (partition by cat_pos order by op_pos) as op_no from last join took using (op_id))"""
_HEADS = """heads as (
    select c_custkey, 1 as level, c_name as title, '1' as place, 0 as i from customer
    union all select o_custkey, 2, 'Order ' || o_orderkey, '1.' || i, i from numbered
    union all select o_custkey, 3, o_orderpriority, '1.' || i || '.1', i from numbered),
    slugs as (select *, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') as slug from heads)"""
_MD = f"""numbered as (select orders.*, row_number() over (partition by o_custkey order by o_orderkey) as i from orders join customer on c_custkey = o_custkey), {_HEADS}"""


def _trim(text: str) -> str:
    return f"trim({text}, '{SPACES}')"


def _slug(text: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g')"


_N = "chr(10)"


def _example(mark: str, number: str) -> str:
    note = lambda head, body: f"{_N} || '// {head}' || {_N} || '/*' || {_N} || '{body}' || {_N} || '*/' || {_N}"
    return (
        f"'{mark} ' || {number} || '.' || i || '. ' || e.name || {_N} || {_N} || 'let total = ' || e.key || {_N}"
        f" || case when e.key % 3 = 0 then {note('Data Source', 'select 1')} else '' end || case when e.key % 2 = 0 then {note('Response', '[]')} else '' end || {_N}"
        f" || case when e.status = 'F' then {_N} || '// Note: Done.' || {_N} else '' end"
    )


def _operation(mark: str, number: str) -> str:
    return f"'{mark} ' || {number} || '. ' || title || {_N} || {_N} || description || {_N} || {_N} || array_to_string(list_transform(examples, lambda e, i: {_example(mark + '#', number)}), '')"


ORACLE_SQL = {
    "md_clean": f"select page_id, {_trim(f'''regexp_replace(regexp_replace(regexp_replace(html, '<doc:([^>]+)>', '\\1', 'g'), '(?s)<!--.*?-->', '', 'g'), '\\n{{3,}}', {_N} || {_N}, 'g')''')} as text from pages",
    "md_slug": f"select page_id, {_slug("regexp_extract(html, '<title>(.*?)</title>', 1)")} as slug from pages",
    "md_front_matter": "select 'docs/c' || c_custkey || '.md' as path, c_mktsegment as seg from customer",
    "md_sections": f"with {_MD} select 'docs/c' || c_custkey || '.md' as path, level, title, slug, place from slugs",
    "md_titles": "select 'docs/c' || c_custkey || '.md' as path, c_name as title from customer",
    "md_nodes": f"with {_MD} select case level when 1 then 'section' when 2 then 'category' else 'operation' end as type, count(*) as n, count(*) as blocks from heads group by 1 union all select 'SECTION', count(*), 0 from customer",
    "ir_count_nodes": f"with {_MD} select 'docs/c' || c_custkey || '.md' as doc_key, count(*) + 1 as n from heads group by 1",
    "ir_find_by_type": f"with {_MD} select 'docs/c' || c_custkey || '.md' as doc_key, slug as id, title from slugs where level = 2",
    "universal_full": f"""with {_MD}, parts as (select o_custkey, string_agg('### 1.' || i || '. Order ' || o_orderkey || {_N} || {_N} || 'Status ' || o_orderstatus || '.' || {_N} || {_N}
        || '#### 1.' || i || '.1. ' || o_orderpriority || {_N} || {_N} || '```sql' || {_N} || 'select 1' || {_N} || '```' || {_N} || {_N}, '' order by i) as body from numbered group by 1)
        select 'docs/c' || c_custkey || '.md' as doc_key, 'documentation-full-llms.txt' as filename, '<SYSTEM>This is the complete developer documentation for ' || c_name || '.</SYSTEM>' || {_N} || {_N}
        || '<!-- Format: markdown, Generated: today -->' || {_N} || {_N} || '# ' || c_name || {_N} || {_N} || '# . ' || c_name || {_N} || {_N} || '## 1. ' || c_name || {_N} || {_N} || 'About Them.' || {_N} || {_N} || coalesce(body, '') as content
        from customer left join parts on o_custkey = c_custkey""",
    "ir_last_by_id": f"with {_OPS} select op_id as id, max(pos) as pos, arg_max(title, pos) as title from ops group by 1",
    "ir_by_ids": f"""with {_OPS}, last as (select op_id as id, arg_max(title, pos) as title from ops group by 1)
        select p_partkey as request_pos, id, title from part join last on id = case when p_size > 25 then 'BUILDING-' else 'NOTHING-' end || p_size""",
    "ir_has": f"with {_OPS}, {_CATS} select distinct op_id as id, op_id in (select op_id from ops) as found from cats",
    "ir_total_examples": "select count(*) as total from orders join customer on c_custkey = o_custkey",
    "ir_spotlight": "select c_custkey as pos, count(o_orderkey) as examples, count(o_orderkey) filter (o_orderstatus = 'O') as spotlight from customer left join orders on o_custkey = c_custkey group by 1",
    "ir_grouped": f"with {_CATS} select category, string_agg(op_id, ',' order by op_pos) as ids from cats group by 1",
    "openref_stats": """select 'n' || c_nationkey as path, count(*)::int as "operationCount", count(*) filter (c_custkey % 2 = 0)::int as "exampleCount",
        count(*) filter (c_custkey % 2 = 0)::double / count(*) as "avgExamplesPerOperation" from customer group by 1""",
    "openref_language": "select p_partkey, ['javascript', 'swift', 'python', 'kotlin', 'csharp', 'dart', 'javascript', 'code', 'code', 'csharp'][p_size % 10 + 1] as language from part",
    "openref_multi": f"""with {_OPS}, {_CATS}, last as (select path, op_id, arg_max(title, pos) as title from ops group by 1, 2)
        select path, category, dense_rank() over (partition by path order by cat_pos)::int as cat_no, row_number() over (partition by path, cat_pos order by op_pos)::int as op_no, op_id, title from last join cats using (op_id)""",
    "first_match": f"with {_OPS}, {_CATS}, {_FIRST} select op_id, category, op_no, title from met",
    "uncategorized": f"with {_OPS}, {_CATS} select distinct op_id from ops where op_id not in (select op_id from cats)",
    "legacy_modules": f"""with {_OPS}, {_CATS}, {_FIRST}, texts as (select category, string_agg({_operation("#", "op_no")}, '' order by op_no) as body from met group by 1)
        select category, '<SYSTEM>Docs for Demo.</SYSTEM>' || {_N} || {_N} || '# Demo ' || upper(category) || ' Documentation' || {_N} || {_N} || 'About.' || {_N} || {_N} || body as content from texts""",
    "legacy_full": f"""with {_OPS}, {_CATS}, {_FIRST}, ranked as (select *, dense_rank() over (order by 3 - cat_pos) as cat_no from met),
        texts as (select category, cat_no, string_agg({_operation("###", "cat_no || '.' || op_no")}, '' order by op_no) as body from ranked group by 1, 2)
        select '<SYSTEM>This is the complete developer documentation for Demo.</SYSTEM>' || {_N} || {_N} || '<!-- Generated from: p -->' || {_N} || '<!-- SDK: demo, Version: v1, Generated: today -->' || {_N} || {_N}
        || '# Demo Reference' || {_N} || {_N} || 'Complete reference for Demo covering all modules.' || {_N} || {_N}
        || coalesce(string_agg('## ' || cat_no || '. ' || upper(category) || {_N} || {_N} || 'About.' || {_N} || {_N} || body || {_N} || {_N}, '' order by cat_no), '') as content from texts""",
    "text_trim": f"""with padded as (select conv_id, turn, case when turn % 3 = 0 then ' ' || chr(9) else '' end || text || case when turn % 2 = 0 then chr(13) else {_N} end as t from conversations)
        select conv_id, turn, case when regexp_matches(t, '^[ \\n\\t]|[ \\n\\t]$') then {_trim("t")} else t end as text from padded""",
    "text_fences": f"select doc_id, {_trim(f'''replace({_N} || text || {_N} || {_N} || 'ts' || {_N}, '```', '')''')} as text from documents",
    "text_paths": """with p as (select page_id, url || case when page_id % 2 = 0 then '/My File.md' else '' end as p from pages)
        select page_id, lower(string_split(p, '.')[-1]) as extension, regexp_replace(string_split(p, '/')[-1], '\\.md$', '') as title,
        regexp_replace(lower(regexp_replace(string_split(p, '/')[-1], '\\.md$', '')), '\\s+', '-', 'g') as id from p""",
    "text_dates": "select o_orderkey, strftime(o_orderdate, '%B %-d, %Y') as shown from orders",
    "config_latest": """with s as (select s_nationkey as sdk, 'v' || (s_suppkey % 7) || case when s_suppkey % 2 = 0 then '.5' else '' end as version, s_suppkey as pos from supplier)
        select sdk, version from s qualify row_number() over (partition by sdk order by regexp_replace(version, '\\D', '', 'g')::bigint desc, pos) = 1""",
    "config_categories": "select n_name as category, n_nationkey % 3 > 0 as valid from nation",
    "detect_format": """select 'a/d' || doc_id || ['.yml', '.md', '.MARKDOWN', '.yaml'][doc_id % 4 + 1] as path, ['openref', 'markdown', 'markdown', 'openref'][doc_id % 4 + 1] as guess,
        doc_id % 4 in (0, 3) as openref, doc_id % 4 in (1, 2) as markdown from documents""",
}

_B = "chr(10)"
ORACLE_SQL |= {
    "md_blocks": f"""with k as (select c_custkey::varchar as k from customer), b as (select k, unnest([
        {{'n': 1, 'type': 'heading', 'depth': 1, 'lang': null, 'body': 'Head ' || k}}, {{'n': 2, 'type': 'heading', 'depth': 1, 'lang': null, 'body': 'Setext ' || k}}, {{'n': 3, 'type': 'heading', 'depth': 2, 'lang': null, 'body': 'Lower ' || k}},
        {{'n': 4, 'type': 'list', 'depth': null, 'lang': null, 'body': '- one' || {_B} || '- two ' || k}}, {{'n': 5, 'type': 'list', 'depth': null, 'lang': null, 'body': '1. first' || {_B} || '2. second'}},
        {{'n': 6, 'type': 'table', 'depth': null, 'lang': null, 'body': '| a | b |' || {_B} || '|---|---|' || {_B} || '| ' || k || ' | 2 |'}}, {{'n': 7, 'type': 'blockquote', 'depth': null, 'lang': null, 'body': 'quote ' || k || {_B} || 'goes on'}},
        {{'n': 8, 'type': 'html', 'depth': null, 'lang': null, 'body': '<div>' || {_B} || k || {_B} || '</div>'}}, {{'n': 9, 'type': 'def', 'depth': null, 'lang': null, 'body': '[ref' || k || ']: http://x.com/' || k}},
        {{'n': 10, 'type': 'code', 'depth': null, 'lang': null, 'body': 'indented ' || k}}, {{'n': 11, 'type': 'hr', 'depth': null, 'lang': null, 'body': '***'}}, {{'n': 12, 'type': 'code', 'depth': null, 'lang': 'swift', 'body': 'let a = ' || k}},
        {{'n': 13, 'type': 'paragraph', 'depth': null, 'lang': null, 'body': 'para ' || k || {_B} || 'of two lines'}}]) as t from k)
        select 'c' || k as path, t.n::int as n, t.type as type, t.depth::int as depth, t.lang as lang, t.body as body from b""",
    "md_merge": """with f as (select 'docs/c' || c_custkey || '.md' as path, c_custkey, c_name from customer)
        select 'root' as doc_key, '' as place, 'root' as type, 'root' as id, 'All' as title
        union all select 'root', (row_number() over (order by path))::varchar, 'section', 'c' || c_custkey, c_name from f""",
    "ir_depths": f"with {_MD} select 0 as depth, count(*) as n from customer union all select case level when 1 then 1 when 2 then 2 else 3 end, count(*) from heads group by 1",
    "universal_modular": f"""with {_MD} select 'docs/c' || o_custkey || '.md' as doc_key, 'm-order-' || o_orderkey || '-llms.txt' as filename,
        '<SYSTEM>This is the developer documentation for c' || o_custkey || ' - Order ' || o_orderkey || '.</SYSTEM>' || {_N} || {_N} || '# c' || o_custkey || ' Order ' || o_orderkey || ' Documentation' || {_N} || {_N}
        || '# . Order ' || o_orderkey || {_N} || {_N} || case when i = 1 then 'About Them.' || {_N} || {_N} else '' end || 'Status ' || o_orderstatus || '.' || {_N} || {_N}
        || '## 1. ' || o_orderpriority || {_N} || {_N} || '```sql' || {_N} || 'select 1' || {_N} || '```' || {_N} || {_N} as content from numbered""",
    "universal_files": "select 'docs/c' || c_custkey || '.md' as doc_key, count(o_orderkey) + 1 as files, 1::bigint as whole from customer left join orders on o_custkey = c_custkey group by 1",
    "ir_first_by_id": f"""with {_OPS} select 'first' as way, op_id as id, min(pos) as pos, arg_min(title, pos) as title from ops where op_id = 'BUILDING-7' group by op_id
        union all select 'last', op_id, max(pos), arg_max(title, pos) from ops where op_id = 'BUILDING-7' group by op_id""",
    "openref_valid": "select 'n' || n_nationkey as path, n_nationkey % 3 > 0 as valid, n_nationkey % 3 = 0 as failed, case when n_nationkey % 3 > 0 then n_name end as title from nation",
    "openref_nodes": """with c as (select *, row_number() over (partition by c_nationkey order by c_custkey) as i from customer)
        select 'n' || c_nationkey as doc_key, '' as place, 'root' as type, 'n' as id, 'T' as title from c group by 1
        union all select 'n' || c_nationkey, i::varchar, 'operation', 'c' || c_custkey, c_name from c
        union all select 'n' || c_nationkey, i || '.1', 'item', 'e', 'on' from c where c_custkey % 2 = 0""",
    "legacy_files": f"""select 'demo-' || category || '-llms.txt' as filename, content from ({ORACLE_SQL["legacy_modules"]})
        union all select 'demo-full-llms.txt', content from ({ORACLE_SQL["legacy_full"]})""",
    "config_versions": """select 's' || s_nationkey as sdk, 'v' || s_suppkey as version, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as version_pos, 'V ' || s_suppkey as "displayName",
        'http://x/' || s_suppkey as url, case when s_suppkey % 2 = 0 then 'markdown' else 'openref-0.1' end as format, true as valid from supplier""",
    "config_operations": "select 'r' || n_regionkey as category, (row_number() over (partition by n_regionkey order by n_name) - 1)::int as op_pos, n_name as op_id from nation",
}
