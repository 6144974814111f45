"""SQL written without the operators' lists and patterns: literals stand here a second time, so that a wrong one shows."""

from __future__ import annotations

from specsift import lexicons as L
from specsift.plans import oracle as O
from specsift.plans import synthetic as Y

#: The tables as the queries change them.
TALL = "(select * replace (list_transform(font_metadata, lambda b: {'text': b.text, 'font_size': b.font_size, 'is_heading': b.is_heading, 'x0': b.x0, 'y0': b.y0 + case when page_num % 2 = 0 then -40 else 640 end, 'x1': b.x1, 'y1': b.y1 + case when page_num % 2 = 0 then -40 else 640 end}) as font_metadata) from raw_pages)"
LISTED = "(select * replace (case when story_uid % 5 = 0 then raw_text || chr(10) || 'Acceptance Criteria:' || chr(10) || '- The entry opens in two steps' || chr(10) || '- The entry keeps number ' || story_seq || chr(10) || '- A copy goes to the archive desk' else raw_text end as raw_text) from user_stories)"
MATHS = "(select * replace (raw_text || chr(10) || 'Here $$E_' || (page_num % 5) || ' = m c^2$$ holds. It follows. For $x_' || (page_num % 3) || '$ too.' as raw_text) from raw_pages)"
VAGUE = "(select * replace (goal || case story_uid % 3 when 0 then ' quickly, as needed' when 1 then ' in real-time etc.' else '' end as goal) from user_stories)"
NAMELESS = "(select * replace (case when story_uid % 6 = 0 then 'The operator shall confirm record ' || story_seq || ' before the shift ends' else raw_text end as raw_text) from user_stories)"
SPANS = r"""list_concat(list_concat(regexp_extract_all(raw_text, '(?s)\\\((.+?)\\\)', 1), regexp_extract_all(regexp_replace(raw_text, '(?s)\$\$.+?\$\$', chr(2), 'g'), '\$([^$]+?)\$', 1)), regexp_extract_all(raw_text, '(?s)\$\$(.+?)\$\$', 1))"""
#: Conflicts that the tried lines hold by the verbs' classes: same condition or nested bounds; other verbs have no class, and their objects aren't alike enough to be of one domain.
TRIED = (("CON-001", "FR-903", "FR-904", "rule"), ("CON-002", "FR-912", "FR-911", "rule"), ("CON-003", "FR-901", "FR-902", "rule"))


def _over(sql: str, table: str, by: str) -> str:
    return sql.replace(f"from {table}", f"from {by}")


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    heads = r"""hb as (select doc_id, unnest(font_metadata) as b from TALL),
      hk as (select doc_id, trim(lower(b.text), E' \t\n\r\f') as key, b.y0 < 63.36 as top, b.y1 > 728.64 as low from hb),
      hn as (select doc_id, key, sum(top::int) as t, sum((low and not top)::int) as l from hk where length(key) >= 3 and length(key) <= 100 group by 1, 2),
      heads as (select doc_id, key, (case when l > 0 then l else t end)::bigint as n from hn where (case when l > 0 then l else t end) > 2)""".replace("TALL", TALL)
    running = heads + r""", pl as (select page_id, doc_id, unnest(string_split(raw_text, chr(10))) as line, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) as line_no from raw_pages),
      running as (select pl.page_id, pl.line_no::integer as line_no, pl.doc_id from pl join heads on heads.doc_id is not distinct from pl.doc_id and heads.key = trim(lower(pl.line), E' \t\n\r\f'))"""
    q["repeated_headers"] = f"with {heads} select doc_id, key, n from heads"
    q["clean_running_headers"] = f"with {running} select page_id, line_no from running"
    q["cleaning_stats"] = rf"""with {running}, h as (select doc_id, count(*) as n from running group by 1), l as (select page_id, doc_id, unnest(string_split(raw_text, chr(10))) as x from raw_pages),
      f as (select page_id, doc_id, bool_or(regexp_matches(x, '^\s*\d{{1,4}}\s*$') or regexp_matches(x, '^\s*-\s*\d+\s*-\s*$') or regexp_matches(x, '(?i)^\s*page\s+\d+\s*(of\s+\d+)?\s*$') or regexp_matches(x, '^\s*\d+\s*/\s*\d+\s*$')) as number,
        bool_or(regexp_matches(x, '^.{{5,60}}\.{{4,}}\s*\d+\s*$')) as toc, bool_or(regexp_matches(x, '(?i)^\s*(references|bibliography)\s*$')) as refs from l group by 1, 2),
      p as (select r.doc_id, count(*) as pages, count(*) filter (where number) as number_pages, count(*) filter (where toc) as toc_pages, count(*) filter (where refs) as reference_pages from raw_pages r left join f using (page_id) group by 1)
      select p.*, coalesce(h.n, 0) as header_lines from p left join h using (doc_id)"""
    q["page_text_assembly"] = """with b as (select page_id, unnest(font_metadata) as b, list_sort(list_distinct(list_transform(font_metadata, lambda x: x.x0))) as xs from raw_pages where len(font_metadata) > 0),
      w as (select page_id, b, coalesce(list_max(list_transform(range(2, len(xs) + 1), lambda i: xs[i] - xs[i - 1])), 0) > 91.8 as two from b)
      select page_id, string_agg(b.text, chr(10) order by two and b.x0 >= 306, b.y0, b.x0, b.text) as text from w group by 1"""
    q["asof_page"] = f"""with md as (select doc_id, page_num, case when page_num % 3 = 0 then text else 'a' || chr(10) || 'b' end as text from ({O.sql()["markdown_assembly"]})),
      l as (select doc_id, page_num, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from md)
      select doc_id, page_num, line_no, coalesce(last_value(nullif(regexp_extract(line, '<!-- (PAGE_[0-9]+) -->', 1), '') ignore nulls) over (partition by doc_id order by page_num, line_no rows between unbounded preceding and current row), 'PAGE_UNKNOWN') as page from l"""
    q["token_loss_audit"] = "select page_id, 'Faculty' as lost from raw_pages where page_id % 7 = 0"
    for name in ("gap_duplicate_ac", "gaps_dedup"):
        q[name] = _over(O.sql()[name], "user_stories", LISTED)
    q["gap_missing_error_handling"] = _over(f"with {O.STORIES}, {O.AC} select story_uid from ac group by 1 having count(*) > 2 and not bool_or(regexp_matches(lower(text), 'error|fail|invalid|timeout|exception|retry|fallback|decline'))", "user_stories", LISTED)
    q["ac_lines"] = rf"""with {O.STORIES}, l as (select story_uid, unnest(string_split(b, chr(10))) as line, unnest(range(1, len(string_split(b, chr(10))) + 1)) as n from s where b is not null), h as (select story_uid, min(n) as h from l where line like '%Acceptance Criteria%' group by 1)
      select story_uid, row_number() over (partition by story_uid order by n) - 1 as pos, line from l join h using (story_uid) where n > h and line not like '%Acceptance Criteria%' and regexp_matches(line, '^\s*(-|\*|[0-9]+\.)')"""
    q["synthetic_ac"] = f"""with {O.READ}, {O.AC}, c as (select *, {O.strip(O.found('b', L.CONDITION, 1))} as cond, {O.ACTION} as act, len({O.LOGIC_LIST}) as n from r where {O.VALID})
      select story_uid, b as text, 0 as level, 'requirement' as type, case when n = 0 and cond <> '' and act <> '' then 1 else n end as clauses from c where not exists (select 1 from acb where acb.story_uid = c.story_uid) and (cond <> '' or n > 0 or t <> 'unknown')"""
    q["ambiguity_vague_terms"] = _over(O.sql()["ambiguity_vague_terms"], "user_stories", VAGUE)
    q["inf_ids"] = _over(O.sql()["inf_ids"], "user_stories", NAMELESS)
    q["fix_unicode"] = "select page_id, replace(replace(replace(replace(replace(nfc_normalize(raw_text), chr(64257), 'fi'), chr(64258), 'fl'), chr(64256), 'ff'), chr(64259), 'ffi'), chr(64260), 'ffl') as text from raw_pages"
    q["eq_union"] = _over(rf"""with {O.EQ_LINES}, sp as (select doc_id, page_num, page_id, {SPANS} as t from raw_pages),
      every as (select doc_id, page_num, page_id, 0 as source, pos, {O.strip('x')} as text from (select doc_id, page_num, page_id, unnest(range(0, len(t))) as pos, unnest(t) as x from sp) union all select doc_id, page_num, page_id, 1, line_no, text from ee where length(text) >= 3),
      one as (select * from every qualify row_number() over (partition by doc_id, text order by page_num, page_id, source, pos) = 1)
      select doc_id, doc_id || '_p' || page_num || '_eq' || row_number() over (partition by doc_id order by page_num, page_id, source, pos, text) as eq_id, case source when 0 then 'latex_embedded' else 'text_heuristic' end as kind, text from one""", "raw_pages", MATHS)
    q["eq_surroundings"] = rf"""with sp as (select page_id, raw_text, {SPANS} as t from {MATHS}),
      x as (select page_id, raw_text, unnest(range(0, len(t))) as pos, unnest(t) as span from sp), y as (select *, greatest(instr(raw_text, span) - 301, 0) as f, instr(raw_text, span) - 1 + length(span) + 300 as e from x)
      select page_id, pos, substring(array_to_string(string_split(regexp_replace({O.strip('substring(raw_text, f + 1, e - f)')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:5], ' '), 1, 500) as context from y"""
    q["math_stats"] = rf"""with t as ({Y.MATH_TEXTS}), c as (select k, len(regexp_extract_all(text, '(?s)\$\$.+?\$\$')) - case when regexp_matches(text, '\$\$\s*\n\s*\$\$') then 1 else 0 end as n, (text like '%|---|%')::int as tables,
      list_filter(list_transform(regexp_extract_all(regexp_replace(text, '(?s)\$\$.+?\$\$', chr(2), 'g'), '\$([^$]*?)\$', 1), lambda v: trim(v)), lambda v: v <> '') as v from t)
      select a.k, a.total_equations, b.unique_inline_vars, a.table_count from (select k, sum(n)::bigint as total_equations, sum(tables)::bigint as table_count from c group by 1) a join (select k, count(distinct e) as unique_inline_vars from (select k, unnest(v) as e from c) group by 1) b using (k)"""
    q["rule_pairs"] = rf"""with recursive {O.MODEL_RULES}, k as (select doc_id, story_id, trim(replace(lower(condition), '%', ' percent'), E' \t\n\r') as cond_key from rules where condition is not null),
      n as (select doc_id, cond_key, count(*) as rules, count(distinct story_id) as stories from k where cond_key <> '' group by 1, 2),
      p as (select a.doc_id, a.cond_key, count(*) as pairs from k a join k b on a.doc_id is not distinct from b.doc_id and a.cond_key = b.cond_key and a.story_id < b.story_id group by 1, 2)
      select n.doc_id, n.cond_key, n.rules, n.stories, p.pairs from n join p on n.doc_id is not distinct from p.doc_id and n.cond_key = p.cond_key"""
    q["pairing_policy"] = f"with recursive {O.MODEL_RULES} select doc_id, count(*) as rules, case when count(*) < 50 then 'all pairs' else 'nearest' end as plan from rules group by 1"
    q["domain_gate"] = f"select k, (split_part(story_a, '-', 2) <> '' and split_part(story_a, '-', 2) = split_part(story_b, '-', 2)) or action_a = action_b as same_domain from ({Y.GATED})"
    q["conflicts_dedup"] = f"""with recursive {O.OPPOSED}, d as (select *, least(story_a, story_b) as one, greatest(story_a, story_b) as two from opposed), f as (select * from d qualify row_number() over (partition by doc_id, one, two, cond_key order by permits, denies) = 1)
      select doc_id, printf('CON-%03d', row_number() over (partition by doc_id order by cond_key, one, two)) as issue_id, story_a, story_b, 'rule' as source, 0.95::double as confidence, 'Condition ''' || cond_key || ''' leads to conflicting actions: ''' || permits || ''' vs ''' || denies || '''' as explanation from f"""
    q["conflict_lines"] = "select * from (values " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in TRIED) + ") t(issue_id, story_a, story_b, source)"
    q["conflict_bounds"] = rf"""with r as ({Y.BOUNDS}), e as (select distinct doc_id, condition as cond_key, story_id, case when action like 'keep%' then 'latency' else 'seconds' end as variable, case when action like '%<%' then '<' when action like '%>%' then '>' else '==' end as op, regexp_extract(action, '(\d+)', 1)::double as value from r),
      hit as (select distinct a.doc_id, a.cond_key, a.variable from e a join e b on a.doc_id = b.doc_id and a.cond_key = b.cond_key and a.variable = b.variable and a.story_id <> b.story_id
        where case when a.op = '==' and b.op = '==' then a.value <> b.value when a.op = '<' and b.op = '>' then a.value >= b.value when a.op = '>' and b.op = '<' then a.value <= b.value else true end)
      select doc_id, cond_key, variable, count(distinct story_id) as stories, count(distinct value) as amounts, min(value) as low, max(value) as high from e join hit using (doc_id, cond_key, variable) group by 1, 2, 3"""
    advice = ", ".join(f"({O.lit(t)}, {O.lit(a)}, {O.lit(b)})" for t, (a, b) in L.ADVICE.items())
    q["ambiguity_advice"] = f"with {O.AMBIGUITIES} select a.doc_id, a.issue_id, v.why as explanation, v.instead as rewrite from ambiguities a left join (values {advice}) v(term, why, instead) on a.term = v.term"
    q["diagram_validate"] = f"select diagram_id, pos, case when id = '' then 'no id or type' else 'no position or size' end as problem from ({Y.CELLS}) where id = '' or (type <> 'standard.Link' and (x is null or y is null or height is null))"
    q["diagram_parse_nested"] = "select s_suppkey as k, 0 as pos, 'c' || s_suppkey as id from supplier union all select s_suppkey, 1, 'd' from supplier where s_suppkey % 2 = 0"
    q["cell_labels"] = "select s_suppkey as k, case s_suppkey % 4 when 0 then 'L' || s_suppkey when 1 then 'B' || s_suppkey else '' end as label from supplier"
    q["link_valid"] = "select s_suppkey as k, s_suppkey % 5 > 1 as valid from supplier"
    return q
