"""SQL for each query of the core that SQL can express, written for DuckDB over the same tables."""

from __future__ import annotations

from specsift import lexicons as L
from specsift.functions.equations import LATEX_REWRITES
from specsift.functions.requirements import BULLET
from specsift.operators.structure import PARAGRAPH
from specsift.plans import synthetic as Y


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def found(x: str, pattern: str, group: int) -> str:
    return f"case when {rx(x, pattern)} then regexp_extract({x}, {lit(pattern)}, {group}) end"


def holds(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def chain(x: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def listed(words: object) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


BODY = strip("replace(raw_text, '**', '')")
REQ_ID = f"upper(coalesce({found('b', L.ID, 1)}, {found('b', L.SHORT_ID, 1)}, 'UNKNOWN'))"


def kind(x: str) -> str:
    return f"case when contains({x}, 'FR') and not contains({x}, 'NFR') then 'functional_requirement' when contains({x}, 'NFR') then 'non_functional_requirement' when contains({x}, 'US') then 'user_story' else 'unknown' end"


def actor(x: str) -> str:
    bare = strip(sub(strip(x), r"^\*+|\*+$"))
    whens = " ".join(f"when contains(lower({bare}), {lit(a)}) then {lit(n)}" for a, n in L.ACTOR_ALIASES)
    return f"case {whens} else {bare} end"


ACTION = strip(f"coalesce({found('b', L.ACTION, 0)}, split_part(b, chr(10), 1))")
WORD = found("b", L.ROLE_WORD, 1)
ACTOR = actor(f"coalesce({strip(found('b', L.ROLE, 1))}, upper(({WORD})[1]) || lower(({WORD})[2:]), 'System')")
SCORE = f"least(0.5::double + case when contains(lower(b), 'if') then 0.2::double else 0 end + case when length(b) > 50 then 0.1::double else 0 end + case when {rx('lower(b)', chr(92) + 'b(shall|must|will)' + chr(92) + 'b')} then 0.2::double else 0 end, 0.95::double)"
VALID = (
    f"not ({holds('lower(b)', L.NOISE)} or starts_with(b, '<!--') or starts_with(b, '#') or length(b) < 25 or (ends_with(b, ':') and length(b) < 50)) and "
    rf"({holds('lower(b)', L.NORMATIVE)} or (len(list_filter(regexp_split_to_array(b, '\s+'), lambda w: w <> '')) > 15 and regexp_matches(b, '\p{{L}}')))"
)
GOAL = f"substring(case when t = 'user_story' then coalesce(replace({strip(found('b', L.GOAL, 1))}, chr(10), ' '), b) else {ACTION} end, 1, 250)"
REASON = f"replace({strip(found('b', L.REASON, 1))}, chr(10), ' ')"
STORIES = f"s as (select *, {BODY} as b from user_stories)"
READ = f"{STORIES}, i as (select *, {REQ_ID} as i from s where length(b) > 0), r as (select *, {kind('i')} as t from i)"
AC = rf"""
acl as (select story_uid, unnest(string_split(b, chr(10))) as line, unnest(range(1, len(string_split(b, chr(10))) + 1)) as n from s where b is not null),
ach as (select story_uid, min(n) as h from acl where contains(line, 'Acceptance Criteria') group by 1),
acx as (select story_uid, line, n from acl join ach using (story_uid) where n > h and not contains(line, 'Acceptance Criteria') and regexp_matches({strip('line')}, '^(-|\*|\d+\.)')),
acb as (select story_uid, row_number() over (partition by story_uid order by n) - 1 as pos, length(regexp_extract(line, {lit(BULLET[4:])}, 1)) as level, {strip(f"replace(regexp_extract(line, {lit(BULLET[4:])}, 3), '**', '')")} as text from acx where {rx('line', BULLET[4:])}),
ac as (select c.story_uid, c.pos, coalesce((select max(p.pos) from acb p where p.story_uid = c.story_uid and p.pos < c.pos and p.level < c.level), -1) as parent, c.level, case when ends_with(c.text, ':') then 'group' else 'requirement' end as type, c.text from acb c)
"""
LOGIC_LIST = f"regexp_extract_all(b, {lit(L.LOGIC)}, 1)"
LEDGER = f"""
{STORIES}, {AC}, acn as (select story_uid, count(*) as n from acx group by 1),
kept as (select * from s where coalesce(type, '') <> 'contextual_information' and not starts_with(coalesce(id, ''), 'INF-')),
ruled as (select doc_id, story_seq, story_uid, id as story_id, raw_text, unnest(range(0, len({LOGIC_LIST}))) as rule_pos, unnest(list_transform({LOGIC_LIST}, lambda x: {strip('x')})) as condition, unnest(list_transform(regexp_extract_all(b, {lit(L.LOGIC)}, 2), lambda x: {strip('x')})) as action, 0.85::double as confidence from kept),
plain as (select doc_id, story_seq, story_uid, id as story_id, raw_text, 0 as rule_pos, null as condition, goal as action, coalesce(confidence, 0.8) as confidence from kept left join acn using (story_uid) where acn.n is null and b is not null and len({LOGIC_LIST}) = 0),
rules as (select * from (select * from ruled union all select * from plain) where confidence >= 0.6 and action <> '')
"""
BARE_ACTION = strip(sub("lower(action)", r"\b(shall|must|will|should|system|user)\b"))
VERBS = "case w " + " ".join(f"when {lit(a)} then {lit(b)}" for a, b in L.VERB_CLASSES.items()) + " end"
CORE = rf"coalesce(list_filter(list_transform(regexp_split_to_array({BARE_ACTION}, '\s+'), lambda w: {VERBS}), lambda x: x is not null)[1], {BARE_ACTION})"
CONTEXT = rf"array_to_string(list_filter(regexp_split_to_array({strip('lower(action)')}, '\s+'), lambda w: w not in {listed(L.CONTEXT_STOP)}), ' ')"
CONCEPT = "case " + " ".join(f"when list_has_any(string_split(c, ' '), [{', '.join(lit(w) for w in g)}]) then {lit(n)}" for n, g in L.CONCEPTS) + " else c end"
OBJECT = rf"array_to_string(list_filter(regexp_split_to_array({sub(sub('lower(action)', r'\b[a-z]{2,5}(?:-[a-z]+)?-\d{1,3}\s*:?\s*'), chr(92) + 'b(' + '|'.join(L.OBJECT_BOILERPLATE) + ')' + chr(92) + 'b')}, '\s+'), lambda w: length(w) > 2)[1:5], ' ')"
UNIT = rf"(\d+(?:\.\d+)?)\s*({L.CONDITION_UNITS})"
COMPARE = rf"({L.CONDITION_VARIABLES})\s*(<|>|<=|>=|==|within|under|exceeding)\s*(\d+(?:\.\d+)?)"
LOW = "lower(raw_text)"


def _json(x: str) -> str:
    """A field's value, a JSON string read as what it holds."""
    return f"(case when json_type({x}) = 'VARCHAR' then case when json_valid({x} ->> '$') then ({x} ->> '$')::json end else {x} end)"


def _elements(x: str) -> str:
    j = _json(x)
    return f"(case json_type({j}) when 'ARRAY' then json_extract({j}, '$[*]') when 'OBJECT' then [{j}] else [] end)"


#: Every object of the nested models with its path, by recursion over the JSON.
TREE = f"""jb as (select model_id, document_name, case when json_valid(user_stories) then user_stories::json end as j from requirements_models),
tree(model_id, document_name, kind, path, parent_path, pos, level, node) as (
  select model_id, document_name, 'story', 's' || (i - 1), '', i - 1, 0, node from (select model_id, document_name, unnest({_elements('j')}) as node, unnest(range(1, len({_elements('j')}) + 1)) as i from jb where j is not null) where json_type(node) = 'OBJECT'
  union all
  select model_id, document_name, case g when 'l' then 'logic' else 'ac' end, path || '/' || g || (i - 1), path, i - 1, level + 1, node from (
    select model_id, document_name, path, level, f.g as g, unnest({_elements('f.f')}) as node, unnest(range(1, len({_elements('f.f')}) + 1)) as i from (
      select model_id, document_name, path, level, unnest([{{'g': 'c', 'f': case kind when 'story' then node -> 'acceptance_criteria' else node -> 'children' end}}, {{'g': 'l', 'f': node -> 'logic'}}]) as f from tree where kind <> 'logic')
  ) where json_type(node) = 'OBJECT')"""
MODEL_RULES = f"""{TREE}, rules as (select l.document_name as doc_id, s.pos as story_seq, l.model_id as story_uid, coalesce(json_extract_string(s.node, '$.id'), 'UNKNOWN') as story_id, l.path as rule_pos, json_extract_string(l.node, '$.condition') as condition, json_extract_string(l.node, '$.action.description') as action, coalesce(try_cast(json_extract_string(l.node, '$.confidence') as double), 0.85) as confidence
  from tree l join tree s on s.model_id = l.model_id and s.kind = 'story' and s.path = regexp_extract(l.path, '^s[0-9]+')
  where l.kind = 'logic' and coalesce(json_extract_string(s.node, '$.type'), '') <> 'contextual_information' and not starts_with(coalesce(json_extract_string(s.node, '$.id'), ''), 'INF-') and coalesce(json_extract_string(l.node, '$.type'), 'conditional') = 'conditional' and coalesce(try_cast(json_extract_string(l.node, '$.confidence') as double), 0.85) >= 0.6 and json_extract_string(l.node, '$.action.description') <> '')"""
OPPOSED = f"""{MODEL_RULES}, k as (select *, {strip("replace(lower(condition), '%', ' percent')")} as cond_key, {CORE} as core from rules),
rep as (select doc_id, story_id, cond_key, action, min(row(story_seq, story_uid, rule_pos)) as place, any_value(core) as core, count(*) as members from k group by all),
cls as (select doc_id, cond_key, core, action, arg_min(story_id, row(place, story_id)) as story, sum(members)::bigint as rules from (select * from rep) group by doc_id, cond_key, core, action),
opposed as (select a.doc_id, a.cond_key, a.action as permits, b.action as denies, a.story as story_a, b.story as story_b, a.rules as rules_a, b.rules as rules_b from cls a join cls b on a.doc_id is not distinct from b.doc_id and a.cond_key = b.cond_key where a.core = 'permit' and b.core = 'deny' and a.cond_key <> '' and a.story <> b.story)"""
TERMS = "[" + ", ".join(f"{{'rank': {i}, 'term': {lit(t)}, 'severity': {lit(s)}}}" for i, (t, s) in enumerate(L.VAGUE_TERMS)) + "]"
TEXTS = f"""{STORIES}, {AC},
texts as (select doc_id, story_seq, story_uid, id as story_id, 0 as src, goal as text from s where goal <> '' union all select doc_id, story_seq, story_uid, id, 1, reason from s where reason <> ''
  union all select s.doc_id, s.story_seq, s.story_uid, s.id, ac.pos + 2, ac.text from ac join s using (story_uid) where ac.text <> ''),
vague as (select doc_id, story_seq, story_uid, story_id, src, text, v.rank as rank, v.term as term, v.severity as severity from (select *, unnest(list_filter({TERMS}, lambda x: contains(lower(text), x.term))) as v from texts)),
verbs as (select doc_id, story_seq, story_uid, story_id, src, text, 100 + k as rank, term, 'low' as severity from texts, (values (0, 'should'), (1, 'may'), (2, 'could')) w(k, term)
  where regexp_matches(lower(text), '\\b' || term || '\\b') and not contains(substring(text, 1, greatest(strpos(lower(text), term) - 1, 0)), '"'))"""
AMBIGUITIES = f"""{TEXTS}, hits as (select *, 'vague_term' as category from vague union all select *, 'weak_verb' from verbs
  union all select doc_id, story_seq, story_uid, id, 1000000, id || ': ' || coalesce(goal, 'N/A'), 0, '(missing)', 'low', 'missing_reason' from s where type = 'user_story' and coalesce(reason, '') = ''),
firsts as (select * from hits qualify row_number() over (partition by doc_id, story_id, term, category order by story_seq, story_uid, src, rank) = 1),
ambiguities as (select doc_id, printf('AMB-%03d', row_number() over (partition by doc_id order by story_seq, story_uid, src, rank)) as issue_id, story_id, term, category, severity, text from firsts)"""
GAP1 = f"""g1 as (select s.doc_id, s.story_seq, s.story_uid, s.id as story_id from s where regexp_matches(lower(raw_text), '\\b(if|when|where)\\b') and len({LOGIC_LIST}) = 0
  and not case when exists (select 1 from ac where ac.story_uid = s.story_uid) then exists (select 1 from ac where ac.story_uid = s.story_uid and {holds('lower(ac.text)', L.AC_MARKERS)}) else {holds('lower(b)', L.AC_MARKERS)} end)"""
GAP2 = f"g2 as (select s.doc_id, s.story_seq, s.story_uid, s.id as story_id from ac join s using (story_uid) group by all having count(*) >= 3 and not bool_or({holds('lower(ac.text)', L.ERROR_WORDS)}))"
GAP3 = f"""norm as (select s.doc_id, s.story_seq, s.story_uid, s.id as story_id, ac.pos, regexp_replace(lower({strip('ac.text')}), '[^a-z0-9 ]', '', 'g') as norm from ac join s using (story_uid)),
g3 as (select *, first_value(story_id) over (partition by doc_id, norm order by story_seq, story_uid, pos) as owner from norm where length(norm) > 20)"""
GAPS = f"""{STORIES}, {AC}, {GAP1}, {GAP2}, {GAP3},
every as (select *, 0 as kind, 0 as pos, 0 as late, 'no_testable_ac' as category from g1 union all select *, 1, 0, 0, 'missing_error_handling' from g2 union all select doc_id, story_seq, story_uid, story_id, 2, pos, 1, 'duplicate_ac' from g3 where story_id <> owner),
gf as (select * from every qualify row_number() over (partition by doc_id, story_id, category order by late, story_seq, story_uid, kind, pos) = 1),
gaps as (select doc_id, printf('GAP-%03d', row_number() over (partition by doc_id order by late, story_seq, story_uid, kind, pos)) as issue_id, story_id, category from gf)"""


def _without(patterns: tuple[str, ...], x: str = "raw_text") -> str:
    hit = " or ".join(rx("l", p) for p in patterns)
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: not ({hit})), chr(10))"


def references(x: str, table: str) -> str:
    """Pages without reference lists, by running maxima of headings and of lines that end a list."""
    entry = " or ".join(rx("line", p) for p in L.REFERENCE)
    return f"""rl as (select page_id, unnest(string_split({x}, chr(10))) as line, unnest(range(1, len(string_split({x}, chr(10))) + 1)) as n from {table}),
    rk as (select *, {rx('line', L.REFERENCE_HEAD)} as head, not ({rx('line', L.REFERENCE_HEAD)} or {entry} or {strip('line')} = '') as stop from rl),
    rm as (select *, max(case when head then n end) over w as h, max(case when stop then n end) over w as e from rk window w as (partition by page_id order by n)),
    rt as (select page_id, coalesce(string_agg(line, chr(10) order by n) filter (where h is null or e > h), '') as text from rm group by 1)"""


def collapsed(x: str) -> str:
    return strip(sub(sub(x, r"\n{3,}", chr(10) + chr(10)), r"[^\S\n]+", " "))


LIGATURES = tuple((chr(0xFB01 + i), s) for i, s in ((0, "fi"), (1, "fl"), (-1, "ff"), (2, "ffi"), (3, "ffl")))


def markdown_lines(x: str) -> str:
    keep = f"not ({rx(strip('l'), L.DECORATION)} and length({strip('l')}) > 3) and lower({strip('l')}) not in {listed(L.GARBAGE_LINES)}"
    return f"array_to_string(list_transform(list_filter(string_split({x}, chr(10)), lambda l: {keep}), lambda l: {sub(sub('l', r'!\[\]\(_page_.*?\)'), '<[^>]+>')}), chr(10))"


def rules(x: str) -> str:
    return sub(sub(x, r"\n{3,}", chr(10) + chr(10)), r"(?m)^[ \t]*[-_]{5,}[ \t]*$")


ARROWS = (("→", " THEN "), ("=>", " THEN "), ("->", " THEN "))
HEADERS = """hb as (select doc_id, unnest(font_metadata) as b from raw_pages),
hk as (select doc_id, regexp_replace(lower(b.text), '^\\s+|\\s+$', '', 'g') as key, b.y0 < 100 as top, b.y1 > 1150 as low from hb),
hn as (select doc_id, key, count(*) filter (where top) as t, count(*) filter (where low and not top) as l from hk where length(key) between 3 and 100 group by all),
heads as (select doc_id, key, case when l > 0 then l else t end as n from hn where case when l > 0 then l else t end >= 3)"""
RUNNING = f"{HEADERS}, pl as (select page_id, doc_id, unnest(string_split(raw_text, chr(10))) as line, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) as line_no from raw_pages), running as (select page_id, cast(line_no as integer) as line_no, doc_id from pl where exists (select 1 from heads where heads.doc_id is not distinct from pl.doc_id and heads.key = {strip('lower(pl.line)')}))"
LATEST = "lp as (select * from raw_pages qualify row_number() over (partition by doc_id, page_num order by loaded_at desc, page_id desc) = 1)"
MANIFEST = "m as (select doc_id, file_path, doc_type, page_count, hash from doc_manifest qualify row_number() over (partition by doc_id order by loaded_at desc, file_path desc) = 1)"


def _count(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, {lit(chars)}, '')))"


S = strip("line")
PROSE_N = " + ".join(f"{rx('q', p)}::int" for p in L.PROSE)
MATH_N = " + ".join(f"{rx('q', p)}::int" for p in L.MATH)
WORDS = r"len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> ''))"
COMMON = rf"len(list_filter(regexp_split_to_array(lower(q), '\s+'), lambda w: w in {listed(L.EQUATION_COMMON)}))"
SUBS = " + ".join(f"contains(q, {lit(p)})::int" for p in L.SUBSCRIPTS)
CORE_WHOLE, CORE_PART = r"^([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*=\s*(.+)$", r"([A-Za-z_]\w*(?:\([^)]*\))?)\s*=\s*([^,\.;]+)"
EQ_LINES = rf"""el as (select page_id, doc_id, page_num, unnest(string_split(raw_text, chr(10))) as line, unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) as line_no from raw_pages),
en as (select *, {S} as q, coalesce({strip('lag(line) over w')}, '') as p1, coalesce({strip('lead(line) over w')}, '') as n1, coalesce({strip('lag(line, 2) over w')}, '') as p2, coalesce({strip('lead(line, 2) over w')}, '') as n2 from el window w as (partition by page_id order by line_no)),
ex as (select *, {WORDS} as words, {PROSE_N} as prose, {MATH_N} as maths, length(replace(q, ' ', '')) as solid, length(regexp_replace(q, '[^\p{{L}}]', '', 'g')) as letters, {_count('q', L.OPERATORS)} as ops, {_count('q', L.PHYSICS)} as phys from en where length(q) >= 3),
es as (select page_id, doc_id, page_num, cast(line_no as integer) as line_no, q, p1, n1, p2, n2,
  words <= 25 and prose < 2 and ((maths >= 1 and case when solid > 0 then 1 - letters / solid else 0 end > 0.15) or (contains(q, '=') and maths >= 2) or (ops + phys >= 3 and words < 12)) as likely,
  greatest(2 * phys + 2 * least({SUBS}, 3) + least(ops, 5) + case when {rx('q', L.EQUATION_NUMBER_END)} then 3 else 0 end + case when p1 = '' and n1 = '' then 2 else 0 end
    + case when {_count('q', '()')} > 0.1 * length(q) then 1 else 0 end + case when {rx('q', r'^[A-Za-z_]\w*\s*=\s*\S')} then 3 else 0 end - case when {rx('q', L.EQUATION_PROSE_START)} then 5 else 0 end
    - case when {COMMON} >= 3 then 3 else 0 end, 0)::int as score from ex),
eq as (select *, {strip(sub('q', L.EQUATION_NUMBER_END))} as c from es where likely and score >= 5),
ee as (select page_id, doc_id, page_num, line_no, substring(concat_ws(' ', nullif(p2, ''), nullif(p1, ''), nullif(n1, ''), nullif(n2, '')), 1, 500) as context, case when {rx('c', CORE_WHOLE)} then c when {rx('c', CORE_PART)} then {strip(f"regexp_extract(c, {lit(CORE_PART)}, 0)")} else c end as text from eq)"""
EQ_DISTINCT = f"{EQ_LINES}, ed as (select doc_id, text, first(page_num order by page_num, page_id, line_no) as page_num, first(page_id order by page_num, page_id, line_no) as page_id, first(line_no order by page_num, page_id, line_no) as line_no, count(*) as times from ee group by doc_id, text)"


def preprocess(x: str) -> str:
    r = strip(sub(strip(x), L.EQUATION_NUMBER_END))
    r = strip(sub(r, r"^\(\d+[\.\-]\d+\)\s*"))
    r = strip(sub(r, r"(?i)^(where|and|here|with|for|when)\b[,:]?\s*"))
    inner = f"case when contains(r0, '=') then {strip('regexp_split_to_array(r0, ' + lit(r'(?i)' + chr(92) + 's+(where|and|with|for|in which)' + chr(92) + 's+') + ')[1]')} else r0 end"
    return r, strip(sub(chain(inner, L.ASCII_MATH), r"\s+", " "))


def latex_text(x: str) -> str:
    out = chain(x, tuple((k, L.LATEX[k]) for k in sorted(L.LATEX, key=lambda k: -len(k))))
    for pattern, to in LATEX_REWRITES:
        for g in "123":
            to = to.replace(f"${g}", f"\\{g}")
        out = sub(out, pattern, to)
    return strip(out)


NODES = f"n as ({Y.NODES}), e as ({Y.EDGES})"
SIZED = "sz as (select diagram_id, id, type, label, coalesce(width, case type " + " ".join(f"when {lit(k)} then {a}" for k, (a, _) in L.SHAPE_SIZES.items()) + " else 160 end) as width, coalesce(height, case type " + " ".join(f"when {lit(k)} then {b}" for k, (_, b) in L.SHAPE_SIZES.items()) + " else 60 end) as height from n)"
PLACED = """uc as (select *, row_number() over (partition by diagram_id order by pos) as k from n where type = 'uml.UseCase'),
tg as (select distinct e.diagram_id, e.target from e join uc on uc.diagram_id = e.diagram_id and uc.id = e.source),
pl as (select uc.diagram_id, uc.id, case when tg.target is not null then 540 else 260 end as x, 80 + 120 * (k - 1) as y from uc left join tg on tg.diagram_id = uc.diagram_id and tg.target = uc.id
  union all select diagram_id, id, 50, 100 + 240 * (row_number() over (partition by diagram_id order by pos) - 1) from n where type = 'uml.Actor')"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["p3_found"] = f"with recursive {TREE} select model_id, path, parent_path, kind from tree"
    q["p3_stories"] = f"with recursive {TREE} select model_id, path, pos, node ->> 'id' as id, node ->> 'type' as type, node ->> 'role' as role, node ->> 'goal' as goal, node ->> 'reason' as reason, try_cast(node ->> 'confidence' as double) as confidence, node ->> 'raw_text' as raw_text from tree where kind = 'story'"
    q["p3_criteria"] = f"with recursive {TREE} select model_id, path, parent_path, pos, level, node ->> 'text' as text, node ->> 'type' as type, try_cast(node ->> 'synthetic' as boolean) as synthetic from tree where kind = 'ac'"
    q["p3_logic"] = f"with recursive {TREE} select model_id, path, parent_path, pos, node ->> 'type' as type, node -> 'trigger' ->> 'event' as event, node ->> 'condition' as condition, node -> 'action' ->> 'description' as action, node ->> 'result' as result, try_cast(node ->> 'confidence' as double) as confidence from tree where kind = 'logic'"
    story = lambda expr, name: f"with {STORIES} select story_uid, {expr} as {name} from s"
    q["extract_id"] = story(REQ_ID, "req_id")
    q["req_type"] = f"with {STORIES} select story_uid, {kind('i')} as req_type from (select story_uid, {REQ_ID} as i from s)"
    q["extract_condition"] = story(strip(found("b", L.CONDITION, 1)), "condition")
    q["extract_action"] = story(ACTION, "action")
    q["extract_actor"] = story(ACTOR, "actor")
    q["actor_normalize"] = f"select story_uid, {actor('role')} as actor from user_stories"
    q["req_confidence"] = story(SCORE, "score")
    q["req_validity"] = story(VALID, "valid")
    q["extract_logic"] = f"with {STORIES} select story_uid, unnest(range(0, len({LOGIC_LIST}))) as pos, unnest(list_transform({LOGIC_LIST}, lambda x: {strip('x')})) as condition, unnest(list_transform(regexp_extract_all(b, {lit(L.LOGIC)}, 2), lambda x: {strip('x')})) as result from s where b is not null"
    q["story_structuring"] = f"with {READ} select story_uid, i as id, t as type, {GOAL} as goal, {REASON} as reason from r"
    q["inf_ids"] = f"with {READ}, v as (select *, row_number() over (partition by doc_id order by story_seq, story_uid) as n from r where {VALID}) select story_uid, printf('INF-%03d', n) as id from v where i = 'UNKNOWN'"
    q["actors_per_doc"] = f"select doc_id, string_agg(distinct a, '|' order by a) as actors from (select doc_id, {actor('role')} as a from user_stories where role is not null and trim(role) <> '') group by 1"
    mark = sub("text", r"\n(\s*(?:[-*•]|\*\*|__)?\s*[A-Z]{2,5}(?:-[A-Z]+)?-\d{1,3})", chr(1) + r"\1")
    fine = f"list_filter(list_transform(string_split({sub(mark, PARAGRAPH, chr(1))}, chr(1)), lambda x: {strip('x')}), lambda x: length(x) > 15)"
    coarse = f"list_filter(list_transform(regexp_split_to_array(text, {lit(PARAGRAPH)}), lambda x: {strip('x')}), lambda x: length(x) > 15 and regexp_matches(x, '[a-zA-Z]'))"
    q["req_blocks"] = f"with f as (select doc_id, text, {fine} as f from documents where text is not null), c as (select doc_id, case when len(f) < 5 then {coarse} else f end as l from f) select doc_id, unnest(range(0, len(l))) as block_no, unnest(l) as block from c"
    q["ac_tree_parents"] = f"with {STORIES}, {AC} select * from ac"
    q["rule_ledger"] = f"with {LEDGER} select story_uid, rule_pos, story_id, condition, action, confidence from rules"
    for name, expr in (("core_action", f"{CORE} as core"), ("polarity", f"case when {holds('lower(action)', L.NEGATIONS)} then 'negative' else 'positive' end as polarity"), ("extract_context", f"{CONTEXT} as context"), ("primary_object", f"{OBJECT} as object"), ("module_prefix", "split_part(coalesce(story_id, ''), '-', 2) as module")):
        q[name] = f"with {LEDGER} select story_uid, rule_pos, {expr} from rules"
    q["concept_groups"] = f"with {LEDGER} select story_uid, rule_pos, {CONCEPT} as concept from (select *, {CONTEXT} as c from rules)"
    op = f"regexp_extract({LOW}, {lit(COMPARE)}, 2)"
    q["condition_logic"] = f"""with {LEDGER} select story_uid, rule_pos, case when {rx(LOW, UNIT)} then regexp_extract({LOW}, {lit(UNIT)}, 2) when {rx(LOW, COMPARE)} then regexp_extract({LOW}, {lit(COMPARE)}, 1) end as variable,
      case when {rx(LOW, UNIT)} then '==' when {rx(LOW, COMPARE)} then case {op} when 'under' then '<' when 'exceeding' then '>' when 'within' then '<=' else {op} end end as operator,
      case when {rx(LOW, UNIT)} then try_cast(regexp_extract({LOW}, {lit(UNIT)}, 1) as double) when {rx(LOW, COMPARE)} then try_cast(regexp_extract({LOW}, {lit(COMPARE)}, 3) as double) end as value from rules"""
    q["model_rule_ledger"] = f"with recursive {MODEL_RULES} select story_uid as model_id, rule_pos as path, story_id, condition, action, confidence from rules"
    q["conflict_rule_layer"] = f"with recursive {OPPOSED} select * from opposed"
    q["ambiguity_vague_terms"] = f"with {TEXTS} select story_uid, src, term, severity from vague"
    q["ambiguity_weak_verbs"] = f"with {TEXTS} select story_uid, src, term from verbs"
    q["ambiguity_missing_reason"] = "select story_uid, id || ': ' || coalesce(goal, 'N/A') as text from user_stories where type = 'user_story' and coalesce(reason, '') = ''"
    q["ambiguities_dedup"] = f"with {AMBIGUITIES} select * from ambiguities"
    q["gap_no_testable_ac"] = f"with {STORIES}, {AC}, {GAP1} select story_uid from g1"
    q["gap_missing_error_handling"] = f"with {STORIES}, {AC}, {GAP2.replace('>= 3', '>= 2')} select story_uid from g2"
    q["gap_duplicate_ac"] = f"with {STORIES}, {AC}, {GAP3} select story_uid, pos, owner from g3 where story_id <> owner"
    q["gaps_dedup"] = f"with {GAPS} select * from gaps"
    counts = "a as (select doc_id, count(*) as n from ambiguities group by 1), c as (select doc_id, count(*) as n from opposed group by 1), g as (select doc_id, count(*) as n from gaps group by 1)"
    every = AMBIGUITIES + "," + OPPOSED + "," + GAPS.replace(STORIES + ", ", "").replace(AC + ", ", "")
    rep = f"{every}, {counts}, rpt as (select d.doc_id, coalesce(a.n, 0) as ambiguities, coalesce(c.n, 0) as conflicts, coalesce(g.n, 0) as gaps, coalesce(a.n, 0) + coalesce(c.n, 0) + coalesce(g.n, 0) as issues from (select distinct doc_id from user_stories) d left join a using (doc_id) left join c using (doc_id) left join g using (doc_id))"
    q["issues_report"] = f"with recursive {rep} select * from rpt"
    q["documents_overview"] = f"with recursive {rep}, n as (select doc_id, count(*) as stories, count(distinct case when trim(role) <> '' then {actor('role')} end) as actors from user_stories group by 1) select n.doc_id, n.stories, n.actors, rpt.issues, rpt.issues > 0 as has_issues from n join rpt using (doc_id)"
    q["missing_actors"] = f"with d as (select distinct doc_id from user_stories where role is not null) select d.doc_id, a.actor from d, (values {', '.join('(' + lit(a) + ')' for a in L.COMMON_ACTORS)}) a(actor) where not exists (select 1 from user_stories u where u.doc_id = d.doc_id and contains(lower(u.role), a.actor))"
    vague = "case " + " ".join(f"when contains(lower(goal), {lit(v)}) then {lit('vague: ' + v)}" for v in L.VAGUE_GOAL_VERBS) + " end"
    q["insights_topk"] = f"with {STORIES}, {AC}, h as (select doc_id, story_seq, story_uid, 0 as k, {vague} as hint from s union all select doc_id, story_seq, story_uid, 1, case when raw_text is not null and not exists (select 1 from acx where acx.story_uid = s.story_uid) then 'no criteria' end from s) select doc_id, row_number() over (partition by doc_id order by story_seq, story_uid, k) as rank, story_uid, hint from h where hint is not null qualify rank <= 4"
    q["srs_context"] = "with f as (select *, row_number() over (partition by doc_id order by story_seq, story_uid) as k from user_stories) select doc_id, coalesce(string_agg(coalesce(goal, raw_text), ', ' order by k), '') as context from f where k <= 10 group by 1"
    rl = f"r as ({Y.RULES})"
    cl = "lower(condition)"
    cop = f"regexp_extract({cl}, {lit(COMPARE)}, 2)"
    q["condition_overlap"] = f"with {rl}, c as (select distinct doc_id, story_id, regexp_extract({cl}, {lit(COMPARE)}, 1) as variable, case {cop} when 'under' then '<' when 'within' then '<' when 'exceeding' then '>' else {cop}[1:1] end as direction, regexp_extract({cl}, {lit(COMPARE)}, 3)::double as value from r where not {rx(cl, UNIT)} and {rx(cl, COMPARE)} and {cop} <> '==') select doc_id, variable, direction, count(distinct story_id) as stories, count(distinct value) as conditions, min(value) as low, max(value) as high from c group by all having stories > 1"
    q["conflict_numeric"] = f"with {rl}, a as (select distinct doc_id, story_id, lower(condition) as cond_key, regexp_extract(action, {lit(UNIT)}, 2) as variable, regexp_extract(action, {lit(UNIT)}, 1)::double as value from r) select doc_id, cond_key, variable, count(distinct story_id) as stories, count(distinct value) as amounts, min(value) as low, max(value) as high from a group by all having stories > 1 and amounts > 1"
    # pages
    q["clean_page_numbers"] = f"select page_id, {_without(L.PAGE_NUMBER)} as text from raw_pages"
    q["clean_toc"] = f"select page_id, {_without((L.TOC,))} as text from raw_pages"
    q["clean_references"] = f"with {references('raw_text', 'raw_pages')} select page_id, text from rt"
    q["dehyphenate"] = f"select page_id, {sub('raw_text', r'(\w)-\n(\w)', r'\1\2')} as text from raw_pages"
    q["collapse_whitespace"] = f"select page_id, {collapsed('raw_text')} as text from raw_pages"
    q["fix_ligatures"] = f"select page_id, {chain('raw_text', LIGATURES)} as text from raw_pages"
    q["count_tables"] = "select doc_id, len(list_filter(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '\\|')) >= 2 or len(regexp_extract_all(l, chr(9))) >= 2)) // 3 as tables from documents where text is not null"
    q["count_figures"] = f"select doc_id, len(regexp_extract_all(text, {lit(L.FIGURE)})) as figures from documents where text is not null"
    done = collapsed(sub(_without((L.TOC,), "text"), r"(\w)-\n(\w)", r"\1\2"))
    q["page_cleaning"] = f"with p0 as (select page_id, {_without(L.PAGE_NUMBER, chain('raw_text', LIGATURES))} as t0 from raw_pages), {references('t0', 'p0')} select page_id, {done} as text from rt"
    q["repeated_headers"] = f"with {HEADERS} select doc_id, key, n from heads"
    q["clean_running_headers"] = f"with {RUNNING} select page_id, line_no from running"
    anyline = lambda ps: "len(list_filter(string_split(raw_text, chr(10)), lambda l: " + " or ".join(rx("l", p) for p in ps) + ")) > 0"
    q["cleaning_stats"] = f"with {RUNNING}, h as (select doc_id, count(*) as n from running group by 1), p as (select doc_id, count(*) as pages, count(*) filter (where {anyline(L.PAGE_NUMBER)}) as number_pages, count(*) filter (where {anyline((L.TOC,))}) as toc_pages, count(*) filter (where {anyline((L.REFERENCE_HEAD,))}) as reference_pages from raw_pages group by 1) select p.*, coalesce(h.n, 0) as header_lines from p left join h using (doc_id)"
    q["asof_section"] = "with p as (select page_id, doc_id, page_num, list_filter(string_split(raw_text, chr(10)), lambda l: regexp_matches(l, '^\\d+\\.\\d+ [A-Z]'))[-1] as h from raw_pages) select page_id, last_value(h ignore nulls) over (partition by doc_id order by page_num, page_id rows between unbounded preceding and current row) as section from p"
    md = lambda expr: f"with m as ({Y.MARKDOWN}) select k, {expr} as text from m"
    q["html_strip"], q["md_symbols"], q["md_line_filters"], q["md_rules"] = md(sub("text", "<[^>]+>")), md(chain("text", ARROWS)), md(markdown_lines("text")), md(rules("text"))
    cleaned = rules(markdown_lines(chain("raw_text", ARROWS)))
    q["token_loss_audit"] = f"with c as (select page_id, raw_text as a, {cleaned} as z from raw_pages), l as (select page_id, list_sort(list_filter([{', '.join(lit(w) for w in L.CRITICAL_TOKENS)}], lambda t: contains(a, t) and not contains(z, t))) as lost from c) select page_id, array_to_string(lost, ',') as lost from l where len(lost) > 0"
    q["markdown_assembly"] = f"with {LATEST} select doc_id, page_num, '<!-- PAGE_' || page_num || ' -->' || chr(10) || {cleaned} as text from lp"
    q["detect_columns"] = "with x as (select page_id, list_sort(list_distinct(list_transform(font_metadata, lambda b: b.x0))) as xs from raw_pages where len(font_metadata) > 0) select page_id, case when coalesce(list_max(list_transform(range(2, len(xs) + 1), lambda i: xs[i] - xs[i - 1])), 0) > 91.8 then 'two_column' else 'single_column' end as layout from x"
    q["page_text_assembly"] = "with b as (select page_id, unnest(font_metadata) as b from raw_pages where len(font_metadata) > 0) select page_id, string_agg(b.text, chr(10) order by b.x0 >= 306, b.y0, b.x0, b.text) as text from b group by 1"
    q["font_block_stats"] = "with b as (select page_id, unnest(font_metadata) as b from raw_pages where len(font_metadata) > 0) select page_id, count(*) as blocks, count(*) filter (where b.font_size >= 13) as headings, round(sum(coalesce(b.font_size, 0)) / count(*), 1) as mean_size from b group by 1"
    # ingest
    q["ingest_dedup"] = "select doc_id, coalesce(min(doc_id) over (partition by case when text is null then 'n' || doc_id else sha256(text) end), doc_id) as first_id, first_id <> doc_id as is_duplicate from documents"
    stem = r"regexp_extract(file_path, '([^/]*?)(\.[^./]*)?$', 1)"
    q["doc_id_slug"] = rf"with {MANIFEST}, t as (select doc_id, case when length({stem}) > 32 then regexp_replace({stem}, '^[0-9a-f]{{32}}[_-]?', '') else {stem} end as s from m) select doc_id, lower(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as slug from t"
    q["manifest_latest"] = f"with {MANIFEST} select * from m"
    whens = " ".join(f"when {holds('lower(file_path)', w)} or coalesce({n}, false) then {lit(n)}" for n, w in L.DOC_TYPES)
    q["classify_doc_type"] = f"with {MANIFEST}, {LATEST}, e as (select doc_id, {', '.join(f'bool_or({holds(chr(108) + chr(111) + chr(119) + chr(101) + chr(114) + "(raw_text)", w)}) as {n}' for n, w in L.DOC_TYPES)} from lp where page_num <= 5 group by 1) select m.doc_id, case {whens} else 'textbook' end as kind from m left join e using (doc_id)"
    q["detect_extraction_path"] = f"with {LATEST} select doc_id, case when avg(length({strip('raw_text')})) >= 100 then 'digital' else 'ocr' end as path from lp where page_num <= 3 group by 1"
    q["processing_flags"] = f"with {LATEST} select doc_id, sum(len(regexp_extract_all(raw_text, '[=∫∑√∂±×÷≤≥≈αβγδεμφ]')))::bigint as symbols, symbols > 50 as high_equation_density, bool_or(coalesce(page_num = 1 and list_max(list_transform(font_metadata, lambda b: b.x0)) - list_min(list_transform(font_metadata, lambda b: b.x0)) > 244.8, false)) as multi_column from lp where page_num <= 10 group by 1"
    q["page_coverage_check"] = f"with {MANIFEST}, h as (select doc_id, count(distinct page_num) as n from raw_pages group by 1) select m.doc_id, page_count, coalesce(n, 0) as extracted, case when page_count > 0 then coalesce(n, 0) / page_count end as share, coalesce(n, 0) > 0 and coalesce(case when page_count > 0 then coalesce(n, 0) / page_count end, 1.0) >= 0.7 as enough from m left join h using (doc_id)"
    q["extract_stats"] = "select doc_id, count(*) as pages, sum(length(raw_text))::bigint as chars, sum(length(raw_text)) / count(*) as mean_chars, sum(length(raw_text)) / count(*) < 200 as thin from raw_pages group by 1"
    # equations
    q["eq_prefilter"] = f"with {EQ_LINES} select page_id, line_no from es where likely"
    q["eq_score"] = f"with {EQ_LINES} select page_id, line_no, score from es"
    q["eq_context"] = f"with {EQ_LINES} select page_id, line_no, context from ee"
    q["eq_text"] = f"with {EQ_LINES} select page_id, line_no, text from ee"
    table = "map {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in L.SYMBOLS.items()) + "}"
    tokens = r"regexp_extract_all({x}, '[\p{{L}}\p{{M}}\p{{Nd}}_]+|[^\p{{L}}\p{{M}}\p{{Nd}}_]+')"
    normal = f"array_to_string(list_transform({tokens.format(x='text')}, lambda w: coalesce({table}[w], w)), '')"
    named = f"list_sort(list_distinct(list_filter({tokens.format(x='normal')}, lambda w: w in {listed(sorted(set(L.SYMBOLS.values())))})))"
    q["eq_symbols"] = f"with {EQ_LINES} select page_id, line_no, {normal} as normal from ee"
    q["eq_variables"] = f"with {EQ_LINES}, no as (select page_id, line_no, {normal} as normal from ee) select page_id, line_no, array_to_string({named}, ',') as variables from no"
    q["eq_stats"] = f"with {EQ_DISTINCT}, no as (select doc_id, {normal} as normal from ed) select doc_id, count(*) as total, count(*) filter (where len({named}) > 0) as with_variables, round(count(*) filter (where len({named}) > 0) * 100 / count(*), 1) as share from no group by 1"
    first, rest = preprocess("text")
    q["eq_preprocess"] = f"with {EQ_LINES}, pp as (select page_id, line_no, {first} as r0 from ee) select page_id, line_no, {rest} as ascii from pp"
    q["eq_dedup"] = f"with {EQ_DISTINCT} select * from ed"
    q["eq_ids"] = f"with {EQ_DISTINCT} select doc_id, doc_id || '_p' || page_num || '_eq' || row_number() over (partition by doc_id order by page_num, page_id, line_no, text) as eq_id, text from ed"
    lx = lambda body: f"with x as ({Y.LATEX}) {body}"
    inner = r"regexp_extract_all(regexp_replace(text, '(?s)\$\$.+?\$\$', '', 'g'), '\$([^$]+?)\$', 1)"
    q["eq_latex"] = lx(rf"select k, array_to_string(list_concat({inner}, regexp_extract_all(text, '(?s)\$\$(.+?)\$\$', 1)), '|') as parts from x")
    q["math_merge_blocks"] = lx(r"select k, regexp_replace(text, '(?s)\$\$(.*?)\$\$\s*\n\s*\$\$(.*?)\$\$', '$$\1 \2$$', 'g') as text from x")
    q["latex_normalize"] = lx(f"select k, {latex_text(chr(32) + lit('') + ' || regexp_extract(text, ' + lit('(?s)' + chr(92) + '$' + chr(92) + '$(.+?)' + chr(92) + '$' + chr(92) + '$') + ', 1)')} as text from x")
    pieces = r"string_split(regexp_replace(regexp_replace(t, '(?s)\$\$.*?\$\$', chr(1), 'g'), '\$[^$\n]*\$', chr(2), 'g'), chr(3))[1]"
    # mathematics is set aside by kind, arrows are replaced, and the kinds are put back in order
    q["md_math_protect"] = lx(rf"""select k, (list_reduce(list_prepend('', list_transform(range(1, len(p) + 1), lambda i: replace(replace(replace(p[i], '→', ' THEN '), '=>', ' THEN '), '->', ' THEN ') || coalesce(m[i], ''))), lambda a, b: a || b)) as text
      from (select k, string_split({pieces.replace("string_split(", "", 1).replace(", chr(3))[1]", "").replace("chr(1)", "chr(2)")}, chr(2)) as p, regexp_extract_all(t, '(?s:\$\$.*?\$\$)|\$[^$\n]*\$') as m from (select k, text || ' -> $a -> b$ -> c' as t from x))""")
    q["eq_number"] = lx(r"select k, nullif(regexp_extract(regexp_extract(text, '(?s)\$\$.+?\$\$(.{0,30})', 1), '\((\d+\.\d+[a-z]?)\)', 1), '') as number from x")
    q["eq_classify"] = f"select page_id, case when {holds('raw_text', ('tau', 'dt', 'dq'))} then 'transient_equation' when contains(raw_text, 'V_DD') and contains(raw_text, 'C_L') then 'power_equation' when {holds('raw_text', ('i_', 'v_', 'V_', 'Vth'))} then 'transfer_equation' else 'general_equation' end as kind from raw_pages"
    q["math_inline_pages"] = lx(rf"select expr, string_agg(page::varchar, ',' order by page) as pages from (select distinct page, trim(unnest({inner})) as expr from x) where expr <> '' group by 1")
    # diagrams
    q["diagram_type"] = f"with r as ({Y.REQUESTS}) select doc_id, case when {holds('lower(request)', ('use case', 'usecase', 'actor'))} then 'usecase' when {holds('lower(request)', ('activity', 'workflow', 'flowchart', 'flow diagram'))} then 'activity' when {holds('lower(request)', ('dfd', 'data flow', 'dataflow', 'data-flow'))} then 'dfd' else 'generic' end as kind from r"
    q["diagram_parse"] = rf"with a as (select k, regexp_replace(regexp_replace(text, '(?i)```(json)?', '', 'g'), '^\s+|\s+$', '', 'g') as t from ({Y.ANSWERS})), j as (select k, try_cast(t as json) as j from a), c as (select k, case when json_type(j) = 'ARRAY' then j else j -> 'cells' end as c from j where j is not null) select k, unnest(range(0, json_array_length(c)::bigint)) as pos, unnest(json_extract_string(c, '$[*].id')) as id from c"
    q["diagram_validate"] = f"with {NODES}, own as (select diagram_id, pos, case when x is null or width is null then 'no position or size' end as problem from n) select * from own where problem is not null union all select e.diagram_id, 0, 'end not in the diagram' from e where not exists (select 1 from n where n.diagram_id = e.diagram_id and n.id = e.target)"
    q["diagram_split"] = f"with {NODES}, a as (select diagram_id, count(*) as shapes from n group by 1), b as (select diagram_id, count(*) as links from e group by 1) select a.diagram_id, coalesce(links, 0) as links, shapes from a left join b using (diagram_id)"
    q["shape_defaults"] = f"with {NODES}, {SIZED} select diagram_id, id, width, height from sz"
    q["shape_width"] = f"with {NODES}, {SIZED} select diagram_id, id, floor(greatest(width, length(label) * 8.5 + case when type = 'uml.UseCase' then 70 else 30 end) + 0.5)::bigint as width from sz"
    bent = f"a.type in {listed(L.ACTIVITY_NODES)} or starts_with(a.type, 'dfd.')"
    router = f"case when a.type = 'uml.UseCase' and b.type = 'uml.UseCase' then 'manhattan' when a.type = 'uml.Actor' or b.type = 'uml.Actor' then 'normal' when {bent} then 'manhattan' else 'normal' end"
    q["link_routing"] = f"with {NODES} select e.diagram_id, e.id, {router} as router, case when {router} = 'manhattan' then 'rounded' else 'normal' end as connector from e left join n a on a.diagram_id = e.diagram_id and a.id = e.source left join n b on b.diagram_id = e.diagram_id and b.id = e.target"
    q["layout_usecase"] = f"with {NODES}, {PLACED} select diagram_id, id, x, y from pl"
    q["layout_boundary"] = f"with {NODES}, {PLACED} select diagram_id, greatest(460, greatest(400, max(x + 200)) - 160)::bigint as width, greatest(400, 120 + 120 * count(*))::bigint as height from pl where x <> 50 group by 1"
    q["layout_dfd"] = f"""with n as ({Y.FLOW_NODES}), e as ({Y.EDGES}), p as (select *, row_number() over (partition by diagram_id order by label, pos) as k from n where type = 'dfd.Process'),
      t as (select diagram_id, source as a, target as b from e union all select diagram_id, target, source from e), f as (select t.diagram_id, t.a, min(p.k) as k from t join p on p.diagram_id = t.diagram_id and p.id = t.b group by all),
      c as (select diagram_id, count(*) as n from p group by 1), s as (select n.diagram_id, n.id, f.k, coalesce(c.n, 0) as ps, row_number() over (partition by n.diagram_id, f.k order by n.pos) - 1 as j from n left join f on f.diagram_id = n.diagram_id and f.a = n.id left join c on c.diagram_id = n.diagram_id where n.type = 'dfd.DataStore')
      select diagram_id, id, 300::bigint as x, (80 + 160 * (k - 1))::bigint as y from p union all select diagram_id, id, case when k is null then 300 else 560 + 220 * j end, case when k is null then 120 + 160 * ps + 100 * j else 95 + 160 * (k - 1) end from s
      union all select diagram_id, id, 40, 80 + 200 * (row_number() over (partition by diagram_id order by pos) - 1) from n where type = 'dfd.ExternalEntity'"""
    # state, similarity
    q["progress_latest"] = "select user_id, event_id, event_type, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"
    q["history_last_n"] = "select user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank, event_id from events qualify rank <= 10"
    q["text_to_pseudo_story"] = "select doc_id, substring(text, 1, 1200) as goal from documents where text is not null"
    q["cosine_similarity"] = "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"
    q["knn_candidate_pairs"] = "with s as (select q.vec_id as q, v.vec_id as v, row_number() over (partition by q.vec_id order by list_dot_product(q.embedding::double[], v.embedding::double[]) desc, v.vec_id) as k from embeddings q join embeddings v on v.vec_id <> q.vec_id where q.vec_id % 20 = 0) select distinct least(q, v) as a, greatest(q, v) as b from s where k <= 15"
    return q
