"""Inputs that no table supplies, written in SQL that both engines read: LaTeX pages, Markdown noise, diagrams, answers."""

from __future__ import annotations

#: LaTeX text of each part: a display block with a number, one that follows it, inline mathematics.
LATEX = r"""
select p_partkey as k, p_size as page,
  concat('$$V_{th} = V_{th0} + \gamma (', cast(p_size as varchar(10)), ' + \phi_f)$$',
         case when p_partkey % 3 = 0 then concat(' (', cast(p_size as varchar(10)), '.', cast(p_partkey % 40 as varchar(10)), ')') else ' as shown' end,
         case when p_partkey % 4 = 0 then concat(chr(10), chr(10), '$$I_d = \mu_{eff} C_{ox} \frac{W}{L} (V_{gs} - V_{th})^{2}$$') else ' and so on' end,
         ' with $x_', cast(p_size as varchar(10)), '$ and $ y = ', cast(p_partkey % 7 as varchar(10)), ' $.') as text
from part
"""

#: Markdown lines with decoration, garbage, placeholders, tags and arrows.
MARKDOWN = r"""
select p_partkey as k,
  concat('# ', p_name, chr(10), case when p_size % 2 = 0 then '+-----+====+' else '| a | b |' end, chr(10), case when p_size % 3 = 0 then 'Tier' else 'The tier list' end, chr(10),
         '![](_page_', cast(p_size as varchar(10)), '_Picture_1.jpeg)<b>', p_brand, '</b> -> FR-', cast(p_size as varchar(10)), ' => shall → must', chr(10), chr(10), chr(10), chr(10), '________', chr(10),
         'Attendance<br>of the CR') as text
from part
"""

#: One diagram for each nation: suppliers are nodes in turn of five types, links run to the next supplier.
NODES = """
select s_nationkey as diagram_id, s_suppkey as pos, concat('n', cast(s_suppkey as varchar(10))) as id,
  case when s_suppkey % 5 = 0 then 'uml.Actor' when s_suppkey % 5 in (1, 2) then 'uml.UseCase' when s_suppkey % 5 = 3 then 'uml.SystemBoundary' else 'uml.DecisionNode' end as type,
  case when s_suppkey % 11 = 0 then null else cast(s_suppkey % 17 as double) end as x, 0.0e0 as y, case when s_suppkey % 4 = 0 then 120 end as width, case when s_suppkey % 4 = 0 then 50 end as height, s_name as label
from supplier
"""
FLOW_NODES = """
select s_nationkey as diagram_id, s_suppkey as pos, concat('n', cast(s_suppkey as varchar(10))) as id,
  case when s_suppkey % 3 = 0 then 'dfd.Process' when s_suppkey % 3 = 1 then 'dfd.DataStore' else 'dfd.ExternalEntity' end as type, s_name as label
from supplier
"""
EDGES = """
select a.s_nationkey as diagram_id, concat('l', cast(a.s_suppkey as varchar(10))) as id, concat('n', cast(a.s_suppkey as varchar(10))) as source, concat('n', cast(min(b.s_suppkey) as varchar(10))) as target
from supplier a join supplier b on a.s_nationkey = b.s_nationkey and b.s_suppkey > a.s_suppkey group by a.s_nationkey, a.s_suppkey
"""
#: Answers of a model: fenced or bare, an object with cells or an array, some broken.
ANSWERS = """
select s_suppkey as k, concat(case when s_suppkey % 2 = 0 then concat('```json', chr(10)) else '' end,
  case when s_suppkey % 3 = 0 then '[' else '{"cells": [' end, '{"id": "a', cast(s_suppkey as varchar(10)), '"},{"id": "b"}', case when s_suppkey % 3 = 0 then ']' when s_suppkey % 7 = 0 then '' else ']}' end,
  case when s_suppkey % 2 = 0 then concat(chr(10), '```') else '' end) as text
from supplier
"""
#: Requests for a diagram, one for each document.
REQUESTS = "select doc_id, concat(case when doc_id % 5 = 0 then 'Draw a use case diagram. ' when doc_id % 5 = 1 then 'A DFD: ' when doc_id % 5 = 2 then 'Flowchart of ' else '' end, coalesce(substring(text, 1, 80), '')) as request from documents"
#: Numeric rules: one for each part, documents by brand, conditions and actions with numbers.
RULES = """
select p_brand as doc_id, concat('FR-', cast(p_partkey % 100 as varchar(10))) as story_id, p_partkey as story_uid,
  concat(case when p_partkey % 3 = 0 then 'latency' when p_partkey % 3 = 1 then 'Capacity' else 'queue' end, case when p_partkey % 4 = 0 then ' under ' when p_partkey % 4 = 1 then ' exceeding ' else ' > ' end, cast(p_size % 9 as varchar(10))) as condition,
  concat('stop within ', cast(p_size % 5 as varchar(10)), case when p_partkey % 2 = 0 then ' seconds' else ' minutes' end) as action
from part
"""

#: Rules on which the layers of conflicts are tried, a pair of requirement lines each, conditions the same or nested.
CONFLICT_LINES = (
    "FR-901: If role is guest, the system shall allow access.", "FR-902: If role is guest, the system shall restrict access.", "FR-903: If API fails, system shall enable fallback.",
    "FR-904: If API fails, system shall block fallback.", "FR-905: If user is deactivated, system shall permit login.", "FR-906: If user is deactivated, system shall detain login.",
    "FR-907: If event triggers, system shall authorize access.", "FR-908: If event triggers, system shall block access.", "FR-909: If test begins, system shall grant permission.",
    "FR-910: If test begins, system shall prohibit action.", "FR-911: If attendance < 75, the system shall detain.", "FR-912: If attendance < 60, the system shall allow.",
)
#: Pairs of rules for the domain gate: one module, one object in two modules, nothing in common.
GATED = """
select p_partkey as k, concat('FR-', case when p_partkey % 3 = 0 then 'SEC' when p_partkey % 3 = 1 then 'PAT' else '' end, '-', cast(p_partkey % 90 as varchar(10))) as story_a,
  concat('FR-', case when p_partkey % 2 = 0 then 'SEC' else '' end, '-', cast(p_size as varchar(10))) as story_b, concat(p_brand, ' writes the ledger of meters') as action_a,
  case when p_partkey % 5 = 0 then concat(p_brand, ' writes the ledger of meters') else 'zzz qqq' end as action_b, 'jjj www kkk' as raw_a, case when p_partkey % 7 = 0 then 'vvv yyy' else 'xxxxxxx hhhhhhh' end as raw_b
from part
"""
#: Rules whose actions bound or name numbers.
BOUNDS = """
select p_brand as doc_id, concat('FR-', cast(p_partkey % 50 as varchar(10))) as story_id, concat('mode is ', cast(p_partkey % 40 as varchar(10))) as condition,
  case when p_partkey % 3 = 0 then concat('keep latency ', case when p_size % 2 = 0 then '<' else '>' end, ' ', cast(p_size % 9 as varchar(10))) else concat('stop within ', cast(p_size % 3 as varchar(10)), ' seconds') end as action
from part
"""
#: Attributes of cells: a label's text, a body's, both, neither.
ATTRIBUTES = """
select s_suppkey as k, case when s_suppkey % 4 = 0 then concat('{"label": {"text": "L', cast(s_suppkey as varchar(10)), '"}, "body": {"text": "B"}}') when s_suppkey % 4 = 1 then concat('{"body": {"text": "B', cast(s_suppkey as varchar(10)), '"}}')
  when s_suppkey % 4 = 2 then '{"label": {"text": null}}' end as attrs from supplier
"""
#: Links of which some have no end or end where they start.
LINKS = "select s_suppkey as k, concat('n', cast(s_suppkey as varchar(10))) as source, case when s_suppkey % 5 = 0 then null when s_suppkey % 5 = 1 then concat('n', cast(s_suppkey as varchar(10))) else concat('n', cast(s_suppkey + 1 as varchar(10))) end as target from supplier"
#: Answers whose cells lie one level deeper.
NESTED_ANSWERS = """
select s_suppkey as k, concat('{"note": "x", "diagram": {"title": "t", "cells": [{"id": "c', cast(s_suppkey as varchar(10)), '"}', case when s_suppkey % 2 = 0 then ',{"id": "d"}' else '' end, ']}}') as text from supplier
"""
#: Cells that lack one thing or another.
CELLS = """
select s_nationkey as diagram_id, s_suppkey as pos, case when s_suppkey % 13 = 0 then '' else concat('n', cast(s_suppkey as varchar(10))) end as id, case when s_suppkey % 6 = 0 then 'standard.Link' else 'uml.Actor' end as type,
  case when s_suppkey % 11 = 0 then null else 1.0e0 end as x, case when s_suppkey % 7 = 0 then null else 2.0e0 end as y, 60 as width, case when s_suppkey % 5 = 0 then null else 100 end as height from supplier
"""
#: Markdown of documents with display and inline mathematics and tables.
MATH_TEXTS = r"""
select p_partkey % 10 as k, concat('$$a_', cast(p_size as varchar(10)), ' = b$$', chr(10), case when p_partkey % 3 = 0 then '$$c = d$$ ' else 'and ' end, 'with $x_', cast(p_size % 4 as varchar(10)), '$ and $ y $.',
  case when p_partkey % 4 = 1 then concat(chr(10), '| a | b |', chr(10), '|---|:-:|', chr(10), '| 1 | 2 |', chr(10), '| 3 | 4 |', chr(10), 'end') else '' end) as text
from part
"""
