"""Queries over the training-text operators and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specsift.llm import actors, chunking, encoding_pages, leakage, lookalikes, ocr, repeats, tokens, truncation
from specsift.runtime import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    t = table
    return {
        "p1_found": lambda s, d: encoding_pages.found(spread(t(s, d, "raw_pages")), spread(t(s, d, "cleaned_pages"))),
        "p1_restored": lambda s, d: encoding_pages.restored(spread(t(s, d, "raw_pages")), spread(t(s, d, "cleaned_pages"))),
        "p2_found": lambda s, d: chunking.found(spread(t(s, d, "knowledge_chunks"))),
        "p2_pieces": lambda s, d: chunking.pieces(spread(t(s, d, "knowledge_chunks"))),
        "p4_found": lambda s, d: ocr.found(t(s, d, "raw_pages"), t(s, d, "cleaned_pages")),
        "p4_paragraphs": lambda s, d: ocr.paragraphs(t(s, d, "raw_pages"), t(s, d, "cleaned_pages")),
        "p5_found": lambda s, d: actors.found(t(s, d, "user_stories"), t(s, d, "requirements_models"), t(s, d, "actor_catalog")),
        "p5_unmatched": lambda s, d: actors.unmatched(t(s, d, "user_stories"), t(s, d, "requirements_models"), t(s, d, "actor_catalog")),
        "p6_found": lambda s, d: lookalikes.found(spread(t(s, d, "raw_pages")), spread(t(s, d, "user_stories"))),
        "p6_canonical": lambda s, d: lookalikes.canonical(spread(t(s, d, "raw_pages")), spread(t(s, d, "user_stories"))),
        "p7_found": lambda s, d: repeats.found(t(s, d, "raw_pages")),
        "p7_cleaned": lambda s, d: repeats.cleaned(t(s, d, "raw_pages")),
        "p8_ids": lambda s, d: tokens.ids(spread(t(s, d, "documents"))),
        "p9_found": lambda s, d: leakage.found(spread(t(s, d, "documents")), t(s, d, "eval_items")),
        "p9_spans": lambda s, d: leakage.spans(spread(t(s, d, "documents")), t(s, d, "eval_items")),
        "p10_found": lambda s, d: truncation.found(t(s, d, "documents")),
        "p10_sources": lambda s, d: truncation.sources(t(s, d, "documents")),
    }


#: Lines of pages, what tells them apart, and how many pages hold each, in SQL with the classes of the definition.
_REPEATS = r"""
with l as (
  select page_id, doc_id, page_num, 'raw_text' as place, unnest(string_split(raw_text, chr(10))) as line,
         unnest(range(1, len(string_split(raw_text, chr(10))) + 1)) as pos
  from raw_pages where raw_text is not null
  union all
  select page_id, doc_id, page_num, 'font_metadata', unnest(list_transform(font_metadata, lambda x: x.text)), unnest(range(1, len(font_metadata) + 1))
  from raw_pages where font_metadata is not null),
k as (select page_id, doc_id, page_num, place, pos, regexp_replace(lower(line), '[\p{Nd}_\p{P}\p{S}\p{Z}\p{C}\p{M}]', '', 'g') as key from l),
f as (select doc_id, place, key, count(distinct page_num) as n from k where length(regexp_replace(key, '\P{L}', '', 'g')) >= 3 group by all),
s as (select doc_id, count(distinct page_num) as pages from raw_pages group by all)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": r"select distinct chunk_id from knowledge_chunks where len(regexp_extract_all(text, '[^\s\p{Z}\x{85}\x{1c}-\x{1f}]+')) > 256",
        "p7_found": _REPEATS + "select k.page_id, k.place, cast(k.pos as integer) as pos from k join f using (doc_id, place, key) join s using (doc_id) where f.n >= 5 and f.n * 5 >= s.pages",
        "p7_cleaned": _REPEATS + """, h as (select k.page_id, list(k.pos) filter (where k.place = 'raw_text') as t, list(k.pos) filter (where k.place = 'font_metadata') as b from k join f using (doc_id, place, key) join s using (doc_id) where f.n >= 5 and f.n * 5 >= s.pages group by 1)
select r.page_id, case when h.t is null then r.raw_text else array_to_string(list_filter(string_split(r.raw_text, chr(10)), lambda x, i: not list_contains(h.t, i)), chr(10)) end as text, coalesce(len(h.t), 0) as removed,
  case when h.b is null then list_transform(r.font_metadata, lambda x: x.text) else list_filter(list_transform(r.font_metadata, lambda x: x.text), lambda x, i: not list_contains(h.b, i)) end as blocks, coalesce(len(h.b), 0) as removed_blocks
from raw_pages r left join h using (page_id)""",
    }
