"""Deeply nested JSON into related flat tables, in one pass.

A depth-first visitor walks each document once and emits a tagged record for every story, criterion (to any depth) and
logic block: table tag, own path, parent path, position, level and the scalar fields as a string map.  The tagged
records are cut into tables by tag, each under its own schema.

Defined results: null, blank or invalid JSON gives no rows; a lone object stands for an array of one; an array given as
a JSON string counts as that array; null elements keep their position and give no row; elements that are no objects
(numbers, strings) likewise; repeated input rows repeat their rows; an empty table gives empty tables; a field met
under an unexpected type is kept as its JSON text.  Nesting depth is not bounded: the visitor keeps its own stack, and
so does the parser that takes over where the interpreter's recursion ends.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGGED = "model_id bigint, tag string, path string, parent_path string, pos int, level int, payload map<string,string>"
CHILD_FIELDS = {"acceptance_criteria", "children", "logic"}


def _constant(name: str) -> None:
    raise ValueError(name)


def _loads(text: str) -> object:
    """Strict JSON: NaN and Infinity are no values."""
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError:
        return _deep(text)


SPACE = re.compile(r"[ \t\n\r]*")
#: What may begin a value that isn't an object, array or string.
PLAIN_VALUE = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


def _deep(text: str) -> object:
    """The same for JSON nested beyond the interpreter's recursion: open objects and arrays are on a stack."""
    at = 0
    stack: list[tuple[object, str | None]] = []

    def peek() -> str:
        nonlocal at
        at = SPACE.match(text, at).end()
        return text[at : at + 1]

    def take(c: str) -> None:
        nonlocal at
        if peek() != c:
            raise ValueError(f"{c!r} expected at {at}")
        at += 1

    def name() -> str:
        nonlocal at
        take('"')
        key, at = scanstring(text, at)
        take(":")
        return key

    while True:
        c = peek()
        if c in ("{", "["):
            at += 1
            value: object = {} if c == "{" else []
            if peek() != ("}" if c == "{" else "]"):
                stack.append((value, name() if c == "{" else None))
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
        elif m := PLAIN_VALUE.match(text, at):
            value, at = json.loads(m.group()), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while stack:
            within, key = stack.pop()
            if key is None:
                within.append(value)
            else:
                within[key] = value
            if peek() == ",":
                at += 1
                stack.append((within, None if key is None else name()))
                break
            take("]" if key is None else "}")
            value = within
        else:
            if peek():
                raise ValueError(f"more text at {at}")
            return value


def _dumps(value: object) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        out, stack = [], [(False, value)]
        while stack:
            raw, x = stack.pop()
            if raw or not x or not isinstance(x, (dict, list)):
                out.append(x if raw else json.dumps(x, ensure_ascii=False))
                continue
            parts: list[tuple[bool, object]] = []
            for k, v in sorted(x.items()) if isinstance(x, dict) else ((None, v) for v in x):
                parts += [(True, ("{" if isinstance(x, dict) else "[") if not parts else ", "), *([] if k is None else [(True, json.dumps(k, ensure_ascii=False) + ": ")]), (False, v)]
            stack += reversed([*parts, (True, "}" if isinstance(x, dict) else "]")])
        return "".join(out)


def _elements(value: object) -> list:
    """The array that a field stands for."""
    if isinstance(value, str):
        try:
            value = _loads(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else []


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return _dumps(value)


def visit(text: str | None) -> Iterator[tuple[str, str, str, int, int, dict[str, str | None]]]:
    """(tag, path, parent path, position, level, payload) of every object, depth first in document order."""
    if not text:
        return
    try:
        top = _loads(text)
    except ValueError:
        return
    stack = [("story", f"s{i}", "", i, 0, x) for i, x in reversed(list(enumerate(_elements(top))))]
    while stack:
        tag, path, parent, pos, level, node = stack.pop()
        if not isinstance(node, dict):
            continue
        yield tag, path, parent, pos, level, {k: _scalar(v) for k, v in node.items() if k not in CHILD_FIELDS}
        if tag == "logic":
            continue
        below = [("ac", f"{path}/c{i}", path, i, level + 1, x) for i, x in enumerate(_elements(node.get("acceptance_criteria" if tag == "story" else "children")))]
        below += [("logic", f"{path}/l{i}", path, i, level + 1, x) for i, x in enumerate(_elements(node.get("logic")))]
        stack.extend(reversed(below))


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(m, *r) for m, text in zip(batch["model_id"], batch["user_stories"], strict=True) for r in visit(text)]
        if rows:
            yield pd.DataFrame(rows, columns=["model_id", "tag", "path", "parent_path", "pos", "level", "payload"])


def tagged(models: DataFrame) -> DataFrame:
    """One record for each object of models(model_id, user_stories)."""
    return models.select("model_id", F.col("user_stories").cast("string")).mapInPandas(_emit, TAGGED)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(m, r[1], r[2], r[0]) for m, text in zip(batch["model_id"], batch["user_stories"], strict=True) for r in visit(text)]
        if rows:
            yield pd.DataFrame(rows, columns=["model_id", "path", "parent_path", "kind"])


def links(models: DataFrame) -> DataFrame:
    """(model_id, path, parent_path, kind) of every object: the keys of the tagged records without their payload."""
    return models.select("model_id", F.col("user_stories").cast("string")).mapInPandas(_keys, "model_id bigint, path string, parent_path string, kind string")


RULE_BLOCKS = "model_id bigint, document_name string, path string, story_seq int, story map<string,string>, payload map<string,string>"


def _emit_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for m, name, text in zip(batch["model_id"], batch["document_name"], batch["user_stories"], strict=True):
            for tag, path, _, pos, _, payload in visit(text):
                if tag == "story":
                    seq, story = pos, {k: payload.get(k) for k in ("id", "type", "role", "raw_text")}
                elif tag == "logic":
                    rows.append((m, name, path, seq, story, payload))
        if rows:
            yield pd.DataFrame(rows, columns=["model_id", "document_name", "path", "story_seq", "story", "payload"])


def owned_blocks(models: DataFrame) -> DataFrame:
    """Every logic block with the position and fields of the story it stands in, from the same single pass."""
    return models.select("model_id", "document_name", F.col("user_stories").cast("string")).mapInPandas(_emit_blocks, RULE_BLOCKS)


def stories(records: DataFrame) -> DataFrame:
    p = lambda k: F.col("payload")[k]
    return records.where("tag = 'story'").select("model_id", "path", "pos", p("id").alias("id"), p("type").alias("type"), p("role").alias("role"), p("goal").alias("goal"), p("reason").alias("reason"), p("confidence").try_cast("double").alias("confidence"), p("raw_text").alias("raw_text"))


def criteria(records: DataFrame) -> DataFrame:
    p = lambda k: F.col("payload")[k]
    return records.where("tag = 'ac'").select("model_id", "path", "parent_path", "pos", "level", p("text").alias("text"), p("type").alias("type"), p("synthetic").try_cast("boolean").alias("synthetic"))


def logic_blocks(records: DataFrame) -> DataFrame:
    p = lambda k: F.col("payload")[k]
    return records.where("tag = 'logic'").select("model_id", "path", "parent_path", "pos", p("type").alias("type"), F.get_json_object(p("trigger"), "$.event").alias("event"), p("condition").alias("condition"), F.get_json_object(p("action"), "$.description").alias("action"), p("result").alias("result"), p("confidence").try_cast("double").alias("confidence"))


def write_tables(models: DataFrame, to: str) -> None:
    """All tables in one write, partitioned by tag."""
    tagged(models).write.mode("overwrite").partitionBy("tag").parquet(to)
