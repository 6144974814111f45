"""Text expressions: column in, column out. All run inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from specsift import lexicons as L


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def contains_any(c: Column | str, words: tuple[str, ...]) -> Column:
    """Whether any of the words is a substring."""
    return reduce(lambda a, b: a | b, (F.contains(col(c), F.lit(w)) for w in words))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def any_match(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(f"(?d){p}") for p in patterns))


def without_lines(c: Column | str, *patterns: str) -> Column:
    """The text without the lines that match any of the patterns."""
    return F.array_join(F.filter(lines(c), lambda x: ~any_match(x, patterns)), "\n")


def dehyphenate(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(\w)-\n(\w)", "$1$2")


def collapse_whitespace(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"\n{3,}", "\n\n"), r"[^\S\n]+", " "))


def fix_ligatures(c: Column | str) -> Column:
    pairs = ((0xFB01, "fi"), (0xFB02, "fl"), (0xFB00, "ff"), (0xFB03, "ffi"), (0xFB04, "ffl"))
    return reduce(lambda x, p: F.replace(x, F.lit(chr(p[0])), F.lit(p[1])), pairs, col(c))


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fix_unicode(c: Column | str) -> Column:
    """Composed characters and no ligatures; ASCII texts stay in the JVM's hands."""
    c = col(c)
    return fix_ligatures(F.when(F.octet_length(c) == F.length(c), c).otherwise(_nfc(c)))


def count_tables(c: Column | str) -> Column:
    """A third of the lines with two or more bars or tabs."""
    rows = F.filter(lines(c), lambda x: (F.regexp_count(x, F.lit(r"\|")) >= 2) | (F.regexp_count(x, F.lit("\t")) >= 2))
    return F.floor(F.size(rows) / 3).cast("bigint")


def count_figures(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(L.FIGURE)).cast("bigint")


def slug(path: Column | str) -> Column:
    """A document id of a file path: stem, long hex prefix dropped, other characters to underscores, lower case."""
    stem = F.regexp_extract(col(path), r"([^/]*?)(\.[^./]*)?$", 1)
    stem = F.when(F.length(stem) > 32, F.regexp_replace(stem, r"^[0-9a-f]{32}[_-]?", "")).otherwise(stem)
    return F.lower(F.regexp_replace(F.regexp_replace(stem, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<[^>]+>", "")


def markdown_symbols(c: Column | str) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(" THEN ")), ("→", "=>", "->"), col(c))


def markdown_lines(c: Column | str) -> Column:
    """Markdown without decorative and garbage lines, image placeholders and tags."""
    kept = F.filter(lines(c), lambda x: ~(strip(x).rlike(L.DECORATION) & (F.length(strip(x)) > 3)) & ~F.lower(strip(x)).isin(*L.GARBAGE_LINES))
    return F.array_join(F.transform(kept, lambda x: strip_html(F.regexp_replace(x, r"!\[\]\(_page_.*?\)", ""))), "\n")


def markdown_rules(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"\n{3,}", "\n\n"), r"(?m)^[ \t]*[-_]{5,}[ \t]*$", "")


#: Mathematics in Markdown: display blocks, bracketed blocks, inline spans of one line.
MATH = r"(?s:\$\$.*?\$\$)|(?s:\\\[.*?\\\])|(?<!\$)\$(?!\$)(?d:.*?)(?<!\$)\$(?!\$)"
HOLE = "\ue000"


def around_math(c: Column | str, clean: Callable[[Column], Column]) -> Column:
    """The text with everything but its mathematics cleaned; if cleaning drops a place of mathematics, all is cleaned."""
    spans = F.regexp_extract_all(col(c), F.lit(MATH), 0)
    rest = F.split(clean(F.regexp_replace(col(c), MATH, HOLE)), HOLE)
    whole = F.array_join(F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.get(spans, i), F.lit("")))), "")
    return F.when(F.size(rest) == F.size(spans) + 1, whole).otherwise(clean(col(c)))


def clean_markdown(c: Column | str) -> Column:
    """The whole Markdown cleaning; mathematics is left as it is, prose between it is cleaned."""
    return around_math(c, lambda x: markdown_rules(markdown_lines(markdown_symbols(x))))


def lost_tokens(before: Column | str, after: Column) -> Column:
    """Critical tokens that a cleaning lost."""
    return F.filter(F.array(*map(F.lit, L.CRITICAL_TOKENS)), lambda t: F.contains(col(before), t) & ~F.contains(after, t))
