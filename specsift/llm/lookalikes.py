"""Text that looks ordinary but is made of other characters: one consistent form, and the texts that needed it.

Full-width forms, ligatures, combining accents, invisible marks and unusual spaces have one ordinary form each.
Look-alike letters are repaired by script: a token's dominant script is the one that most of its letters are of (Latin, if
equally many), and in a token of mixed script the letters of other scripts are replaced by the look-alikes of the
dominant one if the result, of any length, is a word of the corpus; else by Latin ones if that is.  A token beside a line
end may be half a word, so it counts as a word also if it and its other half are one.  The vocabulary is joined: it is
taken over all texts and reduced to the candidates by a semi join.

Defined results: null stays null and is no case; empty and ASCII-only texts are unchanged; words written wholly in
another script, units, powers, formula letters, emoji (with their joiners), typographic quotes and dashes are kept;
repeated rows are judged alike; pages whose text was garbled by decoding are left to the encoding operator.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specsift.llm.encoding_pages import trained
from specsift.runtime import cut

#: Letters from which on a key for comparisons takes a token of mixed script for a word.
LONG = 4
#: Letters that render as a Latin letter.
CYRILLIC = dict(zip("аеорсухіѕјһԁѵԛԝӏАВЕКМНОРСТХІЅЈУԌԚԜӀ", "aeopcyxisjhdvqwlABEKMHOPCTXISJYGQWI", strict=True))
GREEK = dict(zip("οονρυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oovpuikABEZHIKMNOPTYX", strict=True))
LATIN_OF = CYRILLIC | GREEK
#: The same the other way: the first letter of each pair, Cyrillic ones of living alphabets only.
BACK = {"cyrillic": {x: c for c, x in reversed(CYRILLIC.items()) if c not in "һԁѵԛԝӏԌԚԜӀ"}, "greek": {x: c for c, x in reversed(GREEK.items())}}
INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF]))
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
PLAIN = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in SPACES} | {0x2010: "-", 0x2011: "-"} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0xFB00 + i: x for i, x in enumerate(("ff", "fi", "fl", "ffi", "ffl", "st", "st"))}
ODD = re.compile("[" + "".join(map(re.escape, map(chr, PLAIN))) + "]")
MARK = re.compile("[\u0300-\u036f]")
OTHER = re.compile("[\u0370-\u052f]")
#: Words that hold a Greek or Cyrillic letter.
MIXED = re.compile("[^\\W\\d_]*[\u0370-\u052f][^\\W\\d_]*")
VOCABULARY_WORD = "[^A-Za-z\\u00c0-\\u024f]+"
ONE_SCRIPT = "(?<!\\p{L})(?:[A-Za-z\\u00c0-\\u024f]+|[\\u0370-\\u03ff]+|[\\u0400-\\u052f]+)(?!\\p{L})"
#: What follows the first half of a word at a line end, and the second half; a first half at the end of a line.
OTHER_HALF = re.compile("[-\u2010\u2011]?[^\\S\\n]*\\n\\s*([^\\W\\d_]+)")
FIRST_HALF = re.compile("([^\\W\\d_]+)[-\u2010\u2011]?[^\\S\\n]*$")


def _pictograph(c: str) -> bool:
    return ord(c) >= 0x1F000 or 0x2600 <= ord(c) < 0x27C0 or c == "\ufe0f"


def _script(c: str) -> str:
    o = ord(c)
    return "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "other"


def _kept(text: str, m: re.Match) -> bool:
    """Joiners that a sequence of emoji or a script that joins its letters needs."""
    c, before, after = m.group(), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    if c in "\u200c\u200d" and before and after:
        return (_pictograph(before) and _pictograph(after)) or (0x600 <= ord(before) < 0x1000 and 0x600 <= ord(after) < 0x1000)
    return c == "\u3000" and any(0x3000 < ord(x) < 0xFFF0 for x in before + after)


def plain(text: str) -> tuple[str, bool]:
    """The text with ordinary characters for all but look-alike letters, and whether it changed."""
    changed = False

    def one(m: re.Match) -> str:
        nonlocal changed
        if _kept(text, m):
            return m.group()
        changed = True
        return m.group().translate(PLAIN)

    out = ODD.sub(one, text) if ODD.search(text) else text
    if MARK.search(out):
        composed = unicodedata.normalize("NFC", out)
        changed |= composed != out
        out = composed
    return out, changed


@lru_cache(100_000)
def latin(token: str) -> str | None:
    """The all-Latin form of a token of mixed script, or None if it isn't one or a letter has no look-alike."""
    scripts = [_script(c) for c in token]
    if "latin" not in scripts or not {"greek", "cyrillic"} & set(scripts) or "other" in scripts:
        return None
    out = "".join(c if s == "latin" else LATIN_OF.get(c, "") for c, s in zip(token, scripts, strict=True))
    return out if len(out) == len(token) else None


@lru_cache(100_000)
def native(token: str) -> str | None:
    """The all-Greek or all-Cyrillic form of a token in which that script outnumbers Latin, or None if there is none."""
    scripts = [_script(c) for c in token]
    count = {s: scripts.count(s) for s in ("latin", "greek", "cyrillic")}
    script = max(("greek", "cyrillic"), key=count.get)
    if count["latin"] + count["greek"] + count["cyrillic"] < len(token) or not len(token) > count[script] > max(n for s, n in count.items() if s != script):
        return None
    out = "".join(c if s == script else BACK[script].get(LATIN_OF.get(c, c), "") for c, s in zip(token, scripts, strict=True))
    return out if len(out) == len(token) else None


def dominant(token: str) -> str:
    """The script of most letters of a token; Latin, if equally many."""
    scripts = [_script(c) for c in token]
    return max(("latin", "greek", "cyrillic"), key=scripts.count)


@lru_cache(100_000)
def forms(token: str) -> tuple[str, ...]:
    """The forms of a token of mixed script: in its dominant script, then in Latin letters."""
    a, b = latin(token), native(token) if dominant(token) != "latin" else None
    return tuple(x for x in (b, a) if x)


def folded(text: str) -> str:
    """A key for comparisons: tokens of mixed script of at least ``LONG`` letters in one script, Latin if they can be, words or not."""
    return MIXED.sub(lambda m: x if (x := latin(m.group()) or native(m.group())) and len(x) >= LONG else m.group(), text) if OTHER.search(text) else text


def readings(text: str, m: re.Match) -> list[tuple[str, set[str]]]:
    """Each form of a token of mixed script, in order, with the words of which one must be known: itself or, beside a line end, with its other half."""
    halves = []
    if (after := OTHER_HALF.match(text, m.end())) is not None:
        halves.append(("", after.group(1)))
    start = text.rfind("\n", 0, m.start())
    if start > 0 and not text[start : m.start()].strip():
        line = text[text.rfind("\n", 0, start) + 1 : start]
        if (before := FIRST_HALF.search(line)) is not None:
            halves.append((before.group(1), ""))
    out = []
    for x in forms(m.group()):
        wholes = {(next(iter(forms(a)), a) + x + next(iter(forms(b)), b)).lower() for a, b in halves}
        out.append((x, {x.lower()} | wholes))
    return out


def asked(text: str) -> set[str]:
    """Words on which the repair of a text's tokens of mixed script depends."""
    return {w for m in MIXED.finditer(text) for _, words in readings(text, m) for w in words} if OTHER.search(text) else set()


def repaired(text: str, words: set[str]) -> str:
    """The text with each token of mixed script in its first form that is known."""
    if not OTHER.search(text):
        return text
    return MIXED.sub(lambda m: next((x for x, any_of in readings(text, m) if any_of & words), m.group()), text)


SCAN = "tbl string, row_id bigint, garbled boolean, changed boolean, candidates array<string>"


def _scan(batches: Iterator[pd.DataFrame], model: Broadcast) -> Iterator[pd.DataFrame]:
    fix = model.value
    for batch in batches:
        rows = []
        for tbl, k, text in zip(batch["tbl"], batch["row_id"], batch["text"], strict=True):
            out, changed = plain(text)
            words = asked(out)
            if changed or words:
                garbled = tbl == "raw_pages" and fix.text(text)[1]
                rows.append((tbl, k, garbled, changed, sorted(words)))
        yield pd.DataFrame(rows, columns=["tbl", "row_id", "garbled", "changed", "candidates"])


def texts(pages: DataFrame, stories: DataFrame) -> DataFrame:
    a = pages.select(F.lit("raw_pages").alias("tbl"), F.col("page_id").alias("row_id"), F.col("raw_text").alias("text"))
    b = stories.select(F.lit("user_stories").alias("tbl"), F.col("story_uid").alias("row_id"), F.col("raw_text").alias("text"))
    return a.unionByName(b)


def vocabulary(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The words of ``of``(word) that stand somewhere in the corpus in letters of one script only.

    Tokens are told apart as they stand; only the distinct ones are cut into words.
    """
    tokens = rows.select(F.explode(F.split(F.translate("text", "\n\t", "  "), " ")).alias("token")).distinct()
    low, other = F.lower("token"), F.col("token").rlike(OTHER.pattern)
    words = F.when(other, F.regexp_extract_all(low, F.lit(ONE_SCRIPT), F.lit(0))).otherwise(F.split(low, VOCABULARY_WORD))
    return of.select("word").distinct().join(tokens.select(F.explode(words).alias("word")), "word", "left_semi")


def scanned(rows: DataFrame) -> DataFrame:
    """The texts that change or hold tokens of mixed script: few against all texts, so they are kept for their uses."""
    model = trained(rows.where("tbl = 'raw_pages'"), "text")
    return cut(rows.where(F.octet_length("text") > F.length("text")).mapInPandas(partial(_scan, model=model), SCAN))


def found(pages: DataFrame, stories: DataFrame) -> DataFrame:
    """(tbl, row_id) of the texts that a consistent form changes."""
    rows = texts(pages, stories)
    seen = scanned(rows).where(~F.col("garbled"))
    plainly = seen.where("changed").select("tbl", "row_id")
    mixed = seen.where("not changed").select("tbl", "row_id", F.explode("candidates").alias("word"))
    known = vocabulary(rows, mixed)
    return plainly.unionByName(mixed.join(known, "word", "left_semi").select("tbl", "row_id")).distinct()


def canonical(pages: DataFrame, stories: DataFrame) -> DataFrame:
    """(tbl, row_id, text): every text in its consistent form, tokens of mixed script repaired by the corpus vocabulary."""
    rows = texts(pages, stories)
    mixed = scanned(rows).select("tbl", "row_id", F.explode("candidates").alias("word"))
    known = mixed.join(vocabulary(rows, mixed), "word", "left_semi").groupBy("tbl", "row_id").agg(F.collect_set("word").alias("words"))
    joined = rows.join(known, ["tbl", "row_id"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [t if t is None or t.isascii() else repaired(plain(t)[0], set(w)) for t, w in zip(batch["text"], batch["words"], strict=True)]
            yield pd.DataFrame({"tbl": batch["tbl"], "row_id": batch["row_id"], "text": out})

    return joined.mapInPandas(fix, "tbl string, row_id bigint, text string")
