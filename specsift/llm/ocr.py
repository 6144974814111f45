"""Noise in the text of scanned pages: broken words, misread characters, running furniture, page numbers.

Words.  The vocabulary is counted over all pages that weren't scanned.  Tokens of scanned pages that it doesn't hold,
all halves of words broken at a line end, with the break between them, and neighbours that may be one word are put to a
character editor, an averaged perceptron over characters that keeps, deletes, replaces, inserts or joins lines: at a break
it takes the break out or leaves a hyphen.  It is trained on words of the vocabulary, broken anywhere and noised by the
known confusions of scanners.  A proposal counts if it is a word of the vocabulary and the known confusions explain the
token; the best rated one is taken.  Only distinct tokens are edited, and the answers are joined back to their lines.

Furniture.  Lines at the edges of a page are rated by an averaged perceptron over page-position and repetition features
(position, pages of the document and documents with the same letters, share of edge lines among them, numbered first
word, form; of numbers their form, what stands above and whether they are the page's).  It learns what a running header
and what a page number is from what the partial cleaning already removed; where nothing was cleaned it learns from
``taught_by_repetition``.

Bounds.  The editor is trained on at most ``EDITOR_WORDS`` frequent words and the line model on ``SAMPLE_PAGES`` pages.
Furniture is looked for among the ``EDGE`` lines next to the top and bottom of a page (see the README for what lies deeper).
The vocabulary is sent to the tasks as a filter only if it holds at most ``KNOWN_WORDS`` words; beyond that the tasks
send all tokens on and joins apply the same conditions.

Defined results: null and empty texts have no lines; pages without a method aren't scanned pages; without unscanned
pages there is no vocabulary and no word is judged; repeated pages are judged each; lines of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specsift.llm.encoding_pages import repair
from specsift.llm.lookalikes import INVISIBLE, folded, plain
from specsift.llm.perceptron import BREAK, Editor, Perceptron, noises
from specsift.llm.repeats import NO_LETTERS
from specsift.runtime import cut

EDITOR_WORDS, SAMPLE_PAGES, KNOWN_WORDS = 5_000, 3_000, 200_000
MIN_COUNT, MIN_SHARE = 3, 2e-6
EDGE = 4
REMOVED = 0.3
MARKS = "\u00ad¬\u2010\u2011–-"
MARK_SET = set(MARKS)
BROKEN = re.compile(rf"([^\W\d_][^\s{MARKS}]*?)[{MARKS}]\s*$")
FIRST = re.compile(r"\s*([^\s\-–—/]+)")
OUTER = ".,;:?()[]{}|*•“”„\"'’‘«»<>=…"
PARTS = re.compile(r"[-/–—]")
READ = re.compile(r"^(?=.*[a-z])[a-z0-9@!|$]+$")


def scanned(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("extraction_method").startswith("ocr"))


def vocabulary(raw: DataFrame) -> DataFrame:
    """(word, n) of the words of pages that weren't scanned, compounds with their hyphen and their parts.

    Tokens are counted as they stand; only the distinct ones are taken apart.
    """
    tokens = raw.where(~F.col("extraction_method").startswith("ocr")).select(F.explode(F.split(F.translate("raw_text", "\n\t", "  "), " ")).alias("token"))
    distinct = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words = F.split(F.lower(F.regexp_replace("token", f"[{INVISIBLE}]", "")), "[^\\p{L}-]+")
    counts = distinct.select(F.explode(words).alias("word"), "n").groupBy(F.regexp_replace("word", "^-+|-+$", "").alias("word")).agg(F.sum("n").alias("n")).where("word <> ''")
    parts = counts.select(F.explode(F.array_distinct(F.concat(F.array("word"), F.split("word", "-")))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return parts.join(F.broadcast(total), (F.col("n") >= MIN_COUNT) & (F.col("n") >= MIN_SHARE * F.col("total"))).select("word", "n")


SUSPECTS = "tbl string, page_id bigint, line_no int, next_no int, kind string, token string, at int, compound string"


def bare(token: str) -> str:
    token = token.strip(OUTER).lower()
    return token[:-2] if token[-2:] in ("'s", "’s") else token


def normal(text: str) -> str:
    return text.lower() if text.isascii() and "&" not in text else folded(plain(repair().text(text)[0])[0]).lower()


Token = tuple[str, str | None, tuple[str, ...]]


def token_of(token: str, known: frozenset[str] | None) -> Token:
    """(bare word, the word if a scanner may have read it, its parts that aren't known)."""
    word = bare(token)
    parts = tuple(p for p in PARTS.split(word) if READ.match(p) and (known is None or (p not in known and p.rstrip("!") not in known)))
    return word, word if READ.match(word) else None, parts


def suspects(text: str, known: frozenset[str] | None, seen: dict[str, Token]) -> Iterator[tuple[int, int, str, str, int, str]]:
    """(line_no, next_no, kind, token, at, compound) of words, halves broken at a line end and likely gaps.

    kind w: a word; g: two neighbours as one word; h: the halves at a line end with the break between them, and their
    hyphened form as compound; b: the second half as a word of its own, unless the compound is a word.
    """
    lines = normal(text).split("\n")
    skip = False
    for no, line in enumerate(lines, 1):
        tokens = line.split()
        begin, skip = (1 if skip and tokens else 0), False
        if line.rstrip()[-1:] in MARK_SET and (m := BROKEN.search(line)):
            nxt = next((k for k in range(no, min(no + 2, len(lines))) if lines[k].strip()), None)
            second = FIRST.match(lines[nxt]) if nxt is not None else None
            if second:
                a, b = PARTS.split(bare(m.group(1)))[-1], bare(second.group(1))
                if a and b and READ.match(a + b):
                    whole = bare(line[: m.end(1)].split()[-1])
                    yield no, nxt + 1, "h", a + BREAK + b, len(a), f"{whole}-{b}"
                    if READ.match(b) and (known is None or (b not in known and a + b not in known)):
                        yield nxt + 1, nxt + 1, "b", b, 0, a + b
                    skip = True
            tokens = tokens[:-1]
        before = None
        for token in tokens[begin:]:
            t = seen.get(token)
            if t is None:
                t = seen[token] = token_of(token, known)
            word, fit, parts = t
            for part in parts:
                yield no, no, "w", part, 0, ""
            if fit is not None and before is not None and token[0] not in OUTER:
                joined = before + fit
                if 5 <= len(joined) <= 32 and (known is None or joined in known or (before not in known and fit not in known)):
                    yield no, no, "g", joined, len(before), ""
            before = fit if fit is not None and token[-1] not in OUTER else None


def _scan(known: object) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = known.value if known is not None else None
        seen: dict[str, Token] = {}
        for batch in batches:
            rows = [(t, p, *x) for t, p, text in zip(batch["tbl"], batch["page_id"], batch["text"], strict=True) if text for x in suspects(text, words, seen)]
            if len(seen) > 200_000:
                seen.clear()
            yield pd.DataFrame(rows, columns=["tbl", "page_id", "line_no", "next_no", "kind", "token", "at", "compound"])

    return run


@lru_cache(2)
def editor(words: tuple[str, ...]) -> Editor:
    return Editor([w for w in words if "-" not in w], [w for w in words if "-" in w])


def corrections(tokens: DataFrame, words: DataFrame, sample: tuple[str, ...]) -> DataFrame:
    """(token, proposed, first, last, hyphened) of the distinct tokens that the editor turns into words of the vocabulary.

    hyphened tells broken words that keep a hyphen at the break.
    """
    model = tokens.sparkSession.sparkContext.broadcast(editor(sample)) if sample else None

    def proposals(token: str) -> list[tuple[str, str, int, int, bool, int]]:
        read = token.replace(BREAK, "")
        most, at = (1 if len(read) <= 4 else 2), token.find(BREAK)
        out = []
        for k, (w, a, b) in enumerate(model.value.propose(token)):
            # where lines were joined with a hyphen, both sides must be explained
            dash = at > 0 and w.count("-") > read.count("-")
            fits = any(noises(w[:i], token[:at], most) and noises(w[i + 1 :], token[at + 1 :], most) for i, c in enumerate(w) if c == "-") if dash else noises(w, read, most)
            if len(w) > 1 and fits:
                out.append((token, w, a, b, dash, k))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [x for t in batch["token"] if len(t) > 2 for x in proposals(t)]
            yield pd.DataFrame(rows, columns=["token", "proposed", "first", "last", "hyphened", "rank"])

    if model is None:
        return tokens.sparkSession.createDataFrame([], "token string, proposed string, first int, last int, hyphened boolean")
    found = tokens.select("token").distinct().mapInPandas(run, "token string, proposed string, first int, last int, hyphened boolean, rank int")
    real = found.join(words.select(F.col("word").alias("proposed")), "proposed", "left_semi")
    return real.groupBy("token").agg(F.min_by(F.struct("proposed", "first", "last", "hyphened"), "rank").alias("x")).select("token", "x.*")


def sifted(suspects: DataFrame, words: DataFrame) -> DataFrame:
    """The suspects that tasks which know the vocabulary would send on, by joins.

    A word is none if it is known without its last exclamation marks; a gap is none if a half is known and the whole isn't.
    """
    word = lambda name: words.select(F.col("word").alias(name))
    apart = F.concat(F.lit("\u0001"), "token")  # equals no word
    x = suspects.join(word("v"), F.col("token") == F.col("v"), "left")
    gap = (F.col("kind") == "g") & F.col("v").isNull()
    x = x.withColumn("bare", F.when(F.col("kind") == "w", F.regexp_replace("token", "!+$", "")).otherwise(apart))
    x = x.withColumn("left", F.when(gap, F.expr("substring(token, 1, at)")).otherwise(apart)).withColumn("right", F.when(gap, F.expr("substring(token, at + 1)")).otherwise(apart))
    for key in ("bare", "left", "right"):
        x = x.join(word("k"), F.col(key) == F.col("k"), "left_anti")
    return x.drop("v", "bare", "left", "right")


def judged(raw: DataFrame, cleaned: DataFrame | None) -> DataFrame:
    """Suspects with their verdict: (tbl, page_id, line_no, next_no, kind, token, at, word, first, last)."""
    words = cut(vocabulary(raw))
    spark = raw.sparkSession
    sample = tuple(r[0] for r in words.where("length(word) > 1").orderBy(F.desc("n"), "word").limit(EDITOR_WORDS).collect())
    known = spark.sparkContext.broadcast(frozenset(r[0] for r in words.select("word").collect())) if words.count() <= KNOWN_WORDS else None
    rows = texts(raw, cleaned)
    all_suspects = rows.mapInPandas(_scan(known), SUSPECTS)
    all_suspects = cut(all_suspects if known is not None else sifted(all_suspects, words))
    unknown = all_suspects.join(words.select(F.col("word").alias("token")), "token", "left_anti")
    fixed = corrections(unknown, words, sample).where("not hyphened").select(F.col("token").alias("t"), "proposed", "first", "last")
    plainly = words.select(F.col("word").alias("v"))
    compounds = words.select(F.col("word").alias("c"))
    x = all_suspects.join(plainly, F.col("token") == F.col("v"), "left").where("not (kind in ('w', 'b') and v is not null)")
    x = x.join(compounds, (F.col("compound") == F.col("c")) & F.col("kind").isin("h", "b"), "left_anti")
    x = x.join(fixed, (F.col("token") == F.col("t")) & F.col("v").isNull(), "left").where("v is not null or proposed is not null")
    return x.select("tbl", "page_id", "line_no", "next_no", "kind", "token", "at", F.coalesce("v", "proposed").alias("word"), F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last", F.lit(-1)).alias("last"))


def texts(raw: DataFrame, cleaned: DataFrame | None) -> DataFrame:
    """(tbl, page_id, doc_id, page_num, text) of scanned pages, as scanned and as cleaned."""
    pages = scanned(raw).select(F.lit("raw_pages").alias("tbl"), "page_id", "doc_id", "page_num", F.col("raw_text").alias("text"))
    if cleaned is None:
        return pages
    ids = scanned(raw).select("page_id")
    return pages.unionByName(cleaned.join(ids, "page_id", "left_semi").select(F.lit("cleaned_pages").alias("tbl"), "page_id", "doc_id", "page_num", F.col("cleaned_text").alias("text")))


# ---------------------------------------------------------------- furniture


def _key(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.lower(line), NO_LETTERS, ""))


def page_lines(rows: DataFrame, edges_only: bool = False) -> DataFrame:
    """Every line that isn't blank, with its place among them from the top (i) and from the bottom (j)."""
    numbered = F.transform(F.split("text", "\n"), lambda x, k: F.struct((k + 1).alias("line_no"), stripped(x).alias("line")))
    full = F.filter(numbered, lambda x: x["line"] != "")
    one = rows.select("tbl", "page_id", "doc_id", "page_num", full.alias("full")).withColumn("n", F.size("full"))
    above = lambda k: F.when(k > 0, F.get("full", k - 1)["line"])
    placed = F.transform("full", lambda x, k: F.struct(k.alias("i"), x["line_no"].alias("line_no"), x["line"].alias("line"), above(k).alias("above")))
    if edges_only:
        placed = F.filter(placed, lambda x: (x["i"] < EDGE) | (x["i"] >= F.col("n") - EDGE))
    each = one.select("tbl", "page_id", "doc_id", "page_num", "n", F.explode(placed).alias("x"))
    return each.select("tbl", "page_id", "doc_id", "page_num", "n", "x.i", (F.col("n") - 1 - F.col("x.i")).alias("j"), "x.line_no", "x.line", "x.above")


def _bucket(x: Column, *edges: float) -> Column:
    out = F.lit(len(edges))
    for k, e in reversed(list(enumerate(edges))):
        out = F.when(x < e, F.lit(k)).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("string")


#: The forms in which a line holds nothing but a number of up to four digits, or a Roman one.
NUMBER_FORMS = (
    ("plain", "^\\d{1,4}$"),
    ("signs", "^(\\[ ?\\d{1,4} ?\\]|\\( ?\\d{1,4} ?\\)|[-–—~·•*] ?\\d{1,4} ?[-–—~·•*])$"),
    ("of", "^\\d{1,4}( ?/ ?| of )\\d{1,4}$"),
    ("word", "(?i)^(page|pages|p\\.|pg\\.?|seite|s\\.|página|sheet) ?\\d{1,4}( ?(/|of|von|de|sur) ?\\d{1,4})?$"),
    ("roman", "^([ivxlc]{1,6}|[IVXLC]{1,6})$"),
)


def stripped(line: Column) -> Column:
    """Without white space at both ends; a run of it inside is one space."""
    plain = (F.octet_length(line) == F.length(line)) & ~F.contains(line, F.lit("  ")) & ~line.rlike("[\\x00-\\x1f]")
    return F.trim(F.when(plain, line).otherwise(F.regexp_replace(line, "[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+", " ")))


def number_form(line: Column) -> Column:
    out = F.lit("none")
    for name, pattern in reversed(NUMBER_FORMS):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def rated_lines(raw: DataFrame, rows: DataFrame) -> DataFrame:
    """Edge lines of scanned pages with their features."""
    pages = raw.select(F.lit("raw_pages").alias("tbl"), "page_id", "doc_id", "page_num", "extraction_method", F.col("raw_text").alias("text"))
    is_edge = (F.col("i") < EDGE) | (F.col("j") < EDGE)
    prefix = F.xxhash64(F.regexp_extract(F.lower("line"), "^\\W*(\\p{L}+ )\\d", 1))
    numbered = F.col("line").rlike("^\\W*\\p{L}+ \\d")
    per_doc = page_lines(pages, True).select("doc_id", _key(F.col("line")).alias("h"), "page_num").distinct().groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("pages"))
    doc_pages = raw.select("doc_id", "page_num").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("of_pages"))
    docs = per_doc.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("pages").alias("most"))
    ocr_lines = page_lines(scanned(raw).select(F.lit("").alias("tbl"), "page_id", "doc_id", "page_num", F.col("raw_text").alias("text")))
    place = ocr_lines.select(_key(F.col("line")).alias("h"), is_edge.cast("int").alias("e")).groupBy("h").agg(F.count(F.lit(1)).alias("lines"), F.avg("e").alias("edge"))
    shapes = ocr_lines.where(numbered).select(prefix.alias("p"), is_edge.cast("int").alias("e")).groupBy("p").agg(F.count(F.lit(1)).alias("p_lines"), F.avg("e").alias("p_edge"))
    x = page_lines(rows, True).withColumn("h", _key(F.col("line"))).withColumn("p", F.when(numbered, prefix))
    x = x.join(per_doc.select(F.col("doc_id").alias("d1"), F.col("h").alias("h1"), "pages"), (F.col("h") == F.col("h1")) & F.col("doc_id").eqNullSafe(F.col("d1")), "left")
    x = x.join(doc_pages.select(F.col("doc_id").alias("d2"), "of_pages"), F.col("doc_id").eqNullSafe(F.col("d2")), "left")
    x = x.join(docs.join(place, "h").select(F.col("h").alias("h3"), "docs", "most", "lines", "edge"), F.col("h") == F.col("h3"), "left")
    # lines without a prefix, which are most, are spread over all tasks by a key of their own
    x = x.withColumn("at", F.coalesce("p", F.xxhash64("page_id", "line_no", "tbl")))
    x = x.join(shapes.select(F.col("p").alias("p4"), "p_lines", "p_edge"), (F.col("at") == F.col("p4")) & F.col("p").isNotNull(), "left")
    repeated = (F.coalesce("pages", F.lit(1)) > 1) | (F.coalesce("docs", F.lit(1)) > 1) | (F.coalesce("p_edge", F.lit(0.0)) > 0.9)
    x = x.withColumn("repeated", repeated).withColumn("letters", F.length(F.regexp_replace("line", NO_LETTERS, "")))
    x = x.withColumn("form", number_form(F.col("line"))).withColumn("pos", F.when(F.col("i") < EDGE, F.concat(F.lit("T"), F.col("i"))).otherwise(F.concat(F.lit("B"), F.col("j"))))
    label = F.col("above").rlike("^\\p{Lu}[\\p{L}]*( \\p{Ll}+){0,3}$") & (F.col("n") > 2)
    under = F.when(label, "label").when(F.col("above").isNull(), "none").when(F.col("above").rlike("\\p{L}{3}"), "text").otherwise("other")
    own = F.when(F.regexp_extract("line", "\\d+", 0) == F.col("page_num").cast("string"), "own").otherwise("other")
    start = (
        F.when(F.col("line").rlike("^\\d+(\\.\\d+)+ "), "heading").when(F.col("line").rlike("^[-•*+] ?\\S*\\d+:|^[-•+] "), "item").when(F.col("line").rlike("^\\W*\\p{Ll}"), "lower")
        .when(numbered, "numbered").when(F.col("line").rlike("^\\W*\\p{Lu}"), "upper").otherwise("other")
    )
    of_line = {
        "rep": _bucket(F.col("pages"), 1, 2, 3, 5, 8), "share": _bucket(F.col("pages") / F.col("of_pages"), 0.02, 0.1, 0.2, 0.4), "docs": _bucket(F.col("docs"), 1, 2, 5, 20),
        "most": _bucket(F.col("most"), 2, 4, 8), "edge_share": F.when(F.col("lines") < 2, "few").otherwise(_bucket(F.col("edge"), 0.3, 0.6, 0.85, 0.97)),
        "shape": F.when(F.col("p").isNull(), "none").when(F.col("p_lines") < 5, "few").otherwise(_bucket(F.col("p_edge"), 0.5, 0.8, 0.95)), "start": start,
        "end": F.when(F.col("line").rlike("[.!?:;,]$"), "stop").otherwise("open"), "words": _bucket(F.size(F.split("line", " ")), 3, 5, 9, 13),
    }
    of_number = {"number": own, "under": under}
    no_number = F.col("form") == "none"
    x = x.withColumns({k: F.when(no_number, v) for k, v in of_line.items()} | {k: F.when(~no_number, v) for k, v in of_number.items()})
    joined = lambda *names: F.concat_ws("&", *(F.concat(F.lit(k + "="), F.col(k)) for k in names))
    line_pairs = (("edge_share", "start"), ("rep", "edge_share"), ("share", "edge_share"), ("rep", "start"), ("shape", "pos"), ("most", "start"), ("end", "words"), ("rep", "edge_share", "start"))
    number_pairs = (("form", "pos"), ("form", "number"), ("pos", "number"), ("form", "under"), ("form", "under", "number"), ("form", "under", "pos"))
    last = F.concat(F.lit("last="), F.when(F.col("j") == 0, F.col("under")).otherwise("inside"))
    line_features = F.array(F.lit("bias"), joined("pos"), *(joined(k) for k in of_line), *(joined(*names) for names in line_pairs))
    number_features = F.array(F.lit("bias"), last, joined("form"), joined("pos"), *(joined(k) for k in of_number), *(joined(*names) for names in number_pairs))
    # features are kept by their hashes: rows of lines are written once and scored from there
    features = F.transform(F.when(no_number, line_features).otherwise(number_features), lambda f: F.hash(f))
    return x.withColumn("features", features).withColumn("labelled", (F.col("j") == 0) & F.coalesce(F.col("under") == "label", F.lit(False)))


HEADER, NUMBER_CLASS, BODY_CLASS = "header", "page_number", "body"


def taught_by_cleaning(rated: DataFrame, raw: DataFrame, cleaned: DataFrame) -> list[tuple[list[int], str, tuple[str, str]]]:
    """Examples from the edge lines of pages from which cleaning removed furniture.

    Cleaning was partial: a kind of line is taken for a header if it is gone from at least the share ``REMOVED`` of
    these pages and stands elsewhere too (a line that stands once is gone because a repair changed it).  A number is a
    page number if it is gone from a page from which the page number was removed.
    """
    letters = lambda x: F.regexp_replace(x, NO_LETTERS, "")
    lines = F.split("cleaned_text", "\n")
    some = cleaned.where(F.arrays_overlap("removed_elements", F.array(F.lit(HEADER), F.lit(NUMBER_CLASS)))).select(
        F.col("page_id").alias("c_page"), "removed_elements", F.transform(lines, letters).alias("kept"), F.transform(lines, lambda x: stripped(x)).alias("kept_lines")
    )
    ids = some.select("c_page").join(scanned(raw).select("page_id"), F.col("c_page") == F.col("page_id"), "left_semi").orderBy(F.xxhash64("c_page"), "c_page").limit(SAMPLE_PAGES)
    sample = some.join(F.broadcast(ids), "c_page", "left_semi")
    x = rated.where("tbl = 'raw_pages'").join(sample, F.col("page_id") == F.col("c_page"))
    of_number = F.col("form") != "none"
    x = x.where(F.when(of_number, F.array_contains("removed_elements", NUMBER_CLASS)).otherwise((F.col("letters") >= 3) & F.array_contains("removed_elements", HEADER)))
    gone = F.when(of_number, ~F.array_contains("kept_lines", F.col("line"))).otherwise(~F.array_contains("kept", letters(F.col("line"))))
    got = sorted((list(r[0]), r[1], r[2], r[3], r[4]) for r in x.select("features", "repeated", F.coalesce("p", "h").alias("same"), gone.alias("gone"), of_number.alias("number")).collect())
    seen: dict[int, list[int]] = {}
    for _, _, same, gone_, number in got:
        if not number:
            n = seen.setdefault(same, [0, 0])
            n[0] += gone_
            n[1] += 1
    out = []
    for f, repeated, same, gone_, number in got:
        if number:
            out.append((f, NUMBER_CLASS if gone_ else BODY_CLASS, (NUMBER_CLASS, BODY_CLASS)))
        else:
            out.append((f, HEADER if repeated and seen[same][0] >= REMOVED * seen[same][1] else BODY_CLASS, (HEADER, BODY_CLASS)))
    return out


def taught_by_repetition(rated: DataFrame) -> list[tuple[list[int], str, tuple[str, str]]]:
    """Examples where nothing was cleaned: a header is a line on most pages of its document and nearly always at an edge,
    body a line that stands once or elsewhere as often; a page number is a decorated or worded number at the very edge, a
    bare one under a label is content.
    """
    label, outer = F.col("labelled"), (F.col("i") == 0) | (F.col("j") == 0)
    number = F.when(F.col("form") == "none", None).when(outer & ~((F.col("form") == "plain") & label), NUMBER_CLASS).otherwise(BODY_CLASS)
    line = F.when((F.col("form") != "none") | (F.col("letters") < 3), None).when((F.col("pages") * 2 >= F.col("of_pages")) & (F.col("edge") > 0.9), HEADER).when(~F.col("repeated") | (F.col("edge") < 0.5), BODY_CLASS)
    marked = rated.where("tbl = 'raw_pages'").select("page_id", "line_no", "features", number.alias("n"), line.alias("l")).where("n is not null or l is not null")
    rows = marked.orderBy(F.xxhash64("page_id", "line_no"), "page_id", "line_no").limit(SAMPLE_PAGES).collect()
    return [(list(r.features), r.n or r.l, (NUMBER_CLASS if r.n else HEADER, BODY_CLASS)) for r in rows]


def line_model(rated: DataFrame, raw: DataFrame, cleaned: DataFrame | None) -> dict[str, dict[int, float]]:
    """Feature weights of headers and of page numbers against the body."""
    examples = taught_by_cleaning(rated, raw, cleaned) if cleaned is not None else []
    kinds = {k for _, k, _ in examples}
    if not {HEADER, NUMBER_CLASS} <= kinds:
        examples += [x for x in taught_by_repetition(rated) if x[2][0] not in kinds]
    out = {}
    for kind in (HEADER, NUMBER_CLASS):
        w = Perceptron().fit([x for x in examples if x[2][0] == kind], epochs=8, strict=True).weights
        yes, no = w.get(kind, {}), w.get(BODY_CLASS, {})
        out[kind] = {f: yes.get(f, 0.0) - no.get(f, 0.0) for f in yes.keys() | no.keys()}
    return out


def furniture(raw: DataFrame, cleaned: DataFrame | None, rows: DataFrame) -> DataFrame:
    """(tbl, page_id, line_no, kind) of running headers and footers and of page numbers."""
    kept = ("tbl", "page_id", "line_no", "line", "i", "j", "features", "repeated", "letters", "form", "h", "p", "pages", "of_pages", "edge", "labelled")
    rated = cut(rated_lines(raw, rows).select(*kept))
    weights = line_model(rated, raw, cleaned)

    def score(kind: str) -> Column:
        pairs = [F.lit(x) for kv in sorted(weights[kind].items()) for x in kv]
        if not pairs:
            return F.lit(-1.0)
        table = F.create_map(*pairs)
        return F.aggregate("features", F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))

    number = F.col("form") != "none"
    kind = F.when(number & (score(NUMBER_CLASS) > 0), NUMBER_CLASS).when(~number & (F.col("letters") >= 3) & F.col("repeated") & (score(HEADER) > 0), HEADER)
    return rated.select("tbl", "page_id", "line_no", kind.alias("kind")).where("kind is not null")


def found(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(tbl, page_id, line_no, kind) of the noisy lines of scanned pages."""
    rows = texts(raw, cleaned)
    lines = cut(furniture(raw, cleaned, rows))
    x = cut(judged(raw, cleaned))
    hyphens = x.where("kind = 'h'").select("tbl", "page_id", "line_no", F.lit("hyphen").alias("kind"))
    here = x.where("kind <> 'h' or (first >= 0 and first < at)").select("tbl", "page_id", "line_no")
    there = x.where("kind = 'h' and last >= at").select("tbl", "page_id", F.col("next_no").alias("line_no"))
    misread = here.unionByName(there).distinct().join(lines.select("tbl", "page_id", "line_no"), ["tbl", "page_id", "line_no"], "left_anti")
    return lines.unionByName(hyphens).unionByName(misread.withColumn("kind", F.lit("misread"))).distinct()


def paragraphs(raw: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """(page_id, text): scanned pages as continuous paragraphs, furniture and page numbers taken out.

    Cleaned pages, where given, only teach what furniture is.
    """
    rows = texts(raw, None)
    drop = furniture(raw, cleaned, rows).groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    fixes = judged(raw, None).groupBy("page_id").agg(F.collect_list(F.struct("line_no", "next_no", "kind", "token", "at", "word")).alias("fixes"))
    joined = rows.join(drop.withColumnRenamed("page_id", "d"), F.col("page_id") == F.col("d"), "left").join(fixes.withColumnRenamed("page_id", "f"), F.col("page_id") == F.col("f"), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [rebuilt(t, set() if d is None else set(d), [] if f is None else list(f)) for t, d, f in zip(batch["text"], batch["drop"], batch["fixes"], strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"], "text": out})

    return joined.select("page_id", "text", "drop", "fixes").mapInPandas(run, "page_id bigint, text string")


def _like(model: str, word: str) -> str:
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def rebuilt(text: str | None, drop: set[int], fixes: list) -> str | None:
    """One page: corrections by line, broken words joined, lines run together up to a paragraph's end."""
    if text is None:
        return None
    lines = dict(enumerate(folded(plain(repair().text(text)[0])[0]).split("\n"), 1))
    joins: dict[int, str] = {}
    for f in fixes:
        no, token, word, at = f["line_no"], f["token"], f["word"], f["at"]
        if f["kind"] == "h":
            joins[no] = word
        elif f["kind"] == "g":
            lines[no] = re.sub(rf"(?i)(?<!\w){re.escape(token[:at])}\s+{re.escape(token[at:])}(?!\w)", lambda m, w=word: _like(m.group(), w), lines[no], count=1)
        else:
            lines[no] = re.sub(rf"(?i)(?<!\w){re.escape(token)}(?!\w)", lambda m, w=word: _like(m.group(), w), lines[no])
    out: list[str] = []
    carry = False
    for no, line in lines.items():
        body = line.strip()
        if no in drop:
            continue
        if not body:
            carry = False
            continue
        fresh = not carry or re.match(r"([-•*+]|\d+[.)])\s", body)
        if no in joins and (m := BROKEN.search(line)):
            head = line[: m.end(1)].strip()
            stem = re.split(r"[\s\-]", head)[-1]
            body = head[: len(head) - len(stem)] + _like(stem, joins[no]) + "\x00"
        if fresh or not out:
            out.append(body)
        elif out[-1].endswith("\x00"):
            rest = FIRST.match(body)
            tail = body[rest.end(1) :] if rest else ""
            kept = re.search(r"[^\w]*$", rest.group(1)).group() if rest else ""
            out[-1] = out[-1][:-1] + kept + tail
        else:
            out[-1] += " " + body
        carry = True
    return "\n\n".join(x.replace("\x00", "-") for x in out)
