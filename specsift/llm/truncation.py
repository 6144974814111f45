"""Texts cut off by a field limit or a broken transfer: hidden limits by source first, then endings inspected.

Lengths are recomputed under alternative encodings and escapings (characters, UTF-8 and UTF-16 sizes, HTML entities,
JSON escapes, CR LF line ends).  Grouped by source and measure, a hidden limit is a length that far more distinct texts
share than the lengths around it; a source may have any number of limits, in any measures.  A text at a limit is cut
unless its ending is complete.  Of the other texts (broken transfers) the ending alone decides: a text is whole if its
last sentence ends, or if its last line is a closed or known form (table row, list item, label, reference, sign-off,
deliberate trailing off).  A last line without an end is tested against the corpus: if its last word isn't a word of the
corpus, or finished sentences start as it does, or a finished sentence stands before it in the same line, it was cut.
Words and sentence starts of all texts are counted; only the endings' own are kept, by semi joins.

One pass takes each text's lengths and ending down, one more the corpus words and sentence starts; both emit small rows.

Defined results: null, empty and blank texts are no cases; repeated texts are judged alike and count once for a limit;
texts of one line, in any script, are judged by their end; a null source is a source of its own; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specsift.runtime import cut

#: A hidden limit is a length with at least so many distinct texts, so many times as many as the lengths around it have on
#: average, and beyond so many deviations of their chance.
LIMIT_TEXTS, LIMIT_TIMES, DEVIATIONS, AROUND = 5, 8, 6, 64
SENTENCE_END = "[.!?。！？。।؟։။።][\"'”’»›«“)\\]]*$"
ENDS, CLOSERS = (".", "!", "?", "。", "！", "？", "।", "؟", "։"), ('"', "”", "’", "»", ")", "]")
OMISSION = "\\s*(…|\\.\\.\\.|\\[…\\]|\\[\\.\\.\\.\\]|\\(…\\)|\\(\\.\\.\\.\\)|\\[(cut|truncated|more|continued)\\]|\\((cut|truncated|more|continued)\\))$"
CLOSED = "^\\|.*\\|$|^\\(.*\\)$|^\\[.*\\]$|^([-=*_~#]{2,}).*\\1$|[\\p{So}\\p{Sk}]$|^\\W+$"
OPEN_ITEM = "^([-*•+–]|\\d+[.)])\\s|^[\\p{L}_ ]{1,30} = \\S+$|^\\[\\d+\\]|^ref\\."
#: White space and invisible marks that may trail a text.
BLANK = " \t\n\r\f\v\u001c\u001d\u001e\u001f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BREAK = "\\n+|(?<=[.!?…])[\"'”’»)\\]]*\\s+"


def _words(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(x), "\\d+", "0"), "[^\\p{L}\\p{M}\\p{N}'’=&-]+"), lambda w: w != "")


def _start(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


#: What a sentence begins with, up to the end of its third word.
THREE = "^[^\\p{L}\\p{M}\\p{N}'’=&-]*+(?:[\\p{L}\\p{M}\\p{N}'’=&-]++[^\\p{L}\\p{M}\\p{N}'’=&-]*+){0,3}+"
MEASURES = ("characters", "utf8", "utf16", "html_characters", "html_utf8", "json_characters", "json_utf8", "json_ascii", "crlf_characters", "crlf_utf8")


def lengths(text: str) -> Column:
    """The length of a text under each way in which a store may have counted it, in the order of MEASURES."""
    t = F.col(text)
    chars, bytes_ = F.length(t).cast("bigint"), F.octet_length(t).cast("bigint")
    number = lambda c: bytes_ - F.octet_length(F.replace(t, F.lit(c), F.lit("")))
    some = lambda pattern: F.when(bytes_ > chars, F.regexp_count(t, F.lit(pattern)).cast("bigint")).otherwise(F.lit(0))
    lines, doubles = number("\n"), number('"')
    quotes = doubles + number("\\")
    beyond, astral = some("[^\\x00-\\x7f]"), some("[\\x{10000}-\\x{10ffff}]")
    entities = number("&") * 4 + (number("<") + number(">")) * 3 + (doubles + number("'")) * 5
    return F.array(
        chars, bytes_, chars + astral, chars + entities, bytes_ + entities, chars + lines + quotes, bytes_ + lines + quotes,
        chars + lines + quotes + beyond * 5 + astral * 6, chars + lines, bytes_ + lines,
    )


def facts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, same, lengths, kind, word, start) of each text: a hash, its lengths and how it ends.

    kind is whole, cut, number (ends in a number and a full stop), item (a list item or reference, of which the last
    word is tested), prose (a finished sentence stands before the open one) or open (of which the last word and the
    start are tested: three words, two of a longer line without a mark, or all but the last of a shorter one).
    """
    t = F.rtrim("text", F.lit(BLANK))
    x = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "source", F.xxhash64("text").alias("same"), lengths("text").alias("lengths"), t.alias("t")).where("t <> ''")
    x = x.withColumn("line", F.trim(F.substring_index(F.col("t"), "\n", -1))).withColumn("marked", F.col("line").rlike(OMISSION))
    bare = F.when(F.col("marked"), F.regexp_replace(F.col("line"), OMISSION, "")).otherwise(F.col("line"))
    ended = F.col("line").rlike(SENTENCE_END)
    x = x.withColumn("parts", F.when(F.col("marked") | ~ended, F.split(bare, BREAK))).withColumn("tail", F.element_at("parts", -1)).withColumn("words", _words(F.col("tail")))
    before = F.exists(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), lambda s: s.rlike(SENTENCE_END) & (F.size(_words(s)) > 2))
    n = F.size("words")
    kind = (
        F.when(F.col("line").rlike("\\x{fffd}$"), "cut")
        .when(F.col("marked"), F.when(n < 4, "cut").otherwise("open"))
        .when(ended & F.col("line").rlike("(^|\\s)\\d+\\.$"), "number")
        .when(ended, "whole")
        .when(F.col("line").rlike(CLOSED), "whole")
        .when(F.col("line").startswith("|"), "cut")
        .when(F.col("line").rlike(OPEN_ITEM), "item")
        .when((n < 2) | F.col("line").rlike("[,;:–—-]$"), "cut")
        .when(before, "prose")
        .otherwise("open")
    )
    tested = F.when(F.col("marked") | (n == 4), F.lit(3)).when(n > 4, F.lit(2)).otherwise(n - 1)
    return x.select("doc_id", "source", "same", "lengths", kind.alias("kind"), F.element_at("words", -1).alias("word"), F.array_join(F.slice("words", 1, F.greatest(tested, F.lit(1))), " ").alias("start"))


def limits(documents: DataFrame) -> DataFrame:
    """(source, measure, limit_length, texts, around): every length that a hidden limit exposes."""
    return exposed(facts(documents))


def exposed(seen: DataFrame) -> DataFrame:
    """The limits, from facts; each text of a source counts once."""
    each = seen.groupBy("source", "same").agg(F.first("lengths").alias("lengths")).select("source", F.posexplode("lengths").alias("measure", "length"))
    n = each.groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("near", F.floor(F.col("length") / AROUND))
    near = n.groupBy("source", "measure", "near").agg(F.sum("n").alias("all")).select(F.col("source").alias("s"), F.col("measure").alias("m"), F.col("near").alias("k"), "all")
    x = n.where(F.col("n") >= LIMIT_TEXTS).join(near, F.col("source").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m")) & (F.col("near") == F.col("k")))
    x = x.withColumn("around", (F.col("all") - F.col("n")) / (AROUND - 1))
    odd = F.col("n") >= F.greatest(LIMIT_TIMES * F.col("around"), F.col("around") + DEVIATIONS * F.sqrt(F.col("around") + 0.5))
    name = F.get(F.array(*map(F.lit, MEASURES)), F.col("measure"))
    return x.where(odd).select("source", name.alias("measure"), F.col("measure").alias("measure_no"), F.col("length").alias("limit_length"), F.col("n").alias("texts"), "around")


def at_limit(seen: DataFrame, lim: DataFrame) -> DataFrame:
    """doc_id of the texts of which a length is a hidden limit of their source."""
    each = seen.select("doc_id", "source", F.posexplode("lengths").alias("measure_no", "length"))
    lim = lim.select(F.col("source").alias("of"), F.col("measure_no").alias("by"), "limit_length")
    return each.join(lim, each["source"].eqNullSafe(lim["of"]) & (each["measure_no"] == lim["by"]) & (each["length"] == lim["limit_length"]), "left_semi").select("doc_id").distinct()


def corpus(documents: DataFrame) -> DataFrame:
    """Distinct pieces: w and a token inside the texts, before the last one, or s and the first three words of a finished sentence."""

    def finished(s: Column) -> Column:
        last = F.right(s, F.lit(1))
        return (last.isin(*ENDS) & ~s.endswith("...")) | (last.isin(*CLOSERS) & s.rlike(SENTENCE_END) & ~s.rlike(OMISSION))

    tokens = F.split(F.rtrim("text", F.lit(BLANK)), "[ \n\t\r]")
    inner = F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda x: F.concat(F.lit("w"), x))
    starts = F.transform(F.filter(F.split("text", BREAK), finished), lambda s: F.concat(F.lit("s"), F.regexp_extract(s, THREE, 0)))
    return documents.where(F.length("text") > 0).select(F.explode(F.concat(inner, starts)).alias("piece")).distinct()


def met(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted(key) that the corpus holds: w and a word, or s and the first one, two or three words of a sentence."""
    words = _words(F.expr("substring(piece, 2)"))
    three = F.split(F.array_join(words, " "), " ")
    keys = F.when(F.col("piece").startswith("w"), F.transform(words, lambda w: F.concat(F.lit("w"), w))).otherwise(F.array(*[F.concat(F.lit("s"), _start(three, k)) for k in (1, 2, 3)]))
    return corpus(documents).select(F.explode(keys).alias("key")).join(wanted.distinct(), "key", "left_semi").distinct()


def steps(documents: DataFrame) -> DataFrame:
    """(doc_id, step) of the cut texts and what told: limit, ending, prose, word (unknown to the corpus) or start."""
    seen = cut(facts(documents))
    lim = exposed(seen)
    odd = seen.where("kind <> 'whole'")
    full = at_limit(odd, lim).select(F.col("doc_id").alias("full"))
    rest = cut(odd.join(full, F.col("doc_id") == F.col("full"), "left").select("doc_id", "kind", "word", "start", F.col("full").isNotNull().alias("at_limit")))
    ends = rest.where("not at_limit and kind in ('open', 'item')")
    word, start = F.concat(F.lit("w"), "word"), F.concat(F.lit("s"), "start")
    wanted = ends.select(word.alias("key")).unionByName(ends.where("kind = 'open'").select(start.alias("key")))
    held = cut(met(documents, wanted))
    tested = ends.join(held.select(F.col("key").alias("known")), word == F.col("known"), "left").join(held.select(F.col("key").alias("begun")), start == F.col("begun"), "left")
    by = F.when(F.col("known").isNull() & ~F.col("word").contains("0"), "word").when((F.col("kind") == "open") & F.col("begun").isNotNull(), "start")
    told = tested.select("doc_id", by.alias("step")).where("step is not null")
    plainly = rest.select("doc_id", F.when(F.col("at_limit"), "limit").when(F.col("kind") == "cut", "ending").when(F.col("kind") == "prose", "prose").alias("step")).where("step is not null")
    return plainly.unionByName(told)


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the texts that stop before their last word or sentence is complete."""
    return steps(documents).select("doc_id")


def sources(documents: DataFrame) -> DataFrame:
    """(source, texts, cut_texts, share, hidden_limits): how often each source truncates and the limits it shows."""
    flag = documents.select("doc_id", "source").join(found(documents).select(F.col("doc_id").alias("cut_id")).distinct(), F.col("doc_id") == F.col("cut_id"), "left")
    per = flag.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count("cut_id").alias("cut_texts"))
    lim = limits(documents).groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list(F.concat_ws(":", "measure", "limit_length"))).alias("hidden_limits"))
    return per.join(lim, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "texts", "cut_texts", (F.col("cut_texts") / F.col("texts")).alias("share"), "hidden_limits")
