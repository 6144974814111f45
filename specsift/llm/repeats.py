"""Lines that stand on page after page of one document: found by hash and document share, and taken out.

Two lines are the same if only letter case, white space, punctuation, symbols, underscores and digits tell them apart.
Marks and invisible signs count as symbols; digits are decimal ones, so that powers and fractions tell lines apart.  A line is keyed by two hashes (96 bits) of
its document, place and what is left of it, so that neither lines nor names are shuffled for the count.  Distinct page
numbers are counted for each key; a document of any size is spread over all tasks, since the distinct step groups by
page too and the count is combined before the shuffle.

Defined results: null texts, empty pages, null block arrays and blocks without text give no lines; a null doc_id is a
document of its own; a null page_num isn't a page; re-sent rows count each as rows but once as pages; lines left with
under three letters are never cases; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PAGES, SHARE = 5, 5  # at least 5 pages and a fifth of the document's pages
NO_LETTERS = r"[^A-Za-z\p{L}]+"
#: What doesn't tell lines apart beside letter case.
SET_ASIDE = r"[^a-z\p{L}\p{Nl}\p{No}]+"
THREE_LETTERS = r"\p{L}[^\p{L}]*\p{L}[^\p{L}]*\p{L}"


def rest(line: Column) -> Column:
    """What tells a line from others."""
    return F.regexp_replace(F.lower(line), SET_ASIDE, "")


def lines(pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, page_num, place, pos, h1, h2) of every line that may count, of texts and of blocks."""
    texts = F.transform(F.split("raw_text", "\n"), lambda x: rest(x))
    blocks = F.transform(F.coalesce("font_metadata.text", F.array().cast("array<string>")), lambda x: rest(F.coalesce(x, F.lit(""))))
    both = F.array(F.struct(F.lit("raw_text").alias("place"), F.coalesce(texts, F.array().cast("array<string>")).alias("keys")), F.struct(F.lit("font_metadata").alias("place"), blocks.alias("keys")))
    return (
        pages.select("page_id", "doc_id", "page_num", F.explode(both).alias("side"))
        .select("page_id", "doc_id", "page_num", "side.place", F.posexplode("side.keys").alias("at", "key"))
        .where((F.length("key") >= 3) & F.col("key").rlike(THREE_LETTERS))
        .select("page_id", "doc_id", "page_num", "place", (F.col("at") + 1).cast("int").alias("pos"), F.xxhash64("doc_id", "place", "key").alias("h1"), F.hash("key", "place", "doc_id").alias("h2"))
    )


def repeated(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(f1, f2, n) of the lines on enough pages, by their keys."""
    per_page = lines(pages).where(F.col("page_num").isNotNull()).select("h1", "h2", "page_num").distinct()
    return per_page.groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)


def found(pages: DataFrame, min_pages: int = MIN_PAGES, share: int = SHARE) -> DataFrame:
    """(page_id, place, pos) of every line that its document repeats too often."""
    f = repeated(pages, min_pages)
    x = lines(pages).select("page_id", "doc_id", "place", "pos", "h1", "h2")
    hit = x.join(f, (x["h1"] == f["f1"]) & (x["h2"] == f["f2"]))
    sizes = pages.where(F.col("page_num").isNotNull()).select("doc_id", "page_num").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).select(F.col("doc_id").alias("of"), "pages")
    return hit.join(sizes, hit["doc_id"].eqNullSafe(sizes["of"]) & (hit["n"] * share >= sizes["pages"])).select("page_id", "place", "pos")


def cleaned(pages: DataFrame) -> DataFrame:
    """(page_id, text, removed, blocks, removed_blocks): each page's lines and block texts without the repeated ones, and how many went.

    A page without blocks, or with a null array, has null or no blocks as before.
    """
    drop = found(pages).groupBy("page_id").agg(F.collect_set(F.when(F.col("place") == "raw_text", F.col("pos"))).alias("drop"), F.collect_set(F.when(F.col("place") == "font_metadata", F.col("pos"))).alias("drop_blocks"))
    without = lambda items, gone: F.filter(items, lambda _, i: ~F.array_contains(gone, i + 1))
    blocks = F.transform("font_metadata", lambda b: b["text"])
    joined = pages.select("page_id", "raw_text", blocks.alias("all_blocks")).join(drop.withColumnRenamed("page_id", "d_page"), F.col("page_id") == F.col("d_page"), "left")
    none = F.col("d_page").isNull()
    return joined.select(
        "page_id", F.when(none, F.col("raw_text")).otherwise(F.array_join(without(F.split("raw_text", "\n"), "drop"), "\n")).alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"),
        F.when(none, F.col("all_blocks")).otherwise(without("all_blocks", "drop_blocks")).alias("blocks"), F.coalesce(F.size("drop_blocks"), F.lit(0)).alias("removed_blocks"),
    )
