"""Page operators: cleaning by line, running headers, references, layout, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions import text as T
from specsift.operators.ordered import last_seen

PAGE_HEIGHT, PAGE_WIDTH = 792.0, 612.0
HEADER_SHARE, FOOTER_SHARE, MIN_REPEATS = 0.08, 0.92, 3
COLUMN_GAP, HEADING_SIZE = 0.15, 13.0


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, page_num, line_no, line), lines counted from 1."""
    return pages.select("page_id", "doc_id", "page_num", F.posexplode(T.lines("raw_text")).alias("k", "line")).select("page_id", "doc_id", "page_num", (F.col("k") + 1).cast("int").alias("line_no"), "line")


def without_references(text: Column | str) -> Column:
    """The text without reference lists: from a heading on, as long as lines are entries or blank."""
    head = lambda x: x.rlike(L.REFERENCE_HEAD)
    entry = lambda x: T.any_match(x, L.REFERENCE) | (T.strip(x) == "")
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        drop = head(x) | (s["inside"] & entry(x))
        return F.struct(drop.alias("inside"), F.when(drop, s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept"))

    return F.array_join(F.aggregate(T.lines(text), start, step, lambda s: s["kept"]), "\n")


def repeated_headers(pages: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """(doc_id, key, n): block texts in the top or bottom strip of at least three blocks; the bottom count wins."""
    b = pages.select("doc_id", F.explode("font_metadata").alias("b")).select("doc_id", F.lower(T.strip("b.text")).alias("key"), "b.y0", "b.y1").where("length(key) between 3 and 100")
    top, bottom = F.col("y0") < height * HEADER_SHARE, F.col("y1") > height * FOOTER_SHARE
    n = b.groupBy("doc_id", "key").agg(F.count_if(top).alias("top"), F.count_if(~top & bottom).alias("bottom"))
    count = F.when(F.col("bottom") > 0, F.col("bottom")).otherwise(F.col("top"))
    return n.select("doc_id", "key", count.cast("bigint").alias("n")).where(F.col("n") >= MIN_REPEATS)


def running_headers(pages: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """(page_id, line_no) of the lines of pages that are repeated headers of their document."""
    x = page_lines(pages).select("page_id", "doc_id", "line_no", F.lower(T.strip("line")).alias("k"))
    r = repeated_headers(pages, height).select(F.col("doc_id").alias("d"), "key")
    return x.join(r, x["doc_id"].eqNullSafe(r["d"]) & (x["k"] == r["key"]), "left_semi").select("page_id", "line_no")


def cleaned(pages: DataFrame) -> DataFrame:
    """(page_id, text): the cleaning of one page by its own content, in order."""
    t = T.fix_ligatures("raw_text")
    t = without_references(T.without_lines(t, *L.PAGE_NUMBER))
    return pages.select("page_id", T.collapse_whitespace(T.dehyphenate(T.without_lines(t, L.TOC))).alias("text"))


def cleaning_stats(pages: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """(doc_id, pages, number_pages, toc_pages, reference_pages, header_lines) of what cleaning removes."""
    has = lambda p: F.exists(T.lines("raw_text"), lambda x: T.any_match(x, p))
    own = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(has(L.PAGE_NUMBER)).alias("number_pages"), F.count_if(has((L.TOC,))).alias("toc_pages"),
        F.count_if(F.exists(T.lines("raw_text"), lambda x: x.rlike(L.REFERENCE_HEAD))).alias("reference_pages"),
    )
    heads = running_headers(pages, height).join(pages.select("page_id", "doc_id"), "page_id").groupBy(F.col("doc_id").alias("d")).agg(F.count(F.lit(1)).alias("header_lines"))
    return own.join(heads, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "pages", "number_pages", "toc_pages", "reference_pages", F.coalesce("header_lines", F.lit(0)).cast("bigint").alias("header_lines"))


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, section): the last numbered heading on or before each page of its document."""
    heads = F.filter(T.lines("raw_text"), lambda x: x.rlike(r"^\d+\.\d+ [A-Z]"))
    p = pages.select("page_id", "doc_id", "page_num", F.when(F.size(heads) > 0, F.element_at(heads, -1)).alias("heading"))
    return last_seen(p, "doc_id", ["page_num", "page_id"], "heading", "section").select("page_id", "section")


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row for each (document, page number): the one loaded last."""
    return pages.groupBy("doc_id", "page_num").agg(F.max_by(F.struct("page_id", "raw_text"), F.struct("loaded_at", "page_id")).alias("x")).select("doc_id", "page_num", "x.*")


def markdown_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, text): pages cleaned as Markdown, each under its marker."""
    return latest_pages(pages).select("doc_id", "page_num", F.concat(F.lit("<!-- PAGE_"), F.col("page_num").cast("string"), F.lit(" -->\n"), T.clean_markdown("raw_text")).alias("text"))


def write_markdown(pages: DataFrame, to: str) -> None:
    """One folder for each document, its pages in order; no document is gathered into one row."""
    markdown_pages(pages).repartitionByRange("doc_id", "page_num").sortWithinPartitions("doc_id", "page_num").select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n\n").text(to)


def token_losses(pages: DataFrame) -> DataFrame:
    """(page_id, lost) of the pages whose Markdown cleaning loses a critical token."""
    return pages.select("page_id", F.array_sort(T.lost_tokens("raw_text", T.clean_markdown("raw_text"))).alias("lost")).where(F.size("lost") > 0).select("page_id", F.array_join("lost", ",").alias("lost"))


def _laid_out(pages: DataFrame) -> DataFrame:
    xs = F.array_sort(F.array_distinct(F.transform("font_metadata", lambda b: b["x0"])))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("xs") - 1, F.lit(1))), lambda i: F.coalesce(F.get("xs", i) - F.get("xs", i - 1), F.lit(0.0)))
    return pages.where(F.size("font_metadata") > 0).select("page_id", "font_metadata", xs.alias("xs")).select("page_id", "font_metadata", F.when(F.array_max(gaps) > COLUMN_GAP * PAGE_WIDTH, "two_column").otherwise("single_column").alias("layout"))


def columns(pages: DataFrame) -> DataFrame:
    """(page_id, layout): two_column where neighbouring left edges lie further apart than the gap."""
    return _laid_out(pages).select("page_id", "layout")


def assembled(pages: DataFrame) -> DataFrame:
    """(page_id, text): block texts in reading order.

    On pages of two columns the left half comes first, each half from the top; other pages are read from the top.
    """
    two = F.col("layout") == "two_column"
    order = F.transform("font_metadata", lambda b: F.struct((two & (b["x0"] >= PAGE_WIDTH / 2)).alias("right"), b["y0"].alias("y0"), b["x0"].alias("x0"), b["text"].alias("text")))
    return _laid_out(pages).select("page_id", F.array_join(F.transform(F.array_sort(order), lambda b: b["text"]), "\n").alias("text"))


def pages_of_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, page_num, line_no, page): the page marker last seen on or before each line of texts(doc_id, page_num, text), PAGE_UNKNOWN before the first."""
    each = texts.select("doc_id", "page_num", F.posexplode(T.lines("text")).alias("line_no", "line"))
    marked = each.select("doc_id", "page_num", "line_no", F.nullif(F.regexp_extract("line", L.PAGE_MARKER, 1), F.lit("")).alias("mark"))
    return last_seen(marked, "doc_id", ["page_num", "line_no"], "mark", "page").select("doc_id", "page_num", "line_no", F.coalesce("page", F.lit("PAGE_UNKNOWN")).alias("page"))


def font_stats(pages: DataFrame) -> DataFrame:
    """(page_id, blocks, headings, mean_size) of each page with blocks."""
    b = F.col("font_metadata")
    total = F.aggregate(b, F.lit(0.0), lambda s, x: s + F.coalesce(x["font_size"], F.lit(0.0)))
    return pages.where(F.size(b) > 0).select("page_id", F.size(b).cast("bigint").alias("blocks"), F.size(F.filter(b, lambda x: x["font_size"] >= HEADING_SIZE)).cast("bigint").alias("headings"), F.round(total / F.size(b), 1).alias("mean_size"))
