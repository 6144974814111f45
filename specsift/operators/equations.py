"""Equation operators over page lines and LaTeX text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions import equations as Q
from specsift.functions import text as T

THRESHOLD = 5


def scored_lines(pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, page_num, line_no, line, before, after, likely, score); neighbours are lines of the page."""
    every = T.lines("raw_text")
    near = lambda i: F.coalesce(F.when(i >= 0, F.get("lines", i)), F.lit(""))
    rows = pages.select("page_id", "doc_id", "page_num", every.alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), near(i - 1).alias("before"), near(i + 1).alias("after"), F.concat_ws(" ", *[F.nullif(T.strip(near(i + k)), F.lit("")) for k in (-2, -1, 1, 2)]).alias("context")))
    x = rows.select("page_id", "doc_id", "page_num", F.explode(each).alias("x")).select("page_id", "doc_id", "page_num", "x.*")
    return x.where(F.length(T.strip("line")) >= 3).withColumn("likely", Q.is_equation("line")).withColumn("score", Q.score("line", "before", "after"))


def equations(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, text, normal, variables, ascii, context, score): lines that are equations by both measures."""
    e = scored_lines(pages).where(F.col("likely") & (F.col("score") >= THRESHOLD))
    core = Q.core_text("line")
    return e.select("page_id", "doc_id", "page_num", "line_no", core.alias("text"), Q.symbols(core).alias("normal"), F.array_join(Q.variables(Q.symbols(core)), ",").alias("variables"), Q.preprocess(core).alias("ascii"), F.substring("context", 1, 500).alias("context"), "score")


def distinct_equations(pages: DataFrame) -> DataFrame:
    """(doc_id, text, page_num, line_no, times): the first place of each equation in its document."""
    return equations(pages).groupBy("doc_id", "text").agg(F.min(F.struct("page_num", "page_id", "line_no")).alias("at"), F.count(F.lit(1)).alias("times")).select("doc_id", "text", "at.page_num", "at.page_id", "at.line_no", "times")


def equation_ids(pages: DataFrame) -> DataFrame:
    """(doc_id, eq_id, text): distinct equations numbered by place."""
    from specsift.operators.ordered import numbered

    n = numbered(distinct_equations(pages), "doc_id", ["page_num", "page_id", "line_no", "text"])
    return n.select("doc_id", F.format_string("%s_p%d_eq%d", "doc_id", "page_num", "number").alias("eq_id"), "text")


def every_equation(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, page_id, source, pos, text): LaTeX spans (source 0) and equation lines (1), each text at its first place in the document."""
    latex = pages.select("doc_id", "page_num", "page_id", F.lit(0).alias("source"), F.posexplode(Q.latex_parts("raw_text")).alias("pos", "t")).select("doc_id", "page_num", "page_id", "source", "pos", T.strip("t").alias("text"))
    lines = equations(pages).where(F.length("text") >= 3).select("doc_id", "page_num", "page_id", F.lit(1).alias("source"), F.col("line_no").alias("pos"), "text")
    first = latex.unionByName(lines).groupBy("doc_id", "text").agg(F.min(F.struct("page_num", "page_id", "source", "pos")).alias("at"))
    return first.select("doc_id", "at.*", "text")


def every_equation_ids(pages: DataFrame) -> DataFrame:
    """(doc_id, eq_id, kind, text): all equations numbered page by page, LaTeX before lines."""
    from specsift.operators.ordered import numbered

    n = numbered(every_equation(pages), "doc_id", ["page_num", "page_id", "source", "pos", "text"])
    return n.select("doc_id", F.format_string("%s_p%d_eq%d", "doc_id", "page_num", "number").alias("eq_id"), F.when(F.col("source") == 0, "latex_embedded").otherwise("text_heuristic").alias("kind"), "text")


def surroundings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, context): up to five sentences of the 300 characters on each side of every LaTeX span, 500 at most."""
    x = pages.select("page_id", "raw_text", F.posexplode(Q.latex_parts("raw_text")).alias("pos", "t")).withColumn("p", F.position(F.col("t"), F.col("raw_text")) - 1)
    start = F.greatest(F.col("p") - 300, F.lit(0))
    near = T.strip(F.substring("raw_text", start + 1, F.col("p") + F.length("t") + 300 - start))
    five = F.slice(F.split(near, r"(?<=[.!?])\s+"), 1, 5)
    return x.select("page_id", "pos", F.substring(F.array_join(five, " "), 1, 500).alias("context"))


def math_stats(texts: DataFrame, key: str) -> DataFrame:
    """(key, total_equations, unique_inline_vars, table_count) of Markdown texts(key, text).

    Counts of the mathematics that a document's record holds: display equations, distinct inline expressions, tables.
    """
    merged = Q.merge_blocks("text")
    display = F.size(F.regexp_extract_all(merged, F.lit(r"(?s)\$\$(.+?)\$\$"), 1))
    tables = F.size(F.regexp_extract_all("text", F.lit("(?d)" + L.MARKDOWN_TABLE), 1))
    counts = texts.groupBy(key).agg(F.sum(display).alias("total_equations"), F.sum(tables).alias("table_count"))
    inline = inline_math(texts.select(key, F.lit(0).alias("page"), "text"), key).groupBy(F.col(key).alias("k_")).agg(F.count(F.lit(1)).alias("unique_inline_vars"))
    return counts.join(inline, F.col(key).eqNullSafe(F.col("k_")), "left").select(key, "total_equations", F.coalesce("unique_inline_vars", F.lit(0)).cast("bigint").alias("unique_inline_vars"), "table_count")


def equation_stats(pages: DataFrame) -> DataFrame:
    """(doc_id, total, with_variables, share) over the distinct equations of each document."""
    d = distinct_equations(pages).withColumn("v", F.size(Q.variables(Q.symbols("text"))) > 0)
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("v").alias("with_variables")).withColumn("share", F.round(F.col("with_variables") * 100 / F.col("total"), 1))


def assembled(text: Column | str) -> Column:
    """Array of equations run together over lines that end with, or begin with, an operator."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, raw: Column) -> Column:
        x = T.strip(raw)
        goes_on = s["open"].isNotNull() & (x != "") & (s["open"].rlike(r"[+\-*/=(]$") | x.rlike(r"^[+\-*/=)]"))
        done = F.when(goes_on | s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        fresh = F.when(Q.is_equation(x), x)
        return F.struct(done.alias("done"), F.when(goes_on, F.concat(s["open"], F.lit(" "), x)).otherwise(fresh).alias("open"))

    return F.aggregate(T.lines(text), start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def inline_math(lines: DataFrame, key: str) -> DataFrame:
    """(key, expr, pages): inline expressions of lines(key, page, text) with the pages they stand on, first seen first."""
    inner = r"(?<!\$)\$(?!\$)(.*?)(?<!\$)\$(?!\$)"
    x = lines.select(key, "page", F.explode(F.regexp_extract_all("text", F.lit(inner), 1)).alias("expr")).select(key, "page", F.trim("expr").alias("expr")).where("expr <> ''").distinct()
    return x.groupBy(key, "expr").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ",").alias("pages"))
