"""Ingest and triage: identity, duplicates, document types, extraction paths, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions import text as T
from specsift.operators.pages import latest_pages

MIN_CHARS, SAMPLE_PAGES, TYPE_PAGES, FLAG_PAGES, COVERAGE = 100, 3, 5, 10, 0.7
SYMBOL_LIMIT = 50


def manifest(raw: DataFrame) -> DataFrame:
    """One row for each document: the one loaded last."""
    return raw.groupBy("doc_id").agg(F.max_by(F.struct("file_path", "doc_type", "page_count", "hash"), F.struct("loaded_at", "file_path")).alias("x")).select("doc_id", "x.*")


def first_of_content(documents: DataFrame) -> DataFrame:
    """(doc_id, first_id, is_duplicate): the smallest id with the same text; null texts are no duplicates.

    The content hash is aggregated before the join, so that copies meet their class and not each other.
    """
    h = documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("h", "g")
    return h.join(first, F.col("h") == F.col("g"), "left").select("doc_id", F.coalesce("first_id", "doc_id").alias("first_id")).withColumn("is_duplicate", F.col("first_id") != F.col("doc_id"))


def not_registered(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents whose content hash isn't in the registry(hash) yet."""
    return documents.withColumn("hash", F.sha2("text", 256)).join(registry, "hash", "left_anti")


def document_types(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, kind): the first type with a keyword in the path or the first five pages, else textbook."""
    def marks(x: object) -> list:
        return [F.max(T.contains_any(x, words)).alias(kind) for kind, words in L.DOC_TYPES]

    early = latest_pages(pages.where(F.col("page_num") <= TYPE_PAGES)).groupBy(F.col("doc_id").alias("d")).agg(*marks(F.lower("raw_text")))
    m = manifest(raw).select("doc_id", F.lower("file_path").alias("path")).join(early, F.col("doc_id") == F.col("d"), "left")
    kind = F.lit("textbook")
    for name, words in reversed(L.DOC_TYPES):
        kind = F.when(T.contains_any("path", words) | F.coalesce(F.col(name), F.lit(False)), name).otherwise(kind)
    return m.select("doc_id", kind.alias("kind"))


def extraction_paths(pages: DataFrame) -> DataFrame:
    """(doc_id, path): digital if the first three pages hold a hundred characters each on average."""
    p = latest_pages(pages.where(F.col("page_num") <= SAMPLE_PAGES))
    return p.groupBy("doc_id").agg(F.avg(F.length(T.strip("raw_text"))).alias("mean")).select("doc_id", F.when(F.col("mean") >= MIN_CHARS, "digital").otherwise("ocr").alias("path"))


def flags(pages: DataFrame) -> DataFrame:
    """(doc_id, symbols, high_equation_density, multi_column) over the first ten pages of each document."""
    p = pages.where(F.col("page_num") <= FLAG_PAGES).groupBy("doc_id", "page_num").agg(F.max_by(F.struct("raw_text", "font_metadata"), F.struct("loaded_at", "page_id")).alias("x")).select("doc_id", "page_num", "x.*")
    xs = F.transform("font_metadata", lambda b: b["x0"])
    wide = (F.col("page_num") == 1) & (F.array_max(xs) - F.array_min(xs) > 0.4 * 612.0)
    n = p.groupBy("doc_id").agg(F.sum(F.regexp_count("raw_text", F.lit("[=∫∑√∂±×÷≤≥≈αβγδεμφ]"))).alias("symbols"), F.max(F.coalesce(wide, F.lit(False))).alias("multi_column"))
    return n.select("doc_id", F.col("symbols").cast("bigint").alias("symbols"), (F.col("symbols") > SYMBOL_LIMIT).alias("high_equation_density"), "multi_column")


def coverage(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, extracted, share, enough): pages extracted against pages declared."""
    have = pages.select("doc_id", "page_num").distinct().groupBy(F.col("doc_id").alias("d")).agg(F.count(F.lit(1)).alias("extracted"))
    m = manifest(raw).join(have, F.col("doc_id") == F.col("d"), "left").select("doc_id", "page_count", F.coalesce("extracted", F.lit(0)).cast("bigint").alias("extracted"))
    share = F.when(F.col("page_count") > 0, F.col("extracted") / F.col("page_count"))
    return m.select("doc_id", "page_count", "extracted", share.alias("share"), ((F.col("extracted") > 0) & (F.coalesce(share, F.lit(1.0)) >= COVERAGE)).alias("enough"))


def extract_stats(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, mean_chars, thin) of the extracted text."""
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("raw_text")).cast("bigint").alias("chars"))
    return n.select("doc_id", "pages", "chars", (F.col("chars") / F.col("pages")).alias("mean_chars"), (F.col("chars") / F.col("pages") < 200).alias("thin"))
