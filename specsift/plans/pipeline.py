"""The whole chain from pages to an issue report, each stage kept as tables that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specsift.operators import equations, issues, pages, similarity, structure
from specsift.sources.files import write_stage

STAGES = {2: "pages", 3: "markdown", 4: "equations", 5: "stories", 6: "issues"}


def story_rows(markdown: DataFrame) -> DataFrame:
    """(doc_id, story_seq, story_uid, raw_text) of the substantial blocks of cleaned pages, in reading order.

    story_uid follows from the document, page and block, so that a second run gives the same ids.
    """
    key = F.struct("doc_id", "page_num")
    b = structure.blocks(markdown.select(key.alias("k"), "text"), "k", "text")
    return b.select("k.doc_id", (F.shiftleft(F.col("k.page_num").cast("bigint"), 32) + F.col("block_no")).alias("story_seq"), F.xxhash64("k.doc_id", "k.page_num", "block_no").alias("story_uid"), F.col("block").alias("raw_text"))


def structured_stories(markdown: DataFrame) -> DataFrame:
    """Valid stories with the ids of those without one inferred, their type then contextual_information."""
    s = structure.structured(story_rows(markdown)).where("valid")
    ids = structure.inferred_ids(s).select(F.col("story_uid").alias("u"), F.col("id").alias("inferred"))
    x = s.join(ids, F.col("story_uid") == F.col("u"), "left")
    kind = F.when(F.col("inferred").isNotNull(), "contextual_information").otherwise(F.col("type"))
    return x.select("doc_id", "story_seq", "story_uid", F.coalesce("inferred", "id").alias("id"), kind.alias("type"), "role", "goal", "reason", "confidence", F.col("body").alias("raw_text"))


def run(spark: SparkSession, raw_pages: DataFrame, out: str, last: int = 6) -> dict[str, str]:
    """Run the stages up to ``last``; returns the folder of each table written.

    raw_pages has page_id, doc_id, page_num, raw_text and loaded_at. A stage starts from the tables before it, so a run
    can be taken up again after a lost driver by reading them.
    """
    at: dict[str, str] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        at[name] = f"{out}/{name}"
        write_stage(df, at[name])
        return spark.read.parquet(at[name])

    raw = keep("pages", pages.latest_pages(raw_pages))
    if last < 3:
        return at
    markdown = keep("markdown", pages.markdown_pages(raw.withColumn("loaded_at", F.lit(None).cast("timestamp"))))
    if last < 4:
        return at
    keep("equations", equations.equations(raw))
    if last < 5:
        return at
    stories = keep("stories", structured_stories(markdown))
    keep("criteria", structure.criteria(stories))
    rules = keep("rules", structure.ledger(stories))
    if last < 6:
        return at
    keep("ambiguities", issues.ambiguities(stories))
    conflicts = keep("conflicts", similarity.conflicts(rules))
    keep("gaps", issues.gaps(stories))
    keep("report", issues.report(stories, rules, conflicts))
    return at
