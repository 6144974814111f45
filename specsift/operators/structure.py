"""Requirement structuring: blocks of text into typed stories, acceptance criteria and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specsift.functions import requirements as R
from specsift.functions.text import strip

#: A block starts at a line feed before a hyphenated id, or at a blank line.
BLOCK = r"\n(?=\s*(?:[-*•]|\*\*|__)?\s*[A-Z]{2,5}(?:-[A-Z]+)?-\d{1,3})|\n\s*\n"
PARAGRAPH = r"\n\s*\n"


def blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_no, block): substantial blocks; a text of under five is cut into paragraphs instead."""
    cut = lambda pattern: F.filter(F.transform(F.split(text, pattern), strip), lambda b: F.length(b) > 15)
    fine, coarse = cut(BLOCK), F.filter(cut(PARAGRAPH), lambda b: b.rlike("[a-zA-Z]"))
    chosen = F.when(F.size(fine) < 5, coarse).otherwise(fine)
    return texts.select(key, F.posexplode(chosen).alias("block_no", "block"))


def structured(stories: DataFrame) -> DataFrame:
    """Every raw story text read again: id, type, role, condition, action, confidence, goal, reason, validity."""
    s = stories.select("story_uid", "doc_id", "story_seq", R.body("raw_text").alias("body")).where(F.length("body") > 0)
    s = s.withColumn("id", R.extract_id("body"))
    s = s.withColumn("type", R.type_of(F.col("id")))
    return s.select(
        "story_uid", "doc_id", "story_seq", "id", "type", R.extract_actor("body").alias("role"), R.extract_condition("body").alias("condition"), R.extract_action("body").alias("action"),
        R.confidence("body").alias("confidence"), R.goal_of("body", F.col("type")).alias("goal"), R.reason_of("body").alias("reason"), R.is_requirement("body").alias("valid"), "body",
    )


def logic(stories: DataFrame) -> DataFrame:
    """(story_uid, pos, condition, result) of every conditional clause."""
    return stories.select("story_uid", F.posexplode(R.logic_blocks(R.body("raw_text"))).alias("pos", "x")).select("story_uid", "pos", "x.condition", "x.result")


def criteria(stories: DataFrame) -> DataFrame:
    """(story_uid, doc_id, story_seq, id, pos, parent, level, type, text) of the acceptance criteria of every story."""
    return stories.select("story_uid", "doc_id", "story_seq", "id", F.explode(R.criteria_tree(R.body("raw_text"))).alias("x")).select("story_uid", "doc_id", "story_seq", "id", "x.*")


def criteria_lines(stories: DataFrame) -> DataFrame:
    """(story_uid, pos, line) of the bullet lines after the line that announces acceptance criteria."""
    return stories.select("story_uid", F.posexplode(R.criteria_lines(R.body("raw_text"))).alias("pos", "line"))


def synthetic_criteria(stories: DataFrame) -> DataFrame:
    """(story_uid, text, level, type, clauses): the criterion that stands for a valid story without any.

    A story gets one if it has a condition, a clause or a known type; its clauses are the story's own, or the one made of
    its condition and action.
    """
    s = structured(stories).where("valid").withColumn("l", F.size(R.logic_blocks("body"))).withColumn("t", F.size(R.criteria_tree("body")))
    none = s.where((F.col("t") == 0) & ((F.coalesce("condition", F.lit("")) != "") | (F.col("l") > 0) | (F.col("type") != "unknown")))
    own = F.when((F.col("l") == 0) & (F.coalesce("condition", F.lit("")) != "") & (F.coalesce("action", F.lit("")) != ""), F.lit(1)).otherwise(F.col("l"))
    return none.select("story_uid", F.col("body").alias("text"), F.lit(0).alias("level"), F.lit("requirement").alias("type"), own.alias("clauses"))


def inferred_ids(structured_: DataFrame) -> DataFrame:
    """(story_uid, id): stories without an id get INF-nnn, by how many valid stories of the document came before."""
    from specsift.operators.ordered import numbered

    n = numbered(structured_.where("valid"), "doc_id", ["story_seq", "story_uid"])
    return n.where("id = 'UNKNOWN'").select("story_uid", F.format_string("INF-%03d", "number").alias("id"))


def actors(stories: DataFrame) -> DataFrame:
    """(doc_id, actors): the distinct normalised roles of each document, sorted."""
    roles = stories.where("role is not null and trim(role) <> ''").select("doc_id", R.normalize_actor("role").alias("actor")).distinct()
    return roles.groupBy("doc_id").agg(F.array_sort(F.collect_list("actor")).alias("actors"))


def ledger(stories: DataFrame) -> DataFrame:
    """Rules of the stories: (doc_id, story_seq, story_uid, story_id, actor, condition, action, raw_text, confidence).

    A story's clauses are rules; a story without clauses and criteria is itself one, without a condition.  Contextual
    stories give no rules, nor do rules under a confidence of 0.6 or without an action.
    """
    kept = stories.where("coalesce(type, '') <> 'contextual_information' and not startswith(coalesce(id, ''), 'INF-')").withColumn("clauses", R.logic_blocks(R.body("raw_text")))
    base = kept.select("doc_id", "story_seq", "story_uid", F.col("id").alias("story_id"), F.trim("role").alias("actor"), "raw_text", "clauses", "goal", "confidence")
    ruled = base.select("*", F.posexplode("clauses").alias("rule_pos", "x")).select("doc_id", "story_seq", "story_uid", "story_id", "actor", "rule_pos", "x.condition", F.col("x.result").alias("action"), "raw_text", F.lit(0.85).alias("confidence"))
    plain = base.where((F.size("clauses") == 0) & (F.size(R.criteria_lines(R.body("raw_text"))) == 0)).select("doc_id", "story_seq", "story_uid", "story_id", "actor", F.lit(0).alias("rule_pos"), F.lit(None).cast("string").alias("condition"), F.col("goal").alias("action"), "raw_text", F.coalesce("confidence", F.lit(0.8)).alias("confidence"))
    return ruled.unionByName(plain).where("confidence >= 0.6 and action <> ''")


def model_ledger(models: DataFrame) -> DataFrame:
    """Rules of the structured models, from their nested logic blocks, in the ledger's form.

    A logic block belongs to the story that it stands in.  The document is document_name, story_seq the story's position
    and story_uid the model's id; rule_pos is the block's path, so that the order is that of the model.
    """
    from specsift.operators import nested

    own, block = (lambda k: F.col("story")[k]), (lambda k: F.col("payload")[k])
    kept = nested.owned_blocks(models).where((F.coalesce(own("type"), F.lit("")) != "contextual_information") & ~F.coalesce(own("id"), F.lit("")).startswith("INF-") & (F.coalesce(block("type"), F.lit("conditional")) == "conditional"))
    rules = kept.select(
        F.col("document_name").alias("doc_id"), "story_seq", F.col("model_id").alias("story_uid"), F.coalesce(own("id"), F.lit("UNKNOWN")).alias("story_id"), F.trim(own("role")).alias("actor"), F.col("path").alias("rule_pos"),
        block("condition").alias("condition"), F.get_json_object(block("action"), "$.description").alias("action"), own("raw_text").alias("raw_text"), F.coalesce(block("confidence").try_cast("double"), F.lit(0.85)).alias("confidence"),
    )
    return rules.where("confidence >= 0.6 and action <> ''")
