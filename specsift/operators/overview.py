"""Overviews of documents and users: counts, missing actors, hints, latest state, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions import requirements as R
from specsift.operators import issues, structure


def documents(stories: DataFrame, rules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, stories, actors, issues, has_issues) of each document with stories; ``found`` as in the report."""
    n = stories.groupBy("doc_id").agg(F.count(F.lit(1)).alias("stories"))
    a = structure.actors(stories).select(F.col("doc_id").alias("da"), F.size("actors").cast("bigint").alias("actors"))
    r = issues.report(stories, rules, found).select(F.col("doc_id").alias("dr"), "issues")
    x = n.join(a, F.col("doc_id").eqNullSafe(F.col("da")), "left").join(r, F.col("doc_id").eqNullSafe(F.col("dr")), "left")
    return x.select("doc_id", "stories", F.coalesce("actors", F.lit(0)).cast("bigint").alias("actors"), F.coalesce("issues", F.lit(0)).cast("bigint").alias("issues")).withColumn("has_issues", F.col("issues") > 0)


def missing_actors(stories: DataFrame) -> DataFrame:
    """(doc_id, actor): the common actors that no role of a document holds."""
    roles = stories.where("role is not null").groupBy("doc_id").agg(*[F.max(F.contains(F.lower("role"), F.lit(a))).alias(a) for a in L.COMMON_ACTORS])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("actor"), F.col(a).alias("there")) for a in L.COMMON_ACTORS]))
    return roles.select("doc_id", pairs.alias("x")).where("not x.there").select("doc_id", "x.actor")


def hints(stories: DataFrame, top: int = 4) -> DataFrame:
    """(doc_id, rank, story_uid, hint): the first four hints of each document, a report of its own."""
    vague = F.coalesce(*[F.when(F.contains(F.lower("goal"), F.lit(v)), F.lit(v)) for v in L.VAGUE_GOAL_VERBS])
    none = F.when(F.size(R.criteria_lines(R.body("raw_text"))) == 0, F.lit("no criteria"))
    x = stories.select("doc_id", "story_seq", "story_uid", F.posexplode(F.array(F.when(vague.isNotNull(), F.concat(F.lit("vague: "), vague)), none)).alias("k", "hint")).where("hint is not null")
    w = Window.partitionBy("doc_id").orderBy("story_seq", "story_uid", "k")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("doc_id", "rank", "story_uid", "hint")


def context(stories: DataFrame, top: int = 10) -> DataFrame:
    """(doc_id, context): the goals of the first ten stories of each document, in order."""
    w = Window.partitionBy("doc_id").orderBy("story_seq", "story_uid")
    first = stories.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    texts = F.array_sort(F.collect_list(F.struct("k", F.coalesce("goal", "raw_text").alias("t"))))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(texts, lambda x: x["t"]), ", ").alias("context"))


def latest_state(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type, ts): the last event of each user."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", "x.event_id", "x.event_type", "x.ts")


def history(events: DataFrame, keep: int = 10) -> DataFrame:
    """(user_id, rank, event_id): the last ten events of each user, a bounded history."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("user_id", "rank", "event_id")


def pseudo_stories(documents_: DataFrame) -> DataFrame:
    """(doc_id, goal): any text as one story, whose goal is its first 1,200 characters."""
    return documents_.where("text is not null").select("doc_id", F.substring("text", 1, 1200).alias("goal"))
