"""Issues of requirement stories: ambiguities, conflicts, gaps, and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions import requirements as R
from specsift.functions.text import col, contains_any, strip
from specsift.operators.ordered import numbered
from specsift.operators.structure import criteria
from specsift.runtime import cut

KEYS = ("doc_id", "story_seq", "story_uid", "story_id")


def story_texts(stories: DataFrame) -> DataFrame:
    """(doc_id, story_seq, story_uid, story_id, src, text): goal, reason and criteria of a story in scan order."""
    own = stories.select("doc_id", "story_seq", "story_uid", F.col("id").alias("story_id"), F.posexplode(F.array("goal", "reason")).alias("src", "text"))
    acs = criteria(stories).select("doc_id", "story_seq", "story_uid", F.col("id").alias("story_id"), (F.col("pos") + 2).alias("src"), "text")
    return own.unionByName(acs).where("text <> ''")


def vague_terms(text: Column | str) -> Column:
    """Array of (rank, term, category, severity) of the vague terms that a text holds, as substrings."""
    low = F.lower(col(text))
    terms = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(t).alias("term"), F.lit("vague_term").alias("category"), F.lit(s).alias("severity")) for i, (t, s) in enumerate(L.VAGUE_TERMS)])
    return F.filter(terms, lambda x: F.contains(low, x["term"]))


def weak_verbs(text: Column | str) -> Column:
    """The same of weak verbs, as words, unless a quotation mark stands before the verb's first letters."""
    low = F.lower(col(text))
    out = []
    for i, v in enumerate(L.WEAK_VERBS):
        free = ~F.contains(F.substring(col(text), 1, F.greatest(F.locate(v, low) - 1, F.lit(0))), F.lit('"'))
        out.append(F.when(low.rlike(rf"\b{v}\b") & free, F.struct(F.lit(100 + i).alias("rank"), F.lit(v).alias("term"), F.lit("weak_verb").alias("category"), F.lit("low").alias("severity"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def ambiguity_hits(stories: DataFrame) -> DataFrame:
    """One row for each term in each text, and for each user story without a reason."""
    hits = story_texts(stories).select(*KEYS, "src", "text", F.explode(F.concat(vague_terms("text"), weak_verbs("text"))).alias("x")).select(*KEYS, "src", "text", "x.*")
    missing = stories.where("type = 'user_story' and coalesce(reason, '') = ''").select(
        "doc_id", "story_seq", "story_uid", F.col("id").alias("story_id"), F.lit(1_000_000).alias("src"), F.concat_ws(": ", "id", F.coalesce("goal", F.lit("N/A"))).alias("text"),
        F.lit(0).alias("rank"), F.lit("(missing)").alias("term"), F.lit("missing_reason").alias("category"), F.lit("low").alias("severity"),
    )
    return hits.unionByName(missing)


def _first(hits: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The first row of each key; combined before the shuffle."""
    return hits.groupBy(*keys).agg(F.min(F.struct(*order, *payload)).alias("x")).select(*keys, "x.*")


def ambiguities(stories: DataFrame) -> DataFrame:
    """The first hit of each (document, story id, term, category), numbered AMB-nnn within the document."""
    first = _first(ambiguity_hits(stories), ["doc_id", "story_id", "term", "category"], ["story_seq", "story_uid", "src", "rank"], ["severity", "text"])
    n = numbered(first, "doc_id", ["story_seq", "story_uid", "src", "rank"])
    return n.select("doc_id", F.format_string("AMB-%03d", "number").alias("issue_id"), "story_id", "term", "category", "severity", "text")


def explained(found: DataFrame) -> DataFrame:
    """Ambiguities with why their term is one and what to write instead."""
    advice = F.create_map(*[x for t, (why, instead) in L.ADVICE.items() for x in (F.lit(t), F.struct(F.lit(why).alias("why"), F.lit(instead).alias("instead")))])
    a = F.element_at(advice, F.col("term"))
    return found.select("*", a["why"].alias("explanation"), a["instead"].alias("rewrite"))


def representatives(rules: DataFrame) -> DataFrame:
    """One rule for each (document, story id, condition, action), with how many rules it stands for."""
    keyed = rules.withColumn("cond_key", strip(F.replace(F.lower("condition"), F.lit("%"), F.lit(" percent")))).withColumn("core", R.core_action("action"))
    return keyed.groupBy("doc_id", "story_id", "cond_key", "action").agg(F.min(F.struct("story_seq", "story_uid", "rule_pos")).alias("at"), F.first("core").alias("core"), F.min("condition").alias("condition"), F.min("actor").alias("actor"), F.min_by("raw_text", F.struct("story_seq", "story_uid", "rule_pos")).alias("raw"), F.count(F.lit(1)).alias("members"))


def classes(reps: DataFrame, *by: str) -> DataFrame:
    """Of representatives, one row for each (document, condition, class of action, action, and ``by``): its first rule, another story than the first's if there is one, and how many rules and stories share it."""
    r = reps.withColumn("module", R.module_of("story_id"))
    c = r.groupBy("doc_id", "cond_key", "core", "action", *by).agg(F.min(F.struct("at", "story_id", "raw")).alias("first"), F.min("story_id").alias("least"), F.max("story_id").alias("most"), F.sum("members").alias("rules"), F.count(F.lit(1)).alias("stories"))
    other = F.when(F.col("most") != F.col("first.story_id"), F.col("most")).when(F.col("least") != F.col("first.story_id"), F.col("least"))
    return c.withColumn("other", other).drop("least", "most")


def stories_of(first_a: Column | str, other_a: Column | str, first_b: Column | str, other_b: Column | str) -> Column:
    """struct(a, b): two different stories of two classes, their first ones if these differ; null if both hold the same one only."""
    first_a, other_a, first_b, other_b = map(col, (first_a, other_a, first_b, other_b))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return F.when(first_a != first_b, pair(first_a, first_b)).when(other_b.isNotNull(), pair(first_a, other_b)).when(other_a.isNotNull(), pair(other_a, first_b))


def opposed(rules: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """Pairs of action classes of one document that one condition, or two that meet, permit and deny.

    Rules with one condition and action are one class, so that copies aren't paired with each other; a pair of classes
    names two different stories, the first ones if these differ, and a class's members are its rules.  cond_key is the
    condition of the permitting class, cond_key_b that of the denying one.  ``reps`` are the rules' representatives, if
    they are at hand; else they are kept here, since classes and the conditions that meet both come from them.
    """
    from specsift.operators.similarity import meetings

    reps = cut(representatives(rules)) if reps is None else reps
    c = classes(reps).where("cond_key <> '' and core in ('permit', 'deny')")
    m = meetings(reps).select(F.col("doc_id").alias("md"), F.col("cond_key").alias("mk"), "meet")
    c = c.join(m, c["doc_id"].eqNullSafe(m["md"]) & (c["cond_key"] == m["mk"]))
    a = c.where("core = 'permit'").select("doc_id", "cond_key", "meet", F.col("action").alias("permits"), F.col("first.story_id").alias("first_a"), F.col("other").alias("other_a"), F.col("rules").alias("rules_a"))
    b = c.where("core = 'deny'").select(F.col("doc_id").alias("d"), F.col("cond_key").alias("cond_key_b"), F.col("meet").alias("met"), F.col("action").alias("denies"), F.col("first.story_id").alias("first_b"), F.col("other").alias("other_b"), F.col("rules").alias("rules_b"))
    pairs = a.join(b, a["doc_id"].eqNullSafe(b["d"]) & (a["meet"] == b["met"])).where("startswith(meet, '=') or cond_key <> cond_key_b").withColumn("s", stories_of("first_a", "other_a", "first_b", "other_b"))
    return pairs.where("s is not null").select("doc_id", "cond_key", "cond_key_b", "permits", "denies", F.col("s.a").alias("story_a"), F.col("s.b").alias("story_b"), "rules_a", "rules_b")


def overlapping(rules: DataFrame) -> DataFrame:
    """Classes of numeric conditions of one document that overlap: one variable, one direction, at least two stories.

    (doc_id, variable, direction, stories, conditions, low, high): every two members overlap, so a class stands for its
    pairs; conditions of a number and a unit have no direction and overlap with none.
    """
    c = rules.select("doc_id", "story_id", R.condition_logic("condition").alias("c")).where("c.operator in ('<', '<=', '>', '>=')")
    k = c.select("doc_id", "story_id", "c.variable", F.substring("c.operator", 1, 1).alias("direction"), "c.value").distinct()
    n = k.groupBy("doc_id", "variable", "direction").agg(F.countDistinct("story_id").alias("stories"), F.countDistinct("value").alias("conditions"), F.min("value").alias("low"), F.max("value").alias("high"))
    return n.where("stories > 1")


def rule_pairs(rules: DataFrame) -> DataFrame:
    """(doc_id, cond_key, rules, stories, pairs): how many pairs of rules of different stories share a condition.

    Pairs aren't emitted: of n rules, n_s of each story, (n² - sum n_s²) / 2 pairs differ in their story.
    """
    r = representatives(rules).where("cond_key <> ''").groupBy("doc_id", "cond_key", "story_id").agg(F.sum("members").alias("n"))
    n = r.groupBy("doc_id", "cond_key").agg(F.sum("n").alias("rules"), F.count(F.lit(1)).alias("stories"), F.sum(F.col("n") * F.col("n")).alias("own"))
    return n.select("doc_id", "cond_key", "rules", "stories", F.expr("(rules * rules - own) div 2").alias("pairs")).where("pairs > 0")


def numeric_contradictions(rules: DataFrame) -> DataFrame:
    """Conditions of one document under which actions of different stories name numbers that contradict each other.

    (doc_id, cond_key, variable, stories, amounts, low, high), one row for each class of such actions.  Equal numbers
    agree; of bounds, only an upper one below a lower one is no contradiction.
    """
    key = strip(F.replace(F.lower("condition"), F.lit("%"), F.lit(" percent")))
    a = rules.select("doc_id", "story_id", key.alias("cond_key"), R.condition_logic("action").alias("a")).where("a is not null and cond_key <> ''")
    d = a.select("doc_id", "story_id", "cond_key", "a.variable", "a.operator", "a.value").distinct()
    of = lambda op: F.col("operator") == op
    n = d.groupBy("doc_id", "cond_key", "variable").agg(
        F.countDistinct("story_id").alias("stories"), F.countDistinct("value").alias("amounts"), F.min("value").alias("low"), F.max("value").alias("high"), F.bool_and(of("==")).alias("equal"),
        F.bool_and(of("<") | of(">")).alias("bounds"), F.max(F.when(of("<"), F.col("value"))).alias("most"), F.min(F.when(of(">"), F.col("value"))).alias("least"),
        F.countDistinct(F.when(of("<"), F.col("story_id"))).alias("upper"), F.countDistinct(F.when(of(">"), F.col("story_id"))).alias("lower"),
    )
    # apart: one story gives all upper bounds, another all lower ones, and the upper lie below the lower
    apart = F.col("bounds") & (F.col("upper") <= 1) & (F.col("lower") <= 1) & (F.col("most") < F.col("least"))
    hit = F.when(F.col("equal"), F.col("amounts") > 1).otherwise(~F.coalesce(apart, F.lit(False)))
    return n.where((F.col("stories") > 1) & hit).select("doc_id", "cond_key", "variable", "stories", "amounts", "low", "high")


def explanation(cond: Column | str, action_a: Column | str, action_b: Column | str) -> Column:
    return F.concat(F.lit("Condition '"), F.coalesce(col(cond), F.lit("None")), F.lit("' leads to conflicting actions: '"), col(action_a), F.lit("' vs '"), col(action_b), F.lit("'"))


def conflict_issues(found: DataFrame) -> DataFrame:
    """Conflicts as issues: the first of each pair of stories and condition, numbered CON-nnn within the document.

    found(doc_id, cond_key, story_a, story_b, action_a, action_b, source, confidence).
    """
    turn = F.when(F.col("source") == "rule", 0).when(F.col("source") == "embedding", 1).otherwise(2)
    x = found.select("*", turn.alias("turn"), F.least("story_a", "story_b").alias("one"), F.greatest("story_a", "story_b").alias("two"))
    first = _first(x, ["doc_id", "one", "two", "cond_key"], ["turn", "action_a", "action_b"], ["story_a", "story_b", "source", "confidence"])
    # the first bytes of the condition as a number lead, so that a document is numbered in many buckets
    lead = F.conv(F.rpad(F.substring(F.hex("cond_key"), 1, 12), 12, "0"), 16, 10).cast("bigint")
    n = numbered(first.withColumn("lead", lead), "doc_id", ["lead", "cond_key", "one", "two", "turn"])
    return n.select("doc_id", F.format_string("CON-%03d", "number").alias("issue_id"), "story_a", "story_b", "source", "confidence", explanation("cond_key", "action_a", "action_b").alias("explanation"))


def conditional(c: Column | str) -> Column:
    return F.lower(col(c)).rlike(r"\b(if|when|where)\b")


def gap_no_logic(stories: DataFrame) -> DataFrame:
    """Conditional stories without a clause that can be read as logic and without a criterion that sounds like one."""
    s = stories.where(conditional("raw_text")).select("doc_id", "story_seq", "story_uid", F.col("id").alias("story_id"), R.logic_blocks(R.body("raw_text")).alias("l"), R.criteria_tree(R.body("raw_text")).alias("t"), R.body("raw_text").alias("b"))
    texts = F.when(F.size("t") > 0, F.transform("t", lambda x: F.lower(x["text"]))).otherwise(F.array(F.lower("b")))
    spoken = F.exists(texts, lambda x: contains_any(x, L.AC_MARKERS))
    return s.where((F.size("l") == 0) & ~spoken).select(*KEYS, F.lit("no_testable_ac").alias("category"))


def gap_no_errors(stories: DataFrame, least: int = 3) -> DataFrame:
    """Stories of at least so many criteria, none of which mentions a failure."""
    per = criteria(stories).groupBy("doc_id", "story_seq", "story_uid", F.col("id").alias("story_id")).agg(F.count(F.lit(1)).alias("n"), F.max(contains_any(F.lower("text"), L.ERROR_WORDS).cast("int")).alias("e"))
    return per.where((F.col("n") >= least) & (F.col("e") == 0)).select(*KEYS, F.lit("missing_error_handling").alias("category"))


def gap_duplicates(stories: DataFrame) -> DataFrame:
    """Criteria that repeat, letters and digits alone counted, a criterion of another story before them."""
    acs = criteria(stories).select("doc_id", "story_seq", "story_uid", F.col("id").alias("story_id"), "pos", F.regexp_replace(F.lower(strip("text")), "[^a-z0-9 ]", "").alias("norm")).where("length(norm) > 20")
    owner = acs.groupBy("doc_id", "norm").agg(F.min_by("story_id", F.struct("story_seq", "story_uid", "pos")).alias("owner")).select(F.col("doc_id").alias("d"), F.col("norm").alias("m"), "owner")
    return acs.join(owner, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("norm") == F.col("m"))).where("story_id <> owner").select(*KEYS, "pos", "owner", F.lit("duplicate_ac").alias("category"))


def gaps(stories: DataFrame) -> DataFrame:
    """The first gap of each (document, story id, category), numbered GAP-nnn: first the first two kinds, then copies."""
    kinds = [gap_no_logic(stories).select(*KEYS, "category", F.lit(0).alias("kind"), F.lit(0).alias("pos")), gap_no_errors(stories).select(*KEYS, "category", F.lit(1).alias("kind"), F.lit(0).alias("pos")), gap_duplicates(stories).select(*KEYS, "category", F.lit(2).alias("kind"), "pos")]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).withColumn("late", F.when(F.col("kind") == 2, 1).otherwise(0))
    first = _first(every, ["doc_id", "story_id", "category"], ["late", "story_seq", "story_uid", "kind", "pos"], [])
    n = numbered(first.withColumn("turn", F.shiftleft(F.col("late").cast("bigint"), 62) + F.col("story_seq")), "doc_id", ["turn", "story_uid", "kind", "pos"])
    return n.select("doc_id", F.format_string("GAP-%03d", "number").alias("issue_id"), "story_id", "category")


def report(stories: DataFrame, rules: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, ambiguities, conflicts, gaps, issues) of each document that has any story.

    The conflicts are all those between the rules, or the rows ``found``.
    """
    from specsift.operators.similarity import conflicts

    found = conflicts(rules) if found is None else found
    count = lambda df, name: df.groupBy(F.col("doc_id").alias("d_" + name)).agg(F.count(F.lit(1)).alias(name))
    out = stories.select("doc_id").distinct()
    for name, df in (("ambiguities", ambiguities(stories)), ("conflicts", found), ("gaps", gaps(stories))):
        out = out.join(count(df, name), F.col("doc_id").eqNullSafe(F.col("d_" + name)), "left").drop("d_" + name)
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("ambiguities", "conflicts", "gaps")]
    return out.select("doc_id", *zero).withColumn("issues", F.col("ambiguities") + F.col("conflicts") + F.col("gaps"))
