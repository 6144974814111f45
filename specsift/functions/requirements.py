"""Expressions that read requirement text: ids, types, actors, conditions, actions, logic, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specsift import lexicons as L
from specsift.functions.text import col, contains_any, strip


def body(raw: Column | str) -> Column:
    return strip(F.replace(col(raw), F.lit("**"), F.lit("")))


#: A word boundary of ASCII words, since Java's own follows other letters too.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _found(c: Column, pattern: str, group: int) -> Column:
    """The group of the first match, null where there is none."""
    pattern = pattern.replace("(?i)", "(?id)", 1).replace("(?is)", "(?isd)", 1).replace(r"\b", EDGE)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def extract_id(c: Column | str) -> Column:
    c = col(c)
    return F.upper(F.coalesce(_found(c, L.ID, 1), _found(c, L.SHORT_ID, 1), F.lit("UNKNOWN")))


def type_of(id_: Column) -> Column:
    u = F.upper(id_)
    return F.when(F.contains(u, F.lit("FR")) & ~F.contains(u, F.lit("NFR")), "functional_requirement").when(F.contains(u, F.lit("NFR")), "non_functional_requirement").when(F.contains(u, F.lit("US")), "user_story").otherwise("unknown")


def extract_condition(c: Column | str) -> Column:
    return strip(_found(col(c), L.CONDITION, 1))


def extract_action(c: Column | str) -> Column:
    return strip(F.coalesce(_found(col(c), L.ACTION, 0), F.substring_index(col(c), "\n", 1)))


def normalize_actor(role: Column | str) -> Column:
    r = strip(F.regexp_replace(strip(role), r"^\*+|\*+$", ""))
    out = r
    for alias, name in reversed(L.ACTOR_ALIASES):
        out = F.when(F.contains(F.lower(r), F.lit(alias)), name).otherwise(out)
    return out


def extract_actor(c: Column | str) -> Column:
    word = _found(col(c), L.ROLE_WORD, 1)
    return normalize_actor(F.coalesce(strip(_found(col(c), L.ROLE, 1)), F.initcap(word), F.lit("System")))


def confidence(c: Column | str) -> Column:
    """Summed in this order, so that doubles agree: base, conditional, length, normative verb."""
    low = F.lower(col(c))
    score = F.lit(0.5) + F.when(F.contains(low, F.lit("if")), 0.2).otherwise(0.0)
    score = score + F.when(F.length(col(c)) > 50, 0.1).otherwise(0.0)
    score = score + F.when(low.rlike(r"\b(shall|must|will)\b"), 0.2).otherwise(0.0)
    return F.least(score, F.lit(0.95))


def is_requirement(c: Column | str) -> Column:
    c = col(c)
    low, bare = F.lower(c), strip(c)
    words = F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
    noise = contains_any(low, L.NOISE) | c.startswith("<!--") | c.startswith("#") | (F.length(bare) < 25) | (bare.endswith(":") & (F.length(bare) < 50))
    return ~noise & (contains_any(low, L.NORMATIVE) | ((words > 15) & c.rlike(r"\p{L}")))


def logic_blocks(c: Column | str) -> Column:
    """Array of (condition, result) of every conditional clause, in order."""
    pattern = L.LOGIC.replace("(?i)", "(?id)", 1)
    pairs = F.arrays_zip(F.regexp_extract_all(col(c), F.lit(pattern), 1).alias("c"), F.regexp_extract_all(col(c), F.lit(pattern), 2).alias("r"))
    return F.transform(pairs, lambda x: F.struct(strip(x["c"]).alias("condition"), strip(x["r"]).alias("result")))


def goal_of(c: Column | str, type_: Column) -> Column:
    """At most 250 characters: what a user story wants, else the action."""
    wanted = F.replace(strip(_found(col(c), L.GOAL, 1)), F.lit("\n"), F.lit(" "))
    return F.substring(F.when(type_ == "user_story", F.coalesce(wanted, col(c))).otherwise(extract_action(c)), 1, 250)


def reason_of(c: Column | str) -> Column:
    return F.replace(strip(_found(col(c), L.REASON, 1)), F.lit("\n"), F.lit(" "))


def criteria_lines(c: Column | str) -> Column:
    """Bullet lines after the line that announces acceptance criteria."""
    every = F.split(col(c), "\n")
    head = F.array_position(F.transform(every, lambda x: F.contains(x, F.lit("Acceptance Criteria"))), True)
    after = F.when(head > 0, F.slice(every, head.cast("int") + 1, F.size(every))).otherwise(F.array().cast("array<string>"))
    return F.filter(after, lambda x: ~F.contains(x, F.lit("Acceptance Criteria")) & strip(x).rlike(r"^(-|\*|\d+\.)"))


#: Fixed value: a bullet line of acceptance criteria.
BULLET = r"(?d)^(\s*)([-*•]|\d+\.)\s+(.*)"


def criteria_tree(c: Column | str) -> Column:
    """Array of (pos, parent, level, type, text): a line's parent is the last line before it with a smaller indent."""
    bullets = F.filter(criteria_lines(c), lambda x: x.rlike(BULLET))
    indents = F.transform(bullets, lambda x: F.length(F.regexp_extract(x, BULLET, 1)))

    def parent(v: Column, i: Column) -> Column:
        earlier = F.filter(F.sequence(F.lit(0), i), lambda j: (j < i) & (F.get(indents, j) < v))
        return F.coalesce(F.array_max(earlier), F.lit(-1))

    parents = F.transform(indents, parent)
    text = F.transform(bullets, lambda x: strip(F.replace(F.regexp_extract(x, BULLET, 3), F.lit("**"), F.lit(""))))
    return F.transform(
        text, lambda t, i: F.struct(i.alias("pos"), F.get(parents, i).alias("parent"), F.get(indents, i).alias("level"), F.when(t.endswith(":"), "group").otherwise("requirement").alias("type"), t.alias("text"))
    )


# ---------------------------------------------------------------- rules


def core_action(action: Column | str) -> Column:
    """permit or deny by the first verb of a class, else the bare action."""
    bare = strip(F.regexp_replace(F.lower(col(action)), r"\b(shall|must|will|should|system|user)\b", ""))
    classes = F.create_map(*[F.lit(x) for kv in sorted(L.VERB_CLASSES.items()) for x in kv])
    hits = F.filter(F.transform(F.split(bare, r"\s+"), lambda w: F.element_at(classes, w)), lambda x: x.isNotNull())
    return F.coalesce(F.get(hits, 0), bare)


def polarity(c: Column | str) -> Column:
    return F.when(contains_any(F.lower(col(c)), L.NEGATIONS), "negative").otherwise("positive")


def context(c: Column | str) -> Column:
    words = F.filter(F.split(strip(F.lower(col(c))), r"\s+"), lambda w: ~w.isin(*L.CONTEXT_STOP))
    return F.array_join(words, " ")


def concept(context_: Column) -> Column:
    """The first concept group that a word belongs to, by its fixed representative; else the context."""
    words = F.split(context_, " ")
    out = context_
    for name, group in reversed(L.CONCEPTS):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, group))), name).otherwise(out)
    return out


def primary_object(c: Column | str) -> Column:
    """The first five words of more than two letters once ids and boilerplate are gone."""
    text = F.regexp_replace(F.lower(col(c)), r"\b[a-z]{2,5}(?:-[a-z]+)?-\d{1,3}\s*:?\s*", "")
    text = F.regexp_replace(text, rf"\b({'|'.join(L.OBJECT_BOILERPLATE)})\b", "")
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 2), 1, 5), " ")


def condition_logic(c: Column | str) -> Column:
    """struct(variable, operator, value) of a numeric condition: a number with a unit, else a variable compared."""
    low = F.lower(col(c))
    unit = rf"(\d+(?:\.\d+)?)\s*({L.CONDITION_UNITS})"
    compare = rf"({L.CONDITION_VARIABLES})\s*(<|>|<=|>=|==|within|under|exceeding)\s*(\d+(?:\.\d+)?)"
    op = F.regexp_extract(low, compare, 2)
    op = F.when(op == "under", "<").when(op == "exceeding", ">").when(op == "within", "<=").otherwise(op)
    number = lambda p, g: F.regexp_extract(low, p, g).cast("double")
    return F.when(low.rlike(unit), F.struct(F.regexp_extract(low, unit, 2).alias("variable"), F.lit("==").alias("operator"), number(unit, 1).alias("value"))).when(
        low.rlike(compare), F.struct(F.regexp_extract(low, compare, 1).alias("variable"), op.alias("operator"), number(compare, 3).alias("value"))
    )


def module_of(id_: Column | str) -> Column:
    return F.coalesce(F.get(F.split(col(id_), "-"), 1), F.lit(""))
