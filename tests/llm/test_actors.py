import pytest

from specsift.llm import actors as A

CATALOG = [(1, "Crane Operator", "CRO", ["Hoist Driver"]), (2, "Billing Clerk", "BCL", []), (3, "Librarian", "LBR", None), (4, "Security Guard", "SEG", ["Gatekeeper"]), (5, "Laboratory Technician", "Lab Tech", [])]
VALUES = {
    "crane operator": 1, "Operator, Crane": 1, "Cran. Operator": 1, "CraneOperator": 1, "crane_opreator": 1, "cro": 1, "Hoist Drivers": 1, "role: Billing Clerk": 2, "the Billing Clerk (on duty)": 2,
    "Billing Clerk - day team": 2, "“Librarian”": 3, "Librariann": 3, "Ｌｉｂｒａｒｉａｎ": 3, "lab tech": 5, "Gatekeper": 4, "Beekeeper": 0, "Crane Caterer": 0, "TBD": 0, "???": 0, "Security Clerk": 0, "Guard": 0,
}


def tables(spark, roles, lists=()):
    s = spark.createDataFrame([(k, r, "x") for k, r in enumerate(roles)], "story_uid bigint, role string, value string")
    m = spark.createDataFrame([(k, a) for k, a in enumerate(lists)], "model_id bigint, actors array<string>")
    c = spark.createDataFrame(CATALOG, "actor_id bigint, actor_name string, short_form string, alt_names array<string>")
    return s, m, c


@pytest.fixture(scope="module")
def mapped(spark):
    roles = list(VALUES)
    return {roles[r.row_id]: r.actor_id for r in A.found(*tables(spark, roles)).collect()}


@pytest.mark.parametrize("value", list(VALUES))
def test_value(mapped, value):
    assert mapped[value] == VALUES[value]


def test_rows_and_positions(spark):
    s, m, c = tables(spark, [None, " ", "Librarian", "librarian", "librarian"], [["x", None, "Crane Operator", "CRO"], None, []])
    got = sorted(tuple(r) for r in A.found(s, m, c).collect())
    assert got == [("requirements_models", 0, 1, 0), ("requirements_models", 0, 4, 1), ("user_stories", 3, 0, 3), ("user_stories", 4, 0, 3)]
    assert [tuple(r) for r in A.unmatched(s, m, c).collect()] == [("x", 1)]
    assert all(r.actor_id == 0 for r in A.found(s, m, c.limit(0)).collect())
    assert A.found(s.limit(0), m.limit(0), c).count() == 0


def test_long_value(spark):
    assert [r.actor_id for r in A.found(*tables(spark, ["word " * 3000])).collect()] == [0]


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "acb", 1), ("abc", "abc", 0), ("", "ab", 2), ("crane", "carne", 1), ("adjuster", "audster", 2)])
def test_distance(a, b, d):
    assert A.distance(a, b) == d


def test_long_words_within_three_edits(spark):
    values = ["CraneOperator", "CraenOpxraxor", "CraenOpxrxxor"]
    assert A.tolerance("receptionist") == 3 and A.tolerance("technician") == 2
    got = {r.row_id: r.actor_id for r in A.found(*tables(spark, values)).collect()}
    assert got == {0: 1, 1: 1, 2: 0}


def test_forms_of_values_longer_than_any_name():
    assert A.deletions("a" * 30, 10) == {"a" * 30} and len(A.deletions("abcdefghijkl", 9)) > 200


def test_long_names_are_met_within_their_edits(spark):
    name = "Regional Coordinator of Harbour Maintenance Schedules and Equipment Returns"
    catalog = spark.createDataFrame([(5, name, "RCH", None)], "actor_id bigint, actor_name string, short_form string, alt_names array<string>")
    values = [name.replace(" ", "").replace("Maint", "Miant"), name.lower(), "x" * 200]
    stories = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "story_uid bigint, role string")
    models = spark.createDataFrame([], "model_id bigint, actors array<string>")
    assert {r.row_id: r.actor_id for r in A.found(stories, models, catalog).collect()} == {0: 5, 1: 5, 2: 0}
