from specsift.operators import issues, nested, structure

STORY = "story_uid bigint, doc_id string, story_seq int, id string, type string, role string, goal string, reason string, confidence double, raw_text string, extra string"


def stories(spark, rows):
    return spark.createDataFrame([(k, "d", k, i, t, "Admin", g, r, 0.9, x, "e") for k, i, t, g, r, x in rows], STORY)


def test_ambiguities_first_wins(spark):
    s = stories(spark, [(1, "US1", "user_story", "fast breakfast", None, "US1 x"), (2, "US1", "user_story", "fast", None, "US1 y"), (3, "FR-2", "x", 'he said "may" so it may', "r", "FR-2")])
    got = [(r.issue_id, r.story_id, r.term) for r in sorted(issues.ambiguities(s).collect(), key=lambda r: r.issue_id)]
    assert got == [("AMB-001", "US1", "fast"), ("AMB-002", "US1", "(missing)")]


def test_opposed_actions(spark):
    rules = spark.createDataFrame(
        [("d", 1, 1, "FR-1", "A", 0, "role is guest", "allow access", "x", 0.9), ("d", 2, 2, "FR-2", "A", 0, "Role is guest ", "restrict access", "x", 0.9), ("d", 3, 3, "FR-2", "A", 0, "role is guest", "restrict access", "x", 0.9), ("e", 1, 4, "FR-9", "A", 0, "role is guest", "deny access", "x", 0.9)],
        "doc_id string, story_seq int, story_uid bigint, story_id string, actor string, rule_pos int, condition string, action string, raw_text string, confidence double",
    )
    got = [(r.permits, r.denies, r.story_a, r.story_b, r.rules_b) for r in issues.opposed(rules).collect()]
    assert got == [("allow access", "restrict access", "FR-1", "FR-2", 2)]


def test_gaps(spark):
    acs = "\nAcceptance Criteria:\n- The first of the long criteria stands here\n- b\n- c"
    s = stories(spark, [(1, "FR-1", "t", "g", "r", "FR-1 shall" + acs), (2, "FR-2", "t", "g", "r", "FR-2 x" + acs.replace("first", "FIRST")), (3, "FR-3", "t", "g", "r", "FR-3 whenever, where needed")])
    got = {(r.issue_id, r.story_id, r.category) for r in issues.gaps(s).collect()}
    assert {x[1:] for x in got} == {("FR-1", "missing_error_handling"), ("FR-2", "missing_error_handling"), ("FR-3", "no_testable_ac"), ("FR-2", "duplicate_ac")}
    assert ("GAP-004", "FR-2", "duplicate_ac") in got


def test_ledger_of_models(spark):
    text = '[{"id": "FR-1", "role": "A", "raw_text": "r", "acceptance_criteria": {"text": "t", "children": [null, {"text": "u", "logic": "[{\\"condition\\": \\"c\\", \\"action\\": {\\"description\\": \\"allow it\\"}}]"}]}}]'
    m = spark.createDataFrame([(1, "d", text, "x")], "model_id bigint, document_name string, user_stories string, pos string")
    assert [(r.story_id, r.rule_pos, r.action) for r in structure.model_ledger(m).collect()] == [("FR-1", "s0/c0/c1/l0", "allow it")]


def test_nested_edges(spark):
    deep = '{"text": "x", "children": [' * 400 + '{"text": "y"}' + "]}" * 400
    rows = [(1, None), (2, ""), (3, "[{"), (4, "[NaN]"), (5, "{}"), (6, '"[{}, 3, null, {}]"'), (7, f'[{{"acceptance_criteria": {deep}}}]'), (5, "{}")]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "model_id bigint, user_stories string, path string, kind int")
    got = [(r.model_id, r.path) for r in nested.links(df).collect()]
    assert sorted(x for x in got if x[0] != 7) == [(5, "s0"), (5, "s0"), (6, "s0"), (6, "s3")]
    assert sum(x[0] == 7 for x in got) == 402
    assert nested.links(df.limit(0)).count() == 0
    t = nested.tagged(df)
    assert nested.stories(t).count() + nested.criteria(t).count() + nested.logic_blocks(t).count() == len(got)


def test_nested_tables_are_written_by_tag(spark, tmp_path):
    df = spark.createDataFrame([(1, '[{"id": "a", "logic": {"type": "conditional"}}]')], "model_id bigint, user_stories string")
    nested.write_tables(df, str(tmp_path / "t"))
    assert {r.tag for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"story", "logic"}
