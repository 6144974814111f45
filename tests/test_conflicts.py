from specsift.operators import issues, similarity
from specsift.plans import pipeline
from tests.test_pipeline import PAGE

RULES = "doc_id string, story_seq int, story_uid bigint, story_id string, actor string, rule_pos int, condition string, action string, raw_text string, confidence double"


def ledger(spark, rows):
    """(story id, condition, action) of one document in order."""
    return spark.createDataFrame([("d", k, k, i, "A", 0, c, a, "x", 0.9) for k, (i, c, a) in enumerate(rows)], RULES)


def test_a_story_that_is_first_of_both_classes_hides_no_other(spark):
    both = [("R-A-1", "c", "allow access"), ("R-A-1", "c", "deny access")]
    assert issues.opposed(ledger(spark, both)).count() == 0
    for more in ([("R-A-2", "c", "allow access")], [("R-A-0", "c", "deny access")], [("R-A-2", "c", "allow access"), ("R-A-3", "c", "deny access")]):
        rules = ledger(spark, both + more)
        for df in (issues.opposed(rules), similarity.alike_conflicts(rules)):
            (r,) = df.collect()
            assert r.story_a != r.story_b


def test_any_two_stories_of_one_module_pass_the_gate(spark):
    rows = [("R-A-1", "c", "allow early entry"), ("R-B-2", "c", "allow early entry"), ("R-C-3", "c", "deny payment"), ("R-B-4", "c", "deny payment")]
    (r,) = similarity.alike_conflicts(ledger(spark, rows)).collect()
    assert (r.story_a, r.story_b, r.source) == ("R-B-2", "R-B-4", "rule")


def test_conditions_meet_by_number_and_by_likeness(spark):
    rows = [("F-A-1", "latency > 5", "allow entry"), ("F-A-2", "latency > 9", "deny entry"), ("F-A-3", "latency < 9", "deny entry"), ("F-A-4", "the network link drops", "allow resend"), ("F-A-5", "the network link drop", "deny resend"), ("F-A-6", "the printer is offline", "deny resend"), ("F-A-7", "c" * 9, "allow x"), ("F-A-8", "c" * 12, "deny x"), ("F-A-9", "after 30 days", "deny y"), ("F-A-10", "after 31 days", "allow y")]
    expected = {("F-A-1", "F-A-2", "latency > 5", "latency > 9"), ("F-A-4", "F-A-5", "the network link drops", "the network link drop"), ("F-A-7", "F-A-8", "c" * 9, "c" * 12)}
    for df in (issues.opposed(ledger(spark, rows)), similarity.alike_conflicts(ledger(spark, rows))):
        assert sorted((r.story_a, r.story_b, r.cond_key, r.cond_key_b) for r in df.collect()) == sorted(expected)


def test_rules_without_a_condition_conflict_by_polarity_and_number_only(spark):
    rows = [("F-A-1", None, "store the audit log"), ("F-A-2", None, "not store the audit log"), ("F-B-3", None, "stop the pump within 2 seconds"), ("F-B-4", "", "stop the pump within 3 seconds"), ("F-C-5", None, "allow zebra"), ("F-C-6", None, "deny umbrella")]
    got = {(r.story_a, r.story_b, r.source) for r in similarity.alike_conflicts(ledger(spark, rows)).collect()}
    assert got == {("F-A-1", "F-A-2", "embedding"), ("F-B-3", "F-B-4", "numeric")}


def test_report_counts_conflicts_of_every_kind(spark):
    rows = [("F-A-1", "c", "allow entry"), ("F-A-2", "c", "deny entry"), ("F-B-1", "c", "store the audit log"), ("F-B-2", "c", "not store the audit log"), ("F-C-1", "the stop is pressed", "stop within 2 seconds"), ("F-C-2", "the stop is pressed", "stop within 3 seconds")]
    stories = spark.createDataFrame([(1, "d", 1, "F-A-1", "t", "Admin", "g", "r", 0.9, "x")], "story_uid bigint, doc_id string, story_seq int, id string, type string, role string, goal string, reason string, confidence double, raw_text string")
    rules = ledger(spark, rows)
    assert sorted(r.source for r in similarity.conflicts(rules).collect()) == ["embedding", "numeric", "rule"]
    assert issues.report(stories, rules).first().conflicts == 3
    assert issues.report(stories, rules, issues.opposed(rules)).first().conflicts == 1


def test_pipeline_keeps_conflicts_of_every_kind(spark, tmp_path):
    page = PAGE.replace("allow access to the area", "halt the pump within 2 seconds").replace("restrict access to the area", "halt the pump within 3 seconds")
    raw = spark.createDataFrame([(1, "d", 1, page, None)], "page_id bigint, doc_id string, page_num int, raw_text string, loaded_at timestamp")
    at = pipeline.run(spark, raw, str(tmp_path))
    assert [r.source for r in spark.read.parquet(at["conflicts"]).collect()] == ["numeric"]
    assert [r.conflicts for r in spark.read.parquet(at["report"]).collect()] == [1]
