import datetime as dt

from specsift.plans import pipeline

PAGE = """9.1 Access
REQ-SEC-01: If the role is guest, the system shall allow access to the area.

REQ-SEC-02: If the role is guest, the system shall restrict access to the area.

US-3: As a CR member, I want to print quickly when asked, so that queues stay short.

The plant must answer within 5 seconds whenever it can do so.
x = a + b/c (2.1)
7"""


def test_chain(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    raw = spark.createDataFrame([(1, "d", 1, "old", t), (2, "d", 1, PAGE, t + dt.timedelta(1)), (3, "e", 1, None, t)], "page_id bigint, doc_id string, page_num int, raw_text string, loaded_at timestamp")
    at = pipeline.run(spark, raw, str(tmp_path))
    read = lambda n: spark.read.parquet(at[n])
    assert {(r.id, r.type) for r in read("stories").collect()} >= {("REQ-SEC-02", "unknown"), ("US-3", "user_story")}
    assert any(r.id.startswith("INF-") and r.type == "contextual_information" for r in read("stories").collect())
    assert [(r.story_a, r.story_b) for r in read("conflicts").collect()] == [("REQ-SEC-01", "REQ-SEC-02")]
    assert "quickly" in {r.term for r in read("ambiguities").collect()}
    report = {r.doc_id: (r.conflicts, r.ambiguities > 0) for r in read("report").collect()}
    assert report == {"d": (1, True)}
    assert read("equations").count() == 1


def test_stops_at_a_stage(spark, tmp_path):
    raw = spark.createDataFrame([(2, "d", 1, PAGE, None)], "page_id bigint, doc_id string, page_num int, raw_text string, loaded_at timestamp")
    assert set(pipeline.run(spark, raw, str(tmp_path), 3)) == {"pages", "markdown"}
