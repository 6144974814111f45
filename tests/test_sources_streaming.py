import datetime as dt

from pyspark.sql import functions as F

from specsift.operators import ingest, structure
from specsift.sources import files
from specsift.streaming import progress


def test_pdf_listing_and_metadata(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "One File.pdf").write_bytes(b"%PDF-1.4 /Title (T1) /Author (B)")
    (tmp_path / "two.PDF").write_bytes(b"%PDF-1.4 /Encrypt 5 0 R")
    (tmp_path / "three.pdf").write_bytes(b"no")
    (tmp_path / "x.txt").write_text("n")
    got = {r.stem: (r.doc_id, r.problem) for r in files.pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"One File": ("one_file", None), "two": ("two", "encrypted"), "three": ("three", "no pdf")}
    assert {(r.title, r.author) for r in files.pdf_metadata(spark, str(tmp_path)).collect()} == {("T1", "B"), ("two", None), ("three", None)}


def test_page_text_source(spark, tmp_path):
    (tmp_path / "doc.txt").write_text("front\n--- PAGE 1 ---\na\nb\n--- PAGE 2 ---\nc\n")
    spark.dataSource.register(files.PageText)
    got = sorted(tuple(r) for r in spark.read.format("page_text").load(str(tmp_path)).collect())
    assert got == [("doc", 0, "front"), ("doc", 1, "a\nb"), ("doc", 2, "c")]


def test_registry(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert files.registry(spark, path).count() == 0
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    files.add_to_registry(docs.where("doc_id = 1").select(F.sha2("text", 256).alias("hash")), path)
    assert [r.doc_id for r in ingest.not_registered(docs, files.registry(spark, path)).collect()] == [2]
    assert {(r.doc_id, r.first_id) for r in ingest.first_of_content(docs).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_json_stage_reads_older_schema(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"document_name": "d", "user_stories": [{"id": "1"}]}')
    r = files.json_stage(spark, str(tmp_path), "document_name string, actors array<string>, user_stories array<struct<id:string,type:string>>").first()
    assert (r.document_name, r.actors, r.user_stories[0].type) == ("d", None, None)


def test_models_json(spark):
    s = spark.createDataFrame([(1, "d", 1, "FR-1: The system shall stop at once.")], "story_uid bigint, doc_id string, story_seq int, raw_text string")
    assert '"id":"FR-1"' in files.models_json(structure.structured(s)).first().json


def test_progress_stream(spark, tmp_path):
    src, t0 = tmp_path / "in", dt.datetime(2024, 1, 1)
    schema = "doc_id string, status string, stage string, message string, percent int, updated_at timestamp"
    batches = [[("a", "processing", "2", "m", 5, t0), ("a", "processing", "3", "m", 25, t0 + dt.timedelta(minutes=1)), ("b", "processing", "2", "m", 7, t0)], [("b", "done", "6", "m", 75, t0 + dt.timedelta(minutes=30))], [("b", "done", "6", "m", 75, t0 + dt.timedelta(minutes=31))]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*")).withWatermark("updated_at", "1 minute")
    q = progress.progress(stream).writeStream.outputMode("update").format("memory").queryName("prog").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("prog").collect()
    assert ("a", "processing", 25) in {(r.doc_id, r.status, r.percent) for r in rows}
    assert ("a", "expired") in {(r.doc_id, r.status) for r in rows}
    assert ("b", "done") in {(r.doc_id, r.status) for r in rows}


def test_first_seen_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([("x", t0), ("x", t0), ("y", t0)], "hash string, loaded_at timestamp").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("hash string, loaded_at timestamp").parquet(str(tmp_path / "in"))
    q = progress.first_seen(s).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.hash for r in spark.table("seen").collect()) == ["x", "y"]


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-")
    q = progress.arriving_files(spark, str(tmp_path / "in")).select("path", "length").writeStream.format("memory").queryName("arr").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arr").count() == 1


def test_status(spark):
    latest = spark.createDataFrame([("a", "processing")], "doc_id string, status string")
    reports = spark.createDataFrame([("b",), ("b",)], "doc_id string")
    assert {tuple(r) for r in progress.status(latest, reports).collect()} == {("a", "processing"), ("b", "done")}
    assert (progress.page_percent(3, 4), progress.page_percent(1, 0)) == (20, 5)
