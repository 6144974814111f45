"""File sources and sinks: PDF listings, page text with markers, JSON stages, registries, Markdown, exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from specsift.functions import text as T

MARKER = re.compile(r"^--- PAGE (\d+) ---$", re.M)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, doc_id, length, hash, problem) of every PDF below a folder.

    Encrypted and unreadable files are kept with their problem named, so that one of them fails no job; Spark lists no
    files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    head = F.substring("content", 1, 5).cast("string")
    problem = F.when(head != "%PDF-", "no pdf").when(F.contains(F.decode("content", "ISO-8859-1"), F.lit("/Encrypt")), "encrypted")
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return files.select("path", stem.alias("stem"), T.slug("path").alias("doc_id"), "length", F.sha2("content", 256).alias("hash"), problem.alias("problem"))


def pdf_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(path, title, author, subject, creator, creation_date): document information entries, the title else the stem."""
    entry = re.compile(rb"/(Title|Author|Subject|Creator|CreationDate)\s*\(((?:\\.|[^\\()])*)\)")
    names = {b"Title": "title", b"Author": "author", b"Subject": "subject", b"Creator": "creator", b"CreationDate": "creation_date"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = {names[k]: v.decode("latin-1") for k, v in reversed(entry.findall(bytes(content)))}
                found["title"] = found.get("title") or re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])
                rows.append({"path": path, **{n: found.get(n) for n in names.values()}})
            yield pd.DataFrame(rows, columns=["path", *names.values()])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", "content").mapInPandas(run, "path string, title string, author string, subject string, creator string, creation_date string")


def json_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's JSON files under the widest schema: fields that older files lack come out null."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def write_stage(df: DataFrame, path: str, *partitions: str) -> None:
    """A stage as Parquet, the checkpoint between stages."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(hash) of the documents seen so far; empty where there is no registry yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "hash string")
    return spark.read.text(path).select(F.trim("value").alias("hash")).where("hash <> ''")


def add_to_registry(hashes: DataFrame, path: str) -> None:
    """Append the hashes(hash) that the registry doesn't hold."""
    known = registry(hashes.sparkSession, path)
    hashes.select("hash").distinct().join(known, "hash", "left_anti").write.mode("append").text(path)


def without_document(df: DataFrame, doc_id: str) -> DataFrame:
    """A table without one document's rows, by equality."""
    return df.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def of_document(df: DataFrame, doc_id: str) -> DataFrame:
    return df.where(F.col("doc_id") == doc_id)


class PageText(DataSource):
    """Text files with a ``--- PAGE n ---`` line before each page, read as (doc_id, page_num, raw_text).

    ``spark.read.format("page_text").load(folder)`` after ``spark.dataSource.register(PageText)``; one task for each
    file.  Text before the first marker is page 0.
    """

    @classmethod
    def name(cls) -> str:
        return "page_text"

    def schema(self) -> str:
        return "doc_id string, page_num int, raw_text string"

    def reader(self, schema: object) -> DataSourceReader:
        return PageTextReader(self.options)


class PageTextReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        root = Path(self.path.removeprefix("file://"))
        return [InputPartition(str(p)) for p in ([root] if root.is_file() else sorted(root.rglob("*.txt")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pathlib import Path

        p = Path(partition.value)
        parts = MARKER.split(p.read_text(encoding="utf-8"))
        if parts[0].strip():
            yield p.stem, 0, parts[0].strip("\n")
        for number, text in zip(parts[1::2], parts[2::2], strict=True):
            yield p.stem, int(number), text.strip("\n")


def models_json(stories: DataFrame) -> DataFrame:
    """(doc_id, json): the structured stories of each document as one JSON text, nested only here at the sink."""
    item = F.struct("story_seq", "id", "type", "role", "goal", "reason", "confidence", F.col("body").alias("raw_text"))
    return stories.groupBy("doc_id").agg(F.to_json(F.struct(F.first("doc_id").alias("document_name"), F.array_sort(F.collect_list(item)).alias("user_stories"))).alias("json"))
