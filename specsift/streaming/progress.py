"""Streams: latest progress of each document with expiry, first sight of content, arriving files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 600_000
STATE = "status string, stage string, message string, percent int, updated_at timestamp"


def progress(updates: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The latest progress of each document of a stream of (doc_id, status, stage, message, percent, updated_at).

    Later events win, whatever order they come in; a document without an event for ``idle_ms`` of event time is dropped
    from the state and reported once as expired.  The stream needs a watermark on updated_at.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "status", "stage", "message", "percent", "updated_at"]
        if state.hasTimedOut:
            old = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "expired", *old[1:])], columns=columns)
            return
        best = tuple(state.get) if state.exists else None
        for batch in batches:
            top = batch.sort_values("updated_at").iloc[-1]
            if best is None or top["updated_at"] >= pd.Timestamp(best[4]):
                best = (top["status"], top["stage"], top["message"], None if pd.isna(top["percent"]) else int(top["percent"]), top["updated_at"].to_pydatetime())
        state.update(best)
        at = int(pd.Timestamp(best[4]).timestamp() * 1000) + idle_ms
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *best)], columns=columns)

    return updates.groupBy("doc_id").applyInPandasWithState(step, f"doc_id string, {STATE}", STATE, "update", GroupStateTimeout.EventTimeTimeout)


def status(latest: DataFrame, reports: DataFrame) -> DataFrame:
    """(doc_id, status): progress where known; else done where a report exists, else error."""
    r = reports.select(F.col("doc_id").alias("r_doc")).distinct()
    x = latest.select("doc_id", "status").join(r, F.col("doc_id") == F.col("r_doc"), "full")
    return x.select(F.coalesce("doc_id", "r_doc").alias("doc_id"), F.coalesce("status", F.when(F.col("r_doc").isNotNull(), "done").otherwise("error")).alias("status"))


def first_seen(arrivals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Arrivals(hash, loaded_at) whose content wasn't seen within the delay before."""
    return arrivals.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["hash"])


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the PDF files that arrive in a folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)


def page_percent(done: int, pages: int) -> int:
    """The percent shown while pages are extracted."""
    return 5 + int(done / pages * 20) if pages else 5
