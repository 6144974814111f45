"""Session-level helpers: tables, shared checkpoint folder, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to executors that may not share the driver's file system; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or spark.sparkContext.master.startswith("local["):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="specsift-")) / "specsift.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"specsift/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; a file or a directory of part files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, or a local one only where the session runs in one process."""
    sc = spark.sparkContext
    shared, now = spark.conf.get("spark.checkpoint.dir", None), sc.getCheckpointDir()
    if not shared:
        if now:
            return now
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = os.path.join(tempfile.gettempdir(), "specsift-checkpoints")
    if not now:
        sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The rows of a frame with its lineage cut, kept in the shared folder so that they survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all cores where the input comes in fewer pieces than cores; no shuffle otherwise.

    A single small file is read by one task, which Python stages would then run on one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *columns) if columns else df.repartition(cores)
