"""python -m specsift --pages FOLDER --out FOLDER [--stage N]: the chain over pages in Parquet or marked text files."""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from specsift.plans.pipeline import STAGES, run
from specsift.sources.files import PageText


def main() -> None:
    p = argparse.ArgumentParser(prog="specsift", description=__doc__)
    p.add_argument("--pages", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--stage", type=int, choices=sorted(STAGES), default=max(STAGES))
    a = p.parse_args()
    spark = SparkSession.builder.appName("specsift").getOrCreate()
    if a.pages.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(a.pages)
    else:
        spark.dataSource.register(PageText)
        raw = spark.read.format("page_text").load(a.pages).withColumn("page_id", F.xxhash64("doc_id", "page_num")).withColumn("loaded_at", F.lit(None).cast("timestamp"))
    for name, folder in run(spark, raw, a.out, a.stage).items():
        print(f"{name}\t{folder}")


if __name__ == "__main__":
    main()
