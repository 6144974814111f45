"""Order-dependent operators that don't put a whole group into one task.

A group's rows are cut into buckets of their leading order column.  Windows run within (group, bucket); what crosses
buckets (how many rows came before, which value was seen last) is worked out on one row for each bucket and joined back.
Rows with equal order columns are ordered by the tie-breaking columns given; a null group is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in units of the leading order column.
BUCKET = 256


def _bucket(c: str) -> Column:
    return F.coalesce(F.floor(F.col(c) / BUCKET), F.lit(-1))


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    on = F.lit(True)
    for x, y in pairs:
        on = on & a[x].eqNullSafe(b[y])
    return on


def numbered(df: DataFrame, group: str, order: list[str], to: str = "number") -> DataFrame:
    """Rows with their position, from 1, within their group in the given order; order[0] must be numeric."""
    rows = df.withColumn("_b", _bucket(order[0]))
    sizes = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), "_n").withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_g", "_bb", "_before")
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)))
    joined = inside.join(offsets, _same(inside, offsets, [(group, "_g"), ("_b", "_bb")]))
    return joined.withColumn(to, (F.col("_before") + F.col("_k")).cast("bigint")).drop("_b", "_k", "_g", "_bb", "_before")


def last_seen(df: DataFrame, group: str, order: list[str], value: str, to: str) -> DataFrame:
    """Rows with the last non-null value at or before them in their group: an as-of join of a stream with itself."""
    rows = df.withColumn("_b", _bucket(order[0]))
    ends = rows.where(F.col(value).isNotNull()).groupBy(group, "_b").agg(F.max_by(value, F.struct(*order)).alias("_v"))
    every = rows.select(group, "_b").distinct()
    marks = every.join(ends.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), "_v"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_bb")), "left")
    earlier = Window.partitionBy("_g2").orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(F.col(group).alias("_g2"), F.col("_b").alias("_b2"), "_v").withColumn("_c", F.last("_v", True).over(earlier)).select("_g2", "_b2", "_c")
    here = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_l", F.last(value, True).over(here))
    joined = inside.join(carried, _same(inside, carried, [(group, "_g2"), ("_b", "_b2")]))
    return joined.withColumn(to, F.coalesce("_l", "_c")).drop("_b", "_l", "_g2", "_b2", "_c")
