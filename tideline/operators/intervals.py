"""Intervals: merged to disjoint runs, then met by one as-of join, so that no span meets more than one run. Times are whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import joins as J


def merged(spans: DataFrame, *, by: str, start: str = "a", end: str = "b", width: int = 65_536) -> DataFrame:
    """(by, start, end): runs of intervals that touch or overlap (both ends count), as one interval each; ends before their start and nulls go. A
    key's intervals are dealt by stretches of `width` of their starts; the farthest end of earlier stretches comes from one row a stretch."""
    x = spans.select(by, F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b")).filter("_a <= _b")
    x = x.groupBy(by, "_a").agg(F.max("_b").alias("_b")).withColumn("_at", F.floor(F.col("_a") / width))
    before = Window.partitionBy(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    each = x.groupBy(by, "_at").agg(F.max("_b").alias("_m")).select(F.col(by).alias("_owner"), F.col("_at").alias("_then"), F.max("_m").over(before).alias("_far"))
    near = F.max("_b").over(Window.partitionBy(by, "_at").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_near", near).join(each, F.col(by).eqNullSafe(F.col("_owner")) & (F.col("_at") == F.col("_then")))
    reach = F.greatest("_near", "_far")
    x = x.select(by, "_a", "_b", F.when(reach.isNull() | (F.col("_a") > reach), F.col("_a")).alias("_new"))
    runs = J.running_last(x, {"_run": F.col("_new")}, by=by, t="_a", width=width)
    return runs.groupBy(by, F.col("_run").alias(start)).agg(F.max("_b").alias(end))


def overlapping(spans: DataFrame, intervals: DataFrame, *, by: str, start: str = "a", end: str = "b", flag: str = "overlaps", open_end: bool = False, width: int = 65_536) -> DataFrame:
    """Adds whether a span (both ends count; with open_end the intervals' ends don't) overlaps any interval of its key: the last run that
    starts by the span's end is the only one that can reach it. `width`: the numbers of a stretch of time, to suit their unit."""
    runs = merged(intervals.withColumn(end, F.col(end) - 1) if open_end else intervals, by=by, start=start, end=end, width=width)
    runs = runs.select(by, F.col(start).alias("_from"), F.col(end).alias("_to"))
    met = J.asof_join(spans.withColumn("_end", F.col(end).cast("long")), runs, by=by, left_t="_end", right_t="_from", values=["_to"], width=width)
    return met.withColumn(flag, F.coalesce(F.col("_to") >= F.col(start), F.lit(False))).drop("_end", "match_t", "_to")
