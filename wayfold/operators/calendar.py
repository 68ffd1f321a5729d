"""Calendars of day intervals: windows, pairs, islands and grouped sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.dates import overlaps


def clip_to_window(events: DataFrame, since: Column, until: Column) -> DataFrame:
    """Events that touch the window, with the part inside it."""
    return events.filter(overlaps(F.col("day_start"), F.col("day_end"), since, until)).withColumns({"from_day": F.greatest("day_start", since), "to_day": F.least("day_end", until)})


def overlapping_pairs(events: DataFrame, group: str, bucket_days: int = 8) -> DataFrame:
    """(first, second) keys of a group's events that overlap, first < second.

    Events are copied to the day buckets they touch, and a pair is made in the bucket of its later start only, so that
    a group with many events is split over its buckets.
    """
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / bucket_days).cast("int")
    spread = events.withColumn("bucket", F.explode(F.sequence(number(F.col("day_start")), number(F.col("day_end")))))
    a, b = (spread.select(group, "bucket", F.col("event_key").alias(k), F.col("day_start").alias(f"{k}_start"), F.col("day_end").alias(f"{k}_end")) for k in ("first", "second"))
    late = number(F.greatest("first_start", "second_start"))
    return a.join(b, [group, "bucket"]).filter("first < second and first_start <= second_end and second_start <= first_end").filter(F.col("bucket") == late).select(group, "first", "second")


def islands(events: DataFrame, group: str, gap_days: int) -> DataFrame:
    """Runs of a group's events whose gaps are at most ``gap_days``."""
    w = Window.partitionBy(group).orderBy("day_start", "event_key")
    reach = F.max("day_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.datediff("day_start", reach) > gap_days), 1).otherwise(0)
    numbered = events.withColumn("_new", starts).withColumn("island", F.sum("_new").over(w))
    return numbered.groupBy(group, "island").agg(F.min("day_start").alias("day_start"), F.max("day_end").alias("day_end"), F.count("*").alias("events"))


def grouped_sessions(events: DataFrame, group: str, most: int) -> DataFrame:
    """Per group the first ``most`` distinct days in order, the least price and the last end. The days kept per group are bounded."""
    first = events.select(group, "day_start").distinct()
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("day_start"))).filter(F.col("_r") <= most)
    days = ranked.groupBy(group).agg(F.array_sort(F.collect_list("day_start")).alias("days"))
    return days.join(events.groupBy(group).agg(F.min("price").alias("least_price"), F.max("day_end").alias("last_day")), group)
