"""Structured answers over the event log: distinct counts, comparison, first and last, vocabulary, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def in_range(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open range on occurred_from; equal bounds are an empty range, reversed bounds an error."""
    if start and end and start > end:
        raise ValueError("the range begins after it ends")
    if start:
        events = events.where(F.col("occurred_from") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        events = events.where(F.col("occurred_from") < F.lit(end).cast("timestamp_ntz"))
    return events


def representatives(events: DataFrame, include_conflicts: bool = False) -> DataFrame:
    """The earliest eligible row of each dedupe key; a conflict row never hides a later eligible one.

    min_by aggregates partially before the shuffle, which a window over each key could not.
    """
    rows = events if include_conflicts else events.where("conflict_status = 'none'")
    cols = [c for c in events.columns if c != "dedupe_key"]
    first = F.min_by(F.struct(*cols), F.struct("occurred_from", "event_id")).alias("r")
    return rows.groupBy("dedupe_key").agg(first).select("dedupe_key", "r.*")


def distinct_counts(events: DataFrame, include_conflicts: bool = False) -> DataFrame:
    """subject_id, event_type, value, excluded_conflict_count (rows, whether they count or not)."""
    keys = ["subject_id", "event_type"]
    counted = representatives(events, include_conflicts).groupBy(*keys).agg(F.count(F.lit(1)).alias("value"))
    conflicts = events.groupBy(*keys).agg(F.count_if(F.col("conflict_status") != "none").alias("excluded_conflict_count"))
    return conflicts.join(counted, keys, "left").select(*keys, F.coalesce("value", F.lit(0)).alias("value"), "excluded_conflict_count")


def compare(events: DataFrame, left: str, right: str) -> DataFrame:
    """Per event type: counts of two subjects and their difference, in one scan."""
    rows = representatives(events.where(F.col("subject_id").isin(left, right)))
    n = lambda who: F.count_if(F.col("subject_id") == who)
    return rows.groupBy("event_type").agg(n(left).alias("left_count"), n(right).alias("right_count"), (n(left) - n(right)).alias("difference"))


def first_and_last(events: DataFrame) -> DataFrame:
    by = F.struct("occurred_from", "event_id")
    return representatives(events).groupBy("subject_id", "event_type").agg(F.min("occurred_from").alias("first_at"), F.min_by("event_id", by).alias("first_event_id"), F.max("occurred_from").alias("last_at"), F.max_by("event_id", by).alias("last_event_id"))


def explain_empty(events: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (subject_id, event_type): does either occur at all among the visible events?"""
    subjects = events.select(F.col("subject_id").alias("_s")).distinct()
    types = events.select(F.col("event_type").alias("_t")).distinct()
    return probes.join(subjects, F.col("subject_id") == F.col("_s"), "left").join(types, F.col("event_type") == F.col("_t"), "left").select("subject_id", "event_type", F.col("_s").isNotNull().alias("subject_exists"), F.col("_t").isNotNull().alias("type_exists"))


def bounded(events: DataFrame, cap: int) -> DataFrame:
    """Per subject the first `cap` rows by time and id, and whether there were more; the limit is the feature."""
    w = W.Window.partitionBy("subject_id").orderBy("occurred_from", "event_id")
    rows = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap + 1)
    return rows.groupBy("subject_id").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("returned"), (F.count(F.lit(1)) > cap).alias("truncated"))


def first_and_last_of_bounded(events: DataFrame, cap: int) -> DataFrame:
    """first_and_last over the first `cap` rows of each subject. Where there were more, the last event is not known and stays null."""
    w = W.Window.partitionBy("subject_id").orderBy("occurred_from", "event_id")
    rows = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap + 1)
    more = rows.groupBy("subject_id").agg((F.max("_n") > cap).alias("truncated"))
    out = first_and_last(rows.where(F.col("_n") <= cap).drop("_n")).join(more, "subject_id")
    known = lambda c: F.when(~F.col("truncated"), F.col(c)).alias(c)
    return out.select("subject_id", "event_type", "first_at", "first_event_id", known("last_at"), known("last_event_id"), "truncated")


def event_types(events: DataFrame, limit: int = 200) -> DataFrame:
    """The event types that there are, in order, at most `limit` (the limit is the feature)."""
    return events.select("event_type").distinct().orderBy("event_type").limit(limit)
