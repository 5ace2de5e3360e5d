"""Upload sessions and job states from event tables (batch forms of the streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOB_EVENTS = {"signup": "QUEUED", "view": "RUNNING", "purchase": "DONE", "error": "FAILED"}


def sessions(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Sessions that end after ``gap`` without an event."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    out = timed.groupBy("upload", F.session_window("at", gap)).agg(F.min("at").alias("start"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select("upload", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def received(parts: DataFrame) -> DataFrame:
    got = F.array_sort(F.collect_set(F.col("part").cast("string")))
    return parts.groupBy("upload").agg(F.count_distinct("part").alias("received"), F.array_join(got, ",").alias("parts"))


def part_states(parts: DataFrame) -> DataFrame:
    """A part sent again is idempotent with the same digest, a conflict with another."""
    return parts.groupBy("upload", "part").agg(F.count(F.lit(1)).alias("tries"), (F.min("digest") != F.max("digest")).alias("conflict"))


def as_job_events(events: DataFrame) -> DataFrame:
    status = F.create_map(*[F.lit(x) for kv in JOB_EVENTS.items() for x in kv])[F.col("event_type")]
    return events.select(F.col("upload").alias("job"), F.coalesce(status, F.lit("FAILED")).alias("status"), "ts", "event_id")


def latest_states(events: DataFrame) -> DataFrame:
    return events.groupBy("job").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def recovered(states: DataFrame) -> DataFrame:
    """After a crash what was queued or running has failed."""
    open_ = F.col("status").isin("QUEUED", "RUNNING")
    return states.select("job", F.when(open_, "FAILED").otherwise(F.col("status")).alias("status"), open_.alias("recovered"))
