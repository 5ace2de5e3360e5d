"""Job and upload lifecycles as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = {"QUEUED": 0, "RUNNING": 1, "DONE": 2, "FAILED": 2}
STATE = "status string, claimed boolean"
OUTPUT = "job bigint, status string, accepted boolean"


def upload_sessions(events: DataFrame, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of upload events (upload, at); each is emitted once, when the watermark passes its end."""
    return (events.withWatermark("at", late).groupBy("upload", F.session_window("at", gap))
            .agg(F.min("at").alias("start"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).select("upload", "start", "last", "n"))


def accepted_parts(parts: DataFrame, late: str = "1 day") -> DataFrame:
    """The first arrival of each (upload, part, digest); a resent part is dropped while the watermark holds it."""
    return parts.withWatermark("at", late).dropDuplicatesWithinWatermark(["upload", "part", "digest"])


def job_states(events: DataFrame) -> DataFrame:
    """The state machine QUEUED -> RUNNING -> DONE or FAILED: a claim is taken once, a state never goes back."""

    def advance(key, groups, state):
        import pandas as pd

        status = state.get[0] if state.exists else None
        rows = []
        for group in groups:
            for wanted in group.sort_values(["at", "event_id"])["status"]:
                fits = (status is None and wanted == "QUEUED") or (status is not None and ORDER[wanted] == ORDER[status] + 1)
                fits = fits or (status == "QUEUED" and wanted == "FAILED")
                status = wanted if fits else status
                rows.append((key[0], status, fits))
        if status is not None:
            state.update((status, status != "QUEUED"))
        yield pd.DataFrame(rows, columns=["job", "status", "accepted"])

    return events.groupBy("job").applyInPandasWithState(advance, OUTPUT, STATE, "append", "NoTimeout")


def progress_sink(progress: DataFrame, observe, checkpoint: str):
    """Hands each micro-batch to ``observe``; a failure of the observer doesn't stop the stream."""

    def each(batch, number):
        try:
            observe(batch, number)
        except Exception as e:  # an observer is no part of the calculation
            print(f"progress observer failed on batch {number}: {e}")

    return progress.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
