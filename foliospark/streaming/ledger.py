"""Streaming forms: file intake that skips known content, windowed queue health, and leases with expiry per job."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.sources.files import described


def watch(spark: SparkSession, folder: str, known: DataFrame, pattern: str = "*.pdf") -> DataFrame:
    """New files of a folder as a stream: PDFs by their first bytes, whose sha256 is not in `known` (sha)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return described(files).filter("mime = 'application/pdf'").join(known.select("sha"), "sha", "left_anti")


def queue_windows(jobs: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by queue, status and event-time window; rows later than the watermark are dropped, as streams must."""
    return jobs.withWatermark("scheduled_at", late).groupBy(F.window("scheduled_at", size), "queue", "status").agg(F.count("*").alias("jobs")).select(F.col("window.start").alias("start"), "queue", "status", "jobs")


FINAL = ("succeeded", "cancelled")


def leases(events: DataFrame, seconds: int) -> DataFrame:
    """events: job_id, kind (claim, heartbeat, complete, cancel), at (epoch seconds, ordered by arrival).  Emits each job's status after each
    batch: a lease without a sign of life for `seconds` goes back to the queue; completed and cancelled are final, and their state is
    removed after `seconds` more, in which late events of the job change nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, attempts, _ = state.get
            if status == "leased":
                state.update(("queued", attempts, 0))
                yield pd.DataFrame({"job_id": [key[0]], "status": ["queued"], "attempts": [attempts]})
            elif status in FINAL:
                state.remove()
            return
        status, attempts, last = state.get if state.exists else ("queued", 0, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for kind, at in zip(rows["kind"], rows["at"], strict=True):
            if status in FINAL:
                break
            if status == "leased" and at - last > seconds:
                status = "queued"
            if kind == "claim" and status == "queued":
                status, attempts, last = "leased", attempts + 1, at
            elif kind == "heartbeat" and status == "leased":
                last = at
            elif kind == "complete" and status == "leased":
                status = "succeeded"
            elif kind == "cancel":
                status = "cancelled"
        state.update((status, attempts, int(last)))
        if status == "leased" or status in FINAL:
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, attempts int", "status string, attempts int, last long", "update", GroupStateTimeout.ProcessingTimeTimeout)
