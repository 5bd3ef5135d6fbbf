"""Job ledger: claim order, failure and retry, health, roll-ups, gates, fingerprints."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions.text import failure_code, retry_delay


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over fail and are due at once, or are dead if no attempt is left.  jobs without lease_until have no leases."""
    if "lease_until" not in jobs.columns:
        return jobs
    lost = F.coalesce((F.col("status") == "running") & (F.col("lease_until") <= now), F.lit(False))
    dead = F.col("attempts") >= F.col("max_attempts")
    return jobs.withColumns({
        "status": F.when(lost & dead, "dead_letter").when(lost, "failed").otherwise(F.col("status")),
        "scheduled_at": F.when(lost & ~dead, now).otherwise(F.col("scheduled_at")),
        "lease_until": F.when(~lost, F.col("lease_until")),
    })


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """The next job of each queue, expired leases recovered first: queued or failed, due, attempts left; by priority, then schedule, then id."""
    rows = recovered(jobs, now).filter(F.col("status").isin("queued", "failed") & (F.col("scheduled_at") <= now) & (F.col("attempts") < F.col("max_attempts")))
    w = Window.partitionBy("queue").orderBy(F.desc("priority"), "scheduled_at", "job_id")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def after_failure(jobs: DataFrame, error_class: Column | None = None, retryable: Column | None = None) -> DataFrame:
    """Jobs whose run has just failed, with their next status, delay and failure code.  attempts counts that run: a claim has added it.

    Without attempts left, or if no retry helps, a job is dead; else it is failed and due after the back-off; a cancelled one stays so."""
    dead = F.col("attempts") >= F.col("max_attempts")
    if retryable is not None:
        dead = dead | ~retryable
    error = F.lit(None).cast("string") if error_class is None else error_class
    code = failure_code(F.col("queue"), F.col("job_type"), error)
    status = F.when(F.col("status") == "cancelled", "cancelled").when(dead, "dead_letter").otherwise("failed")
    return jobs.select("job_id", "attempts", status.alias("next_status"), F.when(status == "failed", retry_delay(F.col("attempts"))).otherwise(0).alias("delay_seconds"), F.when(status != "cancelled", code).alias("failure_code"))


CANCELLABLE = ("queued", "failed")


def cancelled(
    jobs: DataFrame, *, job_ids: tuple[int, ...] = (), document_ids: tuple[int, ...] = (), title_prefix: str | None = None, queues: tuple[str, ...] = (), statuses: tuple[str, ...] = CANCELLABLE, running: bool = False, most: int = 250
) -> DataFrame:
    """The ledger after a bulk cancel of at most `most` jobs, by priority and schedule.

    A selector is needed: ids of jobs or documents, or how titles begin (any case); queues and statuses only narrow it.  Running jobs are
    cancelled with `running` alone; finished ones never."""
    if not (job_ids or document_ids or title_prefix):
        raise ValueError("a bulk cancel needs job_ids, document_ids or title_prefix")
    wanted = set(statuses or CANCELLABLE) | ({"running", "leased"} if running else set())
    if wanted & {"running", "leased"} and not running:
        raise ValueError("running jobs need running=True")
    if wanted - {"queued", "failed", "running", "leased"}:
        raise ValueError(f"no status that can be cancelled: {sorted(wanted - {'queued', 'failed', 'running', 'leased'})}")
    hit = F.col("status").isin(*wanted)
    for column, values in (("job_id", job_ids), ("document_id", document_ids), ("queue", queues)):
        if values:
            hit = hit & F.col(column).isin(*values)
    if title_prefix:
        hit = hit & F.col("title").ilike(title_prefix + "%")
    chosen = jobs.filter(hit).orderBy(F.desc("priority"), "scheduled_at", "job_id").limit(most).select(F.col("job_id").alias("_id"))
    return jobs.join(chosen, F.col("job_id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNotNull(), "cancelled").otherwise(F.col("status"))).drop("_id")


def retried(jobs: DataFrame, now: Column, statuses: tuple[str, ...] = ("failed", "dead_letter", "cancelled")) -> DataFrame:
    """The ledger after a bulk retry: jobs of the statuses, and running ones whose lease is over, are queued anew, without attempts, at once."""
    hit = F.col("status").isin(*statuses)
    changes = {"attempts": F.lit(0), "scheduled_at": now}
    if "lease_until" in jobs.columns:
        hit = hit | F.coalesce((F.col("status") == "running") & (F.col("lease_until") <= now), F.lit(False))
        changes["lease_until"] = F.lit(None).cast("timestamp")
    marked = jobs.withColumn("_hit", hit)
    out = marked.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()} | {"status": F.when(F.col("_hit"), "queued").otherwise(F.col("status"))})
    return out.drop("_hit")


def health(jobs: DataFrame, now: Column, timeouts: tuple[str, ...] = ()) -> DataFrame:
    """Queues by last success, dead jobs, failures of the kinds that are timeouts, depth and the age of what waits longest."""
    return jobs.groupBy("queue").agg(
        F.unix_timestamp(F.max(F.when(F.col("status") == "succeeded", F.col("scheduled_at")))).alias("last_success"),
        F.count_if(F.col("status") == "dead_letter").alias("errors"),
        F.count_if(F.col("status").isin("failed", "dead_letter") & F.col("job_type").isin(*timeouts)).alias("timeouts"),
        F.count_if(F.col("status").isin("queued", "running")).alias("depth"),
        F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(F.min(F.when(F.col("status") == "queued", F.col("scheduled_at"))))).alias("oldest_age"),
    )


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fingerprint(rows: DataFrame, group: str, *columns: str, parts: int = 4096) -> DataFrame:
    """(group, n, fingerprint): the same whatever the order in which rows come.

    The sorted hashes of the rows of each of `parts` parts, by the hash's first three digits, are hashed, then the sorted hashes of
    the parts: a group is never one array."""
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    hashed = rows.select(group, F.sha2(F.concat_ws("|", *[cell(c) for c in columns]), 256).alias("h"))
    part = F.pmod(F.conv(F.left("h", F.lit(3)), 16, 10).cast("int"), F.lit(parts))
    some = hashed.groupBy(group, part.alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("p"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"])
    return some.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(ordered, ","), 256).alias("fingerprint"))


def gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics (metric, value) against thresholds (metric, direction, threshold); absent or non-finite values fail."""
    ok = F.when(F.col("direction") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return thresholds.join(metrics, "metric", "left").select("metric", "value", "threshold", F.coalesce(ok & ~F.isnan("value") & (F.abs("value") != float("inf")), F.lit(False)).alias("passed"))
