"""Queries over the job ledger and quality gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import ledger
from foliospark.sources.tables import SQL, documents, jobs, table

NOW = "2024-02-01 00:00:00"
JOBS = f"WITH {SQL['jobs']} "


def _now():
    return F.lit(NOW).cast("timestamp")


def _leased(s, d):
    return jobs(s, d).withColumns({"lease_until": F.when(F.col("status") == "running", F.col("scheduled_at") + F.expr("INTERVAL 1 HOUR")), "title": F.concat("job_type", F.lit(" of "), "queue")})


def job_failures(s, d):
    error = F.when(F.col("job_id") % 3 == 0, "ModelTimeoutError").otherwise("ParseError")
    return ledger.after_failure(jobs(s, d).filter("status IN ('running', 'failed')"), error, F.col("job_id") % 5 != 0)


def bulk_changes(s, d):
    """Jobs after a bulk cancel of two queues and a bulk retry of dead jobs."""
    x = ledger.cancelled(_leased(s, d), queues=("q1", "q2"), title_prefix="T1", running=True)
    return ledger.retried(x, _now(), ("dead_letter",)).select("job_id", "status", "attempts", F.unix_timestamp("scheduled_at").alias("scheduled"))


def job_rollup(s, d):
    return jobs(s, d).groupBy("queue", "job_type", "status").agg(F.count("*").alias("jobs"), F.sum("attempts").alias("attempts"), F.max("max_attempts").alias("max_attempts"))


def slo_gates(s, d):
    x = jobs(s, d).groupBy("queue").agg(F.count_if(F.col("status") == "dead_letter").alias("dead_letters"), F.round(F.avg((F.col("status") == "failed").cast("double")), 4).alias("failure_rate"))
    return x.withColumn("passed", (F.col("dead_letters") == 0) & (F.col("failure_rate") <= 0.25))


def gold_metric_gate(s, d):
    x = documents(s, d)
    m = x.groupBy("family").agg(F.round(F.avg((F.col("review_status") != "needs_review").cast("double")), 4).alias("value")).select(F.concat(F.lit("accepted_"), "family").alias("metric"), "value")
    t = s.createDataFrame([("accepted_en", "min", 0.9), ("accepted_de", "min", 0.5), ("accepted_fr", "max", 0.99), ("accepted_xx", "min", 0.5)], "metric string, direction string, threshold double")
    return ledger.gate(m, t)


def family_vote(s, d):
    """The family with most weight in each folder, long documents counting more; a narrow lead gives generic_form."""
    from pyspark.sql.window import Window

    v = documents(s, d).groupBy("folder", "family").agg(F.sum(F.when(F.col("n_chars") > 2000, 1.25).otherwise(0.5)).alias("votes"))
    w = Window.partitionBy("folder").orderBy(F.desc("votes"), "family")
    v = v.withColumns({"n": F.row_number().over(w), "lead": F.col("votes") - F.coalesce(F.lead("votes").over(w), F.lit(0.0))}).filter("n = 1")
    return v.select("folder", F.when(F.col("lead") < 0.5, "generic_form").otherwise(F.col("family")).alias("family"), "votes")


def content_duplicates(s, d):
    x = table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = x.groupBy("sha").agg(F.min("doc_id").alias("original"), F.count("*").alias("copies")).filter("copies > 1")
    return x.join(first, "sha").filter("doc_id <> original").select("doc_id", "original", "sha")


def incremental_embed(s, d):
    """Rows whose content the index does not hold yet; the index holds the documents with even numbers."""
    x = table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return x.join(x.filter("doc_id % 2 = 0").select("sha"), "sha", "left_anti").select("doc_id", "sha")


def plan_budget(s, d):
    """At most 6 tasks a document and 3 a page, buckets in order; line 1 of an order is page 1, and so on by threes."""
    from pyspark.sql.window import Window

    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.expr("(l_linenumber - 1) div 3").alias("page"), F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("bucket"))
    order = ["bucket", "l_linenumber"]
    t = t.withColumn("n_page", F.row_number().over(Window.partitionBy("id", "page").orderBy(*order))).filter("n_page <= 3")
    return t.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter("n <= 6").select("id", "l_linenumber", "n")


QUERIES = {
    "job_claim_order": lambda s, d: ledger.claimable(_leased(s, d), _now()).select("queue", "job_id", "priority"),
    "job_failures": job_failures,
    "bulk_changes": bulk_changes,
    "job_retry_schedule": lambda s, d: ledger.after_failure(jobs(s, d).filter("status = 'failed'")).drop("failure_code"),
    "queue_health": lambda s, d: ledger.health(jobs(s, d), _now(), ("t0",)),
    "latest_health": lambda s, d: ledger.latest(jobs(s, d), "queue", F.desc("scheduled_at"), F.desc("job_id")).select("queue", "job_id", "status"),
    "job_rollup": job_rollup,
    "slo_gates": slo_gates,
    "gold_metric_gate": gold_metric_gate,
    "repeatability_fingerprint": lambda s, d: ledger.fingerprint(jobs(s, d), "queue", "job_id", "status", "attempts"),
    "family_vote": family_vote,
    "content_duplicates": content_duplicates,
    "incremental_embed": incremental_embed,
    "plan_budget": plan_budget,
}

ORACLES = {
    "job_failures": f"""{JOBS}, x AS (SELECT *, attempts >= max_attempts OR job_id % 5 = 0 AS dead FROM jobs WHERE status IN ('running', 'failed'))
    SELECT job_id, attempts, CASE WHEN dead THEN 'dead_letter' ELSE 'failed' END AS next_status, CASE WHEN dead THEN 0 ELSE [30, 30, 60, 120][attempts + 1] END AS delay_seconds,
    queue || '_' || CASE WHEN job_id % 3 = 0 THEN 'model_timeout' ELSE 'parse_error' END AS failure_code FROM x""",
    "bulk_changes": f"""{JOBS}, k AS (SELECT job_id FROM jobs WHERE status IN ('queued', 'failed', 'running') AND queue IN ('q1', 'q2') AND job_type = 't1' ORDER BY priority DESC, scheduled_at, job_id LIMIT 250),
    c AS (SELECT *, job_id IN (FROM k) AS stopped FROM jobs), h AS (SELECT *, NOT stopped AND (status = 'dead_letter' OR (status = 'running' AND scheduled_at + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}')) AS again FROM c)
    SELECT job_id, CASE WHEN stopped THEN 'cancelled' WHEN again THEN 'queued' ELSE status END AS status, CASE WHEN again THEN 0 ELSE attempts END AS attempts, CAST(floor(epoch(CASE WHEN again THEN TIMESTAMP '{NOW}' ELSE scheduled_at END)) AS BIGINT) AS scheduled FROM h""",
    "job_claim_order": f"""{JOBS}, e AS (SELECT *, status = 'running' AND scheduled_at + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}' AS over FROM jobs),
    back AS (SELECT queue, job_id, priority, CASE WHEN over THEN TIMESTAMP '{NOW}' ELSE scheduled_at END AS due FROM e WHERE attempts < max_attempts AND (over OR status IN ('queued', 'failed')))
    SELECT queue, job_id, priority FROM back WHERE due <= TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY queue ORDER BY priority DESC, due, job_id) = 1""",
    "job_retry_schedule": f"{JOBS} SELECT job_id, attempts, CASE WHEN attempts >= max_attempts THEN 'dead_letter' ELSE 'failed' END AS next_status, CASE WHEN attempts < max_attempts THEN [30, 30, 60][attempts + 1] ELSE 0 END AS delay_seconds FROM jobs WHERE status = 'failed'",
    "queue_health": f"""{JOBS} SELECT queue, CAST(floor(epoch(max(CASE WHEN status = 'succeeded' THEN scheduled_at END))) AS BIGINT) AS last_success, count(*) FILTER (WHERE status = 'dead_letter') AS errors, count(*) FILTER (WHERE status IN ('failed', 'dead_letter') AND job_type = 't0') AS timeouts, count(*) FILTER (WHERE status IN ('queued', 'running')) AS depth,
    greatest(0, CAST(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(min(CASE WHEN status = 'queued' THEN scheduled_at END))) AS BIGINT)) AS oldest_age FROM jobs GROUP BY queue""",
    "latest_health": f"{JOBS} SELECT queue, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY queue ORDER BY scheduled_at DESC, job_id DESC) = 1",
    "job_rollup": f"{JOBS} SELECT queue, job_type, status, count(*) AS jobs, CAST(sum(attempts) AS BIGINT) AS attempts, max(max_attempts) AS max_attempts FROM jobs GROUP BY ALL",
    "slo_gates": f"{JOBS}, x AS (SELECT queue, count(*) FILTER (WHERE status = 'dead_letter') AS dead_letters, round(avg(CASE WHEN status = 'failed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS failure_rate FROM jobs GROUP BY queue) SELECT *, dead_letters = 0 AND failure_rate <= 0.25 AS passed FROM x",
    "gold_metric_gate": f"""WITH {SQL['docs']}, m AS (SELECT 'accepted_' || family AS metric, round(avg(CASE WHEN review_status <> 'needs_review' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS value FROM docs GROUP BY 1),
    t AS (SELECT * FROM (VALUES ('accepted_en', 'min', 0.9::DOUBLE), ('accepted_de', 'min', 0.5::DOUBLE), ('accepted_fr', 'max', 0.99::DOUBLE), ('accepted_xx', 'min', 0.5::DOUBLE)) v(metric, direction, threshold))
    SELECT metric, value, threshold, coalesce(CASE WHEN direction = 'min' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM t LEFT JOIN m USING (metric)""",
    "repeatability_fingerprint": f"""{JOBS}, h AS (SELECT queue, sha256('=' || job_id || '|' || coalesce('=' || status, '-') || '|=' || attempts) AS h FROM jobs),
    p AS (SELECT queue, left(h, 3) AS part, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS p FROM h GROUP BY ALL) SELECT queue, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p, ',' ORDER BY part)) AS fingerprint FROM p GROUP BY queue""",
    "family_vote": f"""WITH {SQL['docs']}, v AS (SELECT folder, family, sum(CASE WHEN n_chars > 2000 THEN 1.25::DOUBLE ELSE 0.5::DOUBLE END) AS votes FROM docs GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS n, votes - coalesce(lead(votes) OVER w, 0) AS lead FROM v WINDOW w AS (PARTITION BY folder ORDER BY votes DESC, family))
    SELECT folder, CASE WHEN lead < 0.5 THEN 'generic_form' ELSE family END AS family, votes FROM r WHERE n = 1""",
    "content_duplicates": "WITH x AS (SELECT doc_id, sha256(text) AS sha FROM documents) SELECT doc_id, original, sha FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS original FROM x) WHERE doc_id <> original",
    "incremental_embed": "WITH x AS (SELECT doc_id, sha256(text) AS sha FROM documents) SELECT doc_id, sha FROM x WHERE sha NOT IN (SELECT sha FROM x WHERE doc_id % 2 = 0)",
    "plan_budget": """WITH t AS (SELECT l_orderkey AS id, l_linenumber, (l_linenumber - 1) // 3 AS page, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS bucket FROM lineitem),
    p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id, page ORDER BY bucket, l_linenumber) <= 3)
    SELECT id, l_linenumber, CAST(row_number() OVER (PARTITION BY id ORDER BY bucket, l_linenumber) AS INT) AS n FROM p QUALIFY n <= 6""",
}
