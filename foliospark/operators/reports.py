"""Reliability reports over admission events, planner tasks, jobs and documents: summaries, hard invariants, gates, acceptance."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The gates' default limits.
LIMITS = {"dead_letters": 0, "failure_rate": 0.0, "retry_success": 1.0, "tasks_document": 6, "tasks_page": 3}
FAILURES = ("failed", "dead_letter")


def counters(name: str, rows: DataFrame, key: Column) -> DataFrame:
    """(summary, key, n): a count by key; what has no key counts as unknown."""
    k = F.lower(F.trim(key.cast("string")))
    return rows.groupBy(F.coalesce(F.nullif(k, F.lit("")), F.lit("unknown")).alias("key")).agg(F.count("*").cast("double").alias("n")).select(F.lit(name).alias("summary"), "key", "n")


def measures(name: str, rows: DataFrame, **values: Column) -> DataFrame:
    """(summary, key, n): one aggregate a key, in one pass."""
    one = rows.agg(*[c.cast("double").alias(k) for k, c in values.items()])
    pairs = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.col, values)))
    return one.select(F.lit(name).alias("summary"), F.explode(pairs).alias("key", "n"))


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summaries(events: DataFrame, tasks: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """The report's summaries as (summary, key, n).

    events: decision, reasons (array), concrete; tasks: document, page, status, backend, mode, schema, visual_tokens; jobs: queue, status, attempts;
    documents: review_status, and per document expected and missing fields (arrays)."""
    rejected = F.startswith("decision", F.lit("rejected"))
    reasons = events.filter(rejected).select(F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array("decision"))).alias("r"))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    n = F.count("*")
    return stacked(
        measures("admission", events, admitted=F.count_if(F.startswith("decision", F.lit("admitted"))), rejected=F.count_if(rejected), duplicates=F.count_if(F.col("decision") == "rejected_duplicate")),
        counters("rejections", reasons, F.col("r")),
        measures("evidence", events, concrete=F.count_if("concrete"), missing=F.count_if(~F.coalesce("concrete", F.lit(False))), coverage=share(F.count_if("concrete"), n)),
        measures("planner", tasks, selected=F.count_if(F.startswith("status", F.lit("selected"))), skipped=F.count_if(F.startswith("status", F.lit("skipped"))), over_budget=F.count_if(F.col("status") == "skipped_budget_exceeded"), visual_tokens=F.coalesce(F.sum("visual_tokens"), F.lit(0))),
        counters("modes", tasks, F.col("mode")),
        measures("contracts", tasks, contracted=F.count_if(F.coalesce("schema", F.lit("")) != ""), missing=F.count_if(F.coalesce("schema", F.lit("")) == "")),
        counters("schemas", tasks.filter("schema <> ''"), F.col("schema")),
        counters("backends", tasks.filter(F.startswith("status", F.lit("selected"))), F.col("backend")),
        counters("outcomes", jobs, F.col("status")),
        measures("safe", jobs, unsafe=F.count_if(F.col("status").isin(*FAILURES))),
        measures("coverage", documents, regions=F.count_if(F.size("expected") > 0), full=F.count_if((F.size("expected") > 0) & (F.size("missing") == 0)), none=F.count_if((F.size("expected") > 0) & (F.size("missing") == F.size("expected"))), expected=F.sum(F.size("expected")), absent=F.sum(F.size("missing")), mean=F.round(F.avg(F.when(F.size("expected") > 0, (F.size("expected") - F.size("missing")) / F.size("expected"))), 4)),
        counters("absent_fields", documents.select(F.explode("missing").alias("m")), F.col("m")),
        counters("review", documents, F.col("review_status")),
    )


def violations(rules: dict[str, DataFrame], examples: int = 10) -> DataFrame:
    """rules: invariant to the rows (id) that break it.  (invariant, violations, examples): every invariant comes, with its first examples."""
    names = next(iter(rules.values())).sparkSession.createDataFrame([(n,) for n in rules], "invariant string")
    rows = stacked(*[df.select(F.lit(n).alias("invariant"), F.col("id").cast("string").alias("id")) for n, df in rules.items()])
    nth = rows.withColumn("_n", F.row_number().over(Window.partitionBy("invariant").orderBy("id"))).filter(F.col("_n") <= examples)  # a group limit
    some = nth.groupBy("invariant").agg(F.array_sort(F.collect_list("id")).alias("examples"))
    count = rows.groupBy("invariant").agg(F.count("*").alias("violations"))
    return names.join(count, "invariant", "left").join(some, "invariant", "left").select("invariant", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def service_gates(jobs: DataFrame, tasks: DataFrame, targets: tuple[str, ...], limits: dict = LIMITS) -> DataFrame:
    """(gate, violations, passed).  jobs: queue, status, attempts, max_attempts, code; tasks: document, page, status."""
    failure = F.col("status").isin(*FAILURES)
    dead = jobs.agg(F.count_if(F.col("queue").isin(*targets) & (F.col("status") == "dead_letter")).alias("n")).select(F.lit("targetQueueDeadLetters").alias("gate"), F.when(F.col("n") > limits["dead_letters"], F.col("n")).otherwise(0).alias("violations"))
    unnamed = jobs.agg(F.count_if(failure & F.col("code").isNull()).alias("violations")).select(F.lit("classifiedOperationalFailures").alias("gate"), "violations")
    rate = jobs.groupBy("queue").agg(F.avg(failure.cast("double")).alias("r")).agg(F.count_if(F.col("r") > limits["failure_rate"]).alias("violations")).select(F.lit("runtimeFailureRates").alias("gate"), "violations")
    again = jobs.filter("attempts > 1").agg(F.avg((F.col("status") == "succeeded").cast("double")).alias("r")).select(F.lit("retrySuccessRate").alias("gate"), F.when(F.coalesce("r", F.lit(1.0)) < limits["retry_success"], 1).otherwise(0).cast("long").alias("violations"))
    chosen = tasks.filter(F.startswith("status", F.lit("selected")))
    wide = stacked(chosen.groupBy("document").agg(F.count("*").alias("n")).filter(F.col("n") > limits["tasks_document"]).select("n"), chosen.groupBy("document", "page").agg(F.count("*").alias("n")).filter(F.col("n") > limits["tasks_page"]).select("n"))
    fan = wide.agg(F.count("*").alias("violations")).select(F.lit("runawayFanout").alias("gate"), "violations")
    safe = jobs.agg(F.count_if(F.col("attempts") > F.col("max_attempts")).alias("violations")).select(F.lit("retrySafeJobs").alias("gate"), "violations")
    return stacked(dead, unnamed, rate, again, fan, safe).select("gate", F.col("violations").cast("long").alias("violations"), (F.col("violations") == 0).alias("passed"))


def accepted(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(summary, key, stored, recomputed, agrees) of all keys of both: what one side lacks does not agree."""
    a = stored.select("summary", "key", F.col("n").alias("stored"))
    b = recomputed.select("summary", "key", F.col("n").alias("recomputed"))
    return a.join(b, ["summary", "key"], "full").withColumn("agrees", F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= tolerance, F.col("stored").isNull() & F.col("recomputed").isNull() & F.lit(False)))


def worst_leaves(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics: metric, leaf, value; thresholds: metric, direction, threshold.  A metric is as good as its worst leaf; one that is absent or not
    finite fails."""
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    worst = metrics.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.bool_and(F.coalesce(finite, F.lit(False))).alias("finite"))
    x = thresholds.join(worst, "metric", "left").withColumn("value", F.when(F.col("direction") == "min", F.col("low")).otherwise(F.col("high")))
    ok = F.when(F.col("direction") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return x.select("metric", "value", "threshold", F.coalesce(ok & F.col("finite"), F.lit(False)).alias("passed"))


def manifest_checks(evidence: DataFrame, sections: tuple[str, ...], metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(check, passed): each required section has evidence (section, run_id), and each metric passes its threshold."""
    wanted = evidence.sparkSession.createDataFrame([(x,) for x in sections], "section string")
    there = wanted.join(evidence.filter("run_id IS NOT NULL").select("section").distinct().withColumn("_ok", F.lit(True)), "section", "left")
    return there.select(F.concat(F.lit("evidence."), "section").alias("check"), F.coalesce("_ok", F.lit(False)).alias("passed")).unionByName(worst_leaves(metrics, thresholds).select(F.concat(F.lit("metric."), "metric").alias("check"), "passed"))
