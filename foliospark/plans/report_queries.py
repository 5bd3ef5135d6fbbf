"""Queries of the reliability reports, read models and roll-ups."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import text as T
from foliospark.operators import facts, filters, reports
from foliospark.plans.search_queries import BESIDE, DOCS, EDGES, HOUSEHOLD, USER, chunks
from foliospark.sources.tables import SQL, documents, due_days, folders, jobs, relations, table, tags, totals

TARGETS = ("q0", "q1")


def _report(s, d):
    """Admission events, planner tasks, jobs and documents of a report, from events, order lines and documents."""
    li, e = table(s, d, "lineitem"), jobs(s, d)
    decision = F.when(F.col("l_returnflag") == "N", "admitted_field").when(F.col("l_partkey") % 7 == 0, "rejected_duplicate").otherwise("rejected_quality")
    reasons = F.when(F.col("l_partkey") % 3 == 0, F.array()).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("Placeholder"), F.lit("prompt_echo"))).otherwise(F.array(F.lit("no_evidence"))).cast("array<string>")
    events = li.select(F.col("l_orderkey").alias("document"), decision.alias("decision"), reasons.alias("reasons"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 2 == 0).alias("concrete"), F.col("l_linenumber"), F.col("l_partkey"))
    status = F.when(F.col("l_linenumber") <= 4, "selected").when(F.col("l_partkey") % 2 == 0, "skipped_budget_exceeded").otherwise("skipped_low_value")
    tasks = li.select(F.col("l_orderkey").alias("document"), F.expr("(l_linenumber - 1) div 2").alias("page"), status.alias("status"), F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("Backend"), (F.col("l_suppkey") % 3).cast("string"))).alias("backend"), F.when(F.col("l_partkey") % 5 == 0, " ").otherwise("Exact").alias("mode"), F.when(F.col("l_partkey") % 6 != 0, F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string"))).alias("schema"), F.col("l_quantity").cast("long").alias("visual_tokens"))
    docs = documents(s, d)
    expected = F.filter(F.array(F.lit("total"), F.lit("date"), F.lit("party")), lambda x: (F.col("id") % 4 != 0) | F.lit(False))
    docs = docs.select("id", "review_status", expected.alias("expected")).withColumn("missing", F.filter("expected", lambda x: F.when(x == "total", F.col("id") % 3 == 0).when(x == "date", F.col("id") % 6 == 0).otherwise(F.col("id") % 12 == 6)))
    return events, tasks, e.withColumn("code", F.when(F.col("job_id") % 9 != 0, T.failure_code(F.col("queue"), F.col("job_type"), F.lit("ParseError")))), docs


def report_summaries(s, d):
    return reports.summaries(*_report(s, d))


def hard_invariants(s, d):
    """Checks of tasks, admissions, reviews and jobs.  After a review (a label) a document is confirmed or needs another one, but is not auto-accepted."""
    events, tasks, ledger, docs = _report(s, d)
    reviewed = table(s, d, "labels").select(F.col("doc_id").alias("id"))
    chosen = tasks.filter("status = 'selected'").select(F.col("document").alias("id"), "schema", "backend")
    admitted = events.filter(F.startswith("decision", F.lit("admitted"))).withColumn("id", F.col("document") * 10 + F.col("l_linenumber"))
    return reports.violations({
        "selectedTasksMissingContract": chosen.filter("schema IS NULL").select("id"),
        "selectedTasksMissingGrounding": chosen.filter("backend IS NULL").select("id"),
        "admittedWithoutConcreteEvidence": admitted.filter("NOT coalesce(concrete, false)").select("id"),
        "placeholdersAdmitted": admitted.filter(F.exists("reasons", lambda r: T.is_placeholder(r))).select("id"),
        "reviewedDocumentsAutoAccepted": docs.filter("review_status = 'auto_accepted'").join(reviewed, "id", "left_semi").select("id"),
        "jobsPastTheirAttempts": ledger.filter("attempts > max_attempts").select(F.col("job_id").alias("id")),
    }).withColumn("examples", F.array_join("examples", ","))


def operational_gates(s, d):
    _, tasks, ledger, _ = _report(s, d)
    return reports.service_gates(ledger, tasks, TARGETS)


def report_acceptance(s, d):
    """A stored report against its recomputed numbers: one is changed, one is left out."""
    now = report_summaries(s, d)
    stored = now.filter("NOT (summary = 'evidence' AND key = 'missing')").withColumn("n", F.when((F.col("summary") == "admission") & (F.col("key") == "admitted"), F.col("n") + 1).otherwise(F.col("n")))
    return reports.accepted(stored, now)


def gold_leaves(s, d):
    m = documents(s, d).groupBy("family", "folder").agg(F.avg((F.col("review_status") != "needs_review").cast("double")).alias("v")).select(F.concat(F.lit("accepted_"), "family").alias("metric"), F.col("folder").alias("leaf"), F.round("v", 6).alias("value"))
    m = m.unionByName(s.createDataFrame([("broken", "x", float("nan")), ("broken", "y", 1.0)], "metric string, leaf string, value double"))
    t = s.createDataFrame([("accepted_en", "min", 0.4), ("accepted_de", "max", 1.0), ("accepted_fr", "min", 0.99), ("absent", "min", 0.1), ("broken", "min", 0.1)], "metric string, direction string, threshold double")
    return reports.worst_leaves(m, t)


def document_detail(s, d):
    """The read model of a document: amounts, folder, tags, open deadlines, readable relations; each child is counted before the join."""
    docs = documents(s, d)
    seen = filters.readable(docs, folders(docs), USER, HOUSEHOLD)
    names = tags(docs).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("tag").alias("k"), "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    open_ = due_days(docs).filter(F.col("status").isin(*filters.OPEN_DEADLINES)).groupBy("id").agg(F.count("*").alias("open_deadlines"), F.min("due").alias("next_due"))
    ends = facts.undirected(relations(docs).filter("status <> 'rejected'")).join(seen.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.count_distinct("other").alias("related"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = seen.join(totals(s, d), "id", "left").join(names, "id", "left").join(open_, "id", "left").join(ends, "id", "left")
    return out.select("id", "folder", "total", F.coalesce("tags", F.lit("")).alias("tags"), zero("open_deadlines"), "next_due", zero("related"))


def corpus_counts(s, d):
    """Children of each document, counted apart and joined: no fan-out."""
    docs = documents(s, d)
    ends = relations(docs).select(F.explode(F.array("a", "b")).alias("id"))
    parts = {"tags": tags(docs), "chunks": chunks(s, d), "deadlines": due_days(docs), "edges": ends, "lines": table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"))}
    out = docs.select("id")
    for name, rows in parts.items():
        out = out.join(rows.groupBy("id").agg(F.count("*").alias(name)), "id", "left")
    return out.na.fill(0)


def contact_list(s, d):
    """Customers with their aliases and number of documents; the two are aggregated apart."""
    c, o = table(s, d, "customer"), table(s, d, "orders")
    alias = c.select(F.col("c_custkey").alias("id"), F.explode(F.array(F.col("c_name"), F.concat(F.lit("The "), F.col("c_mktsegment")), F.lower("c_name"))).alias("alias"))
    names = alias.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("alias")), "|").alias("aliases"))
    count = o.groupBy(F.col("o_custkey").alias("id")).agg(F.count_distinct("o_orderkey").alias("documents"), F.max("o_orderdate").alias("last"))
    out = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).join(names, "id", "left").join(count, "id", "left")
    return out.select("id", "name", "aliases", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), F.to_date("last").alias("last"))


def canonical_rollup(s, d):
    """Canonical fields rolled up to their document, and its status by open tasks."""
    li = table(s, d, "lineitem")
    path = F.when(F.col("l_returnflag") == "A", "invoice.total").when(F.col("l_returnflag") == "N", "receipt.total").otherwise("invoice.seller")
    f = li.select(F.col("l_orderkey").alias("id"), path.alias("path"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.concat(F.lit("supplier "), F.lpad(F.col("l_suppkey").cast("string"), 4, "0")).alias("name"), F.col("l_shipdate"))
    up = f.groupBy("id").agg(F.max(F.when(F.col("path").isin("invoice.total", "receipt.total"), F.col("amount"))).alias("total"), F.max(F.when(F.col("path") == "invoice.seller", F.col("name"))).alias("counterparty"), F.to_date(F.max("l_shipdate")).alias("day"))
    tasks = table(s, d, "orders").filter("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("id")).withColumn("_open", F.lit(True))
    return up.join(tasks, "id", "left").select("id", "total", "counterparty", "day", F.when(F.col("_open"), "needs_review").otherwise("auto_accepted").alias("review_status"))


def fact_maps(s, d):
    """The first typed value of each path of a document as a JSON object, keys in order, and the sum of all amounts."""
    li = table(s, d, "lineitem")
    f = li.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("line."), F.lower("l_returnflag")).alias("path"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity").cast("int").cast("string")).alias("value"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.col("l_suppkey"))
    one = f.filter("value IS NOT NULL").groupBy("id", "path").agg(F.min_by("value", F.struct("pos", "l_suppkey", "value")).alias("value"))
    maps = one.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value"))))).alias("facts"))
    return maps.join(li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount")), "id")


def review_queue(s, d):
    """Open reviews: priority, age, then number; nulls last."""
    o = table(s, d, "orders").filter("o_orderstatus = 'O'")
    p = F.when(F.col("o_orderpriority").startswith("1"), 90).when(F.col("o_orderpriority").startswith("2"), 70).when(F.col("o_orderpriority").startswith("3"), 50)
    rows = o.select("o_orderkey", p.alias("priority"), F.to_date("o_orderdate").alias("created"))
    return rows.orderBy(F.col("priority").desc_nulls_last(), "created", "o_orderkey").limit(200)


def folder_paths(s, d):
    """Folders below their parents: nations in regions."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"))


def best_membership(s, d):
    """Of each customer's orders the one of the best rank: urgent before high before the others, then the latest."""
    o = table(s, d, "orders")
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    best = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct(rank.alias("r"), (-F.unix_timestamp("o_orderdate")).alias("t"), "o_orderkey")).alias("o_orderkey"))
    return table(s, d, "customer").select("c_custkey").join(best, "c_custkey", "left")


def latest_plans(s, d):
    """The rows of the latest day of each part: all of them, ties too."""
    li = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"))
    return li.withColumn("r", F.rank().over(w)).filter("r = 1").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


def value_locations(s, d):
    """The first chunk of a document that holds a value, whatever the case; else the document as a whole."""
    want = documents(s, d).select("id", F.lower(F.regexp_extract("text", r"(\S{6,})\s*$", 1)).alias("value")).filter("value <> ''")
    hit = chunks(s, d).join(want, "id").filter(F.contains(F.lower("text"), F.col("value"))).groupBy("id").agg(F.min("chunk").alias("chunk"))
    return want.join(hit, "id", "left").select("id", "value", F.coalesce("chunk", F.lit(-1)).alias("chunk"))


def label_neighbours(s, d):
    """Boxes of lines on a grid: the nearest label on the left of a value in its line, 220 points away at most, or above it, 30 at most."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), "l_suppkey").groupBy("page", "n", "part").agg(F.min("l_suppkey").alias("supp"))
    box = li.select("page", (F.col("n") * 100000 + F.col("part")).alias("id"), ((F.col("part") * 37) % 500).alias("x"), ((F.col("supp") * 13) % 120).alias("y"), (F.col("part") % 2 == 0).alias("is_label"))
    label = box.filter("is_label").select("page", F.col("id").alias("label"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    both = box.filter("NOT is_label").join(label, "page")
    right = (F.abs(F.col("y") - F.col("ly")) <= 5) & (F.col("x") - F.col("lx")).between(1, 220)
    below = (F.abs(F.col("x") - F.col("lx")) <= 20) & (F.col("y") - F.col("ly")).between(6, 30)
    near = both.withColumn("kind", F.when(right, "right_of").when(below, "below_of")).filter("kind IS NOT NULL")
    order = F.struct(F.when(F.col("kind") == "right_of", 0).otherwise(1), F.abs(F.col("x") - F.col("lx")) + F.abs(F.col("y") - F.col("ly")), "label")
    return near.groupBy("page", "id").agg(F.min_by("label", order).alias("label"), F.min_by("kind", order).alias("kind"))


def page_counts(s, d):
    """A page of documents, with the number of all in each row."""
    page, n = filters.page_with_count(documents(s, d).filter("family = 'en'"), 5, 10)
    return page.select("id", F.lit(n).alias("total"))


def ordered_relations(s, d):
    """The 50 relations that come first: suggested, then confirmed, then others, one side first."""
    r = relations(documents(s, d))
    o = F.when(F.col("status") == "suggested", 0).when(F.col("status") == "confirmed", 1).otherwise(2)
    return r.orderBy(o, (F.col("a") % 10 == 3).desc(), "a", "b").limit(50)


QUERIES = {
    "report_summaries": report_summaries, "hard_invariants": hard_invariants, "operational_gates": operational_gates, "report_acceptance": report_acceptance, "gold_leaves": gold_leaves, "document_detail": document_detail,
    "corpus_counts": corpus_counts, "contact_list": contact_list, "canonical_rollup": canonical_rollup, "fact_maps": fact_maps, "review_queue": review_queue, "folder_paths": folder_paths, "best_membership": best_membership,
    "latest_plans": latest_plans, "value_locations": value_locations, "label_neighbours": label_neighbours, "page_counts": page_counts, "ordered_relations": ordered_relations,
}

_T = f"""WITH {SQL['docs']}, {SQL['jobs']}, ev AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'N' THEN 'admitted_field' WHEN l_partkey % 7 = 0 THEN 'rejected_duplicate' ELSE 'rejected_quality' END AS decision, [[], ['placeholder', 'prompt_echo'], ['no_evidence']][l_partkey % 3 + 1] AS reasons, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey % 2 = 0 END AS concrete FROM lineitem),
    tk AS (SELECT l_orderkey AS id, (l_linenumber - 1) // 2 AS page, CASE WHEN l_linenumber <= 4 THEN 'selected' WHEN l_partkey % 2 = 0 THEN 'skipped_budget_exceeded' ELSE 'skipped_low_value' END AS status, CASE WHEN l_partkey % 4 <> 0 THEN 'backend' || (l_suppkey % 3) END AS backend, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'exact' END AS mode, CASE WHEN l_partkey % 6 <> 0 THEN 's' || (l_partkey % 3) END AS sch, CAST(l_quantity AS BIGINT) AS vt FROM lineitem),
    dc AS (SELECT id, review_status, CASE WHEN id % 4 <> 0 THEN 3 ELSE 0 END AS want, CASE WHEN id % 4 <> 0 THEN list_filter(['total', 'date', 'party'], lambda x: CASE x WHEN 'total' THEN id % 3 = 0 WHEN 'date' THEN id % 6 = 0 ELSE id % 12 = 6 END) ELSE [] END AS miss FROM docs),
    ct(summary, key, n) AS (SELECT 'rejections', r, count(*) FROM (SELECT unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE [decision] END) AS r FROM ev WHERE decision LIKE 'rejected%') GROUP BY 2 UNION ALL SELECT 'modes', coalesce(mode, 'unknown'), count(*) FROM tk GROUP BY 2 UNION ALL SELECT 'schemas', sch, count(*) FROM tk WHERE sch IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'backends', coalesce(backend, 'unknown'), count(*) FROM tk WHERE status = 'selected' GROUP BY 2 UNION ALL SELECT 'outcomes', status, count(*) FROM jobs GROUP BY 2 UNION ALL SELECT 'review', review_status, count(*) FROM dc GROUP BY 2 UNION ALL SELECT 'absent_fields', m, count(*) FROM (SELECT unnest(miss) AS m FROM dc) GROUP BY 2
        UNION ALL SELECT 'admission', unnest(['admitted', 'rejected', 'duplicates']), unnest([count(*) FILTER (WHERE decision LIKE 'admitted%'), count(*) FILTER (WHERE decision LIKE 'rejected%'), count(*) FILTER (WHERE decision = 'rejected_duplicate')]) FROM ev
        UNION ALL SELECT 'evidence', unnest(['concrete', 'missing', 'coverage']), unnest([count(*) FILTER (WHERE concrete), count(*) FILTER (WHERE NOT coalesce(concrete, false)), round(count(*) FILTER (WHERE concrete) / count(*), 4)]) FROM ev
        UNION ALL SELECT 'planner', unnest(['selected', 'skipped', 'over_budget', 'visual_tokens']), unnest([count(*) FILTER (WHERE status = 'selected'), count(*) FILTER (WHERE status LIKE 'skipped%'), count(*) FILTER (WHERE status = 'skipped_budget_exceeded'), sum(vt)]) FROM tk
        UNION ALL SELECT 'contracts', unnest(['contracted', 'missing']), unnest([count(sch), count(*) - count(sch)]) FROM tk UNION ALL SELECT 'safe', 'unsafe', count(*) FROM jobs WHERE status IN ('failed', 'dead_letter')
        UNION ALL SELECT 'coverage', unnest(['regions', 'full', 'none', 'expected', 'absent', 'mean']), unnest([count(*) FILTER (WHERE want > 0), count(*) FILTER (WHERE want > 0 AND len(miss) = 0), count(*) FILTER (WHERE want > 0 AND len(miss) = 3), sum(want), sum(len(miss)), round(avg(CASE WHEN want > 0 THEN (3 - len(miss)) / 3.0 END), 4)]) FROM dc),
    sm AS (SELECT summary, key, CAST(n AS DOUBLE) AS n FROM ct)"""
_INV = "(SELECT 'selectedTasksMissingContract' AS invariant, id FROM tk WHERE status = 'selected' AND sch IS NULL UNION ALL SELECT 'selectedTasksMissingGrounding', id FROM tk WHERE status = 'selected' AND backend IS NULL UNION ALL SELECT 'admittedWithoutConcreteEvidence', id FROM ev WHERE decision LIKE 'admitted%' AND NOT coalesce(concrete, false) UNION ALL SELECT 'placeholdersAdmitted', id FROM ev WHERE decision LIKE 'admitted%' AND list_contains(reasons, 'placeholder') UNION ALL SELECT 'reviewedDocumentsAutoAccepted', id FROM dc WHERE review_status = 'auto_accepted' AND id IN (SELECT doc_id FROM labels))"

ORACLES = {
    "report_summaries": _T + " SELECT * FROM sm",
    "hard_invariants": _T + f""", v AS (SELECT invariant, CAST(id AS VARCHAR) AS id, row_number() OVER (PARTITION BY invariant ORDER BY CAST(id AS VARCHAR)) AS n FROM {_INV}), g AS (SELECT invariant, count(*) AS violations, string_agg(id, ',' ORDER BY id) FILTER (WHERE n <= 10) AS examples FROM v GROUP BY 1)
    SELECT i AS invariant, coalesce(violations, 0) AS violations, coalesce(examples, '') AS examples FROM (SELECT unnest(['selectedTasksMissingContract', 'selectedTasksMissingGrounding', 'admittedWithoutConcreteEvidence', 'placeholdersAdmitted', 'reviewedDocumentsAutoAccepted', 'jobsPastTheirAttempts']) AS i) LEFT JOIN g ON i = invariant""",
    "operational_gates": _T + """, n AS (SELECT 'targetQueueDeadLetters' AS gate, (SELECT count(*) FROM jobs WHERE queue IN ('q0', 'q1') AND status = 'dead_letter') AS violations UNION ALL SELECT 'classifiedOperationalFailures', (SELECT count(*) FROM jobs WHERE status IN ('failed', 'dead_letter') AND job_id % 9 = 0)
        UNION ALL SELECT 'runtimeFailureRates', (SELECT count(DISTINCT queue) FROM jobs WHERE status IN ('failed', 'dead_letter')) UNION ALL SELECT 'retrySuccessRate', CASE WHEN (SELECT count(*) FROM jobs WHERE attempts > 1 AND status <> 'succeeded') > 0 THEN 1 ELSE 0 END
        UNION ALL SELECT 'runawayFanout', (SELECT count(*) FROM (SELECT id FROM tk WHERE status = 'selected' GROUP BY 1 HAVING count(*) > 6 UNION ALL SELECT id FROM tk WHERE status = 'selected' GROUP BY id, page HAVING count(*) > 3)) UNION ALL SELECT 'retrySafeJobs', (SELECT count(*) FROM jobs WHERE attempts > max_attempts))
    SELECT gate, violations, violations = 0 AS passed FROM n""",
    "report_acceptance": _T + " SELECT summary, key, CASE WHEN summary = 'evidence' AND key = 'missing' THEN NULL WHEN summary = 'admission' AND key = 'admitted' THEN n + 1 ELSE n END AS stored, n AS recomputed, NOT (summary = 'evidence' AND key = 'missing' OR summary = 'admission' AND key = 'admitted') AS agrees FROM sm",
    "gold_leaves": f"""WITH {SQL['docs']}, m AS (SELECT 'accepted_' || family AS metric, round(avg(CASE WHEN review_status <> 'needs_review' THEN 1.0 ELSE 0.0 END), 6) AS v FROM docs GROUP BY family, folder), w AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM m GROUP BY 1),
    t(metric, direction, threshold) AS (VALUES ('accepted_en', 'min', 0.4::DOUBLE), ('accepted_de', 'max', 1.0), ('accepted_fr', 'min', 0.99), ('absent', 'min', 0.1), ('broken', 'min', 0.1))
    SELECT metric, CASE WHEN metric = 'broken' THEN 1.0 WHEN direction = 'min' THEN lo ELSE hi END::DOUBLE AS value, threshold, coalesce(CASE WHEN direction = 'min' THEN lo >= threshold ELSE hi <= threshold END, false) AS passed FROM t LEFT JOIN w USING (metric)""",
    "document_detail": f"""{BESIDE}, {EDGES} SELECT r.id, folder, (SELECT CAST(max(total) AS DOUBLE) FROM totals t WHERE t.id = r.id) AS total, coalesce((SELECT string_agg(tag, ',' ORDER BY lower(tag)) FROM tags t WHERE t.id = r.id), '') AS tags, (SELECT count(*) FROM due_days x WHERE x.id = r.id AND status NOT IN ('completed', 'dismissed')) AS open_deadlines,
    CAST((SELECT min(due) FROM due_days x WHERE x.id = r.id AND status NOT IN ('completed', 'dismissed')) AS VARCHAR) AS next_due, (SELECT count(DISTINCT other) FROM both_ends e WHERE e.id = r.id AND status <> 'rejected' AND other IN (SELECT id FROM r)) AS related FROM r""",
    "corpus_counts": f"""WITH {SQL['docs']}, {SQL['tags']}, {SQL['relations']}, {SQL['due_days']}, n AS (SELECT id, 'tags' AS k FROM tags UNION ALL SELECT doc_id, 'chunks' FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> '' UNION ALL SELECT id, 'deadlines' FROM due_days UNION ALL SELECT a, 'edges' FROM relations UNION ALL SELECT b, 'edges' FROM relations UNION ALL SELECT l_orderkey, 'lines' FROM lineitem)
    SELECT id, count(*) FILTER (WHERE k = 'tags') AS tags, count(*) FILTER (WHERE k = 'chunks') AS chunks, count(*) FILTER (WHERE k = 'deadlines') AS deadlines, count(*) FILTER (WHERE k = 'edges') AS edges, count(*) FILTER (WHERE k = 'lines') AS lines FROM docs LEFT JOIN n USING (id) GROUP BY id""",
    "contact_list": """WITH a AS (SELECT c_custkey AS id, unnest([c_name, 'The ' || c_mktsegment, lower(c_name)]) AS alias FROM customer) SELECT c_custkey AS id, c_name AS name, (SELECT string_agg(DISTINCT alias, '|' ORDER BY alias) FROM a WHERE a.id = c_custkey) AS aliases, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS documents, CAST((SELECT CAST(max(o_orderdate) AS DATE) FROM orders WHERE o_custkey = c_custkey) AS VARCHAR) AS last FROM customer""",
    "canonical_rollup": """SELECT l_orderkey AS id, CAST(max(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag IN ('A', 'N')) AS DOUBLE) AS total, max('supplier ' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0')) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS counterparty, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS day,
    CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'needs_review' ELSE 'auto_accepted' END AS review_status FROM lineitem GROUP BY l_orderkey""",
    "fact_maps": """WITH f AS (SELECT l_orderkey AS id, 'line.' || lower(l_returnflag) AS path, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value FROM lineitem WHERE l_partkey % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber * 1000000 + l_partkey, l_suppkey, value) = 1),
    m AS (SELECT id, '{' || string_agg('"' || path || '":"' || value || '"', ',' ORDER BY path) || '}' AS facts FROM f GROUP BY 1), a AS (SELECT l_orderkey AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY 1) SELECT id, facts, amount FROM m JOIN a USING (id)""",
    "review_queue": "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 90 WHEN '2' THEN 70 WHEN '3' THEN 50 END AS priority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created FROM orders WHERE o_orderstatus = 'O' ORDER BY priority DESC NULLS LAST, o_orderdate, o_orderkey LIMIT 200",
    "folder_paths": "SELECT n_nationkey, r_name || '/' || n_name AS path FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "best_membership": """SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 1) AS o_orderkey FROM customer""",
    "latest_plans": "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem x WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem y WHERE y.l_partkey = x.l_partkey)",
    "value_locations": r"""WITH w AS (SELECT doc_id AS id, lower(regexp_extract(text, '(\S{6,})\s*$', 1)) AS value FROM documents), ch AS (SELECT doc_id AS id, unnest(range(0, len(ls))) AS chunk, unnest(ls) AS text FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))
    SELECT w.id, value, CAST(coalesce(min(CASE WHEN contains(lower(text), value) THEN chunk END), -1) AS INT) AS chunk FROM w LEFT JOIN ch USING (id) WHERE value <> '' GROUP BY ALL""",
    "label_neighbours": """WITH b AS (SELECT l_orderkey AS page, l_linenumber * 100000 + l_partkey AS id, (l_partkey * 37) % 500 AS x, (min(l_suppkey) * 13) % 120 AS y, l_partkey % 2 = 0 AS lab FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey),
    n AS (SELECT v.page, v.id, l.id AS label, CASE WHEN abs(v.y - l.y) <= 5 AND v.x - l.x BETWEEN 1 AND 220 THEN 'right_of' WHEN abs(v.x - l.x) <= 20 AND v.y - l.y BETWEEN 6 AND 30 THEN 'below_of' END AS kind, abs(v.x - l.x) + abs(v.y - l.y) AS far FROM b v JOIN b l ON v.page = l.page AND l.lab AND NOT v.lab)
    SELECT page, id, label, kind FROM n WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY CASE kind WHEN 'right_of' THEN 0 ELSE 1 END, far, label) = 1""",
    "page_counts": f"{DOCS} SELECT id, CAST((SELECT count(*) FROM docs WHERE family = 'en') AS INT) AS total FROM docs WHERE family = 'en' ORDER BY docs.document_date DESC NULLS LAST, id LIMIT 10 OFFSET 5",
    "ordered_relations": f"{DOCS}, {SQL['relations']} SELECT a, b, kind, status FROM relations ORDER BY CASE status WHEN 'suggested' THEN 0 WHEN 'confirmed' THEN 1 ELSE 2 END, a % 10 = 3 DESC, a, b LIMIT 50",
}
