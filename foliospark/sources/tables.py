"""Table scans, and the document-domain roles that the generic tables play in the registered queries.

Each role is a pair: DataFrame code, and the same view in DuckDB's SQL (`SQL`) for the oracles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCEPTED = ("auto_accepted", "user_confirmed", "user_corrected")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with owner, folder, family, review status, sensitivity and date."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 7).alias("owner_id"),
        F.col("source").alias("folder"),
        F.col("lang").alias("family"),
        "text",
        "n_chars",
        F.when(F.col("quality") == 1, "user_confirmed").when(F.col("quality") == 0, "needs_review").otherwise("auto_accepted").alias("review_status"),
        F.when(F.col("toxic") == 1, "highly_sensitive").otherwise("normal").alias("sensitivity"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("document_date"),
        (F.col("doc_id") % 2).alias("household"),
        (F.col("doc_id") % 23 == 0).alias("deleted"),
        F.when(F.col("doc_id") % 6 == 5, "private").otherwise("household").alias("acl_mode"),
    )


def tags(docs: DataFrame) -> DataFrame:
    """(id, tag): a document has its language, and some have Long or IMPORTANT."""
    own = F.array_compact(F.array("family", F.when(F.col("n_chars") > 2000, "Long"), F.when(F.col("id") % 5 == 0, "IMPORTANT")))
    return docs.select("id", F.explode(own).alias("tag"))


def relations(docs: DataFrame) -> DataFrame:
    """(a, b, kind, status): edges from a document to one a few numbers on."""
    i = F.col("id")
    kind = F.when(i % 3 == 0, "duplicate_of").when(i % 3 == 1, "invoice_for").otherwise("receipt_for")
    status = F.when(i % 5 == 0, "rejected").when(i % 5 == 1, "confirmed").otherwise("suggested")
    edges = docs.filter(i % 4 != 0).select(i.alias("a"), (i + 1 + i % 3).alias("b"), kind.alias("kind"), status.alias("status"))
    return edges.join(docs.select(i.alias("b")), "b", "left_semi").select("a", "b", "kind", "status")


def due_days(docs: DataFrame) -> DataFrame:
    """(id, kind, status, due): deadlines of a third of the documents."""
    i = F.col("id")
    status = F.when(i % 5 == 0, "completed").when(i % 5 == 1, "overdue").when(i % 5 == 2, "due_soon").when(i % 5 == 3, "open").otherwise("dismissed")
    return docs.filter(i % 3 == 0).select("id", F.when(i % 2 == 0, "due_date").otherwise("renewal_date").alias("kind"), status.alias("status"), F.date_add("document_date", 40).alias("due"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, total): the amounts of documents are those of the orders with their numbers."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,4)").alias("total"))


def folders(docs: DataFrame) -> DataFrame:
    """folder, shared, folder_owner, grants, writers: folders with an even number are shared by the household; grants may read, writers also write."""
    number = F.coalesce(F.regexp_extract("folder", "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return docs.select("folder").distinct().select("folder", (number % 2 == 0).alias("shared"), (number % 7).cast("long").alias("folder_owner"), F.array((number % 5).cast("long")).alias("grants"), F.array(F.when(number % 3 == 0, number % 5).cast("long")).alias("writers"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a job ledger."""
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for kv in {"view": "succeeded", "click": "queued", "purchase": "running", "signup": "failed", "error": "dead_letter"}.items() for x in kv])
    return e.select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("q"), (F.col("user_id") % 5).cast("string")).alias("queue"),
        F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("job_type"),
        status[F.col("event_type")].alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.pmod(F.floor("value").cast("int"), F.lit(100)).alias("priority"),
        F.col("ts").alias("scheduled_at"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): orders with their lines, written out as receipts."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    line = lambda x: F.concat(F.lit("Item: part "), x["l_partkey"].cast("string"), F.lit(" lot "), x["l_linenumber"].cast("string"), F.lit("  $"), x["p"].cast("string"))
    items = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", price.alias("p")))).alias("ls"), F.sum(price).alias("subtotal"))
    k, day = F.col("o_orderkey") % 4, F.add_months("o_orderdate", 120)
    who = F.when(k == 3, F.lit("- The corner shop")).otherwise(F.concat(F.lit("Merchant: M\u00fcller & S\u00f6hne "), F.col("o_custkey").cast("string")))
    when = F.when(k == 0, F.concat(F.lit("Date: "), F.date_format(day, "yyyy-MM-dd"))).when(k == 1, F.concat(F.lit("bought on "), F.date_format(day, "M/d/yyyy"))).when(k == 2, F.concat(F.lit("Date # "), F.date_format(day, "d-MMM-yyyy"))).otherwise(F.lit("no date"))
    tax = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Sales Tax: $1.25")).otherwise(F.lit("tax # 2.50"))
    text = F.concat_ws("\n", who, when, F.array_join(F.transform("ls", line), "\n"), F.concat(F.lit("Subtotal "), F.col("subtotal").cast("string")), tax, F.concat(F.lit("TOTAL: $"), F.format_number("o_totalprice", 2)))
    return o.join(items, "o_orderkey").select(F.col("o_orderkey").alias("id"), text.alias("text"))


SQL = {
    "receipts": """i AS (SELECT l_orderkey AS o_orderkey, string_agg('Item: part ' || l_partkey || ' lot ' || l_linenumber || '  $' || CAST(l_extendedprice AS DECIMAL(18,2)), chr(10) ORDER BY l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS ls, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS subtotal FROM lineitem GROUP BY 1),
        rd AS (SELECT *, o_orderkey % 4 AS k, o_orderdate + INTERVAL 10 YEAR AS day FROM orders JOIN i USING (o_orderkey)),
        receipts AS (SELECT o_orderkey AS id, concat_ws(chr(10), CASE WHEN k = 3 THEN '- The corner shop' ELSE 'Merchant: Müller & Söhne ' || o_custkey END,
        CASE k WHEN 0 THEN 'Date: ' || strftime(day, '%Y-%m-%d') WHEN 1 THEN 'bought on ' || strftime(day, '%-m/%-d/%Y') WHEN 2 THEN 'Date # ' || strftime(day, '%-d-%b-%Y') ELSE 'no date' END,
        ls, 'Subtotal ' || subtotal, CASE WHEN o_orderkey % 3 = 0 THEN 'Sales Tax: $1.25' ELSE 'tax # 2.50' END, 'TOTAL: $' || format('{:,.2f}', o_totalprice)) AS text FROM rd)""",
    "docs": """docs AS (SELECT d.doc_id AS id, d.doc_id % 7 AS owner_id, source AS folder, lang AS family, text, n_chars,
        CASE WHEN quality = 1 THEN 'user_confirmed' WHEN quality = 0 THEN 'needs_review' ELSE 'auto_accepted' END AS review_status,
        CASE WHEN toxic = 1 THEN 'highly_sensitive' ELSE 'normal' END AS sensitivity,
        CAST(DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) AS DATE) AS document_date, d.doc_id % 2 AS household, d.doc_id % 23 = 0 AS deleted, CASE WHEN d.doc_id % 6 = 5 THEN 'private' ELSE 'household' END AS acl_mode FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "folders": "folders AS (SELECT folder, n % 2 = 0 AS shared, n % 7 AS folder_owner, [n % 5] AS grants, [CASE WHEN n % 3 = 0 THEN n % 5 END] AS writers FROM (SELECT DISTINCT folder, coalesce(try_cast(regexp_extract(folder, '([0-9]+)$', 1) AS INT), 0) AS n FROM docs))",
    "tags": "tags AS (SELECT id, family AS tag FROM docs UNION ALL SELECT id, 'Long' FROM docs WHERE n_chars > 2000 UNION ALL SELECT id, 'IMPORTANT' FROM docs WHERE id % 5 = 0)",
    "relations": """relations AS (SELECT id AS a, id + 1 + id % 3 AS b, ['duplicate_of', 'invoice_for', 'receipt_for'][id % 3 + 1] AS kind, CASE id % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'suggested' END AS status FROM docs WHERE id % 4 <> 0 AND id + 1 + id % 3 IN (SELECT id FROM docs))""",
    "due_days": """due_days AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'due_date' ELSE 'renewal_date' END AS kind, ['completed', 'overdue', 'due_soon', 'open', 'dismissed'][id % 5 + 1] AS status, CAST(document_date + 40 AS DATE) AS due FROM docs WHERE id % 3 = 0)""",
    "totals": "totals AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,4)) AS total FROM orders)",
    "jobs": """jobs AS (SELECT event_id AS job_id, 'q' || (user_id % 5) AS queue, 't' || (event_id % 3) AS job_type,
        CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'queued' WHEN 'purchase' THEN 'running' WHEN 'signup' THEN 'failed' WHEN 'error' THEN 'dead_letter' END AS status,
        CAST(event_id % 4 AS INT) AS attempts, 3 AS max_attempts, ((CAST(floor(value) AS INT) % 100) + 100) % 100 AS priority, ts AS scheduled_at FROM events)""",
}
