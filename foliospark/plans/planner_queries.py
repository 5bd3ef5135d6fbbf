"""The budgeted planner over the lines of a customer's orders: a customer is the document, an order its page, a line a region."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators import planner
from foliospark.sources.tables import table


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as specs: types by priority, contracts by discount, grounding by status and quantity."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    arrival = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    cents, tax = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    page = F.col("l_linestatus") == "F"
    part = F.col("l_partkey").cast("string")
    return x.select(
        F.col("o_custkey").alias("doc_id"),
        F.row_number().over(arrival).alias("pos"),
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("region_id"),
        F.when(F.col("l_returnflag") == "N", "document_observation").when(F.col("l_returnflag") == "A", "invoice").otherwise("receipt").alias("target_schema"),
        F.when(tax < 8, "schema").otherwise(" ").alias("output_schema"),
        F.when(cents == 1, "exact-contract").when(cents == 9, "generic_review_only_fallback").when(cents == 10, "incompatible family").alias("contract_reason"),
        F.when(cents == 0, "Exact").when(cents == 2, " compatible alias").when(cents == 3, "missing fields").alias("compatibility"),
        F.col("l_linenumber").alias("priority"),
        F.col("l_quantity").cast("int").alias("ordinal"),
        F.when(tax != 1, F.col("l_discount")).alias("confidence"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "invoice_line_item_table").when(F.col("o_orderpriority") == "2-HIGH", "billing_summary").when(F.col("o_orderpriority") == "5-LOW", "receipt_line_item_table").otherwise(F.col("o_orderpriority")).alias("semantic_type"),
        F.lit("tables").alias("task"),
        F.when(page, "page").when(F.col("l_quantity") < 25, "element").when(F.col("l_quantity") < 49, "table").otherwise("unmatched_region").alias("kind"),
        F.when(page, F.col("l_orderkey").cast("string")).alias("page_id"),
        F.when(~page & (F.col("l_quantity") < 25), part).alias("element_id"),
        F.when(~page & (F.col("l_quantity") >= 25), part).alias("table_id"),
        F.array("l_returnflag").alias("expected_fields"),
        F.when(F.col("l_returnflag") == "A", planner.STRUCTURAL).alias("region_source"),
        F.when(F.col("o_orderstatus") == "P", "primary").alias("coverage_role"),
        F.when(F.col("l_extendedprice") > 80000, "high value").alias("must_extract"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("l_linenumber") > 3), "next page").alias("continuation"),
        F.col("o_orderstatus").alias("page_label"),
    )


def extraction_plans(s, d):
    """The choice for each document, in order, with its warnings (sorted) and the suppressed and skipped specs by status."""
    p = planner.plan(specs(s, d))
    n = lambda status: F.size(F.filter("dropped", lambda x: x["status"] == status)).cast("long").alias(status)
    regions = F.array_join(F.transform("selected", lambda x: x["region_id"]), ",")
    return p.select("doc_id", regions.alias("selected"), F.array_join(F.array_sort("warnings"), ",").alias("warnings"), n("skipped_missing_contract"), n("skipped_missing_grounding"), n("skipped_incompatible_schema"), n("suppressed_duplicate"), n("skipped_budget_exceeded"))


def planned_tasks(s, d):
    return planner.planned_tasks(planner.plan(specs(s, d)))


QUERIES = {"extraction_plans": extraction_plans, "planned_tasks": planned_tasks}

SQL = """
WITH RECURSIVE x AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos,
        l_orderkey || '/' || l_linenumber || '/' || l_partkey AS region, round(l_discount * 100) AS cents, round(l_tax * 100) AS tax, l_linestatus = 'F' AS paged, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT doc, pos, region, l_linenumber AS priority, CAST(l_quantity AS INT) AS ordinal,
        CASE WHEN tax >= 8 THEN 'missing_contract' WHEN NOT paged AND l_quantity >= 49 THEN 'missing_grounding' WHEN cents = 10 THEN 'incompatible_schema' END AS reason,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'invoice_line_item_table' WHEN '2-HIGH' THEN 'billing_summary' WHEN '5-LOW' THEN 'receipt_line_item_table' ELSE o_orderpriority END AS kind,
        CASE WHEN cents IN (0, 1) THEN 0 WHEN cents = 2 THEN 1 WHEN cents = 9 THEN 4 WHEN cents = 3 THEN 5 ELSE 2 END AS contract,
        CASE WHEN l_extendedprice > 80000 THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS source,
        CASE WHEN tax <> 1 THEN l_discount ELSE 0.0::DOUBLE END AS confidence, l_extendedprice > 80000 AS must, o_orderstatus = 'O' AND l_linenumber > 3 AS continued,
        CASE WHEN paged THEN CAST(l_orderkey AS VARCHAR) ELSE o_orderstatus END AS page,
        concat_ws('|', l_returnflag, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE '' END, CASE WHEN paged THEN 'p' || l_orderkey WHEN l_quantity < 25 THEN 'e' || l_partkey ELSE 't' || l_partkey || (l_quantity >= 49) END) AS same,
        CASE WHEN cents = 9 THEN 'generic_fallback' WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'line_item' WHEN l_returnflag = 'A' AND NOT paged AND l_quantity >= 25 THEN 'docling_table'
             WHEN l_returnflag = 'N' AND o_orderstatus = 'P' THEN 'observation_primary' WHEN o_orderpriority = '2-HIGH' THEN 'summary' ELSE 'other' END AS bucket FROM x),
v AS (SELECT *, row_number() OVER (PARTITION BY doc, same ORDER BY contract, priority, source, -confidence, ordinal, pos) AS within, min(pos) OVER (PARTITION BY doc, same) AS seat FROM s WHERE reason IS NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY contract, priority, source, -confidence, ordinal, seat) AS rk FROM v WHERE within = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY doc, bucket ORDER BY rk) AS inb, list_position(['line_item', 'summary', 'docling_table', 'observation_primary', 'other'], bucket) AS turn,
        CASE bucket WHEN 'line_item' THEN 4 WHEN 'docling_table' THEN 3 WHEN 'generic_fallback' THEN 0 ELSE 2 END AS quota FROM b),
u AS (SELECT 0 AS phase, * FROM c WHERE inb <= quota UNION ALL BY NAME SELECT 1 AS phase, 0 AS turn, * EXCLUDE (turn) FROM c UNION ALL BY NAME SELECT 2 AS phase, 0 AS turn, * EXCLUDE (turn) FROM c WHERE bucket = 'line_item' AND (must OR continued)),
q AS (SELECT doc, pos, region, page, bucket, phase, row_number() OVER (PARTITION BY doc ORDER BY phase, turn, rk) AS n FROM u),
r AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS picks, CAST([] AS VARCHAR[]) AS pages, CAST([] AS VARCHAR[]) AS said FROM s
    UNION ALL SELECT t.doc, t.n, CASE WHEN takes THEN list_append(picks, pos) ELSE picks END, CASE WHEN takes THEN list_append(pages, page) ELSE pages END,
        CASE WHEN known THEN said WHEN phase = 2 THEN list_append(said, 'plan_line_item_budget_rescued:' || region) WHEN isfull AND phase = 0 THEN list_append(said, 'plan_hard_limit_reached_before_' || bucket)
             WHEN NOT isfull AND crowded THEN list_append(said, 'plan_page_limit_reached:' || page) ELSE said END
    FROM (SELECT q.*, picks, pages, said, list_contains(picks, pos) AS known, len(picks) >= 6 AS isfull, len(list_filter(pages, lambda p: p = page)) >= 3 AS crowded,
            NOT list_contains(picks, pos) AND (phase = 2 OR (len(picks) < 6 AND len(list_filter(pages, lambda p: p = page)) < 3)) AS takes FROM r JOIN q ON q.doc = r.doc AND q.n = r.n + 1) t),
f AS (SELECT doc, arg_max(picks, n) AS picks, arg_max(said, n) AS said FROM r GROUP BY doc),
o AS (SELECT s.doc, s.pos, s.region, s.must, s.kind, nullif(list_position(picks, s.pos), 0) AS place, CASE WHEN list_contains(picks, s.pos) THEN 'pending' WHEN s.reason IS NOT NULL THEN 'skipped_' || s.reason WHEN v.within > 1 THEN 'suppressed_duplicate' ELSE 'skipped_budget_exceeded' END AS status,
        CASE WHEN list_contains(picks, s.pos) THEN NULL WHEN s.reason IS NOT NULL THEN s.reason WHEN v.within > 1 THEN 'duplicate_suppressed' ELSE 'planner_budget_or_fanout_policy' END AS reason
        FROM s JOIN f ON f.doc = s.doc LEFT JOIN v ON v.doc = s.doc AND v.pos = s.pos),
w AS (SELECT doc, unnest(said) AS w FROM f UNION SELECT doc, 'plan_' || reason || ':' || region FROM o WHERE status LIKE 'skipped_missing%' OR status = 'skipped_incompatible_schema'
    UNION SELECT doc, 'plan_duplicate_suppressed:' || region FROM o WHERE status = 'suppressed_duplicate' UNION SELECT doc, 'dropped_must_extract_target:' || kind || ':high value' FROM o WHERE must AND status <> 'pending')
"""

ORACLES = {
    "planned_tasks": SQL + "SELECT doc AS doc_id, pos, region AS region_id, CAST(place AS INT) AS place, status, reason FROM o",
    "extraction_plans": SQL + """SELECT o.doc AS doc_id, coalesce(string_agg(region, ',' ORDER BY place) FILTER (WHERE place IS NOT NULL), '') AS selected, coalesce(any_value(ws.ws), '') AS warnings,
    count(*) FILTER (WHERE status = 'skipped_missing_contract') AS skipped_missing_contract, count(*) FILTER (WHERE status = 'skipped_missing_grounding') AS skipped_missing_grounding, count(*) FILTER (WHERE status = 'skipped_incompatible_schema') AS skipped_incompatible_schema,
    count(*) FILTER (WHERE status = 'suppressed_duplicate') AS suppressed_duplicate, count(*) FILTER (WHERE status = 'skipped_budget_exceeded') AS skipped_budget_exceeded
    FROM o LEFT JOIN (SELECT doc, string_agg(w, ',' ORDER BY w) AS ws FROM w GROUP BY doc) ws ON ws.doc = o.doc GROUP BY o.doc""",
}
