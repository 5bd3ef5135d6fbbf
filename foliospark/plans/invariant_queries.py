"""The twelve invariants over report tables: lines as tasks and inserted rows, orders as admission events, parts as extractions, customers as fields."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import invariants
from foliospark.sources.tables import table

VERSIONS = {"planner_version": "p1", "gate_version": "g1", "registry_version": "r1", "envelope_version": "e1"}


def report_invariants(s, d):
    li, o, part, cust = (table(s, d, t) for t in ("lineitem", "orders", "part", "customer"))
    none, line = F.lit(None).cast("string"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    off = F.round(F.col("l_discount") * 100)
    tasks = li.select(
        F.col("l_orderkey").alias("document"), line.alias("id"), F.when(F.col("l_returnflag") == "A", "Selected").when(F.col("l_returnflag") == "N", "queued").otherwise("dropped").alias("status"), F.when(F.col("l_linestatus") == "F", "granite_x").otherwise("text").alias("backend"),
        F.lit("r").alias("region_id"), F.when(F.round(F.col("l_tax") * 100) != 8, "schema").alias("output_schema"), F.when(F.col("l_quantity") < 25, "table").otherwise("page").alias("kind"), F.when(off != 9, "1").alias("page"), F.when(off != 10, "t").alias("table_id"),
        none.alias("element_id"), none.alias("bbox"), F.when(off == 8, "Incompatible family").alias("compatibility"), none.alias("contract_reason"),
    )
    first = F.left("o_orderpriority", F.lit(1))
    text = lambda v: F.lit(v)
    events = o.select(
        F.col("o_orderkey").alias("document"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "rejected_artifact").otherwise("admitted_auto_promotable").alias("decision"), F.when(first == "1", "qwen").otherwise("docling").alias("engine"), none.alias("region_id"),
        F.when(first != "2", "u").alias("run_id"), text("p1").alias("planner_version"), F.concat(F.lit("f"), first).alias("fingerprint"), F.when(first == "3", "g0").otherwise("g1").alias("gate_version"), text("r1").alias("registry_version"), none.alias("plan_id"), text("k").alias("plan_task_id"),
        text("a").alias("annotation_id"), text("e0").alias("envelope_version"), (F.col("o_totalprice") < 400000).alias("concrete"),
        F.when(F.col("o_totalprice") < 5000, '{"candidate": {"value": {"deep": ["the json schema"]}}}').when(F.col("o_totalprice") < 10000, '{"value": null}').when(F.col("o_totalprice") < 15000, '{"lines": [{"Net Amount": "tbd"}]}').otherwise('{"value": "12"}').alias("payload"),
    )
    rows = li.select(F.col("l_orderkey").alias("document"), line.alias("id"), F.concat(F.lit("f"), "l_linenumber").alias("fingerprint"))
    extractions = part.select(
        F.col("p_partkey").alias("document"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 10, "semantic_region").when(F.col("p_size") < 20, "aggregate").otherwise("page").alias("scope"), none.alias("region_id"), F.when(F.col("p_retailprice") < 950, "auto_accepted").alias("review_status"),
        F.when(F.col("p_type") == "ECONOMY", "granite").otherwise("docling").alias("engine"), none.alias("model_name"), text("invoice").alias("schema"), F.when(F.col("p_size") == 12, F.array(F.lit("Incompatible family"))).alias("warnings"), F.when(F.col("p_size") > 15, F.array("p_brand")).alias("families"),
    )
    balance = F.col("c_acctbal")
    fields = cust.select(
        F.col("c_custkey").alias("document"), F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "receipt.merchant").when(F.col("c_mktsegment") == "MACHINERY", " Invoice.Total Amount").otherwise("notes").alias("field_path"), F.when(balance > 0, "auto_accepted").otherwise("needs_review").alias("status"),
        (balance > 9000).alias("fabricated"), F.when(F.col("c_nationkey") < 5, "Document Title").otherwise("page").alias("source"), F.when(F.col("c_nationkey") <= 20, F.array(F.lit("page"))).alias("sources"), (balance < 500).alias("allowed"),
    )
    found = (invariants.task_violations(tasks), invariants.event_violations(events, VERSIONS), invariants.inserted_violations(events, rows), invariants.extraction_violations(extractions), invariants.field_violations(fields))
    out = invariants.evaluated(*found)
    shown = F.transform("examples", lambda e: F.concat_ws(":", e["document"].cast("string"), e["entity"], e["reason"]))
    return out.select("invariant", "violations", "passed", F.array_join(shown, ",").alias("examples"))


QUERIES = {"report_invariants": report_invariants}

ORACLES = {
    "report_invariants": """WITH t AS (SELECT l_orderkey AS doc, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, round(l_discount * 100) AS off, * FROM lineitem),
    k AS (SELECT * FROM t WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'F'),
    e AS (SELECT o_orderkey AS doc, CAST(o_orderkey AS VARCHAR) AS id, left(o_orderpriority, 1) AS p, o_orderstatus <> 'O' AS ok, o_totalprice AS v FROM orders),
    q AS (SELECT p_partkey AS doc, CAST(p_partkey AS VARCHAR) AS id, * FROM part), c AS (SELECT c_custkey AS doc, CAST(c_custkey AS VARCHAR) AS id, * FROM customer WHERE c_acctbal > 0),
    x AS (SELECT 'selectedTasksMissingContract' AS inv, 'missing_model_output_schema_name' AS why, doc, id FROM k WHERE round(l_tax * 100) = 8
    UNION ALL SELECT 'selectedTasksMissingGrounding', 'missing_concrete_grounding', doc, id FROM k WHERE off = 9 OR (off = 10 AND l_quantity < 25)
    UNION ALL SELECT 'selectedTasksIncompatibleFamilySchema', 'incompatible_schema_or_contract_resolution', doc, id FROM k WHERE off = 8
    UNION ALL SELECT 'promptSchemaArtifactsAdmitted', 'admitted_prompt_or_schema_artifact', doc, id FROM e WHERE ok AND v < 5000
    UNION ALL SELECT 'placeholderOrLiteralNullCandidatesAdmitted', 'admitted_placeholder_or_literal_null', doc, id FROM e WHERE ok AND v >= 5000 AND v < 15000
    UNION ALL SELECT 'admittedCandidatesWithoutConcreteEvidence', 'admitted_without_concrete_evidence', doc, id FROM e WHERE ok AND v >= 400000
    UNION ALL SELECT 'admissionEventsMissingTelemetry', 'missing_run_id', doc, id FROM e WHERE p = '2'
    UNION ALL SELECT 'admissionEventsMissingTelemetry', 'stale_gate_version', doc, id FROM e WHERE p = '3'
    UNION ALL SELECT 'admissionEventsMissingTelemetry', unnest(['missing_plan_id', 'stale_envelope_version']), doc, id FROM e WHERE p = '1'
    UNION ALL SELECT 'rejectedCandidatesInserted', 'rejected_candidate_inserted', t.doc, t.id FROM t JOIN e ON e.doc = t.doc AND NOT ok AND p = CAST(l_linenumber AS VARCHAR)
    UNION ALL SELECT 'modelBackedSemanticRegionAutoAccepted', 'model_backed_semantic_region_auto_accepted', doc, id FROM q WHERE p_size < 10 AND p_retailprice < 950 AND p_type = 'ECONOMY'
    UNION ALL SELECT 'aggregateSchemasFromIncompatibleFamilies', 'aggregate_schema_from_incompatible_source_family', doc, id FROM q WHERE p_size = 12 OR p_size BETWEEN 16 AND 19
    UNION ALL SELECT 'fabricatedCanonicalRequiredFields', 'fabricated_required_field', doc, id FROM c WHERE c_mktsegment = 'MACHINERY' AND (c_acctbal > 9000 OR c_nationkey > 20)
    UNION ALL SELECT 'titleDerivedMerchantSellerWithoutAllowlist', 'title_derived_merchant_seller_without_allowlist', doc, id FROM c WHERE c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 5 AND c_acctbal >= 500),
    n AS (SELECT *, row_number() OVER (PARTITION BY inv ORDER BY doc, id, why) AS r FROM x)
    SELECT invariant, count(inv) AS violations, count(inv) = 0 AS passed, coalesce(string_agg(concat_ws(':', doc, id, why), ',' ORDER BY doc, id, why) FILTER (WHERE r <= 10), '') AS examples FROM (SELECT unnest(%s) AS invariant) i LEFT JOIN n ON inv = invariant GROUP BY invariant""" % list(invariants.INVARIANTS),
}
