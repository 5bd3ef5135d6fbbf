"""Queries from located facts to resolved claims, checks, dedupe and admission."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import claims, facts
from foliospark.plans.text_queries import R, receipt_payload
from foliospark.sources.tables import SQL, documents, table

#: Keys and the types of their values.
REGISTRY = [("line.amount", "money"), ("line.date", "date"), ("line.name", "text")]


def located(s, d):
    """Order lines as facts with a place, an engine and a value; places are missing in parts of them."""
    own = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")  # a line is told apart by these; of several the least values
    li = table(s, d, "lineitem").groupBy(*own).agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")])
    return li.selectExpr(
        "l_orderkey AS document", "(CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 1000 + l_suppkey AS position",
        "CASE WHEN l_partkey % 11 <> 0 THEN (l_linenumber - 1) div 3 + 1 END AS page", "CASE WHEN l_partkey % 4 = 0 THEN concat('e', l_partkey % 6) END AS element_id", "CASE WHEN l_partkey % 4 = 1 THEN 't1' END AS table_id",
        "CASE WHEN l_suppkey % 3 <> 0 THEN l_linenumber END AS row_index", "CAST(NULL AS STRING) AS bbox", "CAST(NULL AS STRING) AS text_span", "CASE WHEN l_partkey % 7 = 0 THEN 'r1' END AS region_id", "CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS source_text",
        "CASE l_linenumber % 4 WHEN 0 THEN 'granite' WHEN 2 THEN 'qwen' ELSE 'docling' END AS engine", "CASE WHEN l_suppkey % 13 = 0 THEN 'planner' ELSE 'lane' END AS method",
        "CASE WHEN l_partkey % 17 = 0 THEN 'other' WHEN l_returnflag = 'A' THEN 'line.amount' WHEN l_returnflag = 'N' THEN 'line.date' ELSE 'line.name' END AS key",
        "CASE WHEN l_returnflag = 'A' THEN concat('$', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) WHEN l_returnflag = 'N' THEN date_format(l_shipdate, 'M/d/yyyy') ELSE concat('part ', l_partkey) END AS value",
        "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,4)) END AS amount", "CAST(l_quantity AS INT) AS quantity", "l_partkey", "l_suppkey", "l_linenumber",
    )


LOC = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_returnflag) AS l_returnflag, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL),
    loc AS (SELECT l_orderkey AS document, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 1000 + l_suppkey AS position, CASE WHEN l_partkey % 11 <> 0 THEN (l_linenumber - 1) // 3 + 1 END AS page, CASE WHEN l_partkey % 4 = 0 THEN 'e' || (l_partkey % 6) END AS element_id,
    CASE WHEN l_partkey % 4 = 1 THEN 't1' END AS table_id, CASE WHEN l_suppkey % 3 <> 0 THEN l_linenumber END AS row_index, CASE WHEN l_partkey % 7 = 0 THEN 'r1' END AS region_id, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS source_text,
    CASE l_linenumber % 4 WHEN 0 THEN 'granite' WHEN 2 THEN 'qwen' ELSE 'docling' END AS engine, CASE WHEN l_suppkey % 13 = 0 THEN 'planner' ELSE 'lane' END AS method,
    CASE WHEN l_partkey % 17 = 0 THEN 'other' WHEN l_returnflag = 'A' THEN 'line.amount' WHEN l_returnflag = 'N' THEN 'line.date' ELSE 'line.name' END AS key,
    CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) WHEN l_returnflag = 'N' THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) ELSE 'part ' || l_partkey END AS typed,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,4)) END AS amount, CAST(l_quantity AS INT) AS quantity, l_partkey, l_suppkey, l_linenumber FROM li),
    pl AS (SELECT *, page IS NOT NULL AND (element_id IS NOT NULL OR (table_id IS NOT NULL AND row_index IS NOT NULL)) AS structural FROM loc)"""


def _joined(*columns: str) -> str:
    return "concat_ws(chr(31), " + ", ".join(f"coalesce('=' || {c}, '-')" for c in columns) + ")"


ANCHOR = _joined("document", "page", "element_id", "table_id", "row_index")


def _claims(s, d):
    return claims.claims(located(s, d), s.createDataFrame(REGISTRY, "key string, value_type string"))


CLAIMS = f"""{LOC}, cl AS (SELECT *, sha256({_joined("document", "page", "element_id", "table_id", "row_index", "key", "typed")}) AS claim_id FROM pl WHERE structural AND engine IN ('granite', 'docling') AND method <> 'planner' AND key <> 'other')"""


def _grouped(s, d):
    return claims.line_groups(located(s, d).filter(claims.structural()), "key", "value", "quantity")


GROUPS = f"""{LOC}, a1 AS (SELECT *, {ANCHOR} AS anchor, {_joined("key", "CASE WHEN key = 'line.amount' OR (key = 'other' AND source_flag = 'A') THEN '$' || typed WHEN source_flag = 'N' THEN strftime(CAST(typed AS DATE), '%-m/%-d/%Y') ELSE typed END", "quantity")} AS content FROM (SELECT pl.*, CASE WHEN typed LIKE 'part %' THEN 'R' WHEN typed LIKE '____-__-__' THEN 'N' ELSE 'A' END AS source_flag FROM pl) WHERE structural),
    a2 AS (SELECT *, count(*) OVER (PARTITION BY document, anchor) AS shared, row_number() OVER (PARTITION BY document, anchor, content ORDER BY position) AS nth FROM a1),
    gr AS (SELECT *, sha256(CASE WHEN row_index IS NOT NULL OR shared = 1 THEN anchor ELSE {_joined("anchor", "content", "nth")} END) AS group_id FROM a2)"""


def line_item_assembly(s, d):
    g = _grouped(s, d).withColumn("claim_id", F.col("position"))
    words = F.when(F.col("l_partkey") % 9 == 0, "n/a").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    field = lambda name, value: g.select("document", "group_id", F.lit(name).alias("field"), value.cast("string").alias("value"), "engine", "claim_id", "page", "row_index")
    parts = field("description", words).unionByName(field("amount", F.col("amount")).filter("value IS NOT NULL")).unionByName(field("quantity", F.col("quantity")))
    return claims.line_items(parts.filter(F.col("engine").isin(*claims.ENGINES)), "description", "amount", "quantity")


def claim_outcomes(s, d):
    decided = facts.resolve(_claims(s, d).select("document", "key", F.col("typed").alias("value"), "engine", "claim_id"), "document", "key")
    decided = decided.select("document", "key", F.when(F.col("needs_review"), "needs_review").otherwise("accepted").alias("decision"))
    has = decided.select("document").distinct().withColumn("_m", F.lit(True))
    docs = table(s, d, "orders").select(F.col("o_orderkey").alias("document"), F.when(F.col("o_orderkey") % 2 == 0, "invoice").otherwise("receipt").alias("family"), (F.col("o_orderkey") % 10 == 0).alias("review_only"), (F.col("o_orderkey") % 7 != 0).alias("has_target"))
    docs = docs.join(has, "document", "left").withColumn("material", F.col("_m").isNotNull()).drop("_m")
    required = s.createDataFrame([("invoice", "line.amount"), ("invoice", "line.date"), ("receipt", "line.amount")], "family string, key string")
    return claims.outcomes(docs, decided, required)


def receipt_validation(s, d):
    rows = receipt_payload(s, d).withColumns({"discount": F.when(F.col("id") % 4 == 0, F.lit(1).cast("decimal(18,4)"))})
    return rows.select("id", F.explode(claims.receipt_checks()).alias("c")).select("id", "c.code", "c.status")


def invoice_validation(s, d):
    o = table(s, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS seller", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS number", "CAST(o_orderdate AS DATE) AS issued",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 4 AS INT) - 2) END AS due", "CAST(o_totalprice AS DECIMAL(18,4)) AS total", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,4)) - o_orderkey % 3 END AS subtotal",
        "CAST(1 AS DECIMAL(18,4)) AS tax", "CAST(NULL AS DECIMAL(18,4)) AS shipping", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(1 AS DECIMAL(18,4)) END AS discount")
    return o.select("id", F.explode(claims.invoice_checks()).alias("c")).select("id", "c.code", "c.status")


def _observations(s, d):
    o = located(s, d)
    return o.select("document", F.col("position"), F.concat(F.lit("k"), (F.col("l_partkey") % 2).cast("string")).alias("name"), (F.col("quantity") % 3).alias("value"), F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string"))).alias("locator"))


def line_candidates(s, d):
    """Lines as candidates with thirteen parts; some without detail."""
    bare = F.col("l_partkey") % 3 == 0
    o = located(s, d)
    only = lambda c: F.when(~bare, c)
    rows = o.select(F.expr("document div 4").alias("document"), (F.col("position") * 10 + F.col("document") % 4).alias("position"), F.lit("Item").alias("kind"), F.concat(F.lit("Part  "), (F.col("l_partkey") % 4).cast("string")).alias("description"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("date").alias("service_date"),
        only(F.col("quantity") % 2).alias("quantity"), F.when(F.col("l_suppkey") % 2 == 0, "kg").alias("unit"), F.lit(None).cast("double").alias("unit_price"), only(F.lit(1.5)).alias("gross"), *[F.lit(None).cast("double").alias(c) for c in ("discount", "tax", "net")], F.lit("USD").alias("currency"), F.when(F.col("l_suppkey") % 5 == 0, "x").alias("hint"),
        F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("p"), F.col("page").cast("string"))).alias("locator"), (F.col("l_suppkey") % 2).cast("int").alias("evidence"))
    return claims.dedupe_lines(rows).select("document", "position", "ordinal")


def line_rejects(s, d):
    o = located(s, d)
    k = F.col("l_partkey") % 8
    text = F.when(k == 0, "").when(k == 1, "Tables in the image").when(k == 2, " TBD ").when(k == 3, "rows of it").when(k == 4, "Yearly service visit").when(k == 5, "Short").otherwise("Something long enough")
    rows = o.select("document", "position", text.alias("description"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("date").alias("day"), F.when(F.col("l_suppkey") % 2 == 0, "hint").alias("hint"), F.when(k == 3, 1).when(F.col("quantity") % 2 == 0, 0).otherwise(F.col("quantity")).alias("quantity"), F.when(k == 3, 1.0).alias("amount"))
    return rows.select("document", "position", claims.reject_line("description", "code", "day", "hint", "quantity", "amount").alias("reason"))


def evidence_policy(s, d):
    o = located(s, d)
    schema = F.when(F.col("l_partkey") % 4 == 0, "Invoice").when(F.col("l_partkey") % 4 == 1, "retail_order").when(F.col("l_partkey") % 4 == 2, "document_observation").otherwise("memo")
    path = F.when(F.col("quantity") % 2 == 0, " Invoice.total").otherwise("receipt.total")
    return o.select("document", "position", claims.evidence_reason(F.col("engine")).alias("evidence_reason"), claims.schema_reason(schema, path).alias("schema_reason"))


def _events(s, d):
    """Admission events: schema, then evidence, then duplicates, by content and place."""
    o = located(s, d)
    fp = F.sha2(claims.joined(F.expr("document div 8"), "key", F.col("quantity") % 5, "page"), 256)
    why = [("schema_mismatch", F.col("key") == "other"), ("evidence", claims.evidence_reason(F.col("engine")).isNotNull())]
    return facts.admit(o.withColumn("order", F.col("document") * 10_000_000_000 + F.col("position")), why, fp, "order").select("document", "position", "key", "engine", "decision", "reason")


def admission_summary(s, d):
    return _events(s, d).groupBy("decision", "reason").agg(F.count("*").alias("events"))


def expected_coverage(s, d):
    g = located(s, d).groupBy("document").agg(F.array_sort(F.collect_set("key")).alias("produced"))
    want = F.array(F.lit("amount"), F.lit("line.date"), F.lit("li"), F.lit("the line.name of it"))
    return g.select("document", claims.coverage(want, F.col("produced")).alias("c")).select("document", F.array_join("c.missing", "|").alias("missing"), "c.ratio")


def review_fold(s, d):
    e = table(s, d, "events")
    events = e.select((F.col("user_id") % 200).alias("document"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "correct").otherwise("confirm").alias("action"), F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"))).alias("path"), F.col("props").alias("value"))
    tasks = e.filter("event_type = 'signup' AND event_id % 40 = 0").select((F.col("user_id") % 200).alias("document"))
    return claims.review_state(events, tasks)


def review_tasks(s, d):
    """Tasks by document: failed checks before absent merchants before unplaced items, each with its priority."""
    checks = receipt_validation(s, d)
    failed = checks.filter("code = 'receipt.total_arithmetic' AND status = 'failed'").select("id", F.lit("validation").alias("task"), F.lit(85).alias("priority"))
    absent = checks.filter("code = 'receipt.required.date' AND status = 'failed'").select("id", F.lit("missing_field").alias("task"), F.lit(75).alias("priority"))
    loose = located(s, d).filter("page IS NULL").select(F.col("document").alias("id"), F.lit("unplaced").alias("task"), F.lit(70).alias("priority")).distinct()
    known = documents(s, d).filter("review_status = 'needs_review'").select(F.col("id"))  # these have an open task already
    return failed.unionByName(absent).unionByName(loose).join(known, "id", "left_anti")


def candidate_rows(s, d):
    """Fields of receipts as long rows; what is empty gives none, and an explanation of benefits always needs review."""
    t = receipt_payload(s, d)
    eob = F.col("id") % 6 == 0
    long = t.selectExpr("id", "stack(4, 'receipt.merchant', merchant, 'receipt.date', day, 'receipt.total', CAST(total AS STRING), 'receipt.tip', CAST(tip AS STRING)) AS (path, value)")
    return long.filter("value IS NOT NULL").select("id", "path", "value", F.when(eob, "needs_review").otherwise("proposed").alias("status"))


QUERIES = {
    "claims": lambda s, d: _claims(s, d).select("document", "position", "key", "typed", "claim_id"),
    "line_item_groups": lambda s, d: _grouped(s, d).select("document", "position", "group_id"),
    "line_item_assembly": line_item_assembly,
    "claim_outcomes": claim_outcomes,
    "receipt_validation": receipt_validation,
    "invoice_validation": invoice_validation,
    "line_candidate_dedupe": line_candidates,
    "observation_dedupe": lambda s, d: claims.dedupe_observations(_observations(s, d), "name", "value").select("document", "position"),
    "line_item_rejects": line_rejects,
    "evidence_policy": evidence_policy,
    "admission_events": _events,
    "admission_summary": admission_summary,
    "expected_field_coverage": expected_coverage,
    "review_state": review_fold,
    "review_tasks": review_tasks,
    "candidate_rows": candidate_rows,
}

_MODEL = "engine IN ('granite', 'qwen')"
_CONCRETE = f"(structural OR (page IS NOT NULL AND (region_id IS NOT NULL OR (NOT {_MODEL} AND coalesce(source_text, '') <> ''))))"
_EVIDENCE = f"CASE WHEN CASE WHEN {_MODEL} THEN structural ELSE {_CONCRETE} END THEN NULL WHEN {_MODEL} AND {_CONCRETE} THEN 'missing_structural_value_anchor' ELSE 'missing_concrete_evidence' END"
_ADMIT = f"""WITH {LOC}, x AS (SELECT *, document * 10000000000 + position AS o, {_joined("document // 8", "key", "quantity % 5", "page")} AS fp, CASE WHEN key = 'other' THEN 'schema_mismatch' WHEN {_EVIDENCE} IS NOT NULL THEN 'evidence' END AS why FROM pl),
    y AS (SELECT *, min(CASE WHEN why IS NULL THEN o END) OVER (PARTITION BY fp) < o AS dup FROM x),
    ev AS (SELECT document, position, key, engine, CASE WHEN coalesce(dup, false) THEN 'duplicate' ELSE why END AS reason FROM y)"""
_PAYLOAD = R + r""", rp AS (SELECT id, id % 4 AS k, CASE WHEN regexp_matches(text, 'Merchant') THEN trim(regexp_extract(text, 'Merchant: (.*)', 1)) ELSE 'The corner shop' END AS merchant,
    CASE WHEN id % 4 = 0 THEN regexp_extract(text, '20[0-9]{2}-[0-9]{2}-[0-9]{2}') WHEN id % 4 = 1 THEN strftime(strptime(regexp_extract(text, '[0-9]+/[0-9]+/20[0-9]{2}'), '%m/%d/%Y'), '%Y-%m-%d') END AS day,
    CAST(regexp_extract(text, 'Subtotal ([0-9.]+)', 1) AS DECIMAL(18,4)) AS subtotal, CASE WHEN id % 3 = 0 THEN 1.25 ELSE 2.5 END AS tax, CAST(replace(regexp_extract(text, 'TOTAL: \$(.*)', 1), ',', '') AS DECIMAL(18,4)) AS total FROM receipts)"""
_RV = _PAYLOAD + """, rv AS (SELECT id, unnest(['receipt.required.merchant', 'receipt.required.date', 'receipt.total_arithmetic']) AS code, unnest(['passed', CASE WHEN k < 2 THEN 'passed' ELSE 'failed' END, CASE WHEN abs(total - subtotal - tax + CASE WHEN k = 0 THEN 1 ELSE 0 END) <= 0.02 THEN 'passed' ELSE 'failed' END]) AS status FROM rp)"""

ORACLES = {
    "claims": f"WITH {CLAIMS} SELECT document, position, key, typed, claim_id FROM cl",
    "line_item_groups": f"WITH {GROUPS} SELECT document, position, group_id FROM gr",
    "line_item_assembly": f"""WITH {GROUPS}, f AS (SELECT document, group_id, unnest(['description', 'amount', 'quantity']) AS field, unnest([CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE 'part ' || l_partkey END, CAST(amount AS VARCHAR), CAST(quantity AS VARCHAR)]) AS value, CASE engine WHEN 'granite' THEN 30 ELSE 20 END AS r, position, page, row_index FROM gr WHERE engine <> 'qwen'),
    w AS (SELECT document, group_id, field, value, max(c) OVER (PARTITION BY document, group_id, field) > 1 AS several FROM (SELECT *, dense_rank() OVER (PARTITION BY document, group_id, field ORDER BY value) AS c FROM f WHERE value IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY document, group_id, field ORDER BY r DESC, value, position) = 1),
    p AS (SELECT document, group_id, max(value) FILTER (WHERE field = 'description') AS description, max(value) FILTER (WHERE field = 'amount') AS amount, max(value) FILTER (WHERE field = 'quantity') AS quantity, bool_or(several) AS needs_review FROM w GROUP BY ALL),
    o AS (SELECT document, group_id, arg_min(page, (page, coalesce(row_index, 1000000))) AS page, min((page, coalesce(row_index, 1000000))) AS place FROM f WHERE value IS NOT NULL GROUP BY ALL)
    SELECT document, CAST(row_number() OVER (PARTITION BY document ORDER BY place, group_id) AS INT) AS ordinal, description, amount, quantity, needs_review FROM p JOIN o USING (document, group_id) WHERE description <> 'n/a'""",
    "claim_outcomes": f"""WITH {CLAIMS}, r AS (SELECT document, key, count(DISTINCT typed) > 1 AS doubt FROM cl GROUP BY ALL), g AS (SELECT document, count(*) FILTER (WHERE doubt) AS doubts, list(key) AS keys FROM r GROUP BY ALL),
    o AS (SELECT o_orderkey AS document, coalesce(doubts, 0) AS doubts, keys, len(list_filter(CASE WHEN o_orderkey % 2 = 0 THEN ['line.amount', 'line.date'] ELSE ['line.amount'] END, lambda k: NOT list_contains(coalesce(keys, []), k))) AS absent FROM orders LEFT JOIN g ON o_orderkey = document)
    SELECT document, absent, doubts, CASE WHEN keys IS NULL AND document % 7 = 0 THEN 'no_extraction_target' WHEN keys IS NULL THEN 'insufficient_signal' WHEN document % 10 = 0 OR doubts > 0 OR absent > 0 THEN 'needs_human_review' ELSE 'extracted_cleanly' END AS outcome FROM o""",
    "receipt_validation": _RV + " SELECT * FROM rv",
    "invoice_validation": """SELECT o_orderkey AS id, unnest(['invoice.required.seller', 'invoice.required.invoice_number', 'invoice.required.total', 'invoice.due_date_not_before_issue_date', 'invoice.total_arithmetic']) AS code,
    unnest([CASE WHEN o_custkey % 5 = 0 THEN 'failed' ELSE 'passed' END, CASE WHEN o_orderkey % 6 = 0 THEN 'failed' ELSE 'passed' END, 'passed', ['not_applicable', 'failed', 'passed', 'passed'][o_orderkey % 4 + 1],
    CASE WHEN o_orderkey % 5 = 0 THEN 'warning' WHEN abs(o_orderkey % 3 - 1 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) <= 0.02 THEN 'passed' ELSE 'failed' END]) AS status FROM orders""",
    "line_candidate_dedupe": f"""WITH {LOC}, x AS (SELECT document // 4 AS document, position * 10 + document % 4 AS position, l_partkey % 4 AS dsc, CASE WHEN l_partkey % 3 <> 0 THEN quantity % 2 END AS q, l_suppkey % 2 = 0 AS kg, coalesce(CASE WHEN l_suppkey % 3 <> 0 THEN 'p' || page END, '') AS l,
        CASE WHEN l_partkey % 3 <> 0 THEN 2 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END + l_suppkey % 2 AS rich FROM loc),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY document, dsc, q, kg, l ORDER BY rich DESC, position) = 1),
    z AS (SELECT * FROM y WHERE q IS NOT NULL OR NOT EXISTS (SELECT 1 FROM y r WHERE r.q IS NOT NULL AND r.document = y.document AND r.dsc = y.dsc AND (r.l = y.l OR y.l = '')))
    SELECT document, position, CAST(row_number() OVER (PARTITION BY document ORDER BY position) AS INT) AS ordinal FROM z""",
    "observation_dedupe": f"""WITH {LOC}, x AS (SELECT document, position, l_partkey % 2 AS name, quantity % 3 AS value, CASE WHEN l_partkey % 3 <> 0 THEN l_suppkey % 4 END AS l FROM loc),
    y AS (SELECT *, row_number() OVER (PARTITION BY document, name, value ORDER BY position) AS n, first_value(coalesce(l, -1)) OVER (PARTITION BY document, name, value ORDER BY position) AS f, row_number() OVER (PARTITION BY document, name, value, l ORDER BY position) AS nl FROM x)
    SELECT document, position FROM y WHERE n = 1 OR (f >= 0 AND l IS NOT NULL AND nl = 1)""",
    "line_item_rejects": f"""WITH {LOC}, x AS (SELECT *, l_partkey % 8 AS k, CASE WHEN l_partkey % 8 = 3 THEN 1 WHEN quantity % 2 = 0 THEN 0 ELSE quantity END AS q FROM loc)
    SELECT document, position, CASE k WHEN 0 THEN 'missing_description' WHEN 1 THEN 'prompt_or_schema_echo' WHEN 2 THEN 'placeholder_or_null_value' WHEN 3 THEN 'fake_schema_line_item' WHEN 4 THEN NULL ELSE CASE WHEN q = 0 AND (k = 5 OR l_suppkey % 2 <> 0) THEN 'zero_amount_without_service_context' END END AS reason FROM x""",
    "evidence_policy": f"""WITH {LOC} SELECT document, position, {_EVIDENCE} AS evidence_reason, CASE l_partkey % 4 WHEN 0 THEN CASE WHEN quantity % 2 <> 0 THEN 'candidate_schema_incompatible' END WHEN 1 THEN 'alias_family_requires_observation_projection' WHEN 2 THEN 'document_observation_is_review_only' END AS schema_reason FROM pl""",
    "admission_events": _ADMIT + " SELECT document, position, key, engine, CASE WHEN reason IS NULL THEN 'admitted' ELSE 'rejected' END AS decision, reason FROM ev",
    "admission_summary": _ADMIT + " SELECT CASE WHEN reason IS NULL THEN 'admitted' ELSE 'rejected' END AS decision, reason, count(*) AS events FROM ev GROUP BY ALL",
    "expected_field_coverage": f"""WITH {LOC}, g AS (SELECT document, list(DISTINCT key) AS ks FROM loc GROUP BY 1), m AS (SELECT document, ['amount', 'line.date', 'li', 'the line.name of it'] AS want, list_filter(['amount', 'line.date', 'li', 'the line.name of it'], lambda e: NOT (CASE e WHEN 'amount' THEN list_contains(ks, 'line.amount') WHEN 'line.date' THEN list_contains(ks, 'line.date') WHEN 'li' THEN false ELSE list_contains(ks, 'line.name') END)) AS ms FROM g)
    SELECT document, array_to_string(ms, '|') AS missing, round((4 - len(ms)) / 4.0, 4)::DOUBLE AS ratio FROM m""",
    "review_state": """WITH e AS (SELECT user_id % 200 AS document, event_id AS moment, CASE event_type WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'correct' ELSE 'confirm' END AS action, 'f' || (event_id % 3) AS path, props AS value FROM events WHERE event_id % 9 <> 0),
    l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY document, path ORDER BY moment DESC) = 1), t AS (SELECT DISTINCT user_id % 200 AS document FROM events WHERE event_type = 'signup' AND event_id % 40 = 0)
    SELECT document, path, CASE WHEN action <> 'reject' THEN value END AS value, CASE action WHEN 'reject' THEN 'rejected' WHEN 'correct' THEN 'user_corrected' ELSE 'user_confirmed' END AS field_status, CASE WHEN document IN (SELECT document FROM t) THEN 'needs_review' ELSE 'user_confirmed' END AS document_status FROM l""",
    "review_tasks": _RV + f""", {SQL['docs']}, {LOC}, q AS (SELECT id, 'validation' AS task, 85 AS priority FROM rv WHERE code = 'receipt.total_arithmetic' AND status = 'failed' UNION ALL SELECT id, 'missing_field', 75 FROM rv WHERE code = 'receipt.required.date' AND status = 'failed' UNION ALL SELECT DISTINCT document, 'unplaced', 70 FROM loc WHERE page IS NULL)
    SELECT * FROM q WHERE id NOT IN (SELECT id FROM docs WHERE review_status = 'needs_review')""",
    "candidate_rows": _PAYLOAD + """, c AS (SELECT id, unnest(['receipt.merchant', 'receipt.date', 'receipt.total']) AS path, unnest([merchant, day, CAST(total AS VARCHAR)]) AS value FROM rp)
    SELECT id, path, value, CASE WHEN id % 6 = 0 THEN 'needs_review' ELSE 'proposed' END AS status FROM c WHERE value IS NOT NULL""",
}
