"""Queries from text to facts and from facts to canon."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import facts
from foliospark.sources.tables import SQL, documents, table

DEC = "DECIMAL(18,4)"
TODAY = "2024-07-01"


def _lines(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("role"), F.col("l_extendedprice").cast("decimal(18,4)").alias("amount"), F.col("l_tax").cast("decimal(18,4)").alias("tax"), "l_suppkey", "l_shipdate", "l_quantity", "l_linestatus")


def _totals(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,4)").alias("total"), "o_custkey", "o_orderdate", "o_orderstatus")


def invoice_arithmetic(s, d):
    p = facts.pivot_roles(_lines(s, d), ["A", "N", "R"]).join(_totals(s, d), "id")
    return p.select("id", facts.sum_check(F.col("total"), [F.col("n")], [F.col("a")], [F.col("r")]).alias("status"))


def line_item_sum_check(s, d):
    sums = _lines(s, d).groupBy("id").agg(F.sum("amount").alias("lines"), F.count_if(F.col("amount").isNull()).alias("missing"))
    gap = F.abs(F.col("total") - F.col("lines"))
    return _totals(s, d).join(sums, "id").select("id", F.when(F.col("missing") > 0, "skipped").when(gap <= F.lit("0.02").cast("decimal(18,4)"), "ok").otherwise("failed").alias("status"))


def upper_bound_check(s, d):
    p = facts.pivot_roles(_lines(s, d), ["A", "R"]).join(_totals(s, d), "id")
    zero = F.lit(0).cast("decimal(18,4)")
    return p.select("id", ((F.coalesce("a", zero) + F.coalesce("r", zero)) <= F.col("total") + F.lit("0.02").cast("decimal(18,4)")).alias("within"))


def _claims(s, d):
    li = _lines(s, d)
    return li.select(F.concat_ws("/", F.col("id").cast("string"), "l_linestatus").alias("key"), F.col("l_quantity").cast("int").alias("value"), F.when(F.col("line") % 2 == 0, "granite").otherwise("docling").alias("engine"), (F.col("id") * 10 + F.col("line")).alias("claim_id"))


def claim_resolution(s, d):
    return facts.resolve(_claims(s, d))


def line_item_dedupe(s, d):
    rich = (F.col("tax") > 0).cast("int") + (F.col("l_quantity") > 25).cast("int") + (F.col("amount") > 30000).cast("int")
    return facts.richest(_lines(s, d).withColumn("pos", F.col("id") * 10 + F.col("line")), ["id", "role"], rich, "pos").select("id", "role", "line")


def admission_gate(s, d):
    rows = table(s, d, "documents").select("doc_id", "source", "n_chars", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    why = [("source_not_allowed", F.col("source") == "src19"), ("too_short", F.col("n_chars") < 100), ("schema_mismatch", (F.col("lang") == "es") & (F.col("n_chars") > 5000))]
    return facts.admit(rows, why, F.col("content"), "doc_id").select("doc_id", "decision", "reason")


def auto_promotion(s, d):
    docs = documents(s, d)
    human = docs.filter("review_status = 'needs_review'").select("folder", "family").distinct()
    best = facts.richest(docs.filter("review_status = 'user_confirmed' AND n_chars >= 100"), ["folder", "family"], F.col("n_chars"), "id")
    return best.join(human, ["folder", "family"], "left_anti").select("folder", "family", "id")


def _bills(s, d):
    """Orders as documents with family, contact, day and content hash; some are copies."""
    o = _totals(s, d)
    k = F.col("id") % 5
    family = F.when(k == 0, "invoice").when(k == 1, "receipt").when(k == 2, "medical_eob").when(k == 3, "medical_bill").otherwise("warranty")
    return o.select("id", family.alias("family"), F.col("o_custkey").alias("contact"), F.to_date("o_orderdate").alias("day"), F.sha2(F.concat_ws("/", F.col("o_custkey").cast("string"), F.floor(F.col("total") / 40000).cast("string")), 256).alias("sha"))


def relationship_suggestions(s, d):
    return facts.relationship_suggestions(_bills(s, d))


def contact_merge(s, d):
    """Customers whose names are equal after normalizing away the number: the first of each group takes the others."""
    c = table(s, d, "customer").select("c_custkey", T.contact_name(F.regexp_replace("c_name", "[0-9]{3}$", "")).alias("name"), "c_nationkey")
    first = c.groupBy("name", "c_nationkey").agg(F.min("c_custkey").alias("into"))
    return c.join(first, ["name", "c_nationkey"]).filter("into <> c_custkey").select("c_custkey", "into", "name")


def undirected_edge_count(s, d):
    edges = table(s, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return facts.undirected(edges).groupBy("id").agg(F.count("*").alias("edges"), F.count_distinct("other").alias("neighbours"))


def timeline(s, d):
    none = F.lit(None)
    a = documents(s, d).select(F.lit("document").alias("kind"), F.col("id"), F.col("document_date").alias("occurred_on"), F.col("folder").alias("title"), none.cast("double").alias("amount"))
    b = table(s, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("occurred_on"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("amount"))
    c = table(s, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.to_date("ts").alias("occurred_on"), F.col("event_type").alias("title"), none.cast("double").alias("amount"))
    return a.unionByName(b).unionByName(c).orderBy(F.desc("occurred_on"), "title", "kind", "id").limit(200)


def smart_views(s, d):
    o = _totals(s, d)
    late = _lines(s, d).groupBy("id").agg(F.max("l_shipdate").alias("last"))
    x = o.join(late, "id", "left")
    return x.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.datediff("last", "o_orderdate") > 90).alias("late"), F.count_if(F.col("last").isNull()).alias("unmatched"), F.count_if(F.col("total") > 200000).alias("large"))


def deadlines(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("due"), ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), (F.col("o_orderkey") % 4).cast("int").alias("evidence"))
    return o.select("id", "due", T.deadline_status(F.col("due"), F.col("confidence"), F.col("evidence"), F.lit("1997-07-01").cast("date")).alias("status"))


TAG = [{"type": "add_tag", "tag": "seen"}]
COLUMNS = ("family", "folder", "n_chars", "text", "review_status", "sensitivity")
RULES = [
    {"name": "english_long", "conditions": [{"field": "family", "op": "eq", "value": "EN "}, {"field": "n_chars", "op": "gte", "value": 2000}], "actions": TAG},
    {"name": "even_folder", "conditions": [{"field": "folder", "op": "regex", "value": "SRC.*[02468]$"}], "actions": [{"type": "add_folder", "folder_path": "even"}, {"type": "set_primary_folder", "folder_path": "closed"}], "reviewRequired": False},
    {"name": "reviewed", "conditions": [{"field": "review_status", "op": "in", "value": ["user_confirmed", "user_corrected"]}, {"field": "sensitivity", "op": "neq", "value": "highly_sensitive"}], "actions": TAG, "priority": 90},
    {"name": "short", "conditions": [{"field": "n_chars", "op": "lte", "value": "150"}, {"field": "text", "op": "exists"}], "actions": [{"type": "create_review_task"}]},
    {"name": "mentions", "conditions": [{"field": "text", "op": "contains", "value": "Licens"}], "actions": TAG},
    {"name": "text_order", "conditions": [{"field": "family", "op": "lte", "value": "es"}], "actions": TAG},
    {"name": "off", "enabled": False, "conditions": [{"field": "text", "op": "exists"}], "actions": TAG},
]


def rule_actions(s, d):
    docs = documents(s, d).withColumn("document_family", F.when(F.col("id") % 3 == 0, "tax_document").otherwise(F.col("family")))
    out = facts.evaluate_rules(docs, RULES, ["even"], fields=COLUMNS)
    return out.select("id", "rule", "priority", *[F.array_join(c, "|").alias(c) for c in ("proposed", "blocked", "safety")])


def applied_actions(s, d):
    docs = documents(s, d)
    state = docs.select("id", F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("folder")).alias("folders"), F.when(F.col("id") % 4 != 0, F.col("folder")).alias("primary_folder"), F.array("family").alias("tags"), "sensitivity", "family")
    act = lambda p, kind, value, when: docs.filter(when).select("id", F.lit(p).alias("position"), F.lit(kind).alias("type"), value.alias("value"))
    todo = act(1, "add_folder", F.lit("archive"), "id % 2 = 0").unionByName(act(2, "add_folder", F.col("folder"), "id % 3 = 0")).unionByName(act(3, "add_tag", F.lit("en"), "true")).unionByName(act(4, "set_primary_folder", F.lit("top"), "id % 5 = 0")).unionByName(act(5, "set_sensitivity", F.lit("pii"), "id % 7 = 0")).unionByName(act(6, "set_sensitivity", F.lit("legal"), "id % 14 = 0")).unionByName(act(7, "create_review_task", F.lit("look"), "id % 6 = 0"))
    out = facts.apply_actions(state, todo)
    return out.select("id", F.array_join("folders", "|").alias("folders"), "primary_folder", F.array_join("tags", "|").alias("tags"), "sensitivity", "family", "organization_changed", "review_tasks")


def money_text(s, d):
    v = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey") % 5
    t = F.when(k == 0, F.concat(F.lit("($"), v, F.lit(")"))).when(k == 1, F.concat(v, F.lit("-"))).when(k == 2, F.concat(F.lit("EUR "), F.replace(v, F.lit("."), F.lit(",")))).when(k == 3, F.format_number("o_totalprice", 2)).otherwise(v)
    return table(s, d, "orders").select("o_orderkey", T.parse_amount(t).alias("amount"))


def date_text(s, d):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "M/d/yyyy")).when(k == 2, F.date_format(day, "dd-MMMM-yyyy")).otherwise(F.lit("none"))
    return table(s, d, "orders").select("o_orderkey", T.parse_day(t).alias("day"))


QUERIES = {
    "classify_text": lambda s, d: table(s, d, "documents").select("doc_id", T.classify(F.col("text"), title=F.col("source")).alias("c")).select("doc_id", "c.family", "c.confidence"),
    "regex_spans": lambda s, d: table(s, d, "documents").select("doc_id", F.explode(T.spans(F.col("text"))).alias("s")).select("doc_id", "s.kind", "s.value"),
    "labeled_values": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.labelled(F.concat(F.lit("Role: "), F.col("role"), F.lit("\nTurn (no.) # "), F.col("turn").cast("string")), "turn (no.)").alias("value")),
    "parse_money": money_text,
    "parse_date": date_text,
    "page_quality": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(T.page_reasons(F.col("text")), ",").alias("reasons")),
    "doc_quality": lambda s, d: table(s, d, "documents").select("source", F.explode(T.page_reasons(F.col("text"))).alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("pages")),
    "primary_amounts_pivot": lambda s, d: facts.pivot_roles(_lines(s, d), ["A", "N", "R"]),
    "invoice_arithmetic": invoice_arithmetic,
    "line_item_sum_check": line_item_sum_check,
    "upper_bound_check": upper_bound_check,
    "claim_resolution": claim_resolution,
    "line_item_dedupe": line_item_dedupe,
    "admission_gate": admission_gate,
    "auto_promotion": auto_promotion,
    "relationship_suggestions": relationship_suggestions,
    "contact_merge": contact_merge,
    "undirected_edge_count": undirected_edge_count,
    "timeline": timeline,
    "smart_views": smart_views,
    "deadlines": deadlines,
    "rule_matches": lambda s, d: facts.match_rules(documents(s, d), RULES, fields=COLUMNS),
    "rule_actions": rule_actions,
    "applied_actions": applied_actions,
}

_P = f"p AS (SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS {DEC}) END) AS a, max(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS {DEC}) END) AS n, max(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS {DEC}) END) AS r FROM lineitem GROUP BY 1)"
_O = f"o AS (SELECT *, o_orderkey AS id, CAST(o_totalprice AS {DEC}) AS total FROM orders)"
_REASON = "CASE WHEN length(trim(text)) = 0 THEN ['missing_text_layer'] ELSE [] END || CASE WHEN length(trim(text)) BETWEEN 1 AND 31 THEN ['low_text_density'] ELSE [] END || CASE WHEN length(text) - length(replace(text, '|', '')) >= 10 THEN ['complex_layout'] ELSE [] END || CASE WHEN contains(text, '***') THEN ['degraded_scan'] ELSE [] END"
_QUALITY = f"q AS (SELECT doc_id, source, CASE WHEN len(x) = 0 THEN ['digital_text_page'] ELSE x END AS x FROM (SELECT doc_id, source, {_REASON} AS x FROM documents))"
_SPAN = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in T.SPANS.items())
_FAMILY = """CASE WHEN contains(t, 'explanation of benefits') OR contains(t, ' eob') OR contains(t, 'patient responsibility') THEN 'medical_eob' WHEN contains(t, 'invoice') OR contains(t, 'balance due') OR contains(t, 'bill to') THEN 'invoice'
    WHEN contains(t, 'receipt') OR contains(t, 'subtotal') OR contains(t, 'sales tax') OR contains(t, 'transaction date') THEN 'receipt' ELSE 'generic' END"""

_RULES_SQL = f"""WITH {SQL['docs']}, m AS (SELECT *, 'english_long' AS rule FROM docs WHERE family = 'en' AND n_chars >= 2000 UNION ALL SELECT *, 'even_folder' FROM docs WHERE regexp_matches(lower(folder), 'src.*[02468]$')
    UNION ALL SELECT *, 'reviewed' FROM docs WHERE review_status IN ('user_confirmed', 'user_corrected') AND sensitivity <> 'highly_sensitive' UNION ALL SELECT *, 'short' FROM docs WHERE n_chars <= 150 AND text <> ''
    UNION ALL SELECT *, 'mentions' FROM docs WHERE contains(lower(text), 'licens') UNION ALL SELECT *, 'text_order' FROM docs WHERE family >= 'es')"""

ORACLES = {
    "classify_text": f"SELECT doc_id, family, CASE family WHEN 'medical_eob' THEN 0.86 WHEN 'invoice' THEN 0.85 WHEN 'receipt' THEN 0.84 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT doc_id, {_FAMILY} AS family FROM (SELECT doc_id, lower(source || chr(10) || text) AS t FROM documents))",
    "regex_spans": _SPAN,
    "labeled_values": r"SELECT conv_id, turn, regexp_extract(t, '(?im)^\s*turn [(]no[.][)]\s*[:#]\s*(.+)$', 1) AS value FROM (SELECT conv_id, turn, 'Role: ' || role || chr(10) || 'Turn (no.) # ' || turn AS t FROM conversations)",
    "parse_money": f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 IN (0, 1) THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders",
    "parse_date": "SELECT o_orderkey, CAST(CAST(try_strptime(CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%B-%Y') ELSE 'none' END, ['%Y-%m-%d', '%m/%d/%Y', '%d-%B-%Y']) AS DATE) AS VARCHAR) AS day FROM orders",
    "page_quality": f"WITH {_QUALITY} SELECT doc_id, array_to_string(x, ',') AS reasons FROM q",
    "doc_quality": f"WITH {_QUALITY} SELECT source, reason, count(*) AS pages FROM (SELECT source, unnest(x) AS reason FROM q) GROUP BY ALL",
    "primary_amounts_pivot": f"WITH {_P} SELECT id, a::DOUBLE AS a, n::DOUBLE AS n, r::DOUBLE AS r FROM p",
    "invoice_arithmetic": f"""WITH {_P}, {_O}, g AS (SELECT p.*, total, total - coalesce(n, 0) - coalesce(a, 0) + coalesce(r, 0) AS gap FROM p JOIN o USING (id))
    SELECT id, CASE WHEN total IS NULL OR n IS NULL THEN 'inconclusive' WHEN abs(gap) <= 0.02 THEN 'ok' WHEN (gap > 0 AND a IS NULL) OR (gap < 0 AND r IS NULL) THEN 'inconclusive' ELSE 'failed' END AS status FROM g""",
    "line_item_sum_check": f"""WITH {_O}, x AS (SELECT l_orderkey AS id, sum(CAST(l_extendedprice AS {DEC})) AS lines, count(*) - count(l_extendedprice) AS missing FROM lineitem GROUP BY 1)
    SELECT id, CASE WHEN missing > 0 THEN 'skipped' WHEN abs(total - lines) <= 0.02 THEN 'ok' ELSE 'failed' END AS status FROM o JOIN x USING (id)""",
    "upper_bound_check": f"WITH {_P}, {_O} SELECT id, coalesce(a, 0) + coalesce(r, 0) <= total + 0.02 AS within FROM p JOIN o USING (id)",
    "claim_resolution": """WITH c AS (SELECT concat_ws('/', CAST(l_orderkey AS VARCHAR), l_linestatus) AS key, CAST(l_quantity AS INT) AS value, CASE WHEN l_linenumber % 2 = 0 THEN 30 ELSE 20 END AS r, l_orderkey * 10 + l_linenumber AS claim_id FROM lineitem),
    n AS (SELECT key, count(*) AS claims, count(DISTINCT value) AS vs FROM c GROUP BY key),
    w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC, value, claim_id) = 1)
    SELECT key, value, claim_id, CASE WHEN claims = 1 THEN 'single_source' WHEN vs = 1 THEN 'multi_source_agreement' ELSE 'source_precedence_conflict' END AS decision, vs > 1 AS needs_review, claims FROM w JOIN n USING (key)""",
    "line_item_dedupe": f"SELECT l_orderkey AS id, l_returnflag AS role, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY (CAST(l_tax AS {DEC}) > 0)::INT + (l_quantity > 25)::INT + (CAST(l_extendedprice AS {DEC}) > 30000)::INT DESC, l_linenumber) = 1",
    "admission_gate": """WITH x AS (SELECT doc_id, text AS head, CASE WHEN source = 'src19' THEN 'source_not_allowed' WHEN n_chars < 100 THEN 'too_short' WHEN lang = 'es' AND n_chars > 5000 THEN 'schema_mismatch' END AS why FROM documents),
    y AS (SELECT *, coalesce(max(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY head ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dup FROM x)
    SELECT doc_id, CASE WHEN dup = 1 OR why IS NOT NULL THEN 'rejected' ELSE 'admitted' END AS decision, CASE WHEN dup = 1 THEN 'duplicate' ELSE why END AS reason FROM y""",
    "auto_promotion": f"""WITH {SQL['docs']} SELECT folder, family, id FROM (SELECT * FROM docs WHERE review_status = 'user_confirmed' AND n_chars >= 100 QUALIFY row_number() OVER (PARTITION BY folder, family ORDER BY n_chars DESC, id) = 1) b
    WHERE NOT EXISTS (SELECT 1 FROM docs h WHERE h.review_status = 'needs_review' AND h.folder = b.folder AND h.family = b.family)""",
    "relationship_suggestions": f"""WITH {_O}, d AS (SELECT id, ['invoice', 'receipt', 'medical_eob', 'medical_bill', 'warranty'][id % 5 + 1] AS family, o_custkey AS contact, CAST(o_orderdate AS DATE) AS day, sha256(o_custkey || '/' || CAST(floor(total / 40000) AS BIGINT)) AS sha FROM o),
    n AS (SELECT *, row_number() OVER (PARTITION BY contact ORDER BY day DESC, id) <= 100 AS recent FROM d),
    ru AS (SELECT * FROM (VALUES ('invoice', 'receipt', 'invoice_for'), ('receipt', 'invoice', 'receipt_for'), ('medical_eob', 'medical_bill', 'eob_for'), ('medical_bill', 'medical_eob', 'bill_for'), ('warranty', 'receipt', 'warranty_for'), ('receipt', 'warranty', 'receipt_for')) v(x, y, kind)),
    k AS (SELECT a.id AS a, b.id AS b, kind, CASE WHEN abs(a.day - b.day) <= 45 THEN 0.86 ELSE 0.78 END::DOUBLE AS confidence FROM n a JOIN ru ON a.family = x JOIN n b ON b.family = y AND a.contact = b.contact AND a.sha <> b.sha AND (a.recent OR b.recent))
    SELECT first AS a, id AS b, 'duplicate_of' AS kind, 0.99::DOUBLE AS confidence FROM (SELECT id, min(id) OVER (PARTITION BY sha) AS first FROM d) WHERE id > first UNION ALL SELECT * FROM k""",
    "contact_merge": r"""WITH c AS (SELECT c_custkey, c_nationkey, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(c_name, '[0-9]{3}$', ''))), '[^\p{L}\p{N}_]+', ' ', 'g'), ' +', ' ', 'g')) AS name FROM customer)
    SELECT c_custkey, first AS "into", name FROM (SELECT *, min(c_custkey) OVER (PARTITION BY name, c_nationkey) AS first FROM c) WHERE first <> c_custkey""",
    "undirected_edge_count": "SELECT id, count(*) AS edges, count(DISTINCT other) AS neighbours FROM (SELECT l_partkey AS id, l_suppkey AS other FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem) GROUP BY id",
    "timeline": f"""WITH {SQL['docs']} SELECT * REPLACE (CAST(occurred_on AS VARCHAR) AS occurred_on) FROM (SELECT 'document' AS kind, id, document_date AS occurred_on, folder AS title, NULL::DOUBLE AS amount FROM docs
    UNION ALL SELECT 'order', o_orderkey, CAST(o_orderdate AS DATE), o_orderpriority, o_totalprice FROM orders UNION ALL SELECT 'event', event_id, CAST(ts AS DATE), event_type, NULL FROM events) ORDER BY 3 DESC, title, kind, id LIMIT 200""",
    "smart_views": f"""WITH {_O}, l AS (SELECT l_orderkey AS id, max(l_shipdate) AS last FROM lineitem GROUP BY 1), x AS (SELECT o.*, last FROM o LEFT JOIN l USING (id))
    SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE CAST(last AS DATE) - CAST(o_orderdate AS DATE) > 90) AS late, count(*) FILTER (WHERE last IS NULL) AS unmatched, count(*) FILTER (WHERE total > 200000) AS large FROM x""",
    "deadlines": """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS due, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, o_orderkey % 4 AS evidence FROM orders)
    SELECT id, CAST(due AS VARCHAR) AS due, CASE WHEN evidence = 0 OR confidence < 0.65 THEN 'needs_review' WHEN due < DATE '1997-07-01' THEN 'overdue' WHEN due - DATE '1997-07-01' <= 30 THEN 'due_soon' ELSE 'open' END AS status FROM o""",
    "rule_matches": _RULES_SQL + " SELECT id, rule FROM m",
    "rule_actions": _RULES_SQL + """ SELECT id, rule, CASE rule WHEN 'reviewed' THEN 90 ELSE 50 END AS priority, CASE rule WHEN 'even_folder' THEN 'add_folder:even' WHEN 'short' THEN 'create_review_task:Review suggested filing.' ELSE 'add_tag:seen' END AS proposed, CASE rule WHEN 'even_folder' THEN 'set_primary_folder:closed' ELSE '' END AS blocked,
    concat_ws('|', CASE WHEN rule <> 'even_folder' THEN 'rule_requires_review' END, CASE WHEN sensitivity = 'highly_sensitive' THEN sensitivity END, CASE WHEN id % 3 = 0 THEN 'tax_document' END) AS safety FROM m""",
    "applied_actions": f"""WITH {SQL['docs']} SELECT id, concat_ws('|', CASE WHEN id % 4 <> 0 THEN folder END, CASE WHEN id % 2 = 0 THEN 'archive' END, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN folder END, CASE WHEN id % 5 = 0 THEN 'top' END) AS folders,
    CASE WHEN id % 5 = 0 THEN 'top' WHEN id % 4 <> 0 THEN folder ELSE 'archive' END AS primary_folder, CASE WHEN family = 'en' THEN 'en' ELSE family || '|en' END AS tags, CASE WHEN id % 14 = 0 THEN 'legal' WHEN id % 7 = 0 THEN 'pii' ELSE sensitivity END AS sensitivity, family,
    id % 2 = 0 OR id % 5 = 0 OR family <> 'en' AS organization_changed, CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS review_tasks FROM docs""",
}
