"""Queries of extraction: parse trees, anchors, families, lanes, keys and values, geometry, payloads."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import extraction as X
from foliospark.sources.tables import SQL, jobs, table


def _papers(s, d):
    """Orders as short papers with the phrases of several families."""
    i = F.col("o_orderkey")
    part = lambda m, t: F.when(i % m == 0, t)
    text = F.concat_ws("\n", F.lit("preinvoice taxes"), part(2, "INVOICE  number 7"), part(3, "Amount\tdue: 9"), part(5, "Paid in full."), part(4, "subtotal, tax"), part(7, "Explanation of  benefits"), part(11, "Repair order: labor"), part(11, "VIN 1"), part(13, "escrow (shortage)"))
    family = F.when(i % 6 == 0, "invoice").when(i % 6 == 1, "receipt").otherwise("generic")
    semantic = F.when(i % 4 == 0, "receipt").when(i % 4 == 1, "invoice").when(i % 4 == 2, "generic")
    return table(s, d, "orders").select(i.alias("id"), text.alias("text"), family.alias("family"), semantic.alias("semantic"))


HITS = """pa AS (SELECT o_orderkey AS id FROM orders), fa AS (SELECT id, unnest(['invoice', 'receipt', 'medical_eob', 'service_record', 'mortgage_escrow_statement']) AS family, unnest([
        list_filter([CASE WHEN id % 3 = 0 THEN 'amount_due' END, CASE WHEN id % 2 = 0 THEN 'invoice' END], lambda x: x IS NOT NULL), CASE WHEN id % 7 = 0 THEN [] ELSE list_filter([CASE WHEN id % 5 = 0 THEN 'paid' END, CASE WHEN id % 4 = 0 THEN 'subtotal' END, CASE WHEN id % 4 = 0 THEN 'tax' END], lambda x: x IS NOT NULL) END,
        CASE WHEN id % 7 = 0 THEN ['eob'] ELSE [] END, CASE WHEN id % 11 = 0 THEN ['repair_order', 'service', 'vehicle'] ELSE [] END, CASE WHEN id % 13 = 0 THEN ['escrow', 'shortage'] ELSE [] END]) AS a FROM pa),
    ro AS (SELECT id, 'retail_order' AS family, ['order'] AS a FROM pa WHERE id % 11 = 0), hi AS (SELECT id, family, a, len(a) >= CASE family WHEN 'service_record' THEN 3 ELSE 2 END AS hint FROM (SELECT * FROM fa UNION ALL SELECT * FROM ro) WHERE len(a) > 0),
    dd AS (SELECT id, CASE id % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' ELSE 'generic' END AS family, CASE id % 4 WHEN 0 THEN 'receipt' WHEN 1 THEN 'invoice' WHEN 2 THEN 'generic' END AS semantic FROM pa)"""


def family_votes(s, d):
    p = _papers(s, d)
    votes = p.select("id", F.lit("source").alias("source"), "family", F.lit(1.0).alias("confidence")).unionByName(p.filter("semantic IS NOT NULL").select("id", F.when(F.col("id") % 3 == 0, "partial").otherwise("page").alias("source"), F.col("semantic").alias("family"), ((F.col("id") % 10) / 10.0).alias("confidence")))
    return X.voted(votes, X.anchors(p).select("id", "family", "anchors"))


def family_reconciliation(s, d):
    """Papers with document types and families of every kind, in any spelling."""
    p = _papers(s, d)
    one = lambda values, k: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("id") % k + 1).cast("int"))
    docs = p.select("id", one(("invoice", "receipt", None, "Insurance_Document ", "whitepaper", "odd"), 6).alias("family"), one((" Payment_Receipt", "invoice", "generic_form", "medical_claim", "insurance_denial", "unheard_of", None, "document_observation"), 8).alias("semantic"))
    return X.reconciled(docs, X.anchors(p))


def contract_modes(s, d):
    tasks = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.element_at(F.array(F.lit("invoice"), F.lit("bill"), F.lit("memo"), F.lit(None)), (F.col("l_partkey") % 4 + 1).cast("int")).alias("schema"))
    return X.contracts(tasks, s.createDataFrame([("invoice", "invoice_v1"), ("receipt", "receipt_v1")], "schema string, contract string"), s.createDataFrame([("bill", "invoice"), ("slip", "receipt")], "alias string, schema string"))


def _pages(s, d):
    li = table(s, d, "lineitem")
    reasons = F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit("handwriting"), F.lit("complex_layout"), F.lit("degraded_scan"))).when(F.col("l_suppkey") % 4 == 1, F.array(F.lit("complex_layout"))).otherwise(F.array().cast("array<string>"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 11 != 0).alias("is_task"), (F.col("l_partkey") % 5 != 0).alias("fits"), (F.col("l_partkey") % 7 != 0).alias("grounded"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_linenumber") - 1).alias("data_rows"), (F.col("l_suppkey") % 3).alias("columns"), (F.col("l_suppkey") % 2).alias("elements"), reasons.alias("reasons"))


def lanes(s, d):
    return _pages(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.lane().alias("t"), X.lane(False).alias("k")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws("/", "t.lane", "t.reason").alias("table_lane"), F.concat_ws("/", "k.lane", "k.reason").alias("key_lane"))


def key_values(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    k = F.col("id") % 6
    picked = o.select("id", F.explode(F.array(F.struct(F.lit("Amount Due").alias("key"), F.when(k != 5, "s1").alias("span_id")), F.struct(F.lit("dueDate").alias("key"), F.lit("s2").alias("span_id")), F.struct(F.lit("colour").alias("key"), F.lit("s3").alias("span_id")))).alias("x")).select("id", "x.*")
    v1 = F.when(k == 0, "none").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    v2 = F.when(k == 1, "soon").otherwise(F.date_format("o_orderdate", "MMM d, yyyy"))
    spans = o.select("id", F.explode(F.array(F.struct(F.lit("s1").alias("span_id"), v1.alias("value")), F.struct(F.lit("s2").alias("span_id"), v2.alias("value")), F.struct(F.lit("s3").alias("span_id"), F.when(k == 2, " ").otherwise("red").alias("value")))).alias("x")).select("id", "x.*")
    return X.key_values(picked, spans, s.createDataFrame([("amount_due", "invoice.total", "money"), ("due-date", "invoice.due_on", "date")], "key string, path string, value_type string"))


def row_gates(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_linenumber")).alias("row_index"))
    return X.gated_rows(li, table(s, d, "orders").select(F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 4 != 0).alias("authoritative"), (F.col("o_orderkey") % 5).alias("data_rows")))


def plan_enforcement(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("target"), "l_partkey")
    return X.enforced(li.filter("l_partkey % 2 = 0"), li.filter("l_partkey % 3 = 0"), "id", "target")


def _parsed(s, d):
    """Documents as parse trees: a line is an element, five lines a page, every second page without its own text."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("ls"))
    texts = F.transform("ls", lambda x, i: F.struct((F.floor(i / 5) + 1).cast("int").alias("page_no"), F.lit("text").alias("label"), x.alias("text")))
    pages = F.transform(F.sequence(F.lit(1), F.ceil(F.size("ls") / 5).cast("int")), lambda n: F.struct(n.alias("page_no"), F.when(n % 2 == 1, F.array_join(F.slice("ls", (n - 1) * 5 + 1, F.lit(5)), "\n")).alias("text")))
    tables = F.array(F.struct(F.lit(1).alias("page_no"), F.lit("| a |").alias("markdown")))
    return X.parsed(docs.select("id", F.to_json(F.struct(pages.alias("pages"), texts.alias("texts"), tables.alias("tables"))).alias("json")))


def document_bundles(s, d):
    """Each document with its pages, elements, tables and chunks, counted, and the hash of its pages in order."""
    pages, elements, tables, chunks = _parsed(s, d)
    text = pages.groupBy("id").agg(F.count("*").alias("pages"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").cast("binary"), 256).alias("sha"))
    count = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    return text.join(count(elements, "elements"), "id", "left").join(count(tables, "tables"), "id", "left").join(chunks.groupBy("id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens")), "id", "left").na.fill(0)


def boxes(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("p"), F.col("l_suppkey").cast("double").alias("q"), "l_partkey", "l_suppkey")
    num = lambda c: c.cast("int").cast("string")
    j = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("["), F.concat_ws(",", num(F.col("p")), num(F.col("q")), num(F.col("p") + 20), num(F.col("q") + 10)), F.lit("]"))).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit('{"l":'), num(F.col("p")), F.lit(',"t":'), num(F.col("q")), F.lit(',"r":'), num(F.col("p") + 20), F.lit(',"b":'), num(F.col("q") + 10), F.lit("}"))).when(F.col("l_partkey") % 4 == 2, F.lit("[1,2,3]")).otherwise(F.lit('{"x0":1}'))
    x = li.withColumn("b", X.box(j)).filter("b IS NOT NULL")
    x = x.withColumns({"u": X.upright(F.col("b"), F.lit(1000.0)), "e": X.expanded(F.col("b"), 15.0, F.lit(600.0), F.lit(60.0)), "o": X.overlap(F.col("b"), F.array(F.lit(100.0), F.lit(0.0), F.lit(400.0), F.lit(50.0)))})
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("u")[1].alias("top"), F.array_join(F.transform("e", lambda v: v.cast("int").cast("string")), ",").alias("grown"), F.round("o", 6).alias("overlap"), X.grid_tokens(F.col("p") + 100, F.col("q") * 10 + 50, 28, 200_000).cast("long").alias("tokens"))


def payload_safety(s, d):
    e = table(s, d, "events")
    k = F.col("event_id") % 5
    j = F.when(k == 0, '{"a": {"API_KEY": "x"}}').when(k == 1, '{"object-uri": "q", "n": "1"}').when(k == 2, '{"where": "filesystem://a/b", "n": "2"}').when(k == 3, F.concat(F.lit('{"outer": {"Prompt-1": {"a": 1}, "list": [{"messages": [], "n": 1.5}, "data:x", '), F.col("props"), F.lit(']}}'))).otherwise(F.col("props"))
    return e.select("event_id", X.holds_secret(j).alias("secret"), F.when(k != 0, X.redacted(j)).alias("shown"))


def aggregate_triggers(s, d):
    """Orders all of whose region jobs are settled, the job that asks counted as done, with their coverage."""
    j = jobs(s, d).select((F.col("job_id") % 5000).alias("document"), "job_id", "status")
    asking = j.groupBy("document").agg(F.max("job_id").alias("asks"))
    x = j.join(asking, "document").withColumn("status", F.when(F.col("job_id") == F.col("asks"), "succeeded").otherwise(F.col("status")))
    g = x.groupBy("document").agg(F.count_if(F.col("status").isin("queued", "running")).alias("pending"), F.count_if(F.col("status") == "succeeded").alias("done"), F.count("*").alias("regions"))
    return g.filter("pending = 0").select("document", "done", "regions", F.round(F.col("done") / F.col("regions"), 4).alias("coverage"), (F.col("done") < F.col("regions")).alias("needs_review"))


def analysis_intake(s, d):
    """Documents by what an analysis may rest on: truth with enough evidence, review, or debugging only."""
    li = table(s, d, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "N").alias("accepted"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_partkey") % 5 != 0)).alias("evident"), F.count_if(F.col("l_returnflag") == "R").alias("proposed"))
    share = F.try_divide("evident", "accepted")
    surface = F.when((F.col("accepted") > 0) & (share >= 0.8), "truth").when((F.col("accepted") > 0) | (F.col("proposed") > 0), "review").otherwise("debug")
    return g.select("id", F.round(share, 4).alias("coverage"), surface.alias("surface"))


QUERIES = {
    "family_anchors": lambda s, d: X.anchors(_papers(s, d)).select("id", "family", F.array_join("anchors", ",").alias("anchors"), "hint"),
    "classified_papers": lambda s, d: X.classified(_papers(s, d).withColumns({"text": F.regexp_replace(F.replace(F.col("text"), F.lit("preinvoice"), F.lit("")), r"\s+", " "), "title": F.lit("Scan"), "difficult": F.col("id") % 9 == 0})),
    "family_votes": family_votes, "family_reconciliation": family_reconciliation,
    "contract_modes": contract_modes, "lanes": lanes, "key_values": key_values, "row_gates": row_gates, "plan_enforcement": plan_enforcement, "document_bundles": document_bundles,
    "boxes": boxes, "payload_safety": payload_safety, "aggregate_triggers": aggregate_triggers, "analysis_intake": analysis_intake,
}

ORACLES = {
    "family_anchors": f"WITH {HITS} SELECT id, family, array_to_string(a, ',') AS anchors, hint FROM hi",
    "classified_papers": """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'medical_eob' WHEN o_orderkey % 2 = 0 THEN 'invoice' ELSE 'generic' END AS family FROM orders)
    SELECT id, family, CASE WHEN family = 'medical_eob' THEN 'explanation_of_benefits' END AS subtype, CASE family WHEN 'medical_eob' THEN 0.86 WHEN 'invoice' THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN family = 'generic' THEN 'docling_only' ELSE 'docling_plus_structured_extraction' END AS route_profile, family <> 'invoice' OR id % 9 = 0 AS needs_review FROM c""",
    "family_votes": f"""WITH {HITS}, v AS (SELECT id, family, 0.35::DOUBLE AS w, 0 AS anchored FROM dd UNION ALL SELECT id, semantic, CASE WHEN id % 3 = 0 THEN 0.5 ELSE (id % 10) / 10.0 END, 0 FROM dd WHERE semantic IS NOT NULL UNION ALL SELECT id, family, len(a) * 1.25, 1 FROM hi),
    t AS (SELECT id, family, round(sum(w), 6) AS votes, max(anchored) AS anchored FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS n, votes - coalesce(lead(votes) OVER w, 0) AS lead FROM t WINDOW w AS (PARTITION BY id ORDER BY votes DESC, family))
    SELECT id, CASE WHEN anchored = 0 AND lead < 0.5 THEN 'generic_form' ELSE family END AS family, votes FROM r WHERE n = 1""",
    "family_reconciliation": f"""WITH {HITS}, g AS (SELECT id, family AS f, len(a) AS n FROM hi WHERE hint),
    x AS (SELECT id, ['invoice', 'receipt', NULL, 'insurance_document', 'whitepaper', 'odd'][id % 6 + 1] AS given, ['payment_receipt', 'invoice', 'generic_form', 'medical_claim', 'insurance_denial', 'unheard_of', NULL, 'document_observation'][id % 8 + 1] AS kind FROM pa),
    y AS (SELECT *, coalesce(given, 'generic') AS source, CASE kind WHEN 'payment_receipt' THEN 'receipt' WHEN 'invoice' THEN 'invoice' WHEN 'generic_form' THEN 'generic' WHEN 'medical_claim' THEN 'medical_eob' WHEN 'insurance_denial' THEN 'insurance_denial' END AS said FROM x),
    z AS (SELECT y.*, (SELECT n FROM g WHERE g.id = y.id AND f = CASE said WHEN 'insurance_denial' THEN 'medical_eob' ELSE said END) AS sup, (SELECT n FROM g WHERE g.id = y.id AND f = CASE source WHEN 'insurance_document' THEN 'medical_eob' ELSE source END) AS backed,
        (SELECT arg_min(f, list_position(['real_estate_title', 'mortgage_escrow_statement', 'financial_dispute_form', 'service_record', 'retail_order'], f)) FROM g WHERE g.id = y.id AND f IN ('real_estate_title', 'mortgage_escrow_statement', 'financial_dispute_form', 'service_record', 'retail_order')) AS best FROM y),
    k AS (SELECT *, CASE WHEN sup IS NOT NULL AND said IS DISTINCT FROM given THEN 1 WHEN sup IS NOT NULL THEN 2 WHEN best IS DISTINCT FROM given AND (best IN ('real_estate_title', 'mortgage_escrow_statement', 'financial_dispute_form') OR (best IS NOT NULL AND source IN ('receipt', 'invoice', 'insurance_document', 'generic'))) THEN 3
        WHEN source IN ('receipt', 'invoice', 'insurance_document') AND kind IN ('generic_form', 'document_observation') AND backed IS NULL THEN 4 ELSE 5 END AS k FROM z),
    o AS (SELECT k.*, CASE WHEN k <= 2 THEN said WHEN k = 3 THEN best WHEN k = 4 THEN 'generic' WHEN source = 'odd' THEN 'generic' ELSE source END AS family, CASE WHEN k <= 2 THEN sup WHEN k = 3 THEN (SELECT n FROM g WHERE g.id = k.id AND f = best) END AS n FROM k)
    SELECT id, family, CASE k WHEN 4 THEN 0.68 WHEN 5 THEN 0.62 ELSE round(least(0.96, 0.72 + 0.04 * n), 4) END::DOUBLE AS confidence,
    ['semantic_document_type_with_docling_support', 'semantic_document_type_confirms_existing_family', 'docling_anchor_family_supersedes_phase4', 'semantic_generic_downgrades_unsupported_phase4_family', 'retain_existing_family'][k] AS reason, k < 5 AND family <> source AS update FROM o""",
    "contract_modes": "SELECT l_orderkey * 10 + l_linenumber AS id, ['exact', 'alias', 'generic_review_only', 'missing'][l_partkey % 4 + 1] AS mode, ['invoice_v1', 'invoice_v1', 'document_observation', NULL][l_partkey % 4 + 1] AS contract FROM lineitem",
    "lanes": """WITH x AS (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN 'vision/difficult_page:handwriting,degraded_scan' END AS hard, CASE WHEN l_partkey % 11 = 0 THEN 'vision/no_semantic_task' WHEN l_partkey % 5 = 0 THEN 'x' END AS first FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN first = 'x' THEN 'vision/region_not_line_item_table' WHEN first IS NOT NULL THEN first WHEN l_partkey % 7 = 0 THEN 'vision/no_grounded_docling_table' WHEN l_partkey % 3 = 0 THEN 'vision/table_grid_missing' WHEN l_linenumber = 1 THEN 'vision/table_grid_has_no_data_rows' WHEN l_suppkey % 3 < 2 THEN 'vision/table_grid_too_narrow' ELSE coalesce(hard, 'text/usable_grid_on_text_page') END AS table_lane,
    CASE WHEN first = 'x' THEN 'vision/region_not_kvp' WHEN first IS NOT NULL THEN first WHEN l_partkey % 7 = 0 THEN 'vision/no_grounded_page' WHEN l_suppkey % 2 = 0 THEN 'vision/no_page_elements' ELSE coalesce(hard, 'text/kvp_spans_on_text_page') END AS key_lane FROM x""",
    "key_values": """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, strftime(o_orderdate, '%b %-d, %Y') AS t FROM orders)
    SELECT id, 'Amount Due' AS key, CASE WHEN k IN (0, 5) THEN 'unmatched' ELSE 'fact' END AS kind, CASE WHEN k NOT IN (0, 5) THEN 'invoice.total' END AS path, CASE WHEN k NOT IN (0, 5) THEN p END AS value FROM o UNION ALL SELECT id, 'dueDate', CASE WHEN k = 1 THEN 'unmatched' ELSE 'fact' END, CASE WHEN k <> 1 THEN 'invoice.due_on' END, CASE WHEN k <> 1 THEN t END FROM o
    UNION ALL SELECT id, 'colour', CASE WHEN k = 2 THEN 'unmatched' ELSE 'observation' END, CASE WHEN k <> 2 THEN 'colour' END, CASE WHEN k <> 2 THEN 'red' END FROM o""",
    "row_gates": """WITH g AS (SELECT l_orderkey AS t, count(*) AS n, count(*) FILTER (WHERE l_partkey % 3 = 0) AS bad FROM lineitem GROUP BY 1), h AS (SELECT t, t % 4 <> 0 AS auth, t % 5 AS want, CASE WHEN t % 4 <> 0 THEN bad ELSE 0 END AS rejected, n FROM g WHERE t IN (SELECT o_orderkey FROM orders))
    SELECT t AS table_id, n - rejected AS accepted, rejected, auth AND want > 0 AND abs(n - rejected - want) >= 1 AND abs(n - rejected - want) > 0.25 * want AS mismatch FROM h""",
    "plan_enforcement": "WITH p AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS target FROM lineitem WHERE l_partkey % 3 = 0), b AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS target FROM lineitem WHERE l_partkey % 2 = 0) SELECT id, target, false AS added FROM p UNION ALL SELECT id, target, true FROM (SELECT * FROM b EXCEPT SELECT * FROM p)",
    "document_bundles": r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) // 5 + 1 AS page FROM documents WHERE text IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY id, page) AS n FROM l),
    p AS (SELECT doc_id AS id, n AS page, array_to_string(list_slice(string_split(text, chr(10)), (n - 1) * 5 + 1, n * 5), chr(10)) AS t, len(string_split(text, chr(10))) AS m FROM documents, unnest(range(1, CAST(ceil(len(string_split(text, chr(10))) / 5.0) AS BIGINT) + 1)) AS u(n)),
    q AS (SELECT id, page, CASE WHEN page % 2 = 1 AND trim(t, ' ') <> '' THEN trim(t, ' ') ELSE t END AS t, m FROM p) SELECT id, count(*) AS pages, sha256(string_agg(t, chr(10) ORDER BY page)) AS sha, any_value(m) AS elements, 1::BIGINT AS tables, count(*) FILTER (WHERE trim(regexp_replace(t, '\s+', ' ', 'g')) <> '') AS chunks, coalesce(CAST(sum(len(regexp_extract_all(t, '\S+'))) AS BIGINT), 0) AS tokens FROM q GROUP BY id""",
    "boxes": """WITH x AS (SELECT *, l_partkey AS p, l_suppkey AS q FROM lineitem WHERE l_partkey % 4 < 2), t AS (SELECT *, least(1.0, sqrt(200000.0 / ((p + 100.0) * (q * 10 + 50.0)))) AS sc FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (1000.0 - (q + 10))::DOUBLE AS top, greatest(0, p - 15) || ',' || greatest(0, q - 15) || ',' || least(600, p + 35) || ',' || least(60, q + 25) AS grown, round(greatest(0, least(p + 20, 400) - greatest(p, 100)) * greatest(0, least(q + 10, 50) - greatest(q, 0)) / 200.0, 6)::DOUBLE AS overlap,
    CAST(least(greatest(1, ceil(round_even((p + 100) * sc, 0) / 28)) * greatest(1, ceil(round_even((q * 10 + 50) * sc, 0) / 28)), 255) AS BIGINT) AS tokens FROM t""",
    "payload_safety": """SELECT event_id, event_id % 5 = 0 AS secret, CASE event_id % 5 WHEN 1 THEN '{"object-uri":"[redacted]","n":"1"}' WHEN 2 THEN '{"where":"[redacted]","n":"2"}' WHEN 3 THEN '{"outer":{"Prompt-1":"[redacted]","list":[{"messages":"[redacted]","n":1.5},"[redacted]",' || replace(props, ' ', '') || ']}}' WHEN 4 THEN replace(props, ' ', '') END AS shown FROM events""",
    "aggregate_triggers": f"""WITH {SQL['jobs']}, j AS (SELECT job_id % 5000 AS document, CASE WHEN job_id = max(job_id) OVER (PARTITION BY job_id % 5000) THEN 'succeeded' ELSE status END AS status FROM jobs)
    SELECT document, count(*) FILTER (WHERE status = 'succeeded') AS done, count(*) AS regions, round(count(*) FILTER (WHERE status = 'succeeded') / count(*), 4)::DOUBLE AS coverage, count(*) FILTER (WHERE status = 'succeeded') < count(*) AS needs_review FROM j GROUP BY 1 HAVING count(*) FILTER (WHERE status IN ('queued', 'running')) = 0""",
    "analysis_intake": """WITH g AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag = 'N') AS a, count(*) FILTER (WHERE l_returnflag = 'N' AND l_partkey % 5 <> 0) AS e, count(*) FILTER (WHERE l_returnflag = 'R') AS p FROM lineitem GROUP BY 1)
    SELECT id, CASE WHEN a > 0 THEN round(e / a, 4) END::DOUBLE AS coverage, CASE WHEN a > 0 AND e / a >= 0.8 THEN 'truth' WHEN a > 0 OR p > 0 THEN 'review' ELSE 'debug' END AS surface FROM g""",
}
