"""Queries of state tables, files, table grids, saved queries and leases."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import claims, filters, grids, ledger, merges, reports, saved_queries
from foliospark.plans.search_queries import DOCS, HOUSEHOLD, READABLE, USER, _beside, ranking_eval
from foliospark.sources import files
from foliospark.sources.tables import SQL, documents, due_days, folders, jobs, relations, table, tags


def _metadata(*pairs):
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("string") for _, v in pairs]))


def deadline_upsert(s, d):
    """Deadlines of documents, and a second finding of some of them."""
    x = due_days(documents(s, d)).withColumnRenamed("id", "document")
    stored = x.withColumns({"confidence": (F.col("document") % 10) / 10.0, "evidence": F.lit("old"), "metadata": _metadata(("source", F.lit("first")), ("page", F.col("document") % 4))})
    new = x.filter("document % 2 = 0").withColumns({"status": F.lit("open"), "confidence": F.lit(0.5), "evidence": F.lit("new"), "metadata": _metadata(("source", F.lit("second")), ("run", F.col("document")))})
    out = merges.upsert_deadlines(stored, new.select(*stored.columns))
    return out.select("document", "kind", "due", "status", F.round("confidence", 4).alias("confidence"), "evidence", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))).alias("metadata"))


def open_tasks(s, d):
    docs = documents(s, d)
    stored = docs.filter("id % 3 = 0").select(F.col("id").alias("document"), F.lit("review").alias("kind"), F.when(F.col("id") % 2 == 0, "open").otherwise("done").alias("status"))
    new = docs.filter("id % 4 = 0").select(F.col("id").alias("document"), F.lit("review").alias("kind"), F.lit("open").alias("status"))
    return merges.insert_missing(stored, new, "document", "kind")


def _contacts(s, d):
    c = table(s, d, "customer")
    contacts = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, _metadata(("nation", F.col("c_nationkey")), ("seg", F.col("c_mktsegment")))).otherwise(_metadata(("nation", F.col("c_nationkey")))).alias("identifiers"))
    alias = c.select(F.col("c_custkey").alias("id"), F.explode(F.array("c_mktsegment", F.lower("c_mktsegment"))).alias("alias"))
    links = table(s, d, "orders").select((F.col("o_orderkey") % 500).alias("document"), F.col("o_custkey").alias("id"))
    mapping = c.filter("c_custkey % 7 = 3").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 3).alias("into"))
    return merges.merge_contacts(contacts, alias, links, mapping)


def contact_state(s, d):
    kept, alias, links = _contacts(s, d)
    a, n = alias.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.lower("alias"))), "|").alias("aliases")), links.groupBy("id").agg(F.count("*").alias("documents"))
    return kept.join(a, "id", "left").join(n, "id", "left").select("id", "name", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("identifiers")))).alias("identifiers"), "aliases", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


def versions(s, d):
    docs = documents(s, d).select("id", "text", "n_chars")
    stored = docs.filter("id % 3 <> 0").select("id", F.sha2(F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.lit("older")).cast("binary"), 256).alias("sha"), F.lit(4).alias("version"), F.lit(True).alias("is_active"))
    stored = stored.unionByName(stored.select("id", F.lit("0").alias("sha"), F.lit(3).alias("version"), F.lit(False).alias("is_active")))
    return merges.supersede(stored, docs.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "id")


def json_patches(s, d):
    e = table(s, d, "events")
    patch = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), F.col("user_id").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.lit('{"a": "x", "z": [1, 2]}')).otherwise(F.lit("{}"))
    return e.select("event_id", merges.patch_json(F.col("props"), patch).alias("props"))


def tag_replacement(s, d):
    docs = documents(s, d)
    stored = tags(docs).select(F.col("id").alias("document"), F.col("tag").alias("name"))
    new = docs.filter("id % 4 = 0").select(F.col("id").alias("document"), F.explode(F.array(F.lit("new"), F.lit("new"), "folder")).alias("name"))
    return merges.replace_members(stored, new, docs.filter("id % 4 = 0").select(F.col("id").alias("document")))


def filing(s, d):
    docs = documents(s, d).select(F.col("id").alias("document"), F.col("folder").alias("primary_folder"), F.when(F.col("id") % 2 == 0, F.col("document_date")).alias("filed_at"))
    return merges.filed(docs, docs.filter("document % 3 = 0").select("document", F.lit("archive").alias("folder")), F.lit("2025-01-01").cast("date"))


def stale_groups(s, d):
    """Orders whose lines are not those of the stored aggregate: some got a line since."""
    li = table(s, d, "lineitem").select("l_orderkey", F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("line"))
    nothing = s.createDataFrame([], "l_orderkey long, fingerprint string")
    before = merges.changed_groups(nothing, li.filter("NOT (l_orderkey % 5 = 0 AND line LIKE '1/%')"), "l_orderkey", "line")
    return merges.changed_groups(before, li, "l_orderkey", "line").select("l_orderkey")


def suggestion_state(s, d):
    e = table(s, d, "events")
    x = documents(s, d).select("id", F.when(F.col("id") % 3 == 0, "accepted").otherwise("pending").alias("status"))
    decisions = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "view", "reject").otherwise("defer").alias("decision"))
    return merges.decided(x, decisions)


def edge_merge(s, d):
    """Stored relationships meet new ones that come the other way round, of every status."""
    r = relations(documents(s, d)).withColumn("evidence", F.array(F.lit("old")))
    status = F.when(F.col("a") % 9 == 0, "rejected").when(F.col("a") % 9 == 3, "confirmed").otherwise("suggested")
    again = r.filter("a % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), "kind", status.alias("status"), F.when(F.col("a") % 2 == 0, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return files.merge_edges(r, again).select("a", "b", "kind", "status", F.array_join("evidence", "|").alias("evidence"))


def field_upsert(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.lower("l_returnflag").alias("path"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("at"), F.col("l_partkey").alias("value"))
    old = li.filter("value % 2 = 0").withColumn("at", F.col("at"))
    return files.upsert(old, li.filter("value % 2 = 1"), "document", "path", order="at").select("document", "path", "value")


# files and grids


def file_descriptions(s, d):
    """Pages as files: type by first bytes, hash, address, title."""
    k = F.col("page_id") % 6
    magic = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.unhex(F.lit("FFD8FFE000"))).when(k == 2, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 3, F.unhex(F.lit("524946460000000057454250"))).when(k == 4, F.unhex(F.lit("4D4D002A"))).otherwise(F.lit("").cast("binary"))
    path = F.concat(F.lit("/in/my_scan-of_page "), F.col("page_id").cast("string"), F.lit(".PDF"))
    rows = table(s, d, "pages").select(path.alias("path"), F.concat(magic, F.col("html").cast("binary")).alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return files.described(rows).withColumn("ok", files.address_ok(F.col("uri")))


def _table_rows(s, d):
    """Orders as markdown tables with four columns, a separator and a totals row."""
    li = table(s, d, "lineitem")
    row = F.concat(F.lit("| part "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | $"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" |"))
    rows = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("r")))).alias("rs"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("sum"))
    return rows.select("id", F.concat_ws("\n", F.lit("| Item | Qty | Amount |"), F.lit("|---|:-:|---|"), F.array_join(F.transform("rs", lambda x: x["r"]), "\n"), F.concat(F.lit("| Total due |  | "), F.col("sum").cast("string"), F.lit(" |"))).alias("markdown"))


def _cells(s, d):
    rows = grids.markdown_rows(_table_rows(s, d))
    return rows.select("id", "row", F.posexplode("cells").alias("col", "text"), (F.col("row") == 0).alias("column_header"))


def saved_query_rows(s, d):
    """The documents of a saved query as JSON."""
    values = saved_queries.parse('{"families": ["EN", "en", "de"], "reviewStatuses": ["auto_accepted"], "open_review_tasks": true, "dateFrom": "2024-03-01", "tags": ["long"], "has_relationships": null}'.replace('"has_relationships": null', '"hasRelationships": true'))
    wanted = saved_queries.to_filters(values | {"families": tuple(x.lower() for x in values["families"])})
    return wanted.apply(documents(s, d), _beside(s, d)).select("id")


def folder_contents(s, d):
    """A smart folder: its saved query and the list's own filter at once."""
    smart = filters.Filters(families=("en", "fr"), date_from="2024-02-01", chars_min=100)
    both = smart.intersect(filters.Filters(families=("en", "de"), date_to="2024-06-30", chars_min=50, folders=("src1", "src2", "src3")))
    return both.apply(documents(s, d)).select("id")


def system_tags(s, d):
    """Seed rows, and which of them documents use."""
    seed = s.createDataFrame([(i, t) for i, t in enumerate(("important", "long", "tax", "medical", "legal", "warranty", "receipt", "archive"))], "position int, tag string")
    used = tags(documents(s, d)).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("documents"))
    return seed.join(used, "tag", "left").select("position", "tag", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


def maintenance(s, d):
    """Jobs appended to the ledger: parse and preview of documents without a chunk, a new projection of the others."""
    docs = documents(s, d)
    blank = docs.filter(F.trim("text") == "").select("id", F.explode(F.array(F.lit("parse"), F.lit("preview"))).alias("job_type"))
    other = docs.filter("trim(text) <> ''").select("id", F.lit("project").alias("job_type"))
    return blank.unionByName(other).withColumn("status", F.lit("queued"))


def lease_sweep(s, d):
    """Running jobs after the recovery of leases, which last an hour."""
    held = jobs(s, d).filter("status = 'running'").withColumn("lease_until", F.col("scheduled_at") + F.expr("INTERVAL 1 HOUR"))
    swept = ledger.recovered(held, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return swept.select("job_id", "status", F.unix_timestamp("scheduled_at").alias("scheduled"), F.col("lease_until").isNotNull().alias("held"))


def upload_ingest(s, d):
    """Uploads against what is stored: the oldest of the same content and household is the duplicate's original; new ones get three jobs."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).alias("household"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("n_chars").alias("created_at"))
    x = files.duplicates_of(docs.filter("id % 3 = 0"), docs.filter("id % 3 <> 0"))
    return x.select("id", F.coalesce("duplicate_of", F.lit(-1).cast("long")).alias("duplicate_of"), F.explode(F.when(F.col("duplicate_of").isNull(), F.array(F.lit("parse"), F.lit("preview"), F.lit("embed"))).otherwise(F.array(F.lit("none")))).alias("job_type"))


def visual_eligible(s, d):
    """Pages whose quality summary says so, nested in JSON; absent is no."""
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"phase8": {"quality": {"visual": '), (F.col("user_id") % 2 == 0).cast("string"), F.lit("}}}"))).when(F.col("event_id") % 4 == 1, F.lit('{"phase8": {}}')).otherwise(F.col("props")).alias("j"))
    return e.select("event_id", F.coalesce(F.expr("try_variant_get(parse_json(j), '$.phase8.quality.visual', 'boolean')"), F.lit(False)).alias("eligible"))


def writable_documents(s, d):
    docs = documents(s, d)
    seen = filters.readable(docs, folders(docs), USER, HOUSEHOLD)
    return filters.writable(seen, USER).select("id", F.lit("owner").alias("why")).unionByName(filters.writable(filters.readable(docs, folders(docs), USER, HOUSEHOLD, "admin"), USER, "admin").select("id", F.lit("admin").alias("why")))


def embedding_sources(s, d):
    """What is embedded of a live document: its projection, else its text; never what is blank."""
    docs = documents(s, d).filter("NOT deleted")
    text = F.coalesce(F.nullif(F.when(F.col("id") % 3 == 0, F.concat("folder", F.lit(" "), "text")).when(F.col("id") % 3 == 1, F.lit("")), F.lit("")), "text", F.lit(""))
    return docs.select("id", text.alias("source")).filter(F.trim("source") != "").select("id", F.sha2(F.col("source").cast("binary"), 256).alias("sha"))


def saved_searches(s, d):
    """Searches by household and name, whatever its case: the last wins; the newest hundred."""
    e = table(s, d, "events").select((F.col("user_id") % 3).alias("household"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat("event_type", (F.col("user_id") % 30).cast("string"))).alias("name"), F.col("event_id").alias("at"), F.col("props").alias("query"))
    last = e.groupBy("household", F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "query", "at"), "at").alias("l"))
    return last.select("household", "l.name", "l.query", "l.at").orderBy(F.desc("at")).limit(100)


def ranking_summary(s, d):
    """Mean hit and reciprocal rank of the golden cases against their thresholds; no cases give zeros."""
    m = ranking_eval(s, d).agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"))
    rows = m.select(F.explode(F.array(F.struct(F.lit("hitRateAtK").alias("metric"), F.col("hit").alias("value")), F.struct(F.lit("meanReciprocalRank").alias("metric"), F.col("mrr").alias("value")))).alias("x")).select("x.metric", F.round("x.value", 6).alias("value"))
    return ledger.gate(rows, s.createDataFrame([("hitRateAtK", "min", 1.0), ("meanReciprocalRank", "min", 0.75)], "metric string, direction string, threshold double"))


def report_rows(s, d):
    """Rows of a report as JSON: dates and amounts as text, nothing for nulls."""
    o = table(s, d, "orders")
    return o.select("o_orderkey", F.to_json(F.struct(F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"))).alias("json"))


def best_evidence(s, d):
    li = table(s, d, "lineitem")
    refs = li.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("rank"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_linenumber")).alias("row_index"), F.when(F.col("l_partkey") % 3 == 0, F.lit("e")).alias("element_id"), F.when(F.col("l_suppkey") % 2 == 0, 1).alias("page_number"))
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return grids.best_evidence(refs).select("id", "rank", none("row_index"), "element_id", none("page_number"))


def audit_trail(s, d):
    """The audit with the events of a change appended: one a changed document, and its time of change."""
    docs = documents(s, d)
    old = docs.select(F.col("id").alias("document"), F.lit("created").alias("event"), F.col("document_date").alias("at"))
    changed = filing(s, d).join(docs.select(F.col("id").alias("document"), "folder"), "document").filter("primary_folder <> folder")
    return old.unionByName(changed.select("document", F.lit("filed").alias("event"), F.lit("2025-01-01").cast("date").alias("at")))


def region_projection(s, d):
    """Claims of order lines by region, with those that fit its family and the regions that are skipped, counted."""
    li = table(s, d, "lineitem")
    path = F.when(F.col("l_partkey") % 3 == 0, "invoice.total").when(F.col("l_partkey") % 3 == 1, "receipt.total").otherwise("loan_number")
    given = li.filter("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("region"), path.alias("path"))
    i = F.col("o_orderkey")
    regions = table(s, d, "orders").select(i.alias("region"), F.when(i % 5 == 0, "document_observation").when(i % 2 == 0, "invoice").otherwise("receipt").alias("family"))
    fit, skipped = claims.projected(given, regions)
    return fit.groupBy("region").agg(F.count("*").alias("claims")).select("region", F.lit("projected").alias("outcome"), "claims").unionByName(skipped.select("region", F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("claims")))


def changed_rows(s, d):
    docs = documents(s, d)
    stored = docs.select("id", "folder", "family", F.lit("2024-01-01").cast("date").alias("updated_at"))
    new = docs.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "moved").otherwise(F.col("folder")).alias("folder"), "family")
    return merges.touched(stored, new, "id", F.lit("2025-01-01").cast("date"))


def extraction_runs(s, d):
    li = table(s, d, "lineitem").select((F.col("l_orderkey") % 400).alias("document"), F.lower("l_returnflag").alias("schema"), F.lit("region").alias("scope"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("long")).alias("region"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("run"))
    old = li.filter("document % 3 <> 0").withColumn("is_current", F.lit(True))
    out = merges.persisted(old, li.filter("document % 5 = 0 AND schema = 'a'"))
    return out.groupBy("document", "schema", "is_current").agg(F.count("*").alias("runs"))


def corpus_manifest(s, d):
    t = table(s, d, "events").groupBy(F.col("event_type").alias("section")).agg(F.max("event_id").cast("string").alias("run_id"))
    m = table(s, d, "events").groupBy(F.lit("value").alias("metric"), F.col("event_type").alias("leaf")).agg(F.round(F.avg("value"), 6).alias("value"))
    return reports.manifest_checks(t, ("click", "view", "planning"), m, s.createDataFrame([("value", "min", 0.0), ("value2", "max", 1.0)], "metric string, direction string, threshold double"))


QUERIES = {
    "deadline_upsert": deadline_upsert, "open_tasks": open_tasks, "contact_state": contact_state, "versions": versions, "json_patches": json_patches, "tag_replacement": tag_replacement, "filing": filing, "stale_groups": stale_groups, "suggestion_state": suggestion_state,
    "edge_merge": edge_merge, "field_upsert": field_upsert, "file_descriptions": file_descriptions,
    "grid_rows": lambda s, d: grids.markdown_rows(_table_rows(s, d)).select("id", "row", F.array_join("cells", "~").alias("cells")),
    "grid_line_items": lambda s, d: grids.line_items(_cells(s, d)).select("id", "row", "kind", "description", "quantity", "amount"),
    "grid_quality": lambda s, d: grids.quality(_cells(s, d)),
    "grid_fingerprints": lambda s, d: grids.fingerprint(_cells(s, d)),
    "saved_query_rows": saved_query_rows, "folder_contents": folder_contents, "system_tags": system_tags, "maintenance": maintenance, "lease_sweep": lease_sweep,
    "upload_ingest": upload_ingest, "visual_eligible": visual_eligible, "writable_documents": writable_documents, "embedding_sources": embedding_sources, "saved_searches": saved_searches, "ranking_summary": ranking_summary, "report_rows": report_rows, "best_evidence": best_evidence, "audit_trail": audit_trail,
    "region_projection": region_projection, "changed_rows": changed_rows, "extraction_runs": extraction_runs, "corpus_manifest": corpus_manifest, "writable_folders": lambda s, d: filters.writable_folders(folders(documents(s, d)), USER),
}

_MD = r"""WITH m AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, '| part ' || l_partkey || ' | ' || CAST(l_quantity AS INT) || ' | $' || CAST(l_extendedprice AS DECIMAL(18,2)) || ' |') AS n FROM lineitem), t AS (SELECT id, count(*) AS c, sum(p) AS total FROM m GROUP BY 1)"""

ORACLES = {
    "deadline_upsert": f"""{DOCS}, {SQL['due_days']}, x AS (SELECT id AS document, kind, CAST(due AS VARCHAR) AS due, status, status IN ('open', 'due_soon', 'overdue', 'needs_review') AS o, id % 2 = 0 AS again, (id % 10) / 10.0 AS c FROM due_days)
    SELECT document, kind, due, CASE WHEN again THEN 'open' ELSE status END AS status, round(CASE WHEN again THEN greatest(c, 0.5) ELSE c END, 4)::DOUBLE AS confidence, CASE WHEN again THEN 'new' ELSE 'old' END AS evidence, CASE WHEN again THEN '{{"page":"' || (document % 4) || '","run":"' || document || '","source":"second"}}' ELSE '{{"page":"' || (document % 4) || '","source":"first"}}' END AS metadata FROM x WHERE o
    UNION ALL SELECT document, kind, due, status, round(c, 4), 'old', '{{"page":"' || (document % 4) || '","source":"first"}}' FROM x WHERE NOT o UNION ALL SELECT document, kind, due, 'open', 0.5, 'new', '{{"run":"' || document || '","source":"second"}}' FROM x WHERE NOT o AND again""",
    "open_tasks": f"{DOCS} SELECT id AS document, 'review' AS kind, CASE WHEN id % 2 = 0 THEN 'open' ELSE 'done' END AS status FROM docs WHERE id % 3 = 0 UNION ALL SELECT id, 'review', 'open' FROM docs WHERE id % 4 = 0 AND id % 3 <> 0",
    "contact_state": """WITH m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 3 THEN c_custkey - 3 ELSE c_custkey END AS into_, c_name, c_nationkey, c_mktsegment FROM customer), k AS (SELECT * FROM m WHERE id = into_),
    al AS (SELECT into_, lower(c_mktsegment) AS a FROM m UNION SELECT into_, lower(c_name) FROM m WHERE id <> into_), ag AS (SELECT into_, string_agg(a, '|' ORDER BY a) AS aliases FROM al GROUP BY 1),
    sg AS (SELECT into_, min(c_mktsegment) FILTER (WHERE id % 5 = 0) AS seg, max(CASE WHEN id = into_ AND id % 5 = 0 THEN c_mktsegment END) AS own FROM m GROUP BY 1), ln AS (SELECT into_, count(DISTINCT o_orderkey % 500) AS n FROM orders JOIN m ON o_custkey = id GROUP BY 1)
    SELECT k.id, c_name AS name, '{"nation":"' || c_nationkey || '"' || CASE WHEN seg IS NULL THEN '' ELSE ',"seg":"' || coalesce(own, seg) || '"' END || '}' AS identifiers, aliases, coalesce(n, 0) AS documents FROM k LEFT JOIN ag ON ag.into_ = k.id LEFT JOIN sg ON sg.into_ = k.id LEFT JOIN ln ON ln.into_ = k.id""",
    "versions": f"""{DOCS} SELECT id, CASE WHEN id % 2 = 0 THEN sha256(text) ELSE sha256('older') END AS sha, 4 AS version, id % 2 = 0 AS is_active FROM docs WHERE id % 3 <> 0 UNION ALL SELECT id, '0', 3, false FROM docs WHERE id % 3 <> 0 UNION ALL SELECT id, sha256(text), CASE WHEN id % 3 = 0 THEN 1 ELSE 5 END, true FROM docs WHERE id % 3 = 0 OR id % 2 = 1""",
    "json_patches": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k":' || user_id || '}' WHEN 1 THEN '{"a":"x","k":' || regexp_extract(props, '[0-9]+') || ',"z":[1,2]}' ELSE '{"k":' || regexp_extract(props, '[0-9]+') || '}' END AS props FROM events""",
    "tag_replacement": f"{DOCS}, {SQL['tags']} SELECT id AS document, tag AS name FROM tags WHERE id % 4 <> 0 UNION ALL SELECT id, 'new' FROM docs WHERE id % 4 = 0 UNION ALL SELECT id, folder FROM docs WHERE id % 4 = 0",
    "filing": f"{DOCS} SELECT id AS document, CASE WHEN id % 3 = 0 THEN 'archive' ELSE folder END AS primary_folder, CAST(CASE WHEN id % 2 = 0 THEN document_date WHEN id % 3 = 0 THEN DATE '2025-01-01' END AS VARCHAR) AS filed_at FROM docs",
    "stale_groups": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1",
    "suggestion_state": f"""{DOCS}, l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1) SELECT docs.id, CASE WHEN docs.id % 3 = 0 THEN 'accepted' WHEN t IS NULL THEN 'pending' WHEN t = 'click' THEN 'accepted' WHEN t = 'view' THEN 'rejected' ELSE 'deferred' END AS status FROM docs LEFT JOIN l USING (id)""",
    "edge_merge": f"""{DOCS}, {SQL['relations']}, n AS (SELECT a AS x, b AS y, kind AS k, CASE a % 9 WHEN 0 THEN 'rejected' WHEN 3 THEN 'confirmed' ELSE 'suggested' END AS now, CASE a % 2 WHEN 0 THEN 'new' ELSE '' END AS proof FROM relations WHERE a % 3 = 0),
    m AS (SELECT * FROM relations LEFT JOIN n ON status <> 'rejected' AND a = x AND b = y AND kind = k)
    SELECT a, b, kind, CASE WHEN now IS NULL OR (status = 'confirmed' AND now = 'suggested') THEN status ELSE now END AS status, CASE WHEN proof = 'new' AND NOT (status = 'confirmed' AND now = 'suggested') THEN 'new' ELSE 'old' END AS evidence FROM m
    UNION ALL SELECT y, x, k, now, proof FROM n WHERE NOT EXISTS (SELECT 1 FROM relations WHERE status <> 'rejected' AND a = x AND b = y AND kind = k)""",
    "field_upsert": """WITH x AS (SELECT l_orderkey AS document, lower(l_returnflag) AS path, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS at_, l_partkey AS value FROM lineitem) SELECT document, path, value FROM x QUALIFY row_number() OVER (PARTITION BY document, path ORDER BY value % 2 DESC, at_ DESC) = 1""",
    "file_descriptions": r"""WITH f AS (SELECT page_id, [unhex('255044462D312E37'), unhex('FFD8FFE000'), unhex('89504E470D0A1A0A00'), unhex('524946460000000057454250'), unhex('4D4D002A'), ''::BLOB][page_id % 6 + 1] || encode(html) AS c FROM pages), h AS (SELECT page_id, sha256(c) AS sha, octet_length(c) AS length FROM f)
    SELECT '/in/my_scan-of_page ' || page_id || '.PDF' AS path, sha, ['application/pdf', 'image/jpeg', 'image/png', 'image/webp', 'image/tiff', NULL][page_id % 6 + 1] AS mime, 'My Scan Of Page ' || page_id AS title, 'filesystem://original/sha256/' || left(sha, 2) || '/' || substr(sha, 3, 2) || '/' || sha || '/original.blob' AS uri, length, true AS ok FROM h""",
    "grid_rows": _MD + " SELECT id, CAST(0 AS INT) AS row, 'Item~Qty~Amount' AS cells FROM t UNION ALL SELECT id, CAST(n AS INT), 'part ' || l_partkey || '~' || q || '~$' || p FROM m UNION ALL SELECT id, CAST(c + 1 AS INT), 'Total due~~' || total FROM t",
    "grid_line_items": _MD + " SELECT id, CAST(n AS INT) AS row, 'item' AS kind, 'part ' || l_partkey AS description, CAST(q AS VARCHAR) AS quantity, '$' || p AS amount FROM m UNION ALL SELECT id, CAST(c + 1 AS INT), 'total', 'Total due', NULL, CAST(total AS VARCHAR) FROM t",
    "grid_quality": _MD + " SELECT id, round(0.25 * least(1, (c + 2) / 4.0) + 0.20 * 0.75 + 0.25 * (3 * (c + 2) - 1) / (3.0 * (c + 2)) + 0.15 + 0.10, 4)::DOUBLE AS score FROM t",
    "grid_fingerprints": _MD + " SELECT id, sha256('item|qty|amount') AS fingerprint FROM t",
    "saved_query_rows": f"{DOCS}, {SQL['relations']} SELECT id FROM docs WHERE family IN ('en', 'de') AND review_status IN ('auto_accepted', 'needs_review') AND document_date >= DATE '2024-03-01' AND n_chars > 2000 AND id IN (SELECT a FROM relations WHERE status <> 'rejected' UNION SELECT b FROM relations WHERE status <> 'rejected')",
    "folder_contents": f"{DOCS} SELECT id FROM docs WHERE family = 'en' AND document_date BETWEEN DATE '2024-02-01' AND DATE '2024-06-30' AND n_chars >= 100 AND folder IN ('src1', 'src2', 'src3')",
    "system_tags": f"{DOCS}, {SQL['tags']} SELECT CAST(i - 1 AS INT) AS position, t AS tag, (SELECT count(*) FROM tags WHERE lower(tag) = t) AS documents FROM (SELECT unnest(range(1, 9)) AS i, unnest(['important', 'long', 'tax', 'medical', 'legal', 'warranty', 'receipt', 'archive']) AS t)",
    "maintenance": f"{DOCS} SELECT id, unnest(['parse', 'preview']) AS job_type, 'queued' AS status FROM docs WHERE trim(text) = '' UNION ALL SELECT id, 'project', 'queued' FROM docs WHERE trim(text) <> ''",
    "lease_sweep": f"""WITH {SQL['jobs']}, x AS (SELECT *, scheduled_at + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-31 00:00:00' AS over FROM jobs WHERE status = 'running')
    SELECT job_id, CASE WHEN NOT over THEN 'running' WHEN attempts >= max_attempts THEN 'dead_letter' ELSE 'failed' END AS status, CAST(floor(epoch(CASE WHEN over AND attempts < max_attempts THEN TIMESTAMP '2024-01-31 00:00:00' ELSE scheduled_at END)) AS BIGINT) AS scheduled, NOT over AS held FROM x""",
    "upload_ingest": """WITH x AS (SELECT doc_id AS id, doc_id % 2 AS h, sha256(text) AS sha, n_chars FROM documents), o AS (SELECT h, sha, arg_min(id, n_chars * 100000000 + id) AS dup FROM x WHERE id % 3 <> 0 GROUP BY ALL), y AS (SELECT id, dup FROM x LEFT JOIN o USING (h, sha) WHERE id % 3 = 0)
    SELECT id, coalesce(dup, -1) AS duplicate_of, unnest(CASE WHEN dup IS NULL THEN ['parse', 'preview', 'embed'] ELSE ['none'] END) AS job_type FROM y""",
    "visual_eligible": "SELECT event_id, event_id % 4 = 0 AND user_id % 2 = 0 AS eligible FROM events",
    "writable_documents": f"{DOCS}, {READABLE} SELECT id, 'owner' AS why FROM r WHERE owner_id = {USER} UNION ALL SELECT id, 'admin' FROM docs WHERE NOT deleted AND household = {HOUSEHOLD}",
    "embedding_sources": f"{DOCS}, x AS (SELECT id, CASE WHEN id % 3 = 0 THEN folder || ' ' || text ELSE text END AS source FROM docs WHERE NOT deleted) SELECT id, sha256(source) AS sha FROM x WHERE trim(source) <> ''",
    "saved_searches": "WITH e AS (SELECT user_id % 3 AS household, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type || (user_id % 30) END AS name, event_id AS at_, props AS query FROM events) SELECT household, name, query, at_ AS \"at\" FROM e QUALIFY row_number() OVER (PARTITION BY household, lower(name) ORDER BY at_ DESC) = 1 ORDER BY at_ DESC LIMIT 100",
    "ranking_summary": """WITH c AS (SELECT item_id AS id, [item_id + item_id % 3, item_id - 1, item_id] AS ret FROM benchmark), m AS (SELECT avg(CASE WHEN list_position(ret, id) > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(coalesce(round(1.0 / nullif(list_position(ret, id), 0), 6), 0.0)) AS mrr FROM c)
    SELECT unnest(['hitRateAtK', 'meanReciprocalRank']) AS metric, unnest([round(hit, 6), round(mrr, 6)])::DOUBLE AS value, unnest([1.0, 0.75])::DOUBLE AS threshold, unnest([hit >= 1.0, mrr >= 0.75]) AS passed FROM m""",
    "report_rows": """SELECT o_orderkey, '{"day":"' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '","amount":"' || CAST(o_totalprice AS DECIMAL(18,2)) || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"priority":"' || o_orderpriority || '"' ELSE '' END || '}' AS json FROM orders""",
    "best_evidence": """WITH x AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS rank, CASE WHEN l_partkey % 5 = 0 THEN l_linenumber END AS row_index, CASE WHEN l_partkey % 3 = 0 THEN 'e' END AS element_id, CASE WHEN l_suppkey % 2 = 0 THEN 1 END AS page_number FROM lineitem)
    SELECT id, rank, coalesce(row_index, -1) AS row_index, element_id, coalesce(page_number, -1) AS page_number FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN x.row_index IS NOT NULL THEN 0 WHEN element_id IS NOT NULL THEN 1 WHEN x.page_number IS NOT NULL THEN 2 ELSE 3 END, rank) = 1""",
    "audit_trail": f"{DOCS} SELECT id AS document, 'created' AS event, CAST(document_date AS VARCHAR) AS \"at\" FROM docs UNION ALL SELECT id, 'filed', '2025-01-01' FROM docs WHERE id % 3 = 0",
    "region_projection": """WITH r AS (SELECT o_orderkey AS region, CASE WHEN o_orderkey % 5 = 0 THEN 'o' WHEN o_orderkey % 2 = 0 THEN 'invoice' ELSE 'receipt' END AS family FROM orders), c AS (SELECT l_orderkey AS region, ['invoice', 'receipt', ''][l_partkey % 3 + 1] AS f FROM lineitem WHERE l_orderkey % 11 <> 0),
    n AS (SELECT r.region, count(f) AS a, count(*) FILTER (WHERE family = 'o' AND f IS NOT NULL OR f = family) AS k FROM r LEFT JOIN c USING (region) GROUP BY 1) SELECT region, CASE WHEN a = 0 THEN 'missing_claims' WHEN k = 0 THEN 'aggregate_incompatible_source_family' ELSE 'projected' END AS outcome, k AS claims FROM n""",
    "changed_rows": f"{DOCS} SELECT id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE folder END AS folder, family, CASE WHEN id % 4 = 0 THEN '2025-01-01' ELSE '2024-01-01' END AS updated_at FROM docs",
    "extraction_runs": """WITH l AS (SELECT l_orderkey % 400 AS document, lower(l_returnflag) AS schema, CASE WHEN l_linenumber > 1 THEN l_linenumber ELSE 0 END AS region FROM lineitem), n AS (SELECT * FROM l WHERE document % 5 = 0 AND schema = 'a'),
    u AS (SELECT document, schema, (document, schema, region) NOT IN (SELECT (document, schema, region) FROM n) AS is_current FROM l WHERE document % 3 <> 0 UNION ALL SELECT document, schema, true FROM n) SELECT document, schema, is_current, count(*) AS runs FROM u GROUP BY ALL""",
    "corpus_manifest": """SELECT unnest(['evidence.click', 'evidence.view', 'evidence.planning', 'metric.value', 'metric.value2']) AS "check", unnest([(SELECT count(*) > 0 FROM events WHERE event_type = 'click'), (SELECT count(*) > 0 FROM events WHERE event_type = 'view'), (SELECT count(*) > 0 FROM events WHERE event_type = 'planning'), (SELECT min(m) >= 0 FROM (SELECT avg(value) AS m FROM events GROUP BY event_type)), false]) AS passed""",
    "writable_folders": f"{DOCS} SELECT folder FROM folders WHERE shared OR folder_owner = {USER} OR list_contains(writers, {USER})",
}
