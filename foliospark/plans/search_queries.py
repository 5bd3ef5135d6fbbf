"""Queries over the document collection: access, filters, facets, rankings."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import ann, filters, search
from foliospark.sources.state import new_path, stamp
from foliospark.sources.tables import SQL, documents, due_days, folders, relations, table, tags, totals

USER, HOUSEHOLD = 3, 1
TERMS = ["idiot", "moron", "trash"]
FILTER = filters.Filters(families=("en", "de"), reviewed_only=True, date_from="2024-02-01", date_to="2024-10-31", chars_min=200)
DOCS = f"WITH {SQL['docs']}, {SQL['folders']} "
READABLE = f"""r AS (SELECT d.* FROM docs d LEFT JOIN folders f ON d.folder = f.folder WHERE NOT deleted AND household = {HOUSEHOLD} AND (owner_id = {USER} OR (acl_mode = 'household' AND sensitivity <> 'highly_sensitive' AND f.folder IS NOT NULL AND (shared OR folder_owner = {USER} OR list_contains(grants, {USER})))))"""
FILTER_SQL = "family IN ('en', 'de') AND review_status IN ('auto_accepted', 'user_confirmed', 'user_corrected') AND document_date BETWEEN DATE '2024-02-01' AND DATE '2024-10-31' AND n_chars >= 200"
BESIDE = f"{DOCS}, {READABLE}, {SQL['tags']}, {SQL['relations']}, {SQL['due_days']}, {SQL['totals']}"
EDGES = "both_ends AS (SELECT a AS id, b AS other, kind, status FROM relations UNION ALL SELECT b, a, kind, status FROM relations)"


def _readable(spark, d):
    docs = documents(spark, d)
    return filters.readable(docs, folders(docs), USER, HOUSEHOLD)


def _beside(spark, d, visible=None):
    docs = documents(spark, d)
    return filters.Related(tags=tags(docs), totals=totals(spark, d), edges=relations(docs), deadlines=due_days(docs), visible=visible)


def chunks(spark, d):
    """One chunk per non-blank line, numbered densely."""
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return doc.select("id", F.posexplode("lines").alias("chunk", "text"))


CHUNKS = "ch AS (SELECT doc_id AS id, unnest(range(0, len(ls))) AS chunk, unnest(ls) AS text FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents))"


_INDEXES: dict[tuple[str, str], search.LexicalIndex] = {}


def _state(spark, d, name):
    """What an index of a table is kept under: it is built anew once the table's files change."""
    return spark.sparkContext.applicationId, stamp(spark, f"{d}/{name}.parquet")


def lexical_index(spark, d):
    """The index of a collection's chunks; built once a session and state of the table, in the shared folder."""
    key = _state(spark, d, "documents")
    if key not in _INDEXES:
        path = new_path(spark, "lexical")
        search.build_index(chunks(spark, d), path)
        _INDEXES[key] = search.open_index(spark, path)
    return _INDEXES[key]


def _bm25_sql(limit: int, allowed: str = "true") -> str:
    n = range(len(TERMS))
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END" for i in n)
    return f"""{CHUNKS}, tk AS (SELECT id, chunk, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ch),
    ct AS (SELECT id, chunk, len(t) AS dl, {tf} FROM tk),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE tf{i} > 0) AS df{i}' for i in n)} FROM ct),
    sc AS (SELECT id, chunk, {score} AS score FROM ct, st WHERE ({' OR '.join(f'tf{i} > 0' for i in n)}) AND {allowed}),
    lexical AS (SELECT id, CAST(chunk AS INT) AS chunk, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY sc.score DESC, id, chunk) AS INT) AS rank FROM sc QUALIFY rank <= {limit})"""


_UNITS: dict[tuple[str, str], str] = {}


def unit_index(spark, d):
    """The unit vectors of a collection; written once a session and state of the table, in the shared folder."""
    key = _state(spark, d, "embeddings")
    if key not in _UNITS:
        path = new_path(spark, "vectors")
        search.unit_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("chunk"), "embedding")).write.parquet(path)
        _UNITS[key] = path
    return spark.read.parquet(_UNITS[key])


def _vectors(spark, d):
    """Unit vectors, and one of the collection's vectors as the query."""
    e = table(spark, d, "embeddings")
    query = e.filter("vec_id = 0").select("embedding").limit(2).collect()  # one row of a query
    if len(query) != 1:
        raise ValueError("the query is one vector")
    return unit_index(spark, d), [float(x) for x in query[0]["embedding"]]


_ANN: dict[tuple[str, str], str] = {}


def ann_index(spark, d):
    """The approximate index of a collection's vectors; written once a session and state of the table, in the shared folder."""
    key = _state(spark, d, "embeddings")
    if key not in _ANN:
        path = new_path(spark, "ann")
        ann.write_index(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("chunk"), "embedding"), path)
        _ANN[key] = path
    return ann.open_index(spark, _ANN[key])


def ann_topk(spark, d):
    """Nearest vectors of the probed lists."""
    return ann.nearest(ann_index(spark, d), _vectors(spark, d)[1], 40)


def ann_exact_topk(spark, d):
    """The same index, all lists."""
    return ann.nearest(ann_index(spark, d), _vectors(spark, d)[1], 40, probes=0)


def ann_recall(spark, d):
    """Recall of the probed lists for vectors of the collection that are asked again."""
    index = ann_index(spark, d)
    return ann.recall(index, index.units.select(F.col("id").alias("query"), "unit").orderBy(F.xxhash64("query")).limit(50))


def _semantic_sql(limit: int) -> str:
    return f"""sv AS (SELECT e.vec_id AS id, 0 AS chunk, round(greatest(0, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 12) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    semantic AS (SELECT id, chunk, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY sv.score DESC, id, chunk) AS INT) AS rank FROM sv QUALIFY rank <= {limit})"""


def bm25_lexical(spark, d):
    return search.bm25(lexical_index(spark, d), TERMS, 40)


def semantic_topk(spark, d):
    v, q = _vectors(spark, d)
    return search.semantic(v, q, 40)


def _sources(spark, d):
    v, q = _vectors(spark, d)
    return {"lexical": lambda n: search.bm25(lexical_index(spark, d), TERMS, n), "semantic": lambda n: search.semantic(v, q, n)}


def hybrid_rrf(spark, d):
    return search.fuse({"lexical": bm25_lexical(spark, d), "semantic": semantic_topk(spark, d)}, 20)


def hybrid_shown(spark, d):
    """The hybrid mode with what is shown of its rows."""
    sources = _sources(spark, d)
    ranked = {"lexical": sources["lexical"](40), "semantic": sources["semantic"](10)}
    texts = chunks(spark, d).withColumn("page", F.when(F.col("chunk") % 2 == 0, F.col("chunk") + 1))
    return search.shown(search.search(sources, "hybrid", 10), ranked, texts)


WANTED = filters.Filters(tags=("important", "LONG"), amount_min=1000.0, relationship_types=("duplicate_of", "receipt_for", "invoice_for"), deadline_types=("due_date", "renewal_date"))
UNRELATED = filters.Filters(has_relationships=False, has_open_deadlines=False)
LINKED = filters.Filters(has_relationships=True, relationship_statuses=("confirmed",), amount_max=200000.0)


def search_filtered(spark, d):
    """Lexical search of what the user may read and the filter admits: nothing else is ranked."""
    seen = _readable(spark, d)
    return search.bm25(lexical_index(spark, d), TERMS, 30, filters.Filters(tags=("en", "important")).apply(seen, _beside(spark, d)).select("id"))


def filtered(wanted):
    def run(spark, d):
        seen = _readable(spark, d)
        return wanted.apply(seen, _beside(spark, d, seen)).select("id")

    return run


def page_vectors(spark, d):
    p = table(spark, d, "pages")
    return search.page_embedding(p.select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"), F.lit("text/html").alias("mime"), F.col("url").alias("descriptor")))


def visual_topk(spark, d):
    v = page_vectors(spark, d).select("id", F.lit(0).alias("chunk"), F.col("vector").alias("embedding"))
    query = v.orderBy("id").limit(1).first()["embedding"]
    return search.semantic(search.unit_vectors(v), list(query), 20)


def composite(spark, d):
    return _readable(spark, d).filter(FILTER.predicate())


def ranking_eval(spark, d):
    b = table(spark, d, "benchmark")
    return search.evaluate(b.select(F.col("item_id").alias("case"), F.array("item_id").alias("expected"), F.array(F.col("item_id") + F.col("item_id") % 3, F.col("item_id") - 1, "item_id").alias("returned")), 3)


def search_projection(spark, d):
    """Whole texts with what else a document is found by: folder, family, tags in order, accepted status, amount."""
    docs = documents(spark, d)
    listed = tags(docs).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("tag").alias("k"), "tag"))), lambda x: x["tag"]), " ").alias("tags"))
    rows = docs.join(listed, "id", "left").join(totals(spark, d), "id", "left")
    body = F.concat_ws("\n", "text", "folder", "family", "tags", F.when(F.col("review_status").isin(*filters.ACCEPTED), F.concat(F.lit("status: "), F.col("review_status"))), F.concat(F.lit("total: "), F.col("total").cast("decimal(18,2)").cast("string")))
    return rows.select("id", F.sha2(body.cast("binary"), 256).alias("sha"), F.length(body).alias("n_chars"))


def document_summary(spark, d):
    docs = documents(spark, d)
    return docs.groupBy("folder").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.min("document_date").alias("first_date"), F.count_if(F.col("review_status") == "needs_review").alias("open_reviews"))


QUERIES = {
    "acl_filtered_documents": lambda s, d: _readable(s, d).select("id", "owner_id", "folder", "sensitivity"),
    "composite_filter_documents": lambda s, d: composite(s, d).select("id", "family", "review_status", "document_date"),
    "substring_search": lambda s, d: documents(s, d).filter(filters.Filters(text="The Than").predicate()).select("id"),
    "facet_family": lambda s, d: filters.facet(composite(s, d), F.col("family")),
    "facet_folder": lambda s, d: filters.facet(composite(s, d), F.col("folder")),
    "facet_review_status": lambda s, d: filters.facet(composite(s, d), F.col("review_status")),
    "facets": lambda s, d: filters.facets(composite(s, d), _beside(s, d, _readable(s, d))),
    "filter_wanted": filtered(WANTED),
    "filter_unrelated": filtered(UNRELATED),
    "filter_linked": filtered(LINKED),
    "search_filtered": search_filtered,
    "hybrid_shown": hybrid_shown,
    "page_vectors": page_vectors,
    "visual_topk": visual_topk,
    "index_postings": lambda s, d: lexical_index(s, d).postings.groupBy("term").agg(F.sum("chunks").alias("chunks"), F.sum("occurrences").alias("occurrences")),
    "facet_month": lambda s, d: filters.facet(composite(s, d), F.date_format(F.date_trunc("month", "document_date"), "yyyy-MM"), 24),
    "document_summary": document_summary,
    "document_paging": lambda s, d: filters.page_of(documents(s, d), 40, 20).select("id", "document_date"),
    "page_chunks": lambda s, d: chunks(s, d).select("id", "chunk", F.greatest(F.size(F.split(F.trim("text"), " +")), F.lit(1)).alias("token_count")),
    "bm25_lexical": bm25_lexical,
    "lexical_fallback": lambda s, d: search.lexical_fallback(lexical_index(s, d), chunks(s, d), "the and of", 30),
    "ann_topk": ann_topk,
    "ann_exact_topk": ann_exact_topk,
    "ann_recall": ann_recall,
    "semantic_topk": semantic_topk,
    "hybrid_rrf": hybrid_rrf,
    "single_mode_dedupe": lambda s, d: search.first_per_document(bm25_lexical(s, d), 15),
    "search_projection": search_projection,
    "snippets": lambda s, d: table(s, d, "documents").select("doc_id", search.snippet(F.col("text")).alias("snippet")),
    "hash_embedding": lambda s, d: search.hash_embedding(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")),
    "ranking_eval": ranking_eval,
}

ORACLES = {
    "acl_filtered_documents": f"{DOCS}, {READABLE} SELECT id, owner_id, folder, sensitivity FROM r",
    "composite_filter_documents": f"{DOCS}, {READABLE} SELECT id, family, review_status, CAST(document_date AS VARCHAR) AS document_date FROM r WHERE {FILTER_SQL}",
    "substring_search": "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the than')",
    "facet_family": f"{DOCS}, {READABLE} SELECT family AS value, count(*) AS total FROM r WHERE {FILTER_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "facet_folder": f"{DOCS}, {READABLE} SELECT folder AS value, count(*) AS total FROM r WHERE {FILTER_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "facet_review_status": f"{DOCS}, {READABLE} SELECT review_status AS value, count(*) AS total FROM r WHERE {FILTER_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "facet_month": f"{DOCS}, {READABLE} SELECT strftime(document_date, '%Y-%m') AS value, count(*) AS total FROM r WHERE {FILTER_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 24",
    "document_summary": f"{DOCS} SELECT folder, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, string_agg(DISTINCT family, ',' ORDER BY family) AS families, CAST(min(document_date) AS VARCHAR) AS first_date, count(*) FILTER (WHERE review_status = 'needs_review') AS open_reviews FROM docs GROUP BY folder",
    "document_paging": f"{DOCS} SELECT id, CAST(document_date AS VARCHAR) AS document_date FROM docs ORDER BY docs.document_date DESC NULLS LAST, id LIMIT 20 OFFSET 40",
    "page_chunks": f"WITH {CHUNKS} SELECT id, CAST(chunk AS INT) AS chunk, CAST(greatest(len(regexp_split_to_array(trim(text), ' +')), 1) AS INT) AS token_count FROM ch",
    "bm25_lexical": f"WITH {_bm25_sql(40)} SELECT * FROM lexical",
    "index_postings": f"WITH {CHUNKS}, t AS (SELECT id, chunk, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ch) SELECT term, count(DISTINCT (id, chunk)) AS chunks, count(*) AS occurrences FROM t GROUP BY term",
    "search_filtered": f"{DOCS}, {READABLE}, {SQL['tags']}, {_bm25_sql(30, "id IN (SELECT r.id FROM r JOIN tags USING (id) WHERE lower(tag) IN ('en', 'important'))")} SELECT * FROM lexical",
    "filter_wanted": f"""{BESIDE}, {EDGES} SELECT id FROM r WHERE EXISTS (SELECT 1 FROM tags t WHERE t.id = r.id AND lower(tag) IN ('important', 'long')) AND (SELECT max(total) FROM totals t WHERE t.id = r.id) >= 1000
    AND EXISTS (SELECT 1 FROM both_ends e WHERE e.id = r.id AND kind IN ('duplicate_of', 'invoice_for', 'receipt_for') AND status <> 'rejected' AND other IN (SELECT id FROM r)) AND EXISTS (SELECT 1 FROM due_days x WHERE x.id = r.id AND kind IN ('due_date', 'renewal_date') AND status IN ('open', 'due_soon', 'overdue', 'needs_review'))""",
    "filter_unrelated": f"""{BESIDE}, {EDGES} SELECT id FROM r WHERE NOT EXISTS (SELECT 1 FROM both_ends e WHERE e.id = r.id AND status <> 'rejected' AND other IN (SELECT id FROM r)) AND NOT EXISTS (SELECT 1 FROM due_days x WHERE x.id = r.id AND status IN ('open', 'due_soon', 'overdue', 'needs_review'))""",
    "filter_linked": f"""{BESIDE}, {EDGES} SELECT id FROM r WHERE EXISTS (SELECT 1 FROM both_ends e WHERE e.id = r.id AND status = 'confirmed' AND other IN (SELECT id FROM r)) AND (SELECT max(total) FROM totals t WHERE t.id = r.id) <= 200000""",
    "facets": f"""{BESIDE}, {EDGES}, c AS (SELECT * FROM r WHERE {FILTER_SQL}),
    v AS (SELECT 'families' AS facet, family AS value, id FROM c UNION ALL SELECT 'folders', folder, id FROM c UNION ALL SELECT 'reviewStatus', review_status, id FROM c UNION ALL SELECT 'sensitivity', sensitivity, id FROM c UNION ALL SELECT 'months', strftime(document_date, '%Y-%m'), id FROM c
        UNION ALL SELECT 'tags', tag, id FROM tags WHERE id IN (SELECT id FROM c) UNION ALL SELECT 'relationshipTypes', kind, e.id FROM both_ends e WHERE status <> 'rejected' AND e.id IN (SELECT id FROM c) AND other IN (SELECT id FROM r) UNION ALL SELECT 'deadlineTypes', kind, id FROM due_days WHERE id IN (SELECT id FROM c) AND status IN ('open', 'due_soon', 'overdue', 'needs_review')),
    n AS (SELECT facet, value, count(DISTINCT id) AS total FROM v WHERE value IS NOT NULL GROUP BY ALL)
    SELECT * FROM n QUALIFY CASE WHEN facet = 'months' THEN row_number() OVER (PARTITION BY facet ORDER BY value DESC) <= 24 ELSE row_number() OVER (PARTITION BY facet ORDER BY total DESC, lower(value), value) <= 20 END""",
    "hybrid_shown": f"""WITH {_bm25_sql(40)}, {_semantic_sql(10)},
    al AS (SELECT id, chunk, rank, 0 AS source, 1.0::DOUBLE / (60 + rank) AS term FROM lexical UNION ALL SELECT id, chunk, rank, 1, 1.2::DOUBLE / (60 + rank) FROM semantic),
    fu AS (SELECT id, round(sum(term), 12) AS raw, arg_min(chunk, source * 1000 + rank) AS chunk, arg_min(chunk, (1 - source) * 1000 + rank) AS shown_chunk, max(CASE WHEN source = 0 THEN 1 END) AS l, max(CASE WHEN source = 1 THEN 1 END) AS m FROM al GROUP BY id)
    SELECT CAST(row_number() OVER (ORDER BY raw DESC, fu.id) AS INT) AS rank, fu.id, round(raw, 6) AS score, fu.chunk, shown_chunk, regexp_replace(left(text, 240), '</?b>', '', 'g') AS source_text, concat_ws('+', CASE WHEN l = 1 THEN 'lexical' END, CASE WHEN m = 1 THEN 'semantic' END) AS modalities,
    CASE WHEN ch.chunk % 2 = 0 THEN 'page ' || (ch.chunk + 1) END AS evidence FROM fu LEFT JOIN ch ON ch.id = fu.id AND ch.chunk = shown_chunk QUALIFY rank <= 10""",
    "lexical_fallback": f"""WITH {CHUNKS}, tk AS (SELECT id, chunk, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT id, chunk, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM ch)),
    o AS (SELECT *, row_number() OVER w AS i, lag(pos) OVER (PARTITION BY id, chunk, term ORDER BY pos) AS before, max(CASE WHEN term = 'the' THEN pos END) OVER w AS a, max(CASE WHEN term = 'and' THEN pos END) OVER w AS b, max(CASE WHEN term = 'of' THEN pos END) OVER w AS c
        FROM tk WHERE term IN ('the', 'and', 'of') WINDOW w AS (PARTITION BY id, chunk ORDER BY pos)),
    cv AS (SELECT o.id, o.chunk, o.pos, o.i, least(a, b, c) AS start FROM o WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND coalesce(before, -1) < least(a, b, c)),
    de AS (SELECT cv.id, cv.chunk, round(sum(0.1::DOUBLE / (1 + cv.pos - cv.start - (cv.i - o.i))), 12) AS score FROM cv JOIN o ON o.id = cv.id AND o.chunk = cv.chunk AND o.pos = cv.start GROUP BY ALL),
    sc AS (SELECT id, chunk, coalesce(de.score, 0) AS score FROM de FULL JOIN (SELECT id, chunk FROM ch WHERE text ILIKE '%the and of%') li USING (id, chunk))
    SELECT id, CAST(chunk AS INT) AS chunk, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY sc.score DESC, id, chunk) AS INT) AS rank FROM sc QUALIFY rank <= 30""",
    "ann_exact_topk": f"WITH {_semantic_sql(40)} SELECT * FROM semantic",
    "semantic_topk": f"WITH {_semantic_sql(40)} SELECT * FROM semantic",
    "hybrid_rrf": f"""WITH {_bm25_sql(40)}, {_semantic_sql(40)},
    al AS (SELECT id, CAST(chunk AS INT) AS chunk, rank, 0 AS source, 1.0::DOUBLE / (60 + rank) AS term FROM lexical UNION ALL SELECT id, chunk, rank, 1, 1.2::DOUBLE / (60 + rank) FROM semantic),
    fu AS (SELECT id, round(sum(term), 12) AS score, arg_min(chunk, source * 1000 + rank) AS chunk, coalesce(min(CASE WHEN source = 0 THEN rank END), 0) AS lexical_rank, coalesce(min(CASE WHEN source = 1 THEN rank END), 0) AS semantic_rank FROM al GROUP BY id)
    SELECT * REPLACE (round(score, 6) AS score), CAST(row_number() OVER (ORDER BY fu.score DESC, id) AS INT) AS rank FROM fu QUALIFY rank <= 20""",
    "single_mode_dedupe": f"WITH {_bm25_sql(40)} SELECT id, CAST(chunk AS INT) AS chunk, score, rank FROM (SELECT * FROM lexical QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank) = 1) ORDER BY rank LIMIT 15",
    "search_projection": f"""{DOCS}, {SQL['tags']}, {SQL['totals']}, g AS (SELECT id, string_agg(tag, ' ' ORDER BY lower(tag), tag) AS tags FROM tags GROUP BY 1),
    p AS (SELECT docs.id, concat_ws(chr(10), text, folder, family, tags, CASE WHEN review_status IN ('auto_accepted', 'user_confirmed', 'user_corrected') THEN 'status: ' || review_status END, 'total: ' || CAST(total AS DECIMAL(18,2))) AS body FROM docs LEFT JOIN g USING (id) LEFT JOIN totals USING (id))
    SELECT id, sha256(body) AS sha, CAST(length(body) AS INT) AS n_chars FROM p""",
    "snippets": "SELECT doc_id, regexp_replace(left(text, 240), '</?b>', '', 'g') AS snippet FROM documents",
    "ranking_eval": """WITH c AS (SELECT item_id AS id, [item_id + item_id % 3, item_id - 1, item_id] AS ret FROM benchmark)
    SELECT id AS "case", CASE WHEN list_position(ret, id) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, coalesce(round(1.0::DOUBLE / nullif(list_position(ret, id), 0), 6), 0.0::DOUBLE) AS reciprocal_rank FROM c""",
}
