"""From parsed documents to facts: parse trees, anchors and families, lanes, keys and values, row gates, geometry, payload safety."""
from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from foliospark.functions import text as T

# The phrases of each family's anchors.
ANCHORS = {
    "medical_eob": {"eob": ("eob", "explanation of benefits"), "claim": ("claim", "claim number"), "patient_responsibility": ("patient responsibility",), "anthem": ("anthem",), "denial": ("denial", "denied")},
    "invoice": {"invoice": ("invoice", "invoice number"), "amount_due": ("amount due", "balance due"), "bill_to": ("bill to",), "due_date": ("due date",)},
    "receipt": {"receipt": ("receipt",), "subtotal": ("subtotal",), "tax": ("tax", "sales tax"), "paid": ("paid", "amount paid"), "payment": ("payment",)},
    "service_record": {"repair_order": ("repair order", "r/o", "ro open date", "rio open date"), "service": ("service", "services", "labor"), "parts": ("parts", "part number"), "vehicle": ("vin", "mileage", "mileage in", "vehicle"), "motorcycle": ("motorcycle", "motorcycles")},
    "retail_order": {"order": ("order", "order number"), "ship_to": ("ship to", "shipping address"), "bh_photo": ("b&h", "bh photo", "b h photo")},
    "real_estate_title": {"title": ("title", "title company"), "seller": ("seller", "seller information", "seller proceeds"), "closing": ("closing", "settlement")},
    "mortgage_escrow_statement": {"escrow": ("escrow",), "mortgage": ("mortgage",), "shortage": ("shortage",), "surplus": ("surplus",), "uwm": ("uwm", "united wholesale mortgage")},
    "financial_dispute_form": {"dispute": ("dispute", "reason for dispute", "dispute form"), "transaction": ("transaction",), "charge": ("charge",), "unauthorized": ("unauthorized", "not authorized"), "chargeback": ("chargeback",), "fraud": ("fraud", "fraudulent")},
}
# How many anchors a family needs (else 2), of which one at least, and the phrases that rule it out.
NEEDED = {"service_record": 3}
ANY_OF = {"invoice": ("invoice", "amount_due"), "receipt": ("receipt", "subtotal", "paid"), "service_record": ("repair_order", "service"), "retail_order": ("order", "ship_to", "bh_photo"), "real_estate_title": ("title", "seller", "closing"), "mortgage_escrow_statement": ("escrow",), "financial_dispute_form": ("dispute", "unauthorized", "chargeback", "fraud")}
RULED_OUT = {"receipt": ("explanation of benefits", "claim number")}
#: Families with extraction schemas.
TARGETS = ("receipt", "invoice", "medical_eob")
DIFFICULT = ("handwriting", "missing_text_layer", "low_text_density", "low_ocr_confidence", "degraded_scan")
# Keys that a job's payload must not hold, and what is hidden in reports.
SECRETS = ("password", "secret", "token", "api_key", "authorization", "cookie", "credential")
HIDDEN = ("answer", "content", "data", "data_url", "image", "image_path", "input", "messages", "object_uri", "objecturi", "path", "prompt", "raw_output", "raw_text", "response", "text", "uri", "url")
HIDDEN_VALUES = ("data:", "filesystem://", "/srv/")


def phrase(text: Column, *phrases: str) -> Column:
    """Whether one of the phrases stands in a text, words whole, in any case and spacing."""
    import re

    flat = F.lower(F.regexp_replace(text, r"\s+", " "))
    return flat.rlike(r"(?U)(?<!\w)(?:" + "|".join(map(re.escape, phrases)) + r")(?!\w)")


def anchors(docs: DataFrame) -> DataFrame:
    """(id, family, anchors, hint): the families of which a text (id, text) has an anchor, and whether they are enough for a hint."""
    rows = []
    for family, own in ANCHORS.items():
        hit = F.array_compact(F.array(*[F.when(phrase(F.col("text"), *p), a) for a, p in sorted(own.items())]))
        if family in RULED_OUT:
            hit = F.when(phrase(F.col("text"), *RULED_OUT[family]), F.array().cast("array<string>")).otherwise(hit)
        rows.append(F.struct(F.lit(family).alias("family"), hit.alias("anchors"), F.lit(NEEDED.get(family, 2)).alias("need"), F.array(*map(F.lit, ANY_OF.get(family, ()))).cast("array<string>").alias("any_of")))
    out = docs.select("id", F.explode(F.array(*rows)).alias("a")).select("id", "a.*").filter(F.size("anchors") > 0)
    hint = (F.size("anchors") >= F.col("need")) & ((F.size("any_of") == 0) | F.arrays_overlap("any_of", "anchors"))
    return out.select("id", "family", "anchors", hint.alias("hint"))


def classified(docs: DataFrame) -> DataFrame:
    """docs: id, text, title, difficult.  Family, subtype, confidence, route and whether a person must look."""
    x = docs.withColumn("c", T.classify(F.col("text"), title=F.col("title"))).select("id", "c.*", "difficult")
    return x.select("id", "family", "subtype", "confidence", F.when(F.col("family").isin(*TARGETS), "docling_plus_structured_extraction").otherwise("docling_only").alias("route_profile"), ((F.col("confidence") < 0.7) | (F.col("family") == "medical_eob") | F.col("difficult")).alias("needs_review"))


def voted(votes: DataFrame, hits: DataFrame, margin: float = 0.5) -> DataFrame:
    """votes: id, source (partial, page or source), family, confidence; hits: (id, family, anchors).  Weights: partial 0.5, a page its confidence, the source's
    own family 0.35, each anchor 1.25.  The family of most votes; without an anchor, a lead of less than the margin gives generic_form."""
    weight = F.when(F.col("source") == "partial", 0.5).when(F.col("source") == "page", F.col("confidence")).otherwise(0.35)
    given = votes.select("id", "family", weight.alias("w"), F.lit(0).alias("anchored")).unionByName(hits.select("id", "family", (F.size("anchors") * 1.25).alias("w"), F.lit(1).alias("anchored")))
    total = given.groupBy("id", "family").agg(F.round(F.sum("w"), 6).alias("votes"), F.max("anchored").alias("anchored"))
    w = Window.partitionBy("id").orderBy(F.desc("votes"), "family")
    top = total.withColumns({"n": F.row_number().over(w), "lead": F.col("votes") - F.coalesce(F.lead("votes").over(w), F.lit(0.0))}).filter("n = 1")
    return top.select("id", F.when((F.col("anchored") == 0) & (F.col("lead") < margin), "generic_form").otherwise(F.col("family")).alias("family"), "votes")


# Families that documents can have; families of the model's document types; whose anchors support a family; families whose
# anchors outweigh the source, first come first, the first three over any source; types that say nothing.
STORED = (
    "generic", "receipt", "invoice", "medical_eob", "medical_bill", "insurance_document", "insurance_denial", "legal_contract", "legal_notice", "tax_document", "warranty", "identity_document", "bank_statement", "financial_statement",
    "handwritten_note", "typed_note", "whitepaper", "reference_document", "retail_order", "service_record", "real_estate_title", "mortgage_escrow_statement", "financial_dispute_form",
)
TYPE_FAMILY = {
    "invoice": "invoice", "receipt": "receipt", "payment_receipt": "receipt", "travel_receipt": "receipt", "restaurant_receipt": "receipt", "medical_eob": "medical_eob", "medical_bill": "medical_bill", "medical_claim": "medical_eob",
    "insurance_denial": "insurance_denial", "insurance_document": "insurance_document", "retail_order": "retail_order", "service_record": "service_record", "real_estate_title": "real_estate_title",
    "mortgage_escrow_statement": "mortgage_escrow_statement", "financial_dispute_form": "financial_dispute_form", "generic_form": "generic", "unsupported_document": "generic", "no_extraction_target": "generic",
}
SUPPORT = {"insurance_denial": "medical_eob", "insurance_document": "medical_eob", "medical_bill": "medical_eob"}
OUTWEIGH = ("real_estate_title", "mortgage_escrow_statement", "financial_dispute_form", "service_record", "retail_order")
REPLACEABLE = ("receipt", "invoice", "medical_eob", "medical_bill", "insurance_document")
SAYS_NOTHING = ("document_observation", "generic_form", "unsupported_document", "no_extraction_target")


def _looked_up(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit(""))), default)


def reconciled(docs: DataFrame, hints: DataFrame) -> DataFrame:
    """docs: id, family, semantic (the model's document type or null); hints: (id, family, anchors, hint).  (id, family, confidence, reason, update).

    A type whose family's anchors are there wins; then the first family of `OUTWEIGH` that is hinted at, where it may replace the source; then a type that says
    nothing takes a family away that no anchors support; else the family stays.  Confidence grows with anchors, 0.96 at most."""
    own = hints.filter("hint").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("family", F.size("anchors").alias("n")))).alias("_n"))  # a few families a document
    x = docs.select("id", F.nullif(F.lower(F.trim("family")), F.lit("")).alias("given"), F.nullif(F.lower(F.trim("semantic")), F.lit("")).alias("kind")).join(own, "id", "left")
    none = F.lit(None).cast("string")
    x = x.withColumns({"source": F.coalesce("given", F.lit("generic")), "said": _looked_up(TYPE_FAMILY, F.col("kind"), none)})
    anchors = lambda family: F.element_at("_n", _looked_up(SUPPORT, family, F.coalesce(family, F.lit(""))))
    hinted = F.coalesce(*[F.when(F.element_at("_n", F.lit(f)).isNotNull(), f) for f in OUTWEIGH])
    x = x.withColumns({"support": F.when(F.col("said").isNotNull(), anchors(F.col("said"))), "backed": anchors(F.col("source")), "hinted": hinted})
    sure = lambda n: F.round(F.least(F.lit(0.96), 0.72 + 0.04 * n), 4)
    result = lambda f, c, r: F.struct(f.alias("family"), c.alias("confidence"), r.alias("reason"))
    other = lambda f: ~f.eqNullSafe(F.col("given"))
    may = F.col("hinted").isin(*OUTWEIGH[:3]) | F.col("source").isin(*REPLACEABLE, "generic")
    decision = (
        F.when(F.col("support").isNotNull(), result(F.col("said"), sure(F.col("support")), F.when(other(F.col("said")), "semantic_document_type_with_docling_support").otherwise("semantic_document_type_confirms_existing_family")))
        .when(F.col("hinted").isNotNull() & other(F.col("hinted")) & may, result(F.col("hinted"), sure(F.element_at("_n", F.col("hinted"))), F.lit("docling_anchor_family_supersedes_phase4")))
        .when(F.col("source").isin(*REPLACEABLE) & F.col("kind").isin(*SAYS_NOTHING) & F.col("backed").isNull(), result(F.lit("generic"), F.lit(0.68), F.lit("semantic_generic_downgrades_unsupported_phase4_family")))
        .otherwise(result(F.col("source"), F.lit(0.62), F.lit("retain_existing_family")))
    )
    x = x.withColumn("d", decision)
    family = F.when(F.col("d.family").isin(*STORED), F.col("d.family")).otherwise("generic")
    return x.select("id", family.alias("family"), "d.confidence", "d.reason", ((F.col("d.reason") != "retain_existing_family") & (family != F.col("source"))).alias("update"))


def contracts(tasks: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """tasks: id, schema; registry: schema, contract; aliases: alias, schema: dimension tables of some dozens of rows.  The contract and how it was found: exact, by alias,
    the generic one that is for review only, or missing."""
    exact = registry.select("schema", F.col("contract").alias("c1"))
    other = aliases.withColumnRenamed("schema", "target").join(registry.withColumnRenamed("schema", "target"), "target").select(F.col("alias").alias("schema"), F.col("contract").alias("c2"))
    x = tasks.join(F.broadcast(exact), "schema", "left").join(F.broadcast(other), "schema", "left")
    mode = F.when(F.col("c1").isNotNull(), "exact").when(F.col("c2").isNotNull(), "alias").when(F.col("schema").isNotNull(), "generic_review_only").otherwise("missing")
    return x.select("id", mode.alias("mode"), F.coalesce("c1", "c2", F.when(F.col("schema").isNotNull(), "document_observation")).alias("contract"))


def lane(table: bool = True) -> Column:
    """struct(lane, reason) of rows with is_task, fits, grounded, data_rows, columns, elements, reasons: line-item tables need a grid with data and two columns, keys
    and values a page with elements; difficult pages go to vision."""
    hard = F.array_join(F.filter("reasons", lambda r: r.isin(*DIFFICULT)), ",")
    step = lambda cond, why: (cond, F.lit(why) if isinstance(why, str) else why)
    ladder = [step(~F.col("is_task"), "no_semantic_task"), step(~F.col("fits"), "region_not_line_item_table" if table else "region_not_kvp"), step(~F.col("grounded"), "no_grounded_docling_table" if table else "no_grounded_page")]
    ladder += [step(F.col("data_rows").isNull(), "table_grid_missing"), step(F.col("data_rows") == 0, "table_grid_has_no_data_rows"), step(F.col("columns") < 2, "table_grid_too_narrow")] if table else [step(F.col("elements") == 0, "no_page_elements")]
    ladder.append(step(hard != "", F.concat(F.lit("difficult_page:"), hard)))
    row = lambda name, why: F.struct(F.lit(name).alias("lane"), why.alias("reason"))
    out = reduce(lambda a, s: a.when(s[0], row("vision", s[1])), ladder[1:], F.when(ladder[0][0], row("vision", ladder[0][1])))
    return out.otherwise(row("text", F.lit("usable_grid_on_text_page" if table else "kvp_spans_on_text_page")))


def key_values(selected: DataFrame, spans: DataFrame, registry: DataFrame) -> DataFrame:
    """selected: id, key, span_id; spans: id, span_id, value; registry: key, path, value_type, a small table.  (id, key, kind, path, value): a fact where the key is registered and the value is of its type, an
    observation where the key is not, else unmatched."""
    x = selected.join(spans, ["id", "span_id"], "left").withColumn("_k", T.quality_key(F.col("key"))).join(F.broadcast(registry.select(T.quality_key(F.col("key")).alias("_k"), "path", "value_type")), "_k", "left")
    value = F.nullif(F.trim("value"), F.lit(""))
    typed = F.when(F.col("value_type") == "money", T.parse_amount(value).cast("decimal(18,2)").cast("string")).when(F.col("value_type") == "date", F.when(T.parse_day(value).isNotNull(), value)).otherwise(value)
    kind = F.when(typed.isNull(), "unmatched").when(F.col("path").isNotNull(), "fact").otherwise("observation")
    return x.select("id", "key", kind.alias("kind"), F.when(typed.isNotNull(), F.coalesce("path", "key")).alias("path"), typed.alias("value"))


def gated_rows(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows: table_id, position, row_index; tables: table_id, authoritative, data_rows.  (table_id, accepted, rejected, mismatch): authoritative tables take only rows with an index, and are
    reviewed if rows are missing by more than a quarter."""
    x = rows.join(tables, "table_id")
    bad = F.col("authoritative") & F.col("row_index").isNull()
    g = x.groupBy("table_id").agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), F.first("data_rows").alias("want"), F.first("authoritative").alias("auth"))
    gap = F.abs(F.col("accepted") - F.col("want"))
    return g.select("table_id", "accepted", "rejected", (F.col("auth") & (F.col("want") > 0) & (gap >= 1) & (gap > 0.25 * F.col("want"))).alias("mismatch"))


def enforced(baseline: DataFrame, plan: DataFrame, *keys: str) -> DataFrame:
    """The plan with what it lacks of the baseline; added tells which."""
    lacking = baseline.select(*keys).distinct().join(plan.select(*keys), [*keys], "left_anti")
    return plan.select(*keys).distinct().withColumn("added", F.lit(False)).unionByName(lacking.withColumn("added", F.lit(True)))


PARSED = "struct<pages:array<struct<page_no:int,text:string>>,texts:array<struct<page_no:int,label:string,text:string>>,tables:array<struct<page_no:int,markdown:string>>>"


def parsed(json: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """json: (id, json) of parsed documents.  pages (id, page, text), elements (id, ordinal, page, label, text), tables (id, ordinal, page, markdown) and chunks (id, chunk, page, text,
    token_count): a page without text has that of its elements; each page with text is a chunk, numbered densely."""
    p = json.select("id", F.from_json("json", PARSED).alias("p"))
    elements = p.select("id", F.posexplode("p.texts").alias("ordinal", "e")).select("id", "ordinal", F.col("e.page_no").alias("page"), "e.label", "e.text")
    tables = p.select("id", F.posexplode("p.tables").alias("ordinal", "e")).select("id", "ordinal", F.col("e.page_no").alias("page"), "e.markdown")
    joined = lambda n: F.array_join(F.transform(F.filter(F.coalesce("p.texts", F.array().cast("array<struct<page_no:int,label:string,text:string>>")), lambda e: e["page_no"] == n), lambda e: e["text"]), "\n")
    pages = p.select("id", F.explode(F.transform("p.pages", lambda g: F.struct(g["page_no"].alias("page"), F.coalesce(F.nullif(F.trim(g["text"]), F.lit("")), joined(g["page_no"])).alias("text")))).alias("g")).select("id", "g.*")
    full = pages.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    chunks = full.withColumn("chunk", F.row_number().over(Window.partitionBy("id").orderBy("page")) - 1).select("id", "chunk", "page", "text", F.greatest(F.lit(1), F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))).alias("token_count"))
    return pages, elements, tables, chunks


# geometry: boxes are arrays left, top, right, bottom


def box(json: Column) -> Column:
    """A box written as an array of four, or by the names l t r b or x0 y0 x1 y1; null if it is none of these."""
    four = F.from_json(json, "array<double>")
    named = lambda ks: F.array(*[F.get_json_object(json, f"$.{k}").try_cast("double") for k in ks])
    whole = lambda a: F.when((F.size(a) == 4) & ~F.exists(a, lambda x: x.isNull()), a)
    return F.coalesce(whole(F.when(F.startswith(json, F.lit("[")), four)), whole(named("ltrb")), whole(named(("x0", "y0", "x1", "y1"))))


def upright(b: Column, height: Column) -> Column:
    """From bottom-left to top-left coordinates."""
    return F.array(b[0], height - F.greatest(b[1], b[3]), b[2], height - F.least(b[1], b[3]))


def expanded(b: Column, by: float, width: Column, height: Column) -> Column:
    """A box grown on all sides, inside the page."""
    return F.array(F.greatest(F.lit(0.0), b[0] - by), F.greatest(F.lit(0.0), b[1] - by), F.least(width, b[2] + by), F.least(height, b[3] + by))


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller box that both cover."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(side(0, 2) * side(1, 3), F.least(size(a), size(b))), F.lit(0.0))


def grid_tokens(width: Column, height: Column, cell: int, most: int) -> Column:
    """Cells of a picture that is scaled to `most` pixels at most."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (width * height)))
    side = lambda x: F.greatest(F.lit(1), F.ceil(F.rint(x * scale) / cell))
    return F.least(side(width) * side(height), F.lit(max(1, most // (cell * cell))))


# payloads


def holds_secret(json: Column) -> Column:
    """Whether an object, at any depth, has a key that must not be in it."""
    return F.coalesce(json.rlike(r'(?i)"(' + "|".join(SECRETS) + r')"\s*:'), F.lit(False))


def _shown(value: object) -> object:
    """The value without what reports hide, at any depth: whole values by their key, texts by how they begin."""
    if isinstance(value, dict):
        return {k: "[redacted]" if any(h in k.replace("-", "_").casefold() for h in HIDDEN) else _shown(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_shown(v) for v in value]
    return "[redacted]" if isinstance(value, str) and value.startswith(HIDDEN_VALUES) else value


@F.pandas_udf(StringType())
def redacted(payloads: pd.Series) -> pd.Series:
    """JSON of any shape without what reports hide; what is no JSON, or nested beyond the parser, is hidden whole; null stays null."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(_shown(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return '"[redacted]"'

    return payloads.map(one, na_action="ignore")
