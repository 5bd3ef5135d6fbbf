"""Claims, line items and candidates: from located facts to resolved, checked and admitted values."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import text as T
from foliospark.operators import facts

# Engines whose values count, those that are models, methods that only plan.
ENGINES = ("granite", "docling")
MODELS = ("granite", "qwen")
PLANNERS = ("semantic_plan", "planner")
# Which paths a schema admits; the schemas that admit observations only.
PATHS = {"invoice": ("invoice.",), "receipt": ("receipt.",), "medical_eob": ("medical_eob.",), "healthcare_coverage_decision": ("medical_eob.", "healthcare_coverage_decision.")}
OBSERVATION_ONLY = {"document_observation": "document_observation_is_review_only", "retail_order": "alias_family_requires_observation_projection", "service_record": "alias_family_requires_observation_projection"}


def joined(*columns: Column | str) -> Column:
    """The canonical text of values, nulls apart from empty texts."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols])


def structural() -> Column:
    """Whether a reference (page, bbox, element_id, table_id, row_index, text_span) locates a value on its page."""
    return F.col("page").isNotNull() & (F.col("bbox").isNotNull() | F.col("element_id").isNotNull() | (F.col("table_id").isNotNull() & F.col("row_index").isNotNull()) | F.col("text_span").isNotNull())


def concrete(engine: Column) -> Column:
    """Whether it is evidence at all: located, in a region, or, but for models, with its source text."""
    return structural() | (F.col("page").isNotNull() & (F.col("region_id").isNotNull() | (~engine.isin(*MODELS) & (F.coalesce("source_text", F.lit("")) != ""))))


def evidence_reason(engine: Column) -> Column:
    """Models need a structural anchor, others concrete evidence; null if it is there."""
    model = engine.isin(*MODELS)
    return F.when(F.when(model, structural()).otherwise(concrete(engine)), F.lit(None).cast("string")).when(model & concrete(engine), "missing_structural_value_anchor").otherwise("missing_concrete_evidence")


def schema_reason(schema: Column, path: Column) -> Column:
    """Why a schema does not admit a field path; unknown schemas admit all."""
    s, p = F.lower(F.trim(schema)), F.lower(F.trim(path))
    out = reduce(lambda a, kv: a.when(s == kv[0], kv[1]), list(OBSERVATION_ONLY.items())[1:], F.when(s == "document_observation", OBSERVATION_ONLY["document_observation"]))
    for name, prefixes in PATHS.items():
        fits = reduce(Column.__or__, [F.startswith(p, F.lit(x)) for x in prefixes])
        out = out.when((s == name) & ~fits, "candidate_schema_incompatible")
    return out


def claims(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows: located facts (document, position, engine, method, key, value and the reference); registry: key, value_type, a table of some
    dozens of rows.  Adds the typed value as text and the claim's id; what is planned only, unknown, unlocated or unreadable is left out."""
    known = rows.filter(F.col("engine").isin(*ENGINES) & ~F.col("method").isin(*PLANNERS) & structural()).join(F.broadcast(registry), "key")
    money, day = T.parse_amount(F.col("value")).cast("decimal(18,2)").cast("string"), T.parse_day(F.col("value")).cast("string")
    typed = F.when(F.col("value_type") == "money", money).when(F.col("value_type") == "date", day).otherwise(F.nullif(F.trim("value"), F.lit("")))
    out = known.withColumn("typed", typed).filter("typed IS NOT NULL")
    return out.withColumn("claim_id", F.sha2(joined("document", "page", "element_id", "table_id", "row_index", "key", "typed"), 256))


def line_groups(items: DataFrame, *content: str) -> DataFrame:
    """Adds group_id to line items (document, position, page, element_id, table_id, row_index): the anchor, if it is a row's or only this
    item's; else anchor, content and occurrence, so rows that share a region stay apart, repeated ones too."""
    anchor = joined("document", "page", "element_id", "table_id", "row_index")
    rows = items.withColumns({"_anchor": anchor, "_content": joined(*content)})
    rows = rows.withColumn("_shared", F.count("*").over(Window.partitionBy("document", "_anchor")))
    nth = F.row_number().over(Window.partitionBy("document", "_anchor", "_content").orderBy("position"))
    own = F.col("row_index").isNotNull() | (F.col("_shared") == 1)
    return rows.withColumn("group_id", F.sha2(F.when(own, F.col("_anchor")).otherwise(joined("_anchor", "_content", nth)), 256)).drop("_anchor", "_content", "_shared")


def line_items(claims_: DataFrame, *fields: str) -> DataFrame:
    """claims: document, group_id, field, value, engine, claim_id, page, row_index.  One row a group with the resolved fields, in page and row
    order; groups without a value or whose description stands for nothing are left out."""
    best = facts.resolve(claims_.withColumnRenamed("group_id", "g"), "document", "g", "field")
    order = claims_.groupBy("document", F.col("group_id").alias("g")).agg(F.min(F.struct(F.col("page").isNull().alias("p"), "page", F.col("row_index").isNull().alias("r"), "row_index")).alias("place"))
    wide = best.groupBy("document", "g").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields], F.bool_or("needs_review").alias("needs_review"))
    good = reduce(Column.__or__, [F.col(f).isNotNull() for f in fields]) & (F.col("description").isNull() | ~(T.is_placeholder(F.col("description")) | T.is_echo(F.col("description"))))
    ordinal = F.row_number().over(Window.partitionBy("document").orderBy("place", "g"))
    return wide.filter(good).join(order, ["document", "g"]).withColumn("ordinal", ordinal).select("document", "ordinal", *fields, "needs_review")


def outcomes(documents: DataFrame, decisions: DataFrame, required: DataFrame) -> DataFrame:
    """documents: document, family, material, review_only, has_target; decisions: document, key, decision; required: family, key, some dozens of rows.
    Per document the required keys that are absent and the outcome."""
    wanted = documents.join(F.broadcast(required), "family").select("document", "key")
    absent = wanted.join(decisions.select("document", "key").distinct(), ["document", "key"], "left_anti").groupBy("document").agg(F.count("*").alias("absent"))
    doubt = decisions.groupBy("document").agg(F.count_if(F.col("decision") == "needs_review").alias("doubts"))
    x = documents.join(absent, "document", "left").join(doubt, "document", "left").withColumns({"absent": F.coalesce("absent", F.lit(0).cast("long")), "doubts": F.coalesce("doubts", F.lit(0).cast("long"))})
    out = F.when(~F.col("has_target") & ~F.col("material"), "no_extraction_target").when(~F.col("material"), "insufficient_signal").when(F.col("review_only") | (F.col("doubts") > 0) | (F.col("absent") > 0), "needs_human_review").otherwise("extracted_cleanly")
    return x.select("document", "absent", "doubts", out.alias("outcome"))


def check(code: str, status: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), status.alias("status"))


def present(value: Column) -> Column:
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", "passed").otherwise("failed")


def sums(total: Column, subtotal: Column, plus: list[Column], minus: list[Column]) -> Column:
    """Whether a total is its parts; a warning if total or subtotal is not there."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,4)")
    want = reduce(Column.__sub__, map(zero, minus), reduce(Column.__add__, map(zero, plus), subtotal))
    return F.when(total.isNull() | subtotal.isNull(), "warning").when(F.abs(total - want) <= F.lit(facts.TOLERANCE).cast("decimal(18,4)"), "passed").otherwise("failed")


def receipt_checks() -> Column:
    """Checks of rows with merchant, day, subtotal, tax, tip, discount, total."""
    c = F.col
    return F.array(check("receipt.required.merchant", present(c("merchant"))), check("receipt.required.date", present(c("day"))), check("receipt.total_arithmetic", sums(c("total"), c("subtotal"), [c("tax"), c("tip")], [c("discount")])))


def invoice_checks() -> Column:
    """Checks of rows with seller, number, issued, due, subtotal, tax, shipping, discount, total."""
    c = F.col
    dates = F.when(c("due") < c("issued"), "failed").when(c("due").isNotNull() & c("issued").isNotNull(), "passed").otherwise("not_applicable")
    return F.array(check("invoice.required.seller", present(c("seller"))), check("invoice.required.invoice_number", present(c("number"))), check("invoice.required.total", present(c("total"))), check("invoice.due_date_not_before_issue_date", dates), check("invoice.total_arithmetic", sums(c("total"), c("subtotal"), [c("tax"), c("shipping")], [c("discount")])))


DETAIL = ("code", "service_date", "quantity", "unit_price", "gross", "discount", "tax", "net")


def dedupe_lines(rows: DataFrame) -> DataFrame:
    """rows: document, position, kind, description, code, service_date, quantity, unit, unit_price, gross, discount, tax, net, currency, hint, locator,
    evidence (how many).  Of rows alike in thirteen parts the richest stays, the first of equals; rows without any detail go if one with detail has the
    same kind, description and code at the same place or they name none.  Renumbered in order."""
    key = lambda c: T.text_key(F.col(c))
    number = lambda c: F.round(F.col(c).cast("double"), 6)
    parts = {"_k": key("kind"), "_d": key("description"), "_c": key("code"), "_l": F.coalesce("locator", F.lit(""))}
    exact = [*parts, "service_date", *[f"_{c}" for c in ("quantity", "unit_price", "gross", "discount", "tax", "net")], "_u", "_cur"]
    rows = rows.withColumns(parts | {f"_{c}": number(c) for c in ("quantity", "unit_price", "gross", "discount", "tax", "net")} | {"_u": key("unit"), "_cur": key("currency")})
    filled = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")
    rich = reduce(Column.__add__, [filled(c) for c in (*DETAIL, "unit", "currency", "hint")]) + F.col("evidence")
    one = facts.richest(rows, ["document", *exact], rich, "position").withColumn("_detail", reduce(Column.__or__, [F.col(c).isNotNull() for c in DETAIL]))
    cover = one.filter("_detail").select("document", "_k", "_d", "_c", F.explode(F.array_distinct(F.array("_l", F.lit("")))).alias("_l")).distinct().withColumn("_covered", F.lit(True))
    kept = one.join(cover, ["document", "_k", "_d", "_c", "_l"], "left").filter("_detail OR _covered IS NULL")
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("document").orderBy("position"))).drop("_detail", "_covered", *exact[:4], *[e for e in exact[4:] if e.startswith("_")])


def dedupe_observations(rows: DataFrame, *value: str) -> DataFrame:
    """rows: document, position, locator (null: none) and value columns.  Of a value without a place one stays, and none if the value came before;
    what comes after an unplaced one goes; else one of each place stays.  This follows from each value's first row, so no order is walked."""
    key = ["document", *value]
    first = rows.groupBy(*key).agg(F.min("position").alias("_first"), F.min_by(F.col("locator").isNotNull(), "position").alias("_placed"))
    each = rows.filter("locator IS NOT NULL").groupBy(*key, "locator").agg(F.min("position").alias("_each"))
    both = rows.join(first, key).join(each, [*key, "locator"], "left")
    return both.filter((F.col("position") == F.col("_first")) | (F.col("_placed") & (F.col("position") == F.col("_each")))).select(*rows.columns)


def reject_line(description: str, code: str, date: str, hint: str, *amounts: str) -> Column:
    """Why a line item is no candidate; null if it is one."""
    text = F.trim(F.coalesce(description, F.lit("")))
    ones = reduce(Column.__add__, [(F.coalesce(F.col(a).cast("double"), F.lit(0.0)) == 1).cast("int") for a in amounts])
    nothing = reduce(Column.__and__, [F.coalesce(F.col(a).cast("double"), F.lit(0.0)) == 0 for a in amounts])
    context = (F.length(text) >= 12) & (reduce(Column.__or__, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in (code, date, hint)]) | F.contains(F.lower(text), F.lit("service")))
    return (
        F.when(T.is_echo(text), "prompt_or_schema_echo").when((ones >= 2) & F.lower(text).rlike("schema|rows"), "fake_schema_line_item").when((text != "") & T.is_placeholder(text), "placeholder_or_null_value")
        .when(text == "", "missing_description").when(nothing & ~context, "zero_amount_without_service_context")
    )


def coverage(expected: Column, produced: Column) -> Column:
    """struct(missing, ratio): an expected field is there if a produced name equals it, or one of three characters or more lies in the other."""
    near = lambda e: F.exists(produced, lambda p: (p == e) | ((F.least(F.length(p), F.length(e)) >= 3) & (F.contains(p, e) | F.contains(e, p))))
    missing = F.filter(expected, lambda e: ~near(e))
    return F.struct(missing.alias("missing"), F.when(F.size(expected) > 0, F.round((F.size(expected) - F.size(missing)) / F.size(expected), 4)).alias("ratio"))


def review_state(events: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """events: document, at, action, path, value.  The fold of review actions: per document and path the last value and how it came, `rejected`
    if the last action was that; and the document's status, needs_review while a task is open, else user_confirmed."""
    last = F.max_by(F.struct("action", "value"), F.struct("at", "action"))
    fields = events.filter("path IS NOT NULL").groupBy("document", "path").agg(last.alias("l"))
    status = F.when(F.col("_open").isNotNull(), "needs_review").otherwise("user_confirmed")
    how = F.when(F.col("l.action") == "reject", "rejected").when(F.col("l.action") == "correct", "user_corrected").otherwise("user_confirmed")
    return fields.join(open_tasks.select("document").distinct().withColumn("_open", F.lit(True)), "document", "left").select("document", "path", F.when(F.col("l.action") != "reject", F.col("l.value")).alias("value"), how.alias("field_status"), status.alias("document_status"))


def projected(claims_: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """claims: region, path and anything else; regions: region, family.  The claims of each region's family (all for an observation), and of the
    regions without any of them why they are skipped."""
    own = F.when(F.contains("path", F.lit(".")), F.substring_index("path", ".", 1))
    x = claims_.join(regions, "region").withColumn("_fits", (F.col("family") == "document_observation") | F.coalesce(own == F.col("family"), F.lit(False)))
    found = x.groupBy("region").agg(F.count_if("_fits").alias("n"))
    why = F.when(F.col("n").isNull(), "missing_claims").when(F.col("n") == 0, "aggregate_incompatible_source_family")
    skipped = regions.join(found, "region", "left").select("region", why.alias("reason")).filter("reason IS NOT NULL")
    return x.filter("_fits").drop("_fits"), skipped
