"""Admission of extraction candidates: fields, then line items, then observations of a run, each admitted, or rejected with a reason.

The order matters in one way only: a candidate whose fingerprint one admitted before it has is a duplicate, whatever else is wrong
with it.  The one admitted before is the first of its fingerprint without a reason of its own, so one aggregate finds it, and no
run or fingerprint is ever walked through in one task.

Columns of candidates: run, kind (field, line_item, observation), pos (order in its kind), field_path (of an observation: its field's
name), value (JSON), description, code, quantity, unit_price, gross_amount, discount_amount, tax_amount, net_amount, currency, category_hint,
family, semantic_type, evidence (array of references, see EVIDENCE), region_id, needs_review, and the reasons that the checks have
found, null if none: source_reason, schema_reason, quality_reason, title_reason, evidence_reason.
"""
from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EVIDENCE = "array<struct<page_number:int,page_id:string,row_index:int,table_id:string,element_id:string,bbox:string,text_span:string,semantic_region_id:string>>"
AMOUNTS = ("quantity", "unit_price", "gross_amount", "discount_amount", "tax_amount", "net_amount")
# Kinds in their order; locators from the most to the least precise; reasons of quality that are artefacts.
KINDS = ("field", "line_item", "observation")
LOCATORS = ("table_row", "table", "element", "page", "semantic_region", "unknown")
ARTEFACTS = ("prompt_or_schema_echo", "fake_schema_line_item")


def _given(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def plain(c: Column) -> Column:
    """Lower case, blanks collapsed; empty for null."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def locator(ref: Column, region: Column | None = None) -> Column:
    """What a reference locates: a table's row, a table, an element, a page; else the region, if one is given."""
    page = ref["page_number"].isNotNull() | _given(ref["page_id"])
    out = F.when(ref["row_index"].isNotNull(), "table_row").when(_given(ref["table_id"]), "table").when(_given(ref["element_id"]), "element").when(page, "page")
    return (out.when(_given(region), "semantic_region") if region is not None else out).otherwise("unknown")


def best_reference(evidence: Column) -> Column:
    """The reference with most locators; of these the most precise one, then the first by page, row and the locators' text.  Null if there is none."""
    far = F.lit(1_000_000_000)

    def key(r: Column) -> Column:
        has = [r["row_index"].isNotNull(), _given(r["table_id"]), _given(r["element_id"]), r["bbox"].isNotNull(), r["text_span"].isNotNull(), r["page_number"].isNotNull() | _given(r["page_id"])]
        own = locator(r, r["semantic_region_id"])
        text = F.to_json(F.struct(plain(r["bbox"]).alias("bbox"), plain(r["element_id"]).alias("element_id"), plain(r["table_id"]).alias("table_id"), plain(r["text_span"]).alias("text_span")))
        return F.struct(
            (-sum((h.cast("int") for h in has), F.lit(0))).alias("a"), F.array_position(F.array(*map(F.lit, LOCATORS)), own).alias("b"), F.coalesce(r["page_number"], far).alias("c"),
            plain(r["page_id"]).alias("d"), F.coalesce(r["row_index"], far).alias("e"), text.alias("f"), r.alias("ref"),
        )

    return F.array_min(F.transform(F.filter(evidence, lambda r: r.isNotNull()), key))["ref"]


def _normal(value: object) -> object:
    """Texts in lower case with blanks collapsed, objects without their evidence, at any depth."""
    if isinstance(value, str):
        return " ".join(value.strip().lower().split())
    if isinstance(value, dict):
        return {k: _normal(v) for k, v in value.items() if _normal(k) != "evidence"}
    return [_normal(v) for v in value] if isinstance(value, list) else value


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks, of the normal form."""
    return json.dumps(_normal(value), sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def _hashed(payloads: pd.Series, values: pd.Series) -> pd.Series:
    """SHA-256 of the canonical payload; amounts are rounded to six places, half to even.  A value that is no JSON counts as text."""

    def one(payload: str, value: str | None) -> str:
        body = json.loads(payload)
        body |= {k: round(body[k], 6) for k in AMOUNTS if body.get(k) is not None}
        if body["kind"] != "line_item":
            try:
                body["value"] = None if value is None else json.loads(value)
            except ValueError:
                body["value"] = value
        return hashlib.sha256(canonical(body).encode()).hexdigest()

    return pd.Series([one(p, v) for p, v in zip(payloads, values, strict=True)], dtype=object)


def fingerprints(candidates: DataFrame) -> DataFrame:
    """Adds fingerprint: what a candidate says and where, by the rules of its kind."""
    rows = candidates.withColumn("_ref", best_reference(F.col("evidence")))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)

    def place(kind: Column, name: str) -> Column:
        return F.struct(kind.alias("locator_kind"), F.col("_ref.page_number").alias("page_number"), F.col("_ref.row_index").alias("row_index")).alias(name)

    none = F.coalesce(F.col("_ref"), F.from_json(F.lit("{}"), rows.schema["_ref"].dataType.simpleString()))
    region, table = place(locator(none, F.col("region_id")), "region"), place(locator(none), "table")
    kind = F.col("kind").alias("kind")
    whole = {"ignoreNullFields": "false"}
    payload = (
        F.when(F.col("kind") == "field", F.to_json(F.struct(kind, text("field_path"), region), whole))
        .when(F.col("kind") == "line_item", F.to_json(F.struct(kind, text("description"), text("code"), *AMOUNTS, text("currency"), text("category_hint"), region, table), whole))
        .otherwise(F.to_json(F.struct(kind, text("family"), text("semantic_type"), F.coalesce("field_path", F.lit("")).alias("field_name"), region), whole))
    )
    return rows.withColumn("fingerprint", _hashed(payload, F.col("value"))).drop("_ref")


def admit(candidates: DataFrame) -> DataFrame:
    """Events: candidates with fingerprint, decision and reason; reason is null for the admitted."""
    quality = F.col("quality_reason")
    poor = F.when(quality.isin(*ARTEFACTS), "rejected_artifact").when(F.contains(quality, F.lit("placeholder")) | F.contains(quality, F.lit("null")) | (quality == "missing_description"), "rejected_placeholder").otherwise("rejected_value_sanity")
    field, observed = F.col("kind") == "field", F.col("kind") == "observation"
    checks = (
        (F.col("source_reason").isNotNull(), F.lit("rejected_source_provenance"), F.col("source_reason")),
        (F.col("schema_reason").isNotNull() & ~observed, F.lit("rejected_family_schema"), F.col("schema_reason")),
        (quality.isNotNull(), poor, quality),
        (F.col("title_reason").isNotNull() & field, F.lit("rejected_source_provenance"), F.col("title_reason")),
        (F.col("evidence_reason").isNotNull(), F.lit("rejected_missing_evidence"), F.col("evidence_reason")),
    )
    found = F.lit(None).cast("struct<decision:string,reason:string>")
    for holds, decision, reason in reversed(checks):
        found = F.when(holds, F.struct(decision.alias("decision"), reason.alias("reason"))).otherwise(found)
    rows = fingerprints(candidates).withColumns({"_found": found, "_order": F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("phase"), F.col("pos").alias("pos"))})
    first = rows.filter("_found IS NULL").groupBy(F.col("run").alias("_run"), F.col("fingerprint").alias("_fp")).agg(F.min("_order").alias("_first"))
    both = rows.join(first, rows["run"].eqNullSafe(first["_run"]) & (rows["fingerprint"] == first["_fp"]), "left")
    twin = F.coalesce(F.col("_order") > F.col("_first"), F.lit(False))
    review = F.col("needs_review") | observed
    passed = F.struct(F.when(review, "admitted_review_required").otherwise("admitted_auto_promotable").alias("decision"), F.lit(None).cast("string").alias("reason"))
    told = F.when(twin, F.struct(F.lit("rejected_duplicate").alias("decision"), F.lit("duplicate_candidate_fingerprint").alias("reason"))).otherwise(F.coalesce("_found", passed))
    return both.withColumn("_told", told).withColumns({"decision": F.col("_told.decision"), "reason": F.col("_told.reason")}).drop("_found", "_order", "_run", "_fp", "_first", "_told")


def with_rejected(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Events and those of payloads that were rejected before they became candidates (columns of candidates, decision, reason), but for payloads
    whose fingerprint an event of the run has; of equal payloads the first counts."""
    raw = fingerprints(payloads)
    own = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "pos")
    least = raw.groupBy("run", "fingerprint").agg(F.min_by(F.struct(*[F.col(c) for c in events.columns if c not in ("run", "fingerprint")]), own).alias("r"))
    fresh = least.join(events.select("run", "fingerprint").distinct(), ["run", "fingerprint"], "left_anti")
    return events.unionByName(fresh.select("run", "fingerprint", "r.*"))


def summary(events: DataFrame) -> DataFrame:
    """(run, produced, admitted, rejected, reasons): counts of each run; reasons: rejections by decision, in their order."""
    counted = events.groupBy("run", "decision").agg(F.count("*").alias("n"))
    no = F.startswith(F.col("decision"), F.lit("rejected_"))
    out = counted.groupBy("run").agg(F.sum("n").alias("produced"), F.sum(F.when(~no, F.col("n")).otherwise(0)).alias("admitted"), F.sum(F.when(no, F.col("n")).otherwise(0)).alias("rejected"), F.sort_array(F.collect_list(F.when(no, F.struct("decision", "n")))).alias("reasons"))
    return out
