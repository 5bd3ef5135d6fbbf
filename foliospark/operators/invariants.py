"""The twelve hard invariants of an extraction report: what breaks them, one scan a table, and how often, with first examples.

Columns.  tasks: document, id, status, backend, region_id, output_schema, kind, page, table_id, element_id, bbox, compatibility, contract_reason.
events: document, id, decision, engine, region_id, run_id, planner_version, fingerprint, gate_version, registry_version, plan_id, plan_task_id, annotation_id,
envelope_version, concrete (boolean), payload (JSON: the candidate, or an object that holds it).  rows (what was inserted): document, id, fingerprint.
extractions: document, id, scope, region_id, review_status, engine, model_name, schema, warnings (array), families (array).  fields: document, id,
field_path, status, fabricated (boolean), source, sources (array: of its evidence), allowed (boolean: a title may name the seller).
"""
from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from foliospark.functions.text import ECHOES, PLACEHOLDERS

# The invariants, engines that are models or are not, states of tasks and fields, required fields.
INVARIANTS = (
    "selectedTasksMissingContract", "selectedTasksMissingGrounding", "selectedTasksIncompatibleFamilySchema", "promptSchemaArtifactsAdmitted", "placeholderOrLiteralNullCandidatesAdmitted", "admittedCandidatesWithoutConcreteEvidence",
    "admissionEventsMissingTelemetry", "rejectedCandidatesInserted", "modelBackedSemanticRegionAutoAccepted", "fabricatedCanonicalRequiredFields", "titleDerivedMerchantSellerWithoutAllowlist", "aggregateSchemasFromIncompatibleFamilies",
)
MODELS = ("granite", "granite_vision", "granite_vision_3b", "model", "model_runtime", "qwen", "qwen_vl", "qwen3_vl_2b", "qwen3_vl_4b", "qwen3_vl_8b")
CHOSEN = ("enqueued", "queued", "running", "completed", "succeeded")
REFUSED = ("missing", "incompatible", "incompatible_family", "incompatible_schema", "incompatible_family_schema")
ACCEPTED = ("auto_accepted", "user_confirmed", "user_corrected", "accepted")
REQUIRED = ("invoice.invoice_number", "invoice.issued_date", "invoice.total_amount", "medical_eob.claim_number", "medical_eob.patient_name", "receipt.receipt_date", "receipt.total_amount")
SELLERS = ("merchant", "seller", "counterparty")
#: Keys whose values a placeholder or null must not fill; the caller's list.
VALUE_KEYS = ("value", "amount", "net_amount", "description")


def _low(c: str | Column) -> Column:
    return F.lower(F.btrim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def _snake(c: str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(F.btrim(F.coalesce(c, F.lit(""))), "(?<=[a-z0-9])(?=[A-Z])", "_")), "[ _-]+", "_"), F.lit("_"))


def _set(c: str) -> Column:
    return _low(c) != ""


def _model(engine: str) -> Column:
    return _low(engine).isin(*MODELS) | _low(engine).rlike("^(granite_vision_|qwen3_vl_)")


def _found(df: DataFrame, *rules: tuple[Column, str, str]) -> DataFrame:
    """(invariant, reason, document, entity): one row for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(name).alias("invariant"), F.lit(reason).alias("reason"))) for holds, name, reason in rules]))
    return df.select("document", F.col("id").cast("string").alias("entity"), F.explode(broken).alias("v")).select("v.invariant", "v.reason", "document", "entity")


def task_violations(tasks: DataFrame, lane: str = "granite") -> DataFrame:
    own = (F.startswith(_low("status"), F.lit("selected")) | _low("status").isin(*CHOSEN)) & F.contains(_low("backend"), F.lit(lane)) & _set("region_id")
    kind = _low("kind")
    grounded = (
        F.when(kind.isin("table", "docling_table"), _set("table_id") & _set("page"))
        .when(kind.isin("element", "text_element"), _set("element_id") & _set("page"))
        .when(kind.isin("page", "full_page", "region", "visual_region"), _set("page") | _set("bbox"))
        .otherwise(_set("page") | _set("table_id") | _set("element_id") | _set("bbox"))
    )
    odd = _snake("compatibility").isin(*REFUSED) | F.contains(_snake("contract_reason"), F.lit("incompatible")) | F.contains(_snake("contract_reason"), F.lit("missing_contract"))
    return _found(
        tasks.filter(own), (~_set("output_schema"), INVARIANTS[0], "missing_model_output_schema_name"), (~grounded, INVARIANTS[1], "missing_concrete_grounding"), (odd, INVARIANTS[2], "incompatible_schema_or_contract_resolution")
    )


def _token(text: str) -> str:
    out = "".join(f"_{c}" if c.isupper() and i and text[i - 1].islower() else c for i, c in enumerate(text.strip()))
    return "_".join(x for x in out.replace("-", "_").replace(" ", "_").lower().split("_") if x)


def _faults(value: object, keys: frozenset[str], key: str | None = None) -> set[str]:
    """echo and placeholder, if a leaf or a key at any depth says so."""
    if isinstance(value, dict):
        return {"echo" for k in value if any(e in k.lower() for e in ECHOES)}.union(*(_faults(v, keys, k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(_faults(v, keys, key) for v in value))
    counts = key is None or _token(key) in keys
    if value is None:
        return {"placeholder"} if counts else set()
    if not isinstance(value, str):
        return set()
    plain = {p.replace("_", "") for p in PLACEHOLDERS}
    empty = counts and (value.strip().lower() in PLACEHOLDERS or _token(value).replace("_", "") in plain)
    return ({"placeholder"} if empty else set()) | ({"echo"} if any(e in value.lower() for e in ECHOES) else set())


def faults(payload: Column, keys: tuple[str, ...] = VALUE_KEYS) -> Column:
    """array<string>: what is wrong with the candidate of a payload."""
    known = frozenset(keys)

    def one(text: str | None) -> list[str]:
        try:
            given = json.loads(text) if text else {}
        except ValueError:
            return []
        inner = given.get("candidate") if isinstance(given, dict) else None
        return sorted(_faults(inner if isinstance(inner, dict) and inner else given, known))

    @F.pandas_udf(ArrayType(StringType()))
    def scanned(payloads: pd.Series) -> pd.Series:
        return payloads.map(one)

    return scanned(payload)


def event_violations(events: DataFrame, versions: dict[str, str]) -> DataFrame:
    """versions: what planner_version, gate_version, registry_version and envelope_version have to be."""
    backed = _model("engine") | _set("region_id")
    tele, rules = INVARIANTS[6], []
    for c in ("run_id", "planner_version", "fingerprint", "gate_version", "registry_version"):
        rules.append((~_set(c), tele, f"missing_{c}"))
    for c in ("plan_id", "plan_task_id", "annotation_id", "envelope_version"):
        rules.append((backed & ~_set(c), tele, f"missing_{c}"))
    for c, want in versions.items():
        stale = (F.coalesce(c, F.lit("")) != "") & (F.btrim(c) != want)
        rules.append(((backed & stale) if c == "envelope_version" else stale, tele, f"stale_{c}"))
    admitted = F.startswith(_low("decision"), F.lit("admitted"))
    read = events.withColumn("_faults", F.when(admitted, faults(F.col("payload"))))
    return _found(
        read, *rules, (F.array_contains("_faults", "echo"), INVARIANTS[3], "admitted_prompt_or_schema_artifact"), (F.array_contains("_faults", "placeholder"), INVARIANTS[4], "admitted_placeholder_or_literal_null"),
        (admitted & ~F.coalesce("concrete", F.lit(False)), INVARIANTS[5], "admitted_without_concrete_evidence"),
    )


def inserted_violations(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that hold the fingerprint of a candidate rejected in their document."""
    gone = events.filter(F.startswith(_low("decision"), F.lit("rejected")) & _set("fingerprint")).select("document", "fingerprint").distinct()
    return _found(rows.join(gone, ["document", "fingerprint"], "left_semi"), (F.lit(True), INVARIANTS[7], "rejected_candidate_inserted"))


def extraction_violations(extractions: DataFrame) -> DataFrame:
    quiet = _low("engine").isin("deterministic", "docling", "docling_text", "fixture", "heuristic", "human", "system", "system_reconciler")
    backed = _model("engine") | (~quiet & _set("engine") & _set("model_name"))
    accepted = (_low("review_status") == "auto_accepted") & ((_low("scope") == "semantic_region") | _set("region_id")) & backed
    schema = _snake("schema")
    warned = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.contains(F.lower(w), F.lit("incompatible")))
    known = F.filter(F.transform(F.coalesce("families", F.array().cast("array<string>")), lambda f: F.lower(F.btrim(f))), lambda f: f != "")
    apart = (F.size(known) > 0) & ~F.array_contains(known, schema)
    whole = _low("scope").isin("aggregate", "document") & ~schema.isin("", "document_observation")
    return _found(extractions, (accepted, INVARIANTS[8], "model_backed_semantic_region_auto_accepted"), (whole & (F.coalesce(warned, F.lit(False)) | F.coalesce(apart, F.lit(False))), INVARIANTS[11], "aggregate_schema_from_incompatible_source_family"))


def field_violations(fields: DataFrame) -> DataFrame:
    path = F.array_join(F.filter(F.transform(F.split(F.coalesce("field_path", F.lit("")), "[.]"), lambda p: F.regexp_replace(F.lower(F.btrim(p)), "[ _-]+", "_")), lambda p: p != ""), ".")
    required = path.isin(*REQUIRED) | path.rlike("[.](invoice_number|total_amount)$")
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    made_up = F.coalesce("fabricated", F.lit(False)) | F.contains(_low("source"), F.lit("fabricated")) | (F.size(sources) == 0)
    title = lambda s: (s == "title") | F.contains(s, F.lit("document_title"))
    named = title(_snake("source")) | F.coalesce(F.exists(sources, lambda s: title(F.regexp_replace(F.lower(F.btrim(s)), "[ _-]+", "_"))), F.lit(False))
    seller = reduce(Column.__or__, [F.contains(path, F.lit(h)) for h in SELLERS])
    return _found(fields.filter(_low("status").isin(*ACCEPTED)), (required & made_up, INVARIANTS[9], "fabricated_required_field"), (seller & named & ~F.coalesce("allowed", F.lit(False)), INVARIANTS[10], "title_derived_merchant_seller_without_allowlist"))


def evaluated(*found: DataFrame, examples: int = 10) -> DataFrame:
    """(invariant, violations, passed, examples): every invariant comes; examples: the first by document, entity and reason."""
    rows = reduce(DataFrame.unionByName, found)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("invariant").orderBy("document", "entity", "reason"))).filter(F.col("_n") <= examples)  # a group limit, taken before the shuffle too
    some = first.groupBy("invariant").agg(F.sort_array(F.collect_list(F.struct("document", "entity", "reason"))).alias("examples"))
    count = rows.groupBy("invariant").agg(F.count("*").alias("violations"))
    names = rows.sparkSession.createDataFrame([(n,) for n in INVARIANTS], "invariant string")
    out = names.join(count, "invariant", "left").join(some, "invariant", "left").withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))
    return out.select("invariant", "violations", (F.col("violations") == 0).alias("passed"), F.coalesce("examples", F.array().cast(out.schema["examples"].dataType)).alias("examples"))
