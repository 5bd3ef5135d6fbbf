"""One planted violation of each kind is found, and nothing else; clean rows beside each."""
from foliospark.operators import invariants as I

VERSIONS = {"planner_version": "p1", "gate_version": "g1", "registry_version": "r1", "envelope_version": "e1"}
TASK = dict(document=1, id="t", status="selected_for_run", backend="granite_local", region_id="r", output_schema="s", kind="table", page="1", table_id="x", element_id=None, bbox=None, compatibility="exact", contract_reason="exact_contract")
EVENT = dict(document=1, id="e", decision="admitted_auto_promotable", engine="granite", region_id="r", run_id="u", planner_version="p1", fingerprint="f", gate_version="g1", registry_version="r1", plan_id="p", plan_task_id="k", annotation_id="a", envelope_version="e1", concrete=True, payload='{"value": "12", "currency": null}')
EXTRACTION = dict(document=1, id="x", scope="semantic_region", region_id="r", review_status="needs_review", engine="qwen3_vl_99", model_name="m", schema="invoice", warnings=None, families=None)
FIELD = dict(document=1, id="c", field_path="invoice.total_amount", status="auto_accepted", fabricated=False, source="page", sources=["page"], allowed=False)
KINDS = {"concrete": "boolean", "fabricated": "boolean", "allowed": "boolean", "document": "long", "warnings": "array<string>", "families": "array<string>", "sources": "array<string>"}


def frame(spark, base, *changes):
    rows = [tuple((base | c).values()) for c in ({}, *changes)]
    return spark.createDataFrame(rows, ", ".join(f"{k} {KINDS.get(k, 'string')}" for k in base))


def found(df):
    return sorted((r.invariant, r.entity, r.reason) for r in df.collect())


def test_tasks(spark):
    got = found(I.task_violations(frame(spark, TASK, dict(id="a", output_schema=" "), dict(id="b", table_id=None), dict(id="c", compatibility="Incompatible Family"), dict(id="d", status="dropped", output_schema=None), dict(id="e", backend="text", output_schema=None),
                                        dict(id="f", kind="region", page=None, bbox="1"), dict(id="g", kind=None, page=None, table_id=None), dict(id="h", contract_reason="missing-contract"))))
    assert got == sorted([(I.INVARIANTS[0], "a", "missing_model_output_schema_name"), (I.INVARIANTS[1], "b", "missing_concrete_grounding"), (I.INVARIANTS[2], "c", "incompatible_schema_or_contract_resolution"),
                          (I.INVARIANTS[1], "g", "missing_concrete_grounding"), (I.INVARIANTS[2], "h", "incompatible_schema_or_contract_resolution")])


def test_events(spark):
    got = found(I.event_violations(frame(
        spark, EVENT, dict(id="a", payload='{"candidate": {"lines": [{"description": "x", "amount": [null]}]}}'), dict(id="b", payload='{"deep": [{"note": "Return only JSON"}]}'), dict(id="c", concrete=None), dict(id="d", run_id=""),
        dict(id="e", gate_version="g0"), dict(id="f", plan_id=None), dict(id="g", plan_id=None, engine="human", region_id=None), dict(id="h", decision="rejected_placeholder", payload='{"value": null}', concrete=False), dict(id="i", payload='{"Value": " N/A "}'),
        dict(id="j", payload='{"json_schema": {"a": 1}}'), dict(id="k", payload="no json"), dict(id="l", payload=None),
    ), VERSIONS))
    assert got == sorted([(I.INVARIANTS[4], "a", "admitted_placeholder_or_literal_null"), (I.INVARIANTS[3], "b", "admitted_prompt_or_schema_artifact"), (I.INVARIANTS[5], "c", "admitted_without_concrete_evidence"), (I.INVARIANTS[6], "d", "missing_run_id"),
                          (I.INVARIANTS[6], "e", "stale_gate_version"), (I.INVARIANTS[6], "f", "missing_plan_id"), (I.INVARIANTS[4], "i", "admitted_placeholder_or_literal_null"), (I.INVARIANTS[3], "j", "admitted_prompt_or_schema_artifact")])


def test_rows_extractions_fields(spark):
    events = frame(spark, EVENT, dict(id="a", decision="rejected_artifact", fingerprint="bad"), dict(id="b", decision="rejected_artifact", fingerprint=None))
    rows = spark.createDataFrame([(1, "i", "bad"), (2, "j", "bad"), (1, "k", "f"), (1, "l", None)], "document long, id string, fingerprint string")
    assert found(I.inserted_violations(events, rows)) == [(I.INVARIANTS[7], "i", "rejected_candidate_inserted")]
    got = found(I.extraction_violations(frame(spark, EXTRACTION, dict(id="a", review_status="auto_accepted"), dict(id="b", review_status="auto_accepted", engine="docling"), dict(id="c", scope="aggregate", warnings=["Incompatible family"]), dict(id="d", scope="document", families=["receipt", ""]),
                                              dict(id="e", scope="document", families=["Invoice"]), dict(id="f", scope="document", schema="document_observation", families=["receipt"]), dict(id="g", families=["receipt"]))))
    assert got == sorted([(I.INVARIANTS[8], "a", "model_backed_semantic_region_auto_accepted"), (I.INVARIANTS[11], "c", "aggregate_schema_from_incompatible_source_family"), (I.INVARIANTS[11], "d", "aggregate_schema_from_incompatible_source_family")])
    got = found(I.field_violations(frame(spark, FIELD, dict(id="a", sources=[]), dict(id="b", fabricated=True, field_path=" Receipt. Total Amount"), dict(id="d", field_path="receipt.merchant", sources=["page", "Document Title"]), dict(id="e", field_path="receipt.merchant", source="title", allowed=True),
                                         dict(id="f", status="needs_review", sources=None), dict(id="g", field_path="notes", sources=None))))
    assert got == sorted([(I.INVARIANTS[9], "a", "fabricated_required_field"), (I.INVARIANTS[9], "b", "fabricated_required_field"), (I.INVARIANTS[10], "d", "title_derived_merchant_seller_without_allowlist")])


def test_report(spark):
    many = frame(spark, TASK, *[dict(id=f"{k:03}", output_schema=None) for k in range(40)])
    got = {r.invariant: r for r in I.evaluated(I.task_violations(many), I.field_violations(frame(spark, FIELD))).collect()}
    assert set(got) == set(I.INVARIANTS) and [n for n, r in got.items() if not r.passed] == [I.INVARIANTS[0]]
    assert got[I.INVARIANTS[0]].violations == 40 and [e.entity for e in got[I.INVARIANTS[0]].examples] == [f"{k:03}" for k in range(10)]
