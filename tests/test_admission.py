"""Admission against a literal loop on shuffled candidates."""
import random
from collections import Counter

from foliospark.operators import admission

COLUMNS = f"run long, kind string, pos int, field_path string, value string, description string, code string, quantity double, unit_price double, gross_amount double, discount_amount double, tax_amount double, net_amount double, currency string, category_hint string, family string, semantic_type string, evidence {admission.EVIDENCE}, region_id string, needs_review boolean, source_reason string, schema_reason string, quality_reason string, title_reason string, evidence_reason string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def made(seed):
    r = random.Random(seed)
    pick = lambda *a: r.choice(a)
    out = []
    for kind in admission.KINDS:
        for pos in range(r.randrange(0, 14)):
            ref = lambda: (pick(None, 1, 2), pick(None, "p"), pick(None, None, 0, 3), pick(None, "t", ""), pick(None, "E 1", "e  1"), None, None, "s")
            out.append((
                seed, kind, pos, pick("a.b", " A.B ", "c"), pick("1", "1.0", '"X  y"', '"x y"', '{"k": 1, "Evidence": 2}', '{"k":1}', None, "no json"), pick("Oil", "oil ", None), pick(None, "7"), pick(None, 1.0000004, 1.0), None, None, None, None, pick(2.5, 3.0), "USD", None,
                "f", pick(None, "s"), [ref() for _ in range(r.randrange(0, 3))] if r.random() < 0.3 else None, "r", r.random() < 0.5,
                "src" if r.random() < 0.1 else None, "sch" if r.random() < 0.1 else None, pick(*[None] * 6, "null_value", "fake_schema_line_item", "odd"), "ttl" if r.random() < 0.1 else None, "evi" if r.random() < 0.1 else None,
            ))
    return out


def loop(rows, prints):
    """Decisions in order: only what was admitted blocks."""
    seen, out = set(), {}
    for row in rows:
        c = dict(zip(NAMES, row))
        fp, kind = prints[c["kind"], c["pos"]], c["kind"]
        if c["source_reason"]:
            got = "rejected_source_provenance", "src"
        elif c["schema_reason"] and kind != "observation":
            got = "rejected_family_schema", "sch"
        elif c["quality_reason"]:
            got = {"null_value": "rejected_placeholder", "fake_schema_line_item": "rejected_artifact", "odd": "rejected_value_sanity"}[c["quality_reason"]], c["quality_reason"]
        elif c["title_reason"] and kind == "field":
            got = "rejected_source_provenance", "ttl"
        elif c["evidence_reason"]:
            got = "rejected_missing_evidence", "evi"
        else:
            got = None
        if fp in seen:
            got = "rejected_duplicate", "duplicate_candidate_fingerprint"
        if got is None:
            seen.add(fp)
            got = ("admitted_review_required" if c["needs_review"] or kind == "observation" else "admitted_auto_promotable"), None
        out[kind, c["pos"]] = got
    return out


def test_loop(spark):
    runs = {seed: made(seed) for seed in range(40)}
    rows = [c for run in runs.values() for c in run]
    random.Random(0).shuffle(rows)
    events = admission.admit(spark.createDataFrame(rows, COLUMNS).repartition(3))
    got = {}
    for e in events.collect():
        got.setdefault(e.run, {})[e.kind, e.pos] = e
    twins = 0
    for seed, run in runs.items():
        own = got.get(seed, {})
        want = loop(run, {k: e.fingerprint for k, e in own.items()})
        assert {k: (e.decision, e.reason) for k, e in own.items()} == want
        twins += sum(d == "rejected_duplicate" for d, _ in want.values())
    assert twins > 20
    for s in admission.summary(events).collect():
        c = Counter(e.decision for e in got[s.run].values())
        assert (s.produced, s.admitted + s.rejected) == (sum(c.values()), s.produced)
        assert {r.decision: r.n for r in s.reasons} == {d: n for d, n in c.items() if d.startswith("rejected")}


def test_fingerprints(spark):
    """The same in other words, and the most specific reference."""
    base = dict(zip(NAMES, made(3)[0])) | {"kind": "field", "field_path": "a.b", "value": '"x y"', "evidence": [(1, None, None, None, None, None, None, None), (1, None, 4, "t", None, None, None, None)], "region_id": None}
    same = [base, base | {"field_path": "  A.B"}, base | {"value": '" X   Y "'}, base | {"evidence": base["evidence"][::-1]}, base | {"region_id": "r"}]
    other = [base | {"value": "1"}, base | {"value": "1.5"}, base | {"evidence": base["evidence"][:1]}, base | {"evidence": None}, base | {"evidence": None, "region_id": "r"}, base | {"kind": "observation"}]
    rows = [tuple((c | {"pos": k})[n] for n in NAMES) for k, c in enumerate(same + other)]
    got = [r.fingerprint for r in admission.fingerprints(spark.createDataFrame(rows, COLUMNS)).orderBy("pos").collect()]
    assert len(set(got[: len(same)])) == 1 and len(set(got)) == 1 + len(other)
    assert admission.canonical({"b": [" X  y", None], "a": {"Evidence": 1, "c": 1.5}}) == '{"a":{"c":1.5},"b":["x y",null]}'


def test_rejected_payloads(spark):
    rows = made(5)[:6]
    events = admission.admit(spark.createDataFrame(rows[:3], COLUMNS))
    from pyspark.sql import functions as F

    raw = spark.createDataFrame(rows + rows[4:], COLUMNS).withColumns({"decision": F.lit("rejected_artifact"), "reason": F.lit("planner")})
    both = admission.with_rejected(events, raw).collect()
    prints = [r.fingerprint for r in admission.fingerprints(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert len(both) == 3 + len(set(prints) - set(prints[:3]))
