"""The planner against a literal loop on random specs."""
import random
import re

import pytest

from foliospark.operators import planner

COLUMNS = "doc_id long, pos int, region_id string, target_schema string, output_schema string, contract_reason string, compatibility string, priority int, ordinal int, confidence double, semantic_type string, task string, kind string, page_id string, element_id string, table_id string, expected_fields array<string>, region_source string, coverage_role string, must_extract string, continuation string, page_label string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def norm(v):
    return "_".join(x for x in re.split("[ _-]", (v or "").strip().lower()) if x)


def loop(specs):
    """The rule, written out for one document."""
    def generic(s):
        return norm(s["compatibility"]) == "generic_review_only" or norm(s["contract_reason"]) == "generic_review_only_fallback"

    def reason(s):
        mode, why = norm(s["compatibility"]), norm(s["contract_reason"])
        if not (s["output_schema"] or "").strip():
            return "missing_contract"
        if s["kind"] not in ("page", "element", "table") or s[s["kind"] + "_id"] is None:
            return "missing_grounding"
        if mode in planner.REFUSED or "incompatible" in why or "missing_contract" in why:
            return "incompatible_schema"
        return None

    def bucket(s):
        if generic(s):
            return "generic_fallback"
        if s["semantic_type"] in planner.LINE_ITEM_TYPES:
            return "line_item"
        if s["region_source"] == planner.STRUCTURAL and s["table_id"]:
            return "docling_table"
        if s["target_schema"] == "document_observation" and s["coverage_role"] == "primary":
            return "observation_primary"
        return "summary" if s["semantic_type"] in planner.SUMMARY_TYPES else "other"

    def rank(s):
        mode, why = norm(s["compatibility"]), norm(s["contract_reason"])
        contract = 0 if mode == "exact" or why == "exact_contract" else 1 if mode == "compatible_alias" or why == "compatible_alias_contract" else 4 if generic(s) else 5 if "missing" in mode or "missing" in why else 2
        return (contract, s["priority"], 0 if s["must_extract"] else 1 if s["region_source"] == planner.STRUCTURAL else 2, -(s["confidence"] or 0.0), s["ordinal"])

    def page(s):
        return s["page_id"] if s["page_id"] is not None else s["page_label"] if s["page_label"] is not None else "unknown"

    said, best, lost = [], {}, []
    invalid = [s for s in specs if reason(s)]
    said += [f"plan_{reason(s)}:{s['region_id']}" for s in invalid]
    for s in specs:
        if reason(s):
            continue
        intent = tuple(s["expected_fields"] or ()) if s["element_id"] is None and s["table_id"] is None else ()
        key = (*(s[c] for c in ("target_schema", "semantic_type", "task", "region_source", "coverage_role", "kind", "page_id", "element_id", "table_id")), intent)
        if key not in best:
            best[key] = s
        elif rank(s) < rank(best[key]):
            lost.append(best[key])
            best[key] = s
        else:
            lost.append(s)
    said += [f"plan_duplicate_suppressed:{s['region_id']}" for s in lost]
    left, picked, pages = list(best.values()), [], {}

    def take(s):
        if pages.get(page(s), 0) >= 3:
            said.append(f"plan_page_limit_reached:{page(s)}")
            return
        picked.append(s)
        pages[page(s)] = pages.get(page(s), 0) + 1

    for name, quota in (("line_item", 4), ("summary", 2), ("docling_table", 3), ("observation_primary", 2), ("other", 2)):
        for s in sorted((s for s in left if bucket(s) == name), key=rank)[:quota]:
            if len(picked) >= 6:
                said.append(f"plan_hard_limit_reached_before_{name}")
                break
            take(s)
    for s in sorted((s for s in left if s not in picked), key=rank):
        if len(picked) >= 6:
            break
        take(s)
    for s in sorted((s for s in left if s not in picked and bucket(s) == "line_item" and (s["must_extract"] or s["continuation"])), key=rank):
        picked.append(s)
        said.append(f"plan_line_item_budget_rescued:{s['region_id']}")
    out = [(s["pos"], f"skipped_{reason(s)}") for s in invalid] + [(s["pos"], "suppressed_duplicate") for s in lost] + [(s["pos"], "skipped_budget_exceeded") for s in left if s not in picked]
    by = {s["pos"]: s for s in specs}
    said += [f"dropped_must_extract_target:{by[p]['semantic_type']}:{by[p]['must_extract']}" for p, _ in out if by[p]["must_extract"]]
    counts = {}
    for s in left:
        counts[bucket(s)] = counts.get(bucket(s), 0) + 1
    return [s["pos"] for s in picked], out, list(dict.fromkeys(said)), counts


def made(seed):
    r = random.Random(seed)
    pick = lambda *a: r.choice(a)
    return [
        dict(zip(NAMES, (
            seed, k, f"r{k}", pick("invoice", "document_observation", None), pick("s", "s", "s", "s", " ", None), pick("exact_contract", "Compatible-Alias  contract", "", None, None, "missing_contract x", "generic_review_only_fallback"),
            pick("exact", "compatible alias", None, None, "Incompatible", "generic-review-only", "missing fields"), r.randrange(3), r.randrange(4), pick(None, 0.2, 0.9, 0.5), pick("invoice_line_item_table", "invoice_line_item_table", "billing_summary", "clause", None), pick("t", None),
            pick("page", "page", "element", "table", "unmatched_region"), pick("p1", "p1", "p2", None), pick("e1", "e2", None, None), pick("t1", "t2", None), pick(["a"], ["a", "b"], [], None), pick("docling_structural", None), pick("primary", None),
            pick("must", "", None, None), pick("g", "", None, None), pick("9", None),
        )))
        for k in range(r.randrange(1, 45))
    ]


def test_random_specs(spark):
    docs = {seed: made(seed) for seed in range(60)}
    rows = [tuple(s.values()) for specs in docs.values() for s in specs]
    random.Random(1).shuffle(rows)
    plans = planner.plan(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    assert len(plans) == len(docs)
    rescued = 0
    for p in plans:
        picked, out, said, counts = loop(docs[p.doc_id])
        assert [s.pos for s in p.selected] == picked
        assert [(s.pos, s.status) for s in p.dropped] == out
        assert p.warnings == said
        assert {c.bucket: c.n for c in p.bucket_counts} == counts
        rescued += len(picked) > 6
    assert rescued


def test_tasks_and_no_specs(spark):
    specs = made(5)
    df = spark.createDataFrame([tuple(s.values()) for s in specs], COLUMNS)
    tasks = planner.planned_tasks(planner.plan(df)).collect()
    assert sorted(t.pos for t in tasks) == [s["pos"] for s in specs]
    assert sorted(t.place for t in tasks if t.place) == list(range(1, sum(t.place is not None for t in tasks) + 1))
    assert planner.plan(df.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [planner.Budget(2, 1), planner.Budget(100, 100)])
def test_other_budgets(spark, budget):
    df = spark.createDataFrame([tuple(s.values()) for k in range(5) for s in made(k)], COLUMNS)
    for p in planner.plan(df, budget).collect():
        rescued = sum("rescued" in w for w in p.warnings)
        assert len(p.selected) <= budget.document + rescued
        if budget.document == 100:
            assert not any(d.status == "skipped_budget_exceeded" for d in p.dropped)
