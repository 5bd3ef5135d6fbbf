"""Budgeted choice of extraction tasks: which regions of a document are worth a model call.

Specs are rows; a document's few specs meet in one array, sorted by arrival, and one ordered fold makes the choice, since
the two budgets (a document's and a page's) and the quotas of the buckets depend on what was chosen before.  Everything runs in
the JVM; the only shuffle is by document.  A null where a key is compared equals another null.

Columns of specs: doc_id, pos (arrival, unique in a document), region_id, target_schema, output_schema, contract_reason,
compatibility, priority (int), ordinal (int), confidence, semantic_type, task, kind, page_id, element_id, table_id (strings),
expected_fields (array<string>), region_source, coverage_role, must_extract, continuation, page_label.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Semantic types of line items and summaries, contract modes, bucket quotas.
LINE_ITEM_TYPES = ("covered_services_line_item_table", "invoice_line_item_table", "receipt_line_item_table", "retail_order_line_item_table", "service_record_line_item_table", "dispute_transaction_table")
SUMMARY_TYPES = ("billing_summary", "payment_summary", "patient_responsibility_summary", "receipt_payment_summary", "escrow_summary", "mortgage_payment_summary")
STRUCTURAL = "docling_structural"
REFUSED = ("missing", "incompatible", "incompatible_family", "incompatible_schema", "incompatible_family_schema")
QUOTAS = (("line_item", 4), ("summary", 2), ("docling_table", 3), ("observation_primary", 2), ("other", 2))


@dataclass(frozen=True)
class Budget:
    """Tasks a document and a page; quotas of the buckets, which are served in this order."""

    document: int = 6
    page: int = 3
    quotas: tuple[tuple[str, int], ...] = QUOTAS


def _taxonomy(c: str) -> Column:
    """Lower case, and one underscore for each run of blanks, hyphens and underscores."""
    return F.btrim(F.regexp_replace(F.lower(F.btrim(F.coalesce(c, F.lit("")))), "[ _-]+", "_"), F.lit("_"))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def judged(specs: DataFrame) -> DataFrame:
    """Adds reason (null: can be chosen), bucket, page_key, rank (in the document; smaller is better, ties are equal) and key (specs with one key are one task)."""
    mode, why = _taxonomy("compatibility"), _taxonomy("contract_reason")
    generic = (mode == "generic_review_only") | (why == "generic_review_only_fallback")
    grounded = F.when(F.col("kind") == "page", F.col("page_id").isNotNull()).when(F.col("kind") == "element", F.col("element_id").isNotNull()).when(F.col("kind") == "table", F.col("table_id").isNotNull()).otherwise(False)
    reason = (
        F.when(F.btrim(F.coalesce("output_schema", F.lit(""))) == "", "missing_contract")
        .when(~grounded, "missing_grounding")
        .when(mode.isin(*REFUSED) | F.contains(why, F.lit("incompatible")) | F.contains(why, F.lit("missing_contract")), "incompatible_schema")
    )
    structural = F.coalesce(F.col("region_source") == STRUCTURAL, F.lit(False))
    bucket = (
        F.when(generic, "generic_fallback")
        .when(F.col("semantic_type").isin(*LINE_ITEM_TYPES), "line_item")
        .when(structural & F.col("table_id").isNotNull(), "docling_table")
        .when((F.col("target_schema") == "document_observation") & (F.col("coverage_role") == "primary"), "observation_primary")
        .when(F.col("semantic_type").isin(*SUMMARY_TYPES), "summary")
        .otherwise("other")
    )
    contract = (
        F.when((mode == "exact") | (why == "exact_contract"), 0)
        .when((mode == "compatible_alias") | (why == "compatible_alias_contract"), 1)
        .when(generic, 4)
        .when(F.contains(mode, F.lit("missing")) | F.contains(why, F.lit("missing")), 5)
        .otherwise(2)
    )
    source = F.when(_filled("must_extract"), 0).when(structural, 1).otherwise(2)
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(contract, "priority", source, F.coalesce("confidence", F.lit(0.0)).desc(), "ordinal"))
    intent = F.when(F.col("element_id").isNull() & F.col("table_id").isNull(), F.coalesce("expected_fields", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    key = F.to_json(F.struct("target_schema", "semantic_type", "task", "region_source", "coverage_role", "kind", "page_id", "element_id", "table_id", intent.alias("intent")))
    return specs.withColumns({
        "reason": reason, "bucket": bucket, "page_key": F.coalesce("page_id", "page_label", F.lit("unknown")), "rank": rank, "key": key,
        "rescue": (bucket == "line_item") & (_filled("must_extract") | _filled("continuation")),
    })


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _distinct_specs(specs: Column) -> Column:
    """(best, lost) of specs in arrival order: of a key the best rank stays, in the place of the key's first spec."""

    def step(acc: Column, s: Column) -> Column:
        at = F.array_position(F.transform(acc["best"], lambda b: b["key"]), s["key"])
        old = F.get(acc["best"], (at - 1).cast("int"))
        wins = s["rank"] < old["rank"]
        best = F.when(at == 0, F.concat(acc["best"], F.array(s))).when(wins, F.transform(acc["best"], lambda b: F.when(b["key"] == s["key"], s).otherwise(b))).otherwise(acc["best"])
        lost = F.when(at == 0, acc["lost"]).otherwise(F.concat(acc["lost"], F.array(F.when(wins, old).otherwise(s))))
        return F.struct(best.alias("best"), lost.alias("lost"))

    none = F.filter(specs, lambda s: F.lit(False))
    return F.aggregate(specs, F.struct(none.alias("best"), none.alias("lost")), step)


def _queue(best: Column, budget: Budget) -> Column:
    """The order in which specs are looked at: buckets by quota, then all again, then those that are never lost."""
    keyed = F.transform(best, lambda s, i: F.struct(s["rank"].alias("rank"), i.alias("i"), s.alias("s")))
    turn = lambda phase, lst: F.transform(lst, lambda s: F.struct(F.lit(phase).alias("phase"), s.alias("s")))

    def turns(ranked: Column) -> Column:
        heads = [turn(0, F.slice(F.filter(ranked, lambda s: s["bucket"] == name), 1, quota)) for name, quota in budget.quotas]  # noqa: B023
        return F.concat(*heads, turn(1, ranked), turn(2, F.filter(ranked, lambda s: s["rescue"])))

    return _let(F.transform(F.sort_array(keyed), lambda x: x["s"]), turns)


def _chosen(queue: Column, budget: Budget) -> Column:
    """(picks, pages, warnings) after the whole queue."""

    def step(acc: Column, x: Column) -> Column:
        s, phase = x["s"], x["phase"]
        known = F.array_contains(acc["picks"], s["pos"])
        full = F.size(acc["picks"]) >= budget.document
        crowded = F.size(F.filter(acc["pages"], lambda p: p == s["page_key"])) >= budget.page
        takes = ~known & ((phase == 2) | (~full & ~crowded))
        said = (
            F.when(known, F.lit(None).cast("string"))
            .when(phase == 2, F.concat(F.lit("plan_line_item_budget_rescued:"), s["region_id"]))
            .when(full, F.when(phase == 0, F.concat(F.lit("plan_hard_limit_reached_before_"), s["bucket"])))
            .when(crowded, F.concat(F.lit("plan_page_limit_reached:"), s["page_key"]))
        )
        grown = lambda name, value: F.when(takes, F.concat(acc[name], F.array(value))).otherwise(acc[name]).alias(name)
        return F.struct(grown("picks", s["pos"]), grown("pages", s["page_key"]), F.when(said.isNull(), acc["warnings"]).otherwise(F.concat(acc["warnings"], F.array(said))).alias("warnings"))

    empty = F.array().cast("array<string>")
    return F.aggregate(queue, F.struct(F.array().cast("array<long>").alias("picks"), empty.alias("pages"), empty.alias("warnings")), step)


def plan(specs: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """One row a document: doc_id, selected, dropped, warnings, bucket_counts.

    selected: structs (pos, region_id, bucket, page_key) in the order of choice; dropped: structs (pos, region_id, status,
    reason), first what cannot be chosen, then suppressed duplicates, then what the budgets left out."""
    fields = ("pos", "region_id", "bucket", "page_key", "rank", "key", "rescue", "reason", "must_extract", "semantic_type")
    rows = judged(specs).select("doc_id", F.struct(*[F.col(c).cast("long").alias(c) if c == "pos" else F.col(c) for c in fields]).alias("s"))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("specs"))  # a document's specs are few
    valid, invalid = F.filter("specs", lambda s: s["reason"].isNull()), F.filter("specs", lambda s: s["reason"].isNotNull())
    choice = lambda d: _let(_chosen(_queue(d["best"], budget), budget), lambda done: _report(invalid, d["best"], d["lost"], done))
    made = docs.select("doc_id", _let(_distinct_specs(valid), choice).alias("plan"))
    # one row a document as it is, without a shuffle: filters on the result cannot be pushed below, where they would repeat the fold
    return made.groupBy("doc_id").agg(F.first("plan").alias("plan")).select("doc_id", "plan.*")


def _report(invalid: Column, best: Column, lost: Column, done: Column) -> Column:
    """(selected, dropped, warnings, bucket_counts) of a finished fold."""
    left = F.filter(best, lambda s: ~F.array_contains(done["picks"], s["pos"]))
    out = lambda lst, status, reason: F.transform(lst, lambda s: F.struct(s["pos"].alias("pos"), s["region_id"].alias("region_id"), status(s).alias("status"), reason(s).alias("reason")))
    dropped = F.concat(
        out(invalid, lambda s: F.concat(F.lit("skipped_"), s["reason"]), lambda s: s["reason"]),
        out(lost, lambda s: F.lit("suppressed_duplicate"), lambda s: F.lit("duplicate_suppressed")),
        out(left, lambda s: F.lit("skipped_budget_exceeded"), lambda s: F.lit("planner_budget_or_fanout_policy")),
    )
    must = F.filter(F.concat(invalid, lost, left), lambda s: F.coalesce(s["must_extract"], F.lit("")) != "")
    warnings = F.array_distinct(F.concat(
        F.transform(invalid, lambda s: F.concat(F.lit("plan_"), s["reason"], F.lit(":"), s["region_id"])),
        F.transform(lost, lambda s: F.concat(F.lit("plan_duplicate_suppressed:"), s["region_id"])),
        done["warnings"],
        F.transform(must, lambda s: F.concat_ws(":", F.lit("dropped_must_extract_target"), F.coalesce(s["semantic_type"], F.lit("None")), s["must_extract"])),
    ))
    pick = lambda s: F.struct(s["pos"].alias("pos"), s["region_id"].alias("region_id"), s["bucket"].alias("bucket"), s["page_key"].alias("page_key"))
    selected = F.transform(done["picks"], lambda p: F.element_at(F.transform(F.filter(best, lambda s: s["pos"] == p), pick), 1))
    names = F.array_sort(F.array_distinct(F.transform(best, lambda s: s["bucket"])))
    counts = F.transform(names, lambda b: F.struct(b.alias("bucket"), F.size(F.filter(best, lambda s: s["bucket"] == b)).alias("n")))
    return F.struct(selected.alias("selected"), dropped.alias("dropped"), warnings.alias("warnings"), counts.alias("bucket_counts"))


def planned_tasks(plans: DataFrame) -> DataFrame:
    """One row a spec: doc_id, pos, region_id, place (from 1; null if dropped), status, reason."""
    taken = plans.select("doc_id", F.posexplode("selected").alias("at", "s")).select("doc_id", "s.pos", "s.region_id", (F.col("at") + 1).alias("place"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reason"))
    lost = plans.select("doc_id", F.explode("dropped").alias("s")).select("doc_id", "s.pos", "s.region_id", F.lit(None).cast("int").alias("place"), "s.status", "s.reason")
    return taken.unionByName(lost)
