"""Facts to canon: pivots, invariants, resolution, dedupe, admission, suggestions, rules."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = "0.02"


def pivot_roles(amounts: DataFrame, roles: list[str]) -> DataFrame:
    """One row a document with the largest amount of each role."""
    return amounts.groupBy("id").agg(*[F.max(F.when(F.col("role") == r, F.col("amount"))).alias(r.lower()) for r in roles])


def sum_check(total: Column, addends: list[Column], optional: list[Column] = (), subtract: list[Column] = (), missing: Column | None = None) -> Column:
    """ok, failed, or inconclusive where a missing optional part could explain the gap; null parts count as zero."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(18,4)"))
    gap = total - reduce(Column.__add__, [zero(c) for c in [*addends, *optional]]) + reduce(Column.__add__, [zero(c) for c in subtract], F.lit(0).cast("decimal(18,4)"))
    lacks = reduce(Column.__or__, [c.isNull() for c in optional], F.lit(False))
    lacks_minus = reduce(Column.__or__, [c.isNull() for c in subtract], F.lit(False))
    tol = F.lit(TOLERANCE).cast("decimal(18,4)")
    return F.when(total.isNull() | reduce(Column.__or__, [c.isNull() for c in addends]), "inconclusive").when(F.abs(gap) <= tol, "ok").when((gap > 0) & lacks | (gap < 0) & lacks_minus, "inconclusive").otherwise("failed")


def resolve(claims: DataFrame, *key: str) -> DataFrame:
    """claims: key columns, value, engine, claim_id.  The winner of each key by engine precedence, value and id, and how it won."""
    key = key or ("key",)
    rank = F.when(F.col("engine") == "granite", 30).otherwise(20)
    best = claims.groupBy(*key).agg(F.min_by(F.struct("value", "engine", "claim_id"), F.struct((-rank).alias("r"), "value", "claim_id")).alias("w"), F.count("*").alias("claims"), (F.min("value") < F.max("value")).alias("several"))
    how = F.when(F.col("claims") == 1, "single_source").when(~F.col("several"), "multi_source_agreement").otherwise("source_precedence_conflict")
    return best.select(*key, F.col("w.value").alias("value"), F.col("w.claim_id").alias("claim_id"), how.alias("decision"), F.coalesce("several", F.lit(False)).alias("needs_review"), "claims")


def richest(rows: DataFrame, key: list[str], richness: Column, position: str) -> DataFrame:
    """One row a key: the richest, the first of equals."""
    w = Window.partitionBy(*key).orderBy(richness.desc(), position)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def admit(rows: DataFrame, reasons: list[tuple[str, Column]], fingerprint: Column, position: str) -> DataFrame:
    """Adds decision and reason.  The first reason that holds rejects; a row whose fingerprint an earlier admissible row has is a duplicate.

    The earliest admissible row of each fingerprint comes from one aggregate, so a frequent fingerprint is no group anywhere."""
    reason = reduce(lambda a, r: a.when(r[1], r[0]), reasons[1:], F.when(reasons[0][1], reasons[0][0]))
    rows = rows.withColumns({"_fp": fingerprint, "_why": reason})
    first = rows.filter("_why IS NULL").groupBy(F.col("_fp").alias("_of")).agg(F.min(position).alias("_first"))
    both = rows.join(first, rows["_fp"].eqNullSafe(first["_of"]), "left")
    dup = F.coalesce(F.col(position) > F.col("_first"), F.lit(False))
    return both.withColumn("reason", F.when(dup, "duplicate").otherwise(F.col("_why"))).withColumn("decision", F.when(F.col("reason").isNull(), "admitted").otherwise("rejected")).drop("_fp", "_why", "_of", "_first")


# Which families relate, from and to, and as what.
FAMILY_LINKS = (("invoice", "receipt", "invoice_for"), ("receipt", "invoice", "receipt_for"), ("medical_eob", "medical_bill", "eob_for"), ("medical_bill", "medical_eob", "bill_for"), ("warranty", "receipt", "warranty_for"), ("receipt", "warranty", "receipt_for"), ("legal_contract", "legal_contract", "amendment_to"))


def relationship_suggestions(docs: DataFrame, days: int = 45, context: int = 100) -> DataFrame:
    """docs: id, family, contact, day, sha.  (a, b, kind, confidence): copies by content (0.99), else documents of one contact whose
    families relate, 0.86 if their days are near and 0.78 if not or unknown.

    Copies are linked to the smallest id of their content.  Each rule reads from a document to its counterpart, so an invoice and a receipt give
    `invoice_for` one way and `receipt_for` the other; of two documents of one family the pair comes once.

    The rule looks at the `context` latest documents of a contact: a pair needs one of them.  That limit is the feature's own, and it
    keeps a frequent contact from giving a quadratic number of pairs."""
    first = docs.filter("sha IS NOT NULL").groupBy(F.col("sha").alias("_sha")).agg(F.min("id").alias("a"))
    copies = docs.join(first, (F.col("sha") == F.col("_sha")) & (F.col("id") > F.col("a"))).select("a", F.col("id").alias("b"), F.lit("duplicate_of").alias("kind"), F.lit(0.99).alias("confidence"))
    link = docs.sparkSession.createDataFrame(list(FAMILY_LINKS), "family string, b_family string, kind string")
    latest = Window.partitionBy("contact").orderBy(F.col("day").desc_nulls_last(), "id")
    recent = docs.filter("contact IS NOT NULL").withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= context).drop("_n")
    named = lambda df: df.select(F.col("id").alias("b"), F.col("contact").alias("b_contact"), F.col("family").alias("b_family"), F.col("day").alias("b_day"), F.col("sha").alias("b_sha"))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        both = left.join(F.broadcast(link), "family").join(named(right), "b_family").filter((F.col("contact") == F.col("b_contact")) & (F.col("id") != F.col("b")) & ((F.col("family") != F.col("b_family")) | (F.col("id") < F.col("b"))))
        near = F.coalesce(F.abs(F.datediff("day", "b_day")) <= days, F.lit(False))
        return both.filter("NOT coalesce(sha = b_sha, false)").select(F.col("id").alias("a"), "b", "kind", F.when(near, 0.86).otherwise(0.78).alias("confidence"))

    return copies.unionByName(pairs(docs, recent).unionByName(pairs(recent, docs)).distinct())


def undirected(edges: DataFrame) -> DataFrame:
    """(id, other): both directions, so that `id IN (a, b)` becomes an equi-join."""
    return edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))


# rules


# What rules may test and do.
FIELDS = ("document_family", "document_subtype", "counterparty", "contacts", "tags", "folders", "folder_paths", "folder_ids", "document_date", "amount_total", "review_status", "sensitivity", "search_text")
OPERATORS = ("eq", "neq", "contains", "in", "gte", "lte", "exists", "regex")
ACTIONS = ("add_folder", "set_primary_folder", "add_tag", "set_sensitivity", "create_review_task", "set_document_type")
SENSITIVITIES = ("normal", "pii", "financial", "medical", "legal", "highly_sensitive")
FAMILIES = ("generic", "receipt", "invoice", "medical_eob", "medical_bill", "insurance_document", "legal_contract", "legal_notice", "tax_document", "warranty", "identity_document", "bank_statement", "financial_statement", "handwritten_note", "typed_note", "whitepaper", "reference_document")
GUARDED = {"sensitivity": ("medical", "legal", "financial", "pii", "highly_sensitive"), "family": ("medical_eob", "medical_bill", "insurance_document", "legal_contract", "legal_notice", "tax_document", "identity_document")}
NESTED = re.compile(r"\([^)]*[*+][^)]*\)\s*[*+{]")


def check_pattern(value: object) -> str:
    if not isinstance(value, str) or not value or len(value) > 128 or NESTED.search(value):
        raise ValueError("a pattern is a text of 128 characters at most without quantifiers in quantified groups")
    try:
        re.compile(value)
    except re.error as e:
        raise ValueError(f"not a pattern: {e}") from None
    return value


def checked_rule(rule: dict, fields: tuple[str, ...] = FIELDS) -> dict:
    """A rule with name, conditions, actions, priority, enabled and review_required in place, or ValueError."""
    named = lambda x, what: " ".join(x.split()) if isinstance(x, str) and x.strip() else _bad(f"{what} is missing")
    out = {"name": named(rule.get("name"), "name"), "enabled": bool(rule.get("enabled", True)), "priority": int(rule.get("priority", 50)), "review_required": bool(rule.get("review_required", rule.get("reviewRequired", True)))}
    if not 0 <= out["priority"] <= 100:
        raise ValueError("the priority is not between 0 and 100")
    for part in ("conditions", "actions"):
        if not isinstance(rule.get(part), list) or not rule[part]:
            raise ValueError(f"{part} are missing")
    out["conditions"] = []
    for c in rule["conditions"]:
        field, op = named(c.get("field"), "field"), named(c.get("op"), "operator")
        if field not in fields and not field.startswith("canonical."):
            raise ValueError(f"no such field: {field}")
        if op not in OPERATORS:
            raise ValueError(f"no such operator: {op}")
        if op != "exists" and "value" not in c:
            raise ValueError("a value is missing")
        if op == "regex":
            check_pattern(c["value"])
        out["conditions"].append({"field": field, "op": op, "value": c.get("value")})
    out["actions"] = [_checked_action(a, named) for a in rule["actions"]]
    return out


def _bad(why: str):
    raise ValueError(why)


def _checked_action(action: dict, named) -> dict:
    out = dict(action, type=named(action.get("type"), "action"))
    if out["type"] not in ACTIONS:
        raise ValueError(f"no such action: {out['type']}")
    if out["type"] in ("add_folder", "set_primary_folder") and not (out.get("folder_id") or out.get("folder_path")):
        raise ValueError("a folder is missing")
    if out["type"] == "add_tag":
        out["tag"] = named(out.get("tag"), "tag")
    for kind, allowed in (("set_sensitivity", SENSITIVITIES), ("set_document_type", FAMILIES)):
        if out["type"] == kind and named(out.get("value"), "value") not in allowed:
            raise ValueError(f"no such value: {out['value']}")
    if out["type"] == "create_review_task":
        out["value"] = (out.get("value") or "").strip() or "Review suggested filing."
    return out


def condition(field: str, op: str, value: object = None, many: bool = False) -> Column:
    """A predicate that is never null.  eq, neq and in compare trimmed and folded; gte and lte as numbers, and where one side is none as
    text by >=, both; contains takes any element of a list; an empty text or list does not exist.  many: the field is a list."""
    f = F.col(field)
    text = f.cast("string") if not many else F.array_join(f, "\n")
    none = F.lit(False)
    if op == "exists":
        return f.isNotNull() & ((F.size(f) > 0) if many else (text != ""))
    if op in ("eq", "neq", "in"):
        values = [str(v).strip().lower() for v in (value if isinstance(value, list) else [value])]
        hit = F.coalesce(F.lower(F.trim(text)).isin(*values), none)
        return ~hit if op == "neq" else hit
    if op == "contains":
        needle = F.lit(str(value).lower())
        return F.coalesce(F.exists(f, lambda x: F.contains(F.lower(x), needle)), none) if many else F.contains(F.lower(F.coalesce(text, F.lit(""))), needle)
    if op == "regex":
        return F.coalesce(text, F.lit("")).rlike(f"(?i){check_pattern(value)}")
    if op in ("gte", "lte"):
        as_text = F.coalesce(text, F.lit("")) >= str(value)
        try:
            limit = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return as_text
        number = F.trim(text).try_cast("double")
        return F.when(number.isNull(), as_text).otherwise(number >= limit if op == "gte" else number <= limit)
    raise ValueError(f"no such operator: {op}")


def holds(rule: dict, lists: tuple[str, ...] = ()) -> Column:
    """Whether all conditions of a checked rule hold; a disabled rule never does."""
    if not rule["enabled"]:
        return F.lit(False)
    return reduce(Column.__and__, [condition(c["field"], c["op"], c["value"], c["field"] in lists) for c in rule["conditions"]])


def match_rules(rows: DataFrame, rules: list[dict], lists: tuple[str, ...] = (), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, rule): which rules hold.  One scan, whatever the number of rules."""
    hit = F.array_compact(F.array(*[F.when(holds(checked_rule(r, fields), lists), F.lit(r["name"])) for r in rules]))
    return rows.select("id", F.explode(hit).alias("rule"))


def evaluate_rules(rows: DataFrame, rules: list[dict], writable: list[str], lists: tuple[str, ...] = (), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, rule, priority, proposed, blocked, safety): for rules that hold their actions as `type:value`, those on folders that are not
    writable apart, and the reasons for a review.  rows need sensitivity and document_family."""
    out = []
    for r in (checked_rule(r, fields) for r in rules):
        named = [(a["type"], str(a.get("folder_path") or a.get("folder_id") or a.get("tag") or a.get("value"))) for a in r["actions"]]
        stopped = [t in ("add_folder", "set_primary_folder") and v not in writable for t, v in named]
        listed = lambda keep: F.array(*[F.lit(f"{t}:{v}") for (t, v), s in zip(named, stopped) if s == keep]).cast("array<string>")  # noqa: E731, B023
        guard = lambda c, values: F.when(F.col(c).isin(*values), F.col(c))
        safety = F.array_compact(F.array(F.lit("rule_requires_review" if r["review_required"] else None).cast("string"), guard("sensitivity", GUARDED["sensitivity"]), guard("document_family", GUARDED["family"])))
        out.append(F.when(holds(r, lists), F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["priority"]).alias("priority"), listed(False).alias("proposed"), listed(True).alias("blocked"), safety.alias("safety"))))
    return rows.select("id", F.explode(F.array_compact(F.array(*out))).alias("r")).select("id", "r.*")


def apply_actions(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """docs: id, folders, primary_folder, tags, sensitivity, family; actions: id, position, type, value.  The documents after their actions
    in order: folders and tags are added once, the first added folder becomes primary where there is none, later settings win."""
    step = F.struct("position", "type", "value")
    todo = actions.groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("_a"))  # a document's actions are few: those of its matched rules
    of = lambda *kinds: F.transform(F.filter(F.coalesce("_a", F.array().cast("array<struct<position:int,type:string,value:string>>")), lambda x: x["type"].isin(*kinds)), lambda x: x["value"])
    last = lambda kind, old: F.coalesce(F.element_at(F.when(F.size(of(kind)) > 0, of(kind)), -1), F.col(old))
    folders, tags = F.array_distinct(F.concat("folders", of("add_folder", "set_primary_folder"))), F.array_distinct(F.concat("tags", of("add_tag")))
    first = F.when(F.size(of("add_folder")) > 0, F.get(of("add_folder"), F.lit(0)))
    out = docs.join(todo, "id", "left").select("id", folders.alias("folders"), F.coalesce(last("set_primary_folder", "primary_folder"), first).alias("primary_folder"), tags.alias("tags"), last("set_sensitivity", "sensitivity").alias("sensitivity"), last("set_document_type", "family").alias("family"),
        ((F.size(folders) > F.size("folders")) | (F.size(tags) > F.size("tags")) | ~F.coalesce(last("set_primary_folder", "primary_folder"), first).eqNullSafe(F.col("primary_folder"))).alias("organization_changed"), (F.size(of("create_review_task"))).alias("review_tasks"))
    return out
