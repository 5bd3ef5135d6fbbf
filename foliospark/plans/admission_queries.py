"""Admission over order lines: an order is a run, its lines are fields, line items and observations by their return flag."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators import admission
from foliospark.sources.tables import table


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = table(spark, sf_dir, "lineitem").withColumns({"pos": F.row_number().over(order), "tens": F.floor(F.col("l_quantity") / 10).cast("int"), "off": F.round(F.col("l_discount") * 100), "tax": F.round(F.col("l_tax") * 100)})
    kind = F.when(F.col("l_returnflag") == "A", "field").when(F.col("l_returnflag") == "N", "line_item").otherwise("observation")
    page, done = F.floor((F.col("l_linenumber") - 1) / 3).cast("int") + 1, F.col("l_linestatus") == "F"
    none, text = F.lit(None), lambda v: v.cast("string")
    ref = lambda row, tab: F.struct(page.alias("page_number"), text(none).alias("page_id"), row.cast("int").alias("row_index"), text(tab).alias("table_id"), text(none).alias("element_id"), text(none).alias("bbox"), text(none).alias("text_span"), text(none).alias("semantic_region_id"))
    value = F.when(kind == "field", text(F.col("tens"))).when(kind == "observation", F.concat(F.lit('{"b": "'), F.col("l_linestatus"), F.lit('  Ä", "a": ['), text(F.col("tens")), F.lit(', null], "Evidence": "'), text(F.col("l_partkey")), F.lit('"}')))
    amount = F.lit(None).cast("double")
    return x.select(
        F.col("l_orderkey").alias("run"), kind.alias("kind"), "pos", F.when(kind == "field", F.when(done, "  Invoice.Total ").otherwise("invoice.tax")).when(kind == "observation", "Seen  On").alias("field_path"), value.alias("value"),
        F.concat(F.lit(" Part   "), "l_linestatus").alias("description"), text(none).alias("code"), (F.col("tens") + F.lit(0.0)).alias("quantity"), amount.alias("unit_price"), amount.alias("gross_amount"), amount.alias("discount_amount"),
        amount.alias("tax_amount"), (F.col("tens") * F.lit(1.25)).alias("net_amount"), F.lit("USD").alias("currency"), text(none).alias("category_hint"), F.lit("invoice").alias("family"), text(none).alias("semantic_type"),
        F.array(ref(none, none), F.when(done, ref(F.col("tens"), F.lit("t1")))).alias("evidence"), F.lit("r").alias("region_id"), (~done).alias("needs_review"),
        F.when(F.col("tax") == 8, "engine_emits_no_values").alias("source_reason"), F.when(F.col("off") == 10, "candidate_schema_incompatible").alias("schema_reason"),
        F.when(F.col("off") == 9, "placeholder_value").when(F.col("off") == 8, "prompt_or_schema_echo").when(F.col("off") == 7, "too_long").alias("quality_reason"),
        F.when(F.col("tax") == 6, "title_derived").alias("title_reason"), F.when(F.col("tax") == 7, "missing_concrete_evidence").alias("evidence_reason"),
    )


def candidate_admission(s, d):
    return admission.admit(candidates(s, d)).select("run", "kind", "pos", "fingerprint", "decision", "reason")


def admission_counts(s, d):
    out = admission.summary(admission.admit(candidates(s, d)))
    return out.select("run", "produced", "admitted", "rejected", F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["decision"], r["n"])), ",").alias("reasons"))


QUERIES = {"candidate_admission": candidate_admission, "admission_counts": admission_counts}

SQL = """
WITH x AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CAST(floor(l_quantity / 10) AS INT) AS tens, round(l_discount * 100) AS off, round(l_tax * 100) AS tax,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS phase, l_linestatus = 'F' AS done, lower(l_linestatus) AS st, (l_linenumber - 1) // 3 + 1 AS page FROM lineitem),
p AS (SELECT *, '{"locator_kind":"' || CASE WHEN done THEN 'table_row' ELSE 'page' END || '","page_number":' || page || ',"row_index":' || CASE WHEN done THEN CAST(tens AS VARCHAR) ELSE 'null' END || '}' AS place FROM x),
j AS (SELECT *, CASE phase WHEN 1 THEN '{"field_path":"' || CASE WHEN done THEN 'invoice.total' ELSE 'invoice.tax' END || '","kind":"field","region":' || place || ',"value":' || tens || '}'
        WHEN 2 THEN '{"category_hint":"","code":"","currency":"usd","description":"part ' || st || '","discount_amount":null,"gross_amount":null,"kind":"line_item","net_amount":' || CAST(tens * 1.25::DOUBLE AS VARCHAR) || ',"quantity":' || tens || '.0,"region":' || place || ',"table":' || place || ',"tax_amount":null,"unit_price":null}'
        ELSE '{"family":"invoice","field_name":"seen on","kind":"observation","region":' || place || ',"semantic_type":"","value":{"a":[' || tens || ',null],"b":"' || st || ' \\u00e4"}}' END AS body,
    CASE WHEN tax = 8 THEN ['rejected_source_provenance', 'engine_emits_no_values'] WHEN off = 10 AND phase < 3 THEN ['rejected_family_schema', 'candidate_schema_incompatible'] WHEN off = 9 THEN ['rejected_placeholder', 'placeholder_value']
        WHEN off = 8 THEN ['rejected_artifact', 'prompt_or_schema_echo'] WHEN off = 7 THEN ['rejected_value_sanity', 'too_long'] WHEN tax = 6 AND phase = 1 THEN ['rejected_source_provenance', 'title_derived'] WHEN tax = 7 THEN ['rejected_missing_evidence', 'missing_concrete_evidence'] END AS why FROM p),
k AS (SELECT *, coalesce(min(CASE WHEN why IS NULL THEN pos END) OVER (PARTITION BY run, body) < pos, false) AS twin FROM j),
e AS (SELECT run, ['field', 'line_item', 'observation'][phase] AS kind, pos, sha256(body) AS fingerprint, CASE WHEN twin THEN 'rejected_duplicate' WHEN why IS NOT NULL THEN why[1] WHEN done AND phase < 3 THEN 'admitted_auto_promotable' ELSE 'admitted_review_required' END AS decision,
    CASE WHEN twin THEN 'duplicate_candidate_fingerprint' ELSE why[2] END AS reason FROM k)
"""

ORACLES = {
    "candidate_admission": SQL + "SELECT run, kind, CAST(pos AS INT) AS pos, fingerprint, decision, reason FROM e",
    "admission_counts": SQL + """, c AS (SELECT run, decision, count(*) AS n FROM e GROUP BY ALL)
    SELECT run, CAST(sum(n) AS BIGINT) AS produced, CAST(coalesce(sum(n) FILTER (WHERE decision LIKE 'admitted%'), 0) AS BIGINT) AS admitted, CAST(coalesce(sum(n) FILTER (WHERE decision LIKE 'rejected%'), 0) AS BIGINT) AS rejected,
    coalesce(string_agg(decision || ':' || n, ',' ORDER BY decision) FILTER (WHERE decision LIKE 'rejected%'), '') AS reasons FROM c GROUP BY run""",
}
