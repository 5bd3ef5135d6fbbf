"""Queries of the text scalars and of the heuristic payloads over texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.sources.tables import SQL, receipts, table

R = f"WITH {SQL['receipts']} "


def receipt_payload(s, d):
    """Merchant, day, amounts and items of receipts."""
    t = F.col("text")
    fields = {
        "merchant": F.coalesce(T.labelled(t, "merchant", "store"), T.first_line(t)),
        "day": T.find_day(F.coalesce(T.labelled(t, "date", "transaction date"), t)),
        "subtotal": T.money_after(t, "subtotal"),
        "tax": T.money_after(t, "tax", "sales tax"),
        "tip": T.money_after(t, "tip"),
        "total": T.money_after(t, "total", "amount paid", "grand total"),
        "items": F.size(T.item_lines(t)),
        "item_sum": F.aggregate(T.item_lines(t), F.lit(0).cast("decimal(18,4)"), lambda a, x: (a + x["amount"]).cast("decimal(18,4)")),
        "first_item": F.get(T.item_lines(t), F.lit(0))["description"],
    }
    return receipts(s, d).select("id", *[c.alias(n) for n, c in fields.items()])


def date_fragments(s, d):
    """Dates in eleven ways of writing, alone and inside sentences."""
    day, k = F.add_months("o_orderdate", 120), F.col("o_orderkey") % 13
    ways = ["yyyy-MM-dd", "M/d/yy", "MM/dd/yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy"]
    t = F.lit("no day")
    for i, f in enumerate(ways):
        t = F.when(k == i, F.date_format(day, f)).otherwise(t)
    t = F.when(k == 10, F.concat(F.lit("due on "), F.date_format(day, "d-MMM-yyyy"), F.lit(" or 1/2/2003"))).when(k == 11, F.concat(F.lit("paid "), F.date_format(day, "MMMM d, yyyy"), F.lit("."))).otherwise(t)
    return table(s, d, "orders").select("o_orderkey", T.parse_day(t).alias("day"))


def classify_receipts(s, d):
    t = receipts(s, d).select("id", F.when(F.col("id") % 2 == 0, F.regexp_replace("text", "(?i)subtotal|sales tax", "x")).otherwise(F.col("text")).alias("text"))
    name = F.when(F.col("id") % 5 == 0, "scan EOB.pdf").when(F.col("id") % 5 == 1, "March Invoice.pdf").otherwise("scan.pdf")
    return t.select("id", T.classify(F.col("text"), name, F.lit("A scan"), F.col("id") % 3 != 0).alias("c")).select("id", "c.*")


def _path():
    k = F.col("o_orderkey") % 8
    paths = ["warranty.Expiration", "policy.renewal_on", "notice.response_deadline", "court.filing_deadline", "visit.appointment", "invoice.due_date", "invoice.total", "Due.amount"]
    out = F.lit(paths[7])
    for i, p in enumerate(paths[:7]):
        out = F.when(k == i, p).otherwise(out)
    return out


def name_keys(s, d):
    """The keys of names: contact, text, token and quality keys."""
    n = F.concat(F.lit(" Ünïted  "), F.col("p_name"), F.lit(" & Co-Op\t "), F.col("p_brand"), F.lit(" HTTPServer camelCase"))
    return table(s, d, "part").select("p_partkey", T.contact_name(n).alias("contact"), T.text_key(n).alias("text_key"), T.name_token(F.concat(F.lit("ModelTimeout-"), "p_brand")).alias("token"), T.quality_key(F.concat(F.lit("unitPrice HTMLValue-"), F.col("p_brand"))).alias("quality"))


def alias_lists(s, d):
    low = F.lower("c_mktsegment")
    names = F.array(F.col("c_mktsegment"), F.concat(F.lit(" "), low, F.lit("  ")), F.lit("  "), F.concat(F.lit("A  "), low), F.concat(F.lit("a "), F.col("c_mktsegment")), F.lit("Straße"), F.lit("STRASSE"))
    return table(s, d, "customer").select("c_custkey", F.array_join(T.aliases(names), "|").alias("aliases"))


def failure_codes(s, d):
    k = F.col("event_id") % 6
    error = F.when(k == 0, "ModelTimeoutError").when(k == 1, "ValueError").when(k == 2, "HTTP error 500").when(k == 3, "").otherwise("ModelProtocolError")
    queue = F.when(k == 4, F.lit(None)).otherwise(F.concat(F.lit("docQueue-"), (F.col("user_id") % 5).cast("string")))
    explicit = F.when(F.col("event_id") % 11 == 0, "Known Failure")
    return table(s, d, "events").select("event_id", T.failure_code(queue, F.col("event_type"), error, explicit).alias("code"), T.retry_delay((F.col("event_id") % 40).cast("int")).alias("delay"))


def confidence_scale(s, d):
    c = F.col("value") - 20
    return table(s, d, "events").select("event_id", F.round(T.ratio(c), 6).alias("confidence"), T.text_tokens(F.col("props")).alias("tokens"))


def observation_rejects(s, d):
    """Placeholders and echoes among names and values."""
    k = F.col("p_partkey") % 9
    name = F.when(k == 0, "visibleField").when(k == 1, " N/A ").when(k == 2, "table schema rows").otherwise(F.col("p_brand"))
    value = F.when(k == 3, "Not Available").when(k == 4, "Return only JSON please").when(k == 5, F.lit(None)).when(k == 6, "n/a").otherwise(F.col("p_name"))
    return table(s, d, "part").select("p_partkey", T.reject_observation(name, value).alias("reason"))


QUERIES = {
    "receipt_payload": receipt_payload,
    "date_fragments": date_fragments,
    "classify_receipts": classify_receipts,
    "deadline_types": lambda s, d: table(s, d, "orders").select("o_orderkey", T.deadline_type(_path()).alias("deadline_type")),
    "name_keys": name_keys,
    "alias_lists": alias_lists,
    "failure_codes": failure_codes,
    "confidence_scale": confidence_scale,
    "observation_rejects": observation_rejects,
}

_KEY = r"trim(lower(regexp_replace(regexp_replace(regexp_replace(replace(replace(trim({}), '-', '_'), ' ', '_'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_+', '_', 'g')), '_')"

ORACLES = {
    "receipt_payload": R + r"""SELECT id, CASE WHEN regexp_matches(text, '(?im)^\s*merchant\s*[:#]') THEN trim(regexp_extract(text, '(?im)^\s*merchant\s*[:#]\s*(.+)$', 1)) ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' -' || chr(9))), lambda x: length(x) >= 3 AND NOT regexp_matches(x, '(^|[^\p{L}\p{N}_])\$?\s*[0-9]'))[1] END AS merchant,
    CASE WHEN regexp_matches(text, '(?im)^date:') THEN regexp_extract(text, '20[0-9]{2}-[0-9]{2}-[0-9]{2}') WHEN regexp_matches(text, 'bought on') THEN strftime(strptime(regexp_extract(text, '[0-9]+/[0-9]+/20[0-9]{2}'), '%m/%d/%Y'), '%Y-%m-%d') END AS day,
    CAST(regexp_extract(text, '(?im)^subtotal ([0-9.]+)$', 1) AS DOUBLE) AS subtotal, CAST(regexp_extract(text, '(?im)^(sales )?tax(:|\s#) \$?([0-9.]+)$', 3) AS DOUBLE) AS tax, NULL::DOUBLE AS tip,
    CAST(replace(regexp_extract(text, '(?im)^total: \$(.*)$', 1), ',', '') AS DOUBLE) AS total, CAST(len(regexp_extract_all(text, 'Item: ')) AS INT) AS items,
    CAST(list_sum(list_transform(regexp_extract_all(text, 'lot [0-9]+  \$([0-9.]+)', 1), lambda x: CAST(x AS DECIMAL(18,2)))) AS DOUBLE) AS item_sum, regexp_extract(text, 'Item: (part [0-9]+ lot [0-9]+)', 1) AS first_item FROM receipts""",
    "date_fragments": """WITH o AS (SELECT o_orderkey, o_orderkey % 13 AS k, o_orderdate + INTERVAL 10 YEAR AS day FROM orders)
    SELECT o_orderkey, CASE WHEN k = 10 THEN '2003-01-02' WHEN k < 12 THEN CAST(CAST(day AS DATE) AS VARCHAR) END AS day FROM o""",
    "classify_receipts": R + """, t AS (SELECT id, lower(CASE id % 5 WHEN 0 THEN 'scan EOB.pdf' WHEN 1 THEN 'March Invoice.pdf' ELSE 'scan.pdf' END || ' A scan ' || CASE WHEN id % 2 = 0 THEN regexp_replace(text, '(?i)subtotal|sales tax', 'x', 'g') ELSE text END) AS t FROM receipts),
    f AS (SELECT id, CASE WHEN contains(t, 'explanation of benefits') OR contains(t, ' eob') OR contains(t, 'patient responsibility') THEN 'medical_eob' WHEN contains(t, 'invoice') OR contains(t, 'balance due') OR contains(t, 'bill to') THEN 'invoice'
        WHEN contains(t, 'receipt') OR contains(t, 'subtotal') OR contains(t, 'sales tax') OR contains(t, 'transaction date') THEN 'receipt' ELSE 'generic' END AS family FROM t)
    SELECT id, family, CASE WHEN family = 'medical_eob' THEN 'explanation_of_benefits' END AS subtype, CASE family WHEN 'medical_eob' THEN 0.86 WHEN 'invoice' THEN 0.85 WHEN 'receipt' THEN 0.84 ELSE CASE WHEN id % 3 <> 0 THEN 0.5 ELSE 0.35 END END::DOUBLE AS confidence FROM f""",
    "deadline_types": "SELECT o_orderkey, ['warranty_expiration', 'renewal_date', 'response_deadline', 'filing_deadline', 'appointment_date', 'due_date', NULL, NULL][o_orderkey % 8 + 1] AS deadline_type FROM orders",
    "name_keys": r"""WITH n AS (SELECT p_partkey, p_brand, ' Ünïted  ' || p_name || ' & Co-Op' || chr(9) || ' ' || p_brand || ' HTTPServer camelCase' AS n FROM part)
    SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(n), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS contact, trim(regexp_replace(lower(n), '\s+', ' ', 'g')) AS text_key,
    trim(regexp_replace(lower(regexp_replace('Model_Timeout-' || substr(p_brand, 1, 1) || regexp_replace(substr(p_brand, 2), '([A-Z])', '_\1', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_+', '_', 'g'), '_') AS token,
    """ + _KEY.format("('unitPrice HTMLValue-' || p_brand)") + " AS quality FROM n",
    "alias_lists": "SELECT c_custkey, c_mktsegment || '|A ' || lower(c_mktsegment) || '|Straße' AS aliases FROM customer",
    "failure_codes": """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'known_failure' ELSE CASE WHEN event_id % 6 = 4 THEN event_type ELSE 'doc_queue_' || (user_id % 5) END || '_' ||
    ['model_timeout', 'value_error', 'h_t_t_p_error_500', 'operational_failure', 'model_protocol', 'model_protocol'][event_id % 6 + 1] END AS code, CAST(least(3600, 30 * pow(2, least(30, greatest(event_id % 40 - 1, 0)))) AS INT) AS delay FROM events""",
    "confidence_scale": "SELECT event_id, round(CASE WHEN value - 20 BETWEEN 0 AND 1 THEN value - 20 WHEN value - 20 > 1 AND value - 20 <= 100 THEN (value - 20) / 100 END, 6) AS confidence, CAST(ceil(length(props) / 4.0) AS BIGINT) AS tokens FROM events",
    "observation_rejects": "SELECT p_partkey, ['placeholder_field_name', 'placeholder_field_name', 'prompt_or_schema_echo', 'placeholder_or_null_value', 'prompt_or_schema_echo', 'placeholder_or_null_value', 'placeholder_or_null_value', NULL, NULL][p_partkey % 9 + 1] AS reason FROM part",
}
