"""Text scalars: amounts, dates, labels, names, typed spans, page and document quality.  All are Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classifier's phrases in the order they are tried, with family, subtype and confidence.
SIGNALS = (
    ("medical_eob", "explanation_of_benefits", ("explanation of benefits", " eob", "patient responsibility"), 0.86),
    ("invoice", None, ("invoice", "balance due", "invoice number", "bill to"), 0.85),
    ("receipt", None, ("receipt", "subtotal", "sales tax", "transaction date"), 0.84),
)
# The patterns of typed spans.
SPANS = {
    "money": r"[$]\s?[0-9]+(?:,[0-9]{3})*(?:[.][0-9]{2})?",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "phone": r"[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "iso_date": r"20[0-9]{2}-[0-9]{2}-[0-9]{2}",
}
# The date formats, in the order they are tried, and the fragments of a text that may be dates.
DATE_FORMATS = ("yyyy-M-d", "M/d/yy", "M/d/yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy", "d-MMMM-yy", "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy")
DATE_FRAGMENTS = (r"\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b", r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", r"\b[0-9]{1,2}-[A-Za-z]{3,9}-[0-9]{2,4}\b", r"\b[A-Za-z]{3,9}\s+[0-9]{1,2},?\s+[0-9]{2,4}\b")


def parse_amount(text: Column) -> Column:
    """decimal(18,4) of an amount as written: signs by brackets, leading or trailing minus; the last of comma and stop is the
    decimal mark if both occur; a lone comma with three digits behind groups thousands, as do several of one kind."""
    body = F.regexp_replace(text, r"[^0-9.,()\-]", "")
    negative = F.contains(body, F.lit("-")) | (F.startswith(body, F.lit("(")) & F.endswith(body, F.lit(")")))
    digits = F.regexp_replace(body, r"[()\-]", "")
    commas, stops = F.length(digits) - F.length(F.replace(digits, F.lit(","), F.lit(""))), F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit("")))
    last_comma, last_stop = F.length(digits) - F.instr(F.reverse(digits), ","), F.length(digits) - F.instr(F.reverse(digits), ".")
    no_commas = F.replace(digits, F.lit(","), F.lit(""))
    plain = (
        F.when((commas > 0) & (stops > 0), F.when(last_stop > last_comma, no_commas).otherwise(F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
        .when(commas > 1, no_commas)
        .when(commas == 1, F.when(digits.rlike(",[0-9]{3}$"), no_commas).otherwise(F.replace(digits, F.lit(","), F.lit("."))))
        .when(stops > 1, F.replace(digits, F.lit("."), F.lit("")))
        .otherwise(digits)
    )
    value = F.nullif(plain, F.lit("")).try_cast("decimal(18,4)")
    return F.when(negative, -value).otherwise(value).cast("decimal(18,4)")


def parse_day(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The date of a text: the whole text, then its fragments in order, each by the first format that fits; two-digit years
    from 69 on are in the last century."""
    given = F.trim(text)
    parts = F.concat(F.array(given), *[F.regexp_extract_all(given, F.lit(p), 0) for p in DATE_FRAGMENTS])

    def day(part: Column) -> Column:
        short = F.regexp_replace(part, r"\s+", " ")
        tried = []
        for f in formats:
            d = F.to_date(F.try_to_timestamp(short, F.lit(f)))
            tried.append(d if "yyyy" in f else F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d))
        return F.coalesce(*tried)

    return F.get(F.filter(F.transform(parts, day), lambda d: d.isNotNull()), F.lit(0))


def _escaped(label: str) -> str:
    import re

    return re.escape(label)


def labelled(text: Column, *labels: str) -> Column:
    """What follows `label:` or `label #`, on its line or the next with anything; the first label that does; else null."""
    found = [F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{_escaped(x)}\s*[:#]\s*([^\n]+)", 1)), F.lit("")) for x in labels]
    return F.coalesce(*found)


def money_after(text: Column, *labels: str) -> Column:
    """decimal(18,4) behind a label that begins a line: the first label that has an amount with two decimals."""
    found = [F.nullif(F.replace(F.regexp_extract(text, rf"(?im)^\s*{_escaped(x)}\s*[:#]?\s*[$]?\s*([0-9,]+[.][0-9]{{2}})", 1), F.lit(","), F.lit("")), F.lit("")) for x in labels]
    return F.coalesce(*found).try_cast("decimal(18,4)")


def find_day(text: Column) -> Column:
    """The first date of this century in a text, ISO before m/d/yyyy, as ISO text."""
    iso = F.nullif(F.regexp_extract(text, r"\b(20[0-9]{2}-[01][0-9]-[0-3][0-9])\b", 1), F.lit(""))
    us = lambda i: F.regexp_extract(text, r"\b([01]?[0-9])/([0-3]?[0-9])/(20[0-9]{2})\b", i)
    return F.coalesce(iso, F.when(us(3) != "", F.concat(us(3), F.lit("-"), F.lpad(us(1), 2, "0"), F.lit("-"), F.lpad(us(2), 2, "0"))))


def first_line(text: Column, size: int = 120) -> Column:
    """The first line of three characters or more, without blanks and hyphens around it, that holds no number."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" -\t")))
    good = F.filter(lines, lambda x: (F.length(x) >= 3) & ~x.rlike(r"(?U)(?<!\w)[$]?\s*[0-9]"))
    return F.left(F.get(good, F.lit(0)), F.lit(size))


def item_lines(text: Column) -> Column:
    """array<struct(description, amount)> of the lines `item ... amount` and `line ... amount`, in order."""
    pattern = r"(?i)^\s*(?:item|line)\s*[:#-]?\s*(.+?)\s+[$]?([0-9,]+[.][0-9]{2})\s*$"
    rows = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    return F.transform(rows, lambda x: F.struct(F.left(F.trim(F.regexp_extract(x, pattern, 1)), F.lit(180)).alias("description"), F.replace(F.regexp_extract(x, pattern, 2), F.lit(","), F.lit("")).try_cast("decimal(18,4)").alias("amount")))


def classify(text: Column, name: Column | None = None, title: Column | None = None, parsed: Column | None = None) -> Column:
    """struct(family, subtype, confidence): the first phrase list that file name, title and text hold a phrase of; else generic,
    with less confidence if the parse did not succeed."""
    low = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (name, title, text) if c is not None]))
    row = lambda f, s, c: F.struct(F.lit(f).alias("family"), F.lit(s).cast("string").alias("subtype"), c.alias("confidence"))
    out = None
    for family, subtype, phrases, confidence in SIGNALS:
        hit, value = low.rlike("|".join(phrases)), row(family, subtype, F.lit(confidence))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    weak = F.lit(0.5) if parsed is None else F.when(F.coalesce(parsed, F.lit(False)), 0.5).otherwise(0.35)
    return out.otherwise(row("generic", None, weak))


def spans(text: Column) -> Column:
    """array<struct(kind, value)>: typed spans, kinds in order, values as they occur."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*[of(k, p) for k, p in SPANS.items()])


def folded(text: Column) -> Column:
    """Lower case for comparisons; a sharp s counts as two."""
    return F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss"))


def contact_name(name: Column) -> Column:
    """Folded, other than letters, digits and underscores of any script to spaces, spaces collapsed; null if nothing is left or
    the name has more than 240 characters."""
    short = F.trim(F.regexp_replace(name, r"\s+", " "))
    words = F.trim(F.regexp_replace(F.regexp_replace(folded(short), r"(?U)[^\w\s]+", " "), r"\s+", " "))
    return F.when(F.length(short) <= 240, F.nullif(words, F.lit("")))


def aliases(names: Column) -> Column:
    """Trimmed names without blanks; of those equal when folded the first one."""
    short = F.filter(F.transform(names, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    keys = F.transform(short, folded)
    return F.filter(F.transform(short, lambda x, i: F.when(F.array_position(keys, folded(x)) == i + 1, x)), lambda x: x.isNotNull())


def deadline_status(due: Column, confidence: Column, evidence: Column, today: Column) -> Column:
    """Without evidence, a due day or enough confidence (a null one is enough) a deadline needs review."""
    days = F.datediff(due, today)
    return F.when((evidence == 0) | (confidence < 0.65) | due.isNull(), "needs_review").when(days < 0, "overdue").when(days <= 30, "due_soon").otherwise("open")


def deadline_type(path: Column) -> Column:
    """The kind of deadline that a field path names; null if none."""
    has = lambda w: F.contains(F.lower(path), F.lit(w))
    return (
        F.when(has("warranty") & (has("expire") | has("expiration")), "warranty_expiration")
        .when(has("renewal"), "renewal_date")
        .when(has("response") & has("deadline"), "response_deadline")
        .when(has("filing") & has("deadline"), "filing_deadline")
        .when(has("appointment"), "appointment_date")
        .when(has("due") & has("date"), "due_date")
    )


def retry_delay(attempt: Column) -> Column:
    """Seconds: 30, doubled each time, an hour at most."""
    return F.least(F.lit(3600), (F.lit(30) * F.pow(F.lit(2), F.least(F.lit(7), F.greatest(attempt - 1, F.lit(0))))).cast("int"))


def text_key(text: Column) -> Column:
    """Lower case with single blanks; the empty text for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def name_token(text: Column) -> Column:
    """Words of a name, parted at signs and before capitals, in lower case and joined by underscores."""
    split = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "(?<=.)(?=[A-Z])", "_")
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(split, "[^A-Za-z0-9]+", "_")), "_+", "_"), F.lit("_"))


# Error classes whose codes have names of their own.
ERROR_NAMES = {"ModelTimeoutError": "model_timeout", "ModelProtocolError": "model_protocol"}


def failure_code(queue: Column, job_type: Column, error_class: Column, explicit: Column | None = None) -> Column:
    """An explicit code as a token, else queue (or type) and error class."""
    none = lambda c: F.nullif(name_token(c), F.lit(""))
    error = F.lit(None).cast("string")
    for name, code in ERROR_NAMES.items():
        error = F.coalesce(error, F.when(error_class == name, code))
    built = F.concat_ws("_", F.coalesce(none(queue), none(job_type), F.lit("pipeline_job")), F.coalesce(error, none(error_class), F.lit("operational_failure")))
    return built if explicit is None else F.coalesce(none(explicit), built)


def ratio(confidence: Column) -> Column:
    """A confidence between 0 and 1; percentages are scaled, anything else is null."""
    return F.when(confidence.between(0, 1), confidence).when((confidence > 1) & (confidence <= 100), confidence / 100)


def text_tokens(text: Column) -> Column:
    """An estimate: a token for four characters."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


# Names and values that stand for nothing, and the signs of a prompt or a schema in an answer.
PLACEHOLDERS = ("", "null", "none", "n/a", "na", "field", "key", "value", "missing", "not_applicable", "not_available", "not_found", "not_provided", "placeholder", "tbd", "unknown", "visible_field", "visible_value", "example_value", "<placeholder>")
ECHOES = ("identify and extract", "extract the schema", "extruct the schema", "tabls schema", "table schema", "tables in the image", "reading order", "return only json", "matching the schema", "$schema", "json schema", "response_format", "tool schema", "json_schema", "system_prompt", "tool_schema")


def quality_key(text: Column) -> Column:
    """A name or value in snake case: hyphens, blanks and changes of case part its words."""
    t = F.translate(F.trim(F.coalesce(text, F.lit(""))), "- ", "__")
    t = F.regexp_replace(F.regexp_replace(t, "(?<=[A-Z])(?=[A-Z][a-z])", "_"), "(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.btrim(F.regexp_replace(F.lower(t), "_+", "_"), F.lit("_"))


def is_placeholder(text: Column) -> Column:
    key = quality_key(text)
    return key.isin(*PLACEHOLDERS) | F.replace(key, F.lit("_"), F.lit("")).isin(*{p.replace("_", "") for p in PLACEHOLDERS})


def is_echo(text: Column) -> Column:
    import re

    return F.coalesce(F.lower(text).rlike("|".join(map(re.escape, ECHOES))), F.lit(False))


def reject_observation(name: Column, value: Column) -> Column:
    """Why an observation is no candidate; null if it is one."""
    return F.when(is_placeholder(name), "placeholder_field_name").when(is_placeholder(value), "placeholder_or_null_value").when(is_echo(name) | is_echo(value), "prompt_or_schema_echo")


def page_reasons(text: Column) -> Column:
    """Quality reasons of a page's text, in order; digital_text_page if there is none."""
    size = F.length(F.trim(text))
    reasons = F.array_compact(F.array(F.when(size == 0, "missing_text_layer"), F.when((size > 0) & (size < 32), "low_text_density"), F.when(F.regexp_count(text, F.lit("[|]")) >= 10, "complex_layout"), F.when(F.contains(text, F.lit("***")), "degraded_scan")))
    return F.when(F.size(reasons) == 0, F.array(F.lit("digital_text_page"))).otherwise(reasons)
