"""Span candidates of a page: values with a label beside them, and typed values, each anchored in its element's text.

Elements: doc_id, page (int), page_id, element_id, ordinal, text, and box, an array left, top, right, bottom in reading space
(see `reading_box`), or null.  Offsets count characters (code points) of the element's text.

Neighbours are found on strips: a label's reach to the right is `RIGHT` points, so values whose left edge lies in
its strip of that width, or in the next one, are all that can be beside it; below it is the same with top edges.  Each value has one
strip, so each pair meets once, and a page's labels and values never all meet.  `beside` has all pairs, by equi-joins; `candidates` needs
a value's first label alone and finds it by windows, whose keys begin with the page: elements that lie by document or page are not dealt
out again, and each is read once.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions.text import folded

# Reach of labels in points, lengths, spans a page, and the patterns of labelled and typed values.
RIGHT, BELOW = 220.0, 30.0
VALUE_CHARS, LABEL_CHARS, LABEL_WORDS, PAGE_LIMIT = 80, 60, 6, 80
# The look-ahead only says early that no colon follows.
COLON = r"([A-Za-z](?=[\w .,\-/&()#'%]{0,58}+[^\S\n]*+[:：])[\w .,\-/&()#'%]{0,58}?)[^\S\n]*[:：][^\S\n]*([^\n]{1,80})"
TYPED = (
    ("regex_money", "money", r"(?<![\d.,])(?:\(?-?[$€£]\s?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{2})?\)?|\(?-?(?:\d{1,3}(?:,\d{3})*|\d+)\.\d{2}\)?-?)(?![\d.,])"),
    ("regex_date", "date", r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.? \d{1,2},? \d{4})\b"),
    ("regex_email", "text", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("regex_phone", "text", r"\b(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}\b"),
    ("regex_zip", "text", r"\b\d{5}(?:-\d{4})?\b"),
    ("regex_identifier", "identifier", r"\b(?=[A-Z0-9/#-]*\d)[A-Z0-9][A-Z0-9/#-]{5,24}\b"),
)
MARK = "\x01"


def _java(pattern: str) -> str:
    """Letters, digits and word bounds of all scripts."""
    return "(?U)" + pattern


def _ascii(text: Column, of: Callable[[Callable[[str], str]], Column]) -> Column:
    """A pattern's result: for texts of ASCII alone Java's plain classes are the same and cheaper."""
    return F.when(F.length(text) == F.octet_length(text), of(str)).otherwise(of(_java))


def matches(text: Column, pattern: str, signs: str = "") -> Column:
    """array<struct(start, value)>: all matches in order.  They are marked in the text, which is then cut at the marks.  signs: each match
    has one of them."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\x02")).otherwise(text)
    marked = _ascii(text, lambda kind: F.regexp_replace(clean, F.lit(kind(pattern)), F.lit(f"{MARK}$0{MARK}")))
    if signs:
        marked = F.when(reduce(or_, [F.contains(text, F.lit(x)) for x in signs]), marked).otherwise(clean)
    pieces = F.split(marked, MARK)

    def found(p: Column) -> Column:
        ends = lambda i: F.aggregate(F.slice(p, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
        odd = F.filter(F.transform(p, lambda x, i: F.struct(i.alias("i"), x.alias("value"))), lambda x: x["i"] % 2 == 1)
        return F.transform(odd, lambda x: F.struct(ends(x["i"]).alias("start"), x["value"].alias("value")))

    return F.element_at(F.transform(F.array(pieces), found), 1)


def _plain(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def value_type(text: Column) -> Column:
    """The type whose pattern the whole text fits, in order; else text."""
    own, out = _trimmed(text), None
    for _, kind, pattern in TYPED:
        whole = rf"\A(?:{pattern})\z" if "(?i)" not in pattern else rf"\A{pattern}\z"
        fits = _ascii(own, lambda kind: own.rlike(kind(whole)))  # noqa: B023
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("text")


def looks_like_label(text: Column) -> Column:
    """A few words that end in a colon, or that are mostly capitals without a digit."""
    flat = _plain(text)
    letters, capitals = F.length(F.regexp_replace(flat, r"[^\p{L}]", "")), F.length(F.regexp_replace(flat, r"[^\p{Lu}]", ""))
    short = (F.length(flat) > 0) & (F.length(flat) <= LABEL_CHARS) & (F.size(F.split(flat, " ")) <= LABEL_WORDS)
    return F.coalesce(short & (F.endswith(flat, F.lit(":")) | ((letters > 0) & (capitals >= F.lit(0.7) * letters) & ~flat.rlike(r"\p{Nd}"))), F.lit(False))


def reading_box(raw: Column, origin: Column) -> Column:
    """left, top, right, bottom with top above bottom: boxes counted from the bottom are turned over."""
    low = F.upper(F.coalesce(origin, F.lit(""))) == "BOTTOMLEFT"
    top, bottom = F.when(low, -raw[1]).otherwise(raw[1]), F.when(low, -raw[3]).otherwise(raw[3])
    return F.when(F.size(raw) == 4, F.array(raw[0], F.least(top, bottom), raw[2], F.greatest(top, bottom)))


def _overlap(a: Column, b: Column, low: int, high: int) -> Column:
    return F.least(a[high], b[high]) - F.greatest(a[low], b[low])


def beside(elements: DataFrame) -> DataFrame:
    """(label fields as struct l, value fields as struct v, kind): values right of a label, or else below it."""
    fields = F.struct("doc_id", "page", "page_id", "element_id", "ordinal", "text", "box")
    known = elements.filter(F.col("box").isNotNull()).withColumn("is_label", looks_like_label(F.col("text")))
    labels = known.filter("is_label").select("doc_id", "page", fields.alias("l"))
    values = known.filter("NOT is_label").select("doc_id", "page", fields.alias("v"))
    lb, vb = F.col("l.box"), F.col("v.box")
    right = (_overlap(lb, vb, 1, 3) > 0) & (vb[0] >= lb[2]) & (vb[0] - lb[2] <= RIGHT)
    below = (_overlap(lb, vb, 0, 2) > 0) & (vb[1] >= lb[3]) & (vb[1] - lb[3] <= BELOW)

    def strip(kind: str, width: float, edge: int, own: int, holds: Column) -> DataFrame:
        first = F.floor(lb[own] / width)
        reach = labels.withColumn("strip", F.explode(F.array(first, first + 1)))
        return reach.join(values.withColumn("strip", F.floor(vb[edge] / width)), ["doc_id", "page", "strip"]).filter(holds).select("l", "v", F.lit(kind).alias("kind"))

    return strip("label_right_of", RIGHT, 0, 2, right).unionByName(strip("label_below_of", BELOW, 1, 3, below & ~right))


def first_labels(elements: DataFrame) -> DataFrame:
    """elements with near, the label of least ordinal that a value has to its left or above it: struct ordinal, text, kind, or null.

    A label stands once more in the rows for each strip that it reaches, so one window a direction shows values the labels of their strip."""
    box = F.col("box")
    is_label = F.coalesce(box.isNotNull() & looks_like_label(F.col("text")), F.lit(False))
    role = lambda k, strip: F.struct(F.lit(k).alias("role"), strip.cast("long").alias("strip"))
    right, below = F.floor(box[2] / RIGHT), F.floor(box[3] / BELOW)
    own = F.array(role(0, F.lit(None)))
    roles = F.when(F.col("is_label"), F.concat(own, F.array(role(1, right), role(1, right + 1), role(2, below), role(2, below + 1)))).otherwise(own)
    rows = elements.withColumn("is_label", is_label).withColumn("r", F.explode(roles))
    value = box.isNotNull() & ~F.col("is_label")

    def seen(rows: DataFrame, k: int, kind: str, width: float, edge: int, holds: Callable[[Column], Column]) -> DataFrame:
        """kind: the first label; rows with role k end here."""
        mine = F.col("r.role") == k
        strips = F.when(mine, F.col("r.strip")).when(value, F.floor(box[edge] / width))
        listed = F.collect_list(F.when(mine, F.struct("ordinal", "text", "box"))).over(Window.partitionBy("doc_id", "page", "strip"))
        rows = rows.withColumn("strip", strips).withColumn("seen", listed).filter(~mine)
        first = F.array_min(F.transform(F.filter("seen", holds), lambda x: F.struct(x["ordinal"].alias("ordinal"), x["text"].alias("text"), F.lit(kind).alias("kind"))))
        return rows.withColumn(kind, F.when(value, first)).drop("strip", "seen")

    is_right = lambda x: (_overlap(x["box"], box, 1, 3) > 0) & (box[0] >= x["box"][2]) & (box[0] - x["box"][2] <= RIGHT)
    is_below = lambda x: (_overlap(x["box"], box, 0, 2) > 0) & (box[1] >= x["box"][3]) & (box[1] - x["box"][3] <= BELOW)
    rows = seen(rows, 1, "label_right_of", RIGHT, 0, is_right)
    rows = seen(rows, 2, "label_below_of", BELOW, 1, lambda x: is_below(x) & ~is_right(x))
    return rows.withColumn("near", F.least("label_right_of", "label_below_of")).drop("r", "is_label", "label_right_of", "label_below_of")


def candidates(elements: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """One row a span: doc_id, page, place (1..limit), span_id, page_id, element_id, kind, value_type, value_text, label_text, start, end.

    Labelled spans come first, then typed ones; of equal values (folded) in one element each group keeps the first; of spans
    of one id the first stays.  `limit` is the feature's rank in the page, applied at the end."""
    own = ("doc_id", "page", "page_id", "element_id", "ordinal")
    full = elements.select(*own, "text", "box").filter(F.col("text").rlike(r"(?U)\S"))
    part = lambda phase, i, at, value, label=F.lit(None), kind=F.lit(None), o1=F.col("ordinal"): F.struct(
        F.lit(phase).alias("phase"), F.lit(i).alias("i"), at.alias("at"), value.alias("value"), label.cast("string").alias("label"), kind.cast("string").alias("kind"), o1.cast("long").alias("o1"))
    colon = F.transform(matches(F.col("text"), COLON, ":："), lambda x: part(0, 0, x["start"], x["value"]))
    near = F.filter(F.array(part(1, 0, F.lit(0), F.col("text"), F.col("near.text"), F.col("near.kind"), F.col("near.ordinal"))), lambda x: x["kind"].isNotNull())
    typed = [F.transform(matches(F.col("text"), p), lambda x: part(2, i, x["start"], x["value"])) for i, (_, _, p) in enumerate(TYPED)]  # noqa: B023
    none = F.slice(F.array(part(2, 0, F.lit(0), F.lit(""))), 1, 0)
    mail = [k for k, _, _ in TYPED].index("regex_email")
    digits = F.concat(*typed[:mail], *typed[mail + 1 :])  # each of these has one
    typed = F.when(F.col("text").rlike(r"\p{Nd}"), digits).otherwise(none), F.when(F.contains("text", F.lit("@")), typed[mail]).otherwise(none)
    # an outer generator, as otherwise the list is also made in a filter for lists without elements
    each = first_labels(full).select(*own, F.explode_outer(F.concat(colon, near, *typed)).alias("m")).filter("m IS NOT NULL").select(*own, "m.*")
    phase, at, size = F.col("phase"), F.col("at"), F.length("value")
    # before a match's first colon is its label; typed matches neither begin nor end with white space
    head = F.regexp_extract("value", r"\A[^:：]*", 0)
    rest = F.regexp_replace(F.substr("value", F.length(head) + 2), r"(?U)\A[^\S\n]+", "")
    each = each.withColumns({"label": F.when(phase == 0, _plain(head)).when(phase == 1, _plain(F.col("label"))), "full": F.when(phase == 0, rest).otherwise(F.col("value"))})
    each = each.withColumn("cut", F.when(phase == 0, _trimmed(F.col("full"))).when(phase == 1, _plain(F.col("full"))).otherwise(F.col("full")))
    each = each.filter((phase > 0) | ((F.col("cut") != "") & (F.size(F.split("label", " ")) <= LABEL_WORDS)))
    listed = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in TYPED]), F.col("i") + 1)
    begin = F.when(phase == 0, at + size - F.length("full")).otherwise(at)
    every = each.select(*own, F.when(phase == 0, "label_colon").when(phase == 1, F.col("kind")).otherwise(listed(0)).alias("kind"), F.when(phase == 2, listed(1)).otherwise(value_type(F.col("full"))).alias("value_type"),
        F.left("cut", F.lit(VALUE_CHARS)).alias("value_text"), F.left("label", F.lit(LABEL_CHARS)).alias("label_text"), begin.alias("start"),
        F.when(phase == 0, begin + F.length(F.regexp_replace("full", r"(?U)\s+$", ""))).when(phase == 1, F.least(size, F.lit(VALUE_CHARS))).otherwise(at + size).alias("end"),
        "phase", "o1", F.when(phase == 0, at).when(phase == 1, F.col("ordinal")).otherwise(F.col("i") * F.lit(1 << 40) + at).cast("long").alias("o2"))
    order = ("phase", "o1", "o2")
    same = Window.partitionBy("doc_id", "page", "element_id", F.col("phase") == 2, folded(F.col("value_text"))).orderBy(*order)
    every = every.withColumn("n", F.row_number().over(same)).filter("n = 1")
    every = every.withColumn("span_id", F.concat(F.lit("s"), F.concat_ws("_", "page", "ordinal", "start", "end")))
    every = every.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page", "span_id").orderBy(*order))).filter("n = 1")
    ranked = every.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order))).filter(F.col("place") <= limit)
    return ranked.select("doc_id", "page", "place", "span_id", "page_id", "element_id", "kind", "value_type", "value_text", "label_text", "start", "end")
