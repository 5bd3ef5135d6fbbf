"""Line items and totals from table grids with merged cells.

Cells: id (of the grid), pos (order in the file), row, col, row_span, col_span, text, column_header, row_section, box (left, top, right,
bottom, or null).  A merged cell may be written once or once for each place that it covers.  Grids: id, num_rows, num_cols (null: by the cells),
family.  Roles: id, col, role.

Places are spread out, one row each, and of cells that claim one place the one that begins first, by row and column, has it.  A grid's
rows then meet in arrays of its width; no grid is one task's work beyond its own cells.  All keys begin with the id: cells that lie by it are
not dealt out again, and each is read once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions.text import folded, parse_amount

# Roles and the fields they fill; money roles; phrases of totals rows by family, in the order they are tried, and those that
# only keep a row from being an item.
FIELDS = {
    "description": "description", "code": "code", "quantity": "quantity", "unit": "unit", "unit_price": "unit_price", "gross_amount": "gross_amount", "allowed_amount": "allowed_amount", "plan_paid": "plan_paid_amount",
    "discount": "discount_amount", "tax_amount": "tax_amount", "amount": "net_amount", "service_date": "service_date", "tax_category_hint": "tax_category_hint", "category_hint": "category_hint",
}
MONEY = ("unit_price", "gross_amount", "allowed_amount", "plan_paid", "discount", "tax_amount", "amount")
TOTALS = {
    "invoice": (
        ("subtotal", "invoice.subtotal"), ("sub-total", "invoice.subtotal"), ("sub total", "invoice.subtotal"), ("sales tax", "invoice.tax_total"), ("tax", "invoice.tax_total"), ("shipping", "invoice.shipping_total"),
        ("freight", "invoice.shipping_total"), ("discount", "invoice.discount_total"), ("amount paid", "invoice.amount_paid"), ("payment received", "invoice.amount_paid"), ("balance due", "invoice.balance_due"),
        ("amount due", "invoice.balance_due"), ("balance", "invoice.balance_due"), ("total", "invoice.total_amount"),
    ),
    "receipt": (
        ("subtotal", "receipt.transaction.subtotal"), ("sub-total", "receipt.transaction.subtotal"), ("sub total", "receipt.transaction.subtotal"), ("sales tax", "receipt.transaction.tax"), ("tax", "receipt.transaction.tax"),
        ("tip", "receipt.transaction.tip"), ("gratuity", "receipt.transaction.tip"), ("discount", "receipt.transaction.discount_total"), ("total", "receipt.transaction.total"),
    ),
    "service_record": (("subtotal", "service_record.subtotal"), ("sub-total", "service_record.subtotal"), ("sub total", "service_record.subtotal"), ("sales tax", "service_record.tax"), ("tax", "service_record.tax"), ("total", "service_record.total")),
    "retail_order": (("total", "retail_order.total"),),
    "medical_eob": (
        ("total billed", "medical_eob.total_billed"), ("total allowed", "medical_eob.total_allowed"), ("total plan paid", "medical_eob.total_plan_paid"), ("plan paid", "medical_eob.total_plan_paid"),
        ("patient responsibility", "medical_eob.total_patient_responsibility"),
    ),
}
NO_ITEM = ("grand total", "amount due", "balance due", "sub-total", "sub total", "subtotal", "totals", "total", "balance")
LABEL_WORDS = 5


def flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def places(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(id, row, col, text, column_header, row_section, box, ...): every place of a grid that a cell covers; by_flags: whether any cell of the grid is flagged."""
    span = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1)
    known = cells.filter("row >= 0 AND col >= 0").withColumns({"row_span": span("row_span"), "col_span": span("col_span")})
    body = F.struct("row_span", "col_span", flat(F.col("text")).alias("text"), F.coalesce("column_header", F.lit(False)).alias("column_header"), F.coalesce("row_section", F.lit(False)).alias("row_section"), "box")
    own = known.groupBy("id", "row", "col").agg(F.min_by(body, "pos").alias("c"))
    grid = Window.partitionBy("id")
    wide = own.withColumns({"_rows": F.max(F.col("row") + F.col("c.row_span")).over(grid), "_cols": F.max(F.col("col") + F.col("c.col_span")).over(grid), "by_flags": F.bool_or("c.column_header").over(grid)})
    size = lambda given, found: F.when(F.col(given) > 0, F.col(given)).otherwise(F.col(found)).alias(given)
    sized = wide.join(grids.select("id", "num_rows", "num_cols"), "id", "left").select("id", "row", "col", "c", "by_flags", size("num_rows", "_rows"), size("num_cols", "_cols")).filter("row < num_rows AND col < num_cols")
    first = F.struct("row", "col").alias("first")
    c = F.struct("num_rows", "num_cols", "by_flags", "c.text", "c.column_header", "c.row_section", "c.box").alias("c")
    to = lambda at, over, end: F.sequence(F.col(at), F.least(F.col(at) + F.col(over), F.col(end)) - 1)
    down = sized.select("id", first, c, F.col("c.col_span").alias("over"), F.explode(to("row", "c.row_span", "num_rows")).alias("r"))
    over = down.select("id", "first", "c", "r", F.explode(to("first.col", "over", "c.num_cols")).alias("k"))
    spread = over.groupBy("id", F.col("r").alias("row"), F.col("k").alias("col")).agg(F.min_by("c", "first").alias("c"))
    return spread.select("id", "row", "col", "c.*")


def headed(spread: DataFrame) -> DataFrame:
    """spread with header, how many rows the grid's header has: the leading rows with a flagged cell, one at least; without any flag the first row,
    unless it has a number beyond the first column.  Windows over one order of the places, so they are not made again for a join."""
    grid, row = Window.partitionBy("id"), Window.partitionBy("id", "row")
    flagged = spread.withColumns({"_flag": F.bool_or("column_header").over(row), "_n": F.row_number().over(row.orderBy("col"))})
    upto = grid.orderBy("row", "col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = flagged.withColumn("_upto", F.sum(F.when(F.col("_flag") & (F.col("_n") == 1), 1).otherwise(0)).over(upto))
    number = (F.col("row") == 0) & (F.col("col") > 0) & parse_amount(F.when(F.col("row") == 0, F.col("text"))).isNotNull()
    run = F.coalesce(F.max(F.when(F.col("_flag") & (F.col("_upto") == F.col("row") + 1), F.col("row") + 1)).over(grid), F.lit(0))
    rows = counted.withColumns({"_run": run, "_number": F.bool_or(number).over(grid)})
    return rows.withColumn("header", F.when(F.col("by_flags"), F.greatest("_run", F.lit(1))).when(F.col("_number"), 0).otherwise(1)).drop("_flag", "_n", "_upto", "_run", "_number")


def header(spread: DataFrame) -> DataFrame:
    """(id, header) of each grid."""
    return headed(spread).groupBy("id").agg(F.first("header").alias("header"))  # one value a grid


def labels(spread: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """(id, num_cols, labels, fingerprint): the header text of each column, from the top down, and a hash of the grid's shape."""
    rows = headed(spread) if head is None else spread.join(head, "id")
    top = F.when((F.col("row") < F.col("header")) & (F.col("text") != ""), F.struct("row", "text"))
    own = rows.groupBy("id", "col").agg(F.first("num_cols").alias("num_cols"), F.sort_array(F.collect_list(top)).alias("t"))
    own = own.select("id", "col", "num_cols", F.array_join(F.array_distinct(F.transform("t", lambda x: x["text"])), " / ").alias("label"))
    named = own.groupBy("id").agg(F.first("num_cols").alias("num_cols"), F.map_from_entries(F.collect_list(F.struct("col", "label"))).alias("m"))
    found = named.withColumn("labels", F.transform(F.sequence(F.lit(0), F.col("num_cols") - 1), lambda c: F.coalesce(F.element_at("m", c), F.lit(""))))
    shape = F.to_json(F.struct(F.transform("labels", folded).alias("labels"), F.col("num_cols").alias("num_cols")))
    return found.select("id", "num_cols", "labels", F.sha2(shape, 256).alias("fingerprint"))


def _phrase(phrase: str) -> str:
    return r"(?<![a-z0-9-])" + phrase.replace(" ", r"\ ") + r"(?![a-z0-9-])"


def extracted(cells: DataFrame, grids: DataFrame, roles: DataFrame) -> DataFrame:
    """One row for each data row: id, row, kind (item, total, suppressed, skipped), key, amount, fields (map), reason, box.

    Data rows come after the header, have a text, and are no band of sections alone.  A row with a few words that say so and without a quantity
    is a total: by its family's key, with the amount of the amount column, else of the rightmost money column, else of the rightmost
    number; a total that the family does not know, or without amount, is suppressed, so it never counts as an item."""
    # what a grid has besides its cells comes by its id alone, so that the places stay where they are
    told = roles.groupBy("id").agg(F.collect_list(F.when(F.col("role").isin(*FIELDS), F.struct("col", "role"))).alias("told"), F.bool_or(F.col("role") == "description").alias("described"))
    body = headed(places(cells, grids)).filter("row >= header").join(told.select("id", "told"), "id", "left")
    own = F.transform(F.filter("told", lambda x: x["col"] == F.col("col")), lambda x: x["role"])
    # amounts before the generator: within the aggregate they would not be compiled
    body = body.withColumn("amount", parse_amount(F.col("text"))).withColumn("role", F.explode_outer(own))
    cell = F.struct("col", "role", "text", "amount", "row_section", "box")
    rows = body.groupBy("id", "row").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    rows = rows.filter(F.exists("cells", lambda c: (c["text"] != "") & ~c["row_section"]))
    rows = rows.join(told.select("id", "described"), "id", "left").join(grids.select("id", "family"), "id", "left")
    names = F.filter("cells", lambda c: F.when(F.col("described"), c["role"] == "description").otherwise(c["col"] == 0) & (c["text"] != ""))
    rows = rows.withColumn("label", F.coalesce(F.get(names, F.lit(0))["text"], F.lit("")))
    counted = F.exists("cells", lambda c: c["role"].eqNullSafe("quantity") & c["amount"].isNotNull())
    short = (F.col("label") != "") & (F.size(F.split("label", " ")) <= LABEL_WORDS) & ~counted
    low, key = folded(F.col("label")), F.lit(None).cast("string")
    for family, phrases in TOTALS.items():
        for phrase, name in reversed(phrases):
            key = F.when((F.col("family") == family) & low.rlike(_phrase(phrase)), name).otherwise(key)
    known = lambda c: c["amount"].isNotNull()
    by_amount = F.filter("cells", lambda c: (c["role"] == "amount") & known(c))
    by_money = F.filter("cells", lambda c: c["role"].isin(*[m for m in MONEY if m != "amount"]) & known(c))
    any_one = F.filter("cells", known)
    last = lambda a: F.element_at(a, -1)
    best = F.when(F.size(by_amount) > 0, F.get(by_amount, F.lit(0))).when(F.size(by_money) > 0, last(by_money)).when(F.size(any_one) > 0, last(any_one))["amount"]
    rows = rows.withColumns({"key": F.when(short, key), "amount": best, "other": short & low.rlike("|".join(map(_phrase, NO_ITEM)))})
    numeric = lambda c: c["role"].isin(*MONEY, "quantity")
    filled = F.filter("cells", lambda c: c["role"].isNotNull() & F.when(numeric(c), known(c)).otherwise(c["text"] != ""))
    value = lambda role, name: F.get(F.filter(F.col("filled"), lambda c: c["role"] == role), F.lit(0))  # noqa: E731, ARG005
    rows = rows.withColumn("filled", filled)
    pairs = [F.struct(F.lit(name).alias("k"), F.when(F.lit(role in (*MONEY, "quantity")), value(role, name)["amount"].cast("string")).otherwise(value(role, name)["text"]).alias("v")) for role, name in FIELDS.items()]
    fields = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    kind = F.when(F.col("key").isNotNull() & F.col("amount").isNotNull(), "total").when(F.col("key").isNotNull() | F.col("other"), "suppressed").when(F.size("filled") == 0, "skipped").otherwise("item")
    reason = F.when(F.col("kind") == "suppressed", F.when(F.col("key").isNotNull(), "totals_row_without_amount").otherwise("unmapped_totals_row"))
    boxes = F.transform(F.filter("cells", lambda c: c["box"].isNotNull()), lambda c: c["box"])
    side = lambda pick, i: pick(F.transform(boxes, lambda b: b[i]))
    union = F.when(F.size(boxes) > 0, F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3)))
    rows = rows.withColumn("kind", kind)
    total = F.col("kind") == "total"
    return rows.select("id", "row", "kind", F.when(total, F.col("key")).alias("key"), F.when(total, F.col("amount")).alias("amount"), F.when(F.col("kind") == "item", fields).alias("fields"), reason.alias("reason"), union.alias("box"))
