"""Table grids: markdown rows, header rows, column labels, totals, line items, quality scores; all on exploded cells."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words that name a column's role, and phrases of totals rows, in the order they are tried.
ROLES = {"description": ("description", "item", "service"), "quantity": ("qty", "quantity", "units"), "unit_price": ("unit price", "rate", "price"), "amount": ("amount", "total", "charge")}
TOTALS = ("subtotal", "grand total", "total due", "amount due", "balance", "total", "tax")


def markdown_rows(tables: DataFrame) -> DataFrame:
    """(id, markdown) -> (id, row, cells): separator rows skipped, rows numbered densely, cells trimmed."""
    lines = F.filter(F.split("markdown", "\n"), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^[\s|:\-]+$"))
    rows = tables.select("id", F.posexplode(lines).alias("row", "line"))
    return rows.select("id", "row", F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))


def numeric(text: Column) -> Column:
    return F.regexp_replace(text, r"[$,%\s()]", "").rlike(r"^-?[0-9]+([.][0-9]+)?$")


def header_rows(cells: DataFrame) -> DataFrame:
    """cells: id, row, col, text, column_header.  Rows of the header: the leading run with flagged cells, else row 0 if it
    has no number beyond the first column."""
    rows = cells.groupBy("id", "row").agg(F.bool_or("column_header").alias("flagged"), F.bool_or((F.col("col") > 0) & numeric(F.col("text"))).alias("number"))
    end = rows.groupBy("id").agg(F.coalesce(F.min(F.when(~F.col("flagged"), F.col("row"))), F.max("row") + 1).alias("run"), F.max(F.when(F.col("row") == 0, ~F.col("number"))).alias("plain"))
    return end.select("id", F.when(F.col("run") > 0, F.col("run")).when(F.col("plain"), 1).otherwise(0).alias("header"))


def columns(cells: DataFrame, header: DataFrame) -> DataFrame:
    """(id, col, label, role): header texts joined by ' / ', the role by the first role word in the label."""
    top = cells.join(header, "id").filter("row < header AND trim(text) <> ''")
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"]), " / ")
    out = top.groupBy("id", "col").agg(label.alias("label"))
    role = None
    for name, words in ROLES.items():
        hit = F.lower("label").rlike(r"\b(" + "|".join(words) + r")\b")
        role = F.when(hit, name) if role is None else role.when(hit, name)
    return out.withColumn("role", role)


def line_items(cells: DataFrame) -> DataFrame:
    """(id, row, kind, description, quantity, unit_price, amount): data rows by column role; kind is total for rows that a
    totals phrase opens and that have no quantity, else item."""
    header = header_rows(cells)
    named = cells.join(header, "id").filter("row >= header").join(columns(cells, header).select("id", "col", "role"), ["id", "col"], "left")
    rows = named.groupBy("id", "row").agg(*[F.min(F.when((F.col("role") == r) & (F.trim("text") != ""), F.trim("text"))).alias(r) for r in ROLES], F.min_by("text", "col").alias("first"))
    total = F.lower("first").rlike(r"^\s*(" + "|".join(TOTALS) + r")\b") & F.col("quantity").isNull()
    return rows.select("id", "row", F.when(total, "total").otherwise("item").alias("kind"), *ROLES)


def fingerprint(cells: DataFrame) -> DataFrame:
    """(id, fingerprint): sha256 of the column labels in order."""
    cols = columns(cells, header_rows(cells))
    return cols.groupBy("id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.lower("label").alias("label")))), lambda s: s["label"]), "|"), 256).alias("fingerprint"))


def quality(cells: DataFrame) -> DataFrame:
    """(id, score): size, filled share, header and numbers of a grid, rounded to 4 places."""
    g = cells.groupBy("id").agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"), F.avg((F.trim("text") != "").cast("double")).alias("filled"), F.bool_or("column_header").cast("int").alias("head"), F.count_if(numeric(F.col("text"))).alias("num"))
    score = 0.25 * F.least(F.lit(1.0), F.col("r") / 4) + 0.20 * F.least(F.lit(1.0), F.col("c") / 4) + 0.25 * F.col("filled") + 0.15 * F.col("head") + 0.10 * F.least(F.lit(1.0), F.col("num") / 2)
    return g.select("id", F.round(score, 4).alias("score"))


def best_evidence(refs: DataFrame) -> DataFrame:
    """refs: id, rank, row_index, element_id, page_number.  The most specific reference of each fact: row, element, page, none."""
    specific = F.when(F.col("row_index").isNotNull(), 0).when(F.col("element_id").isNotNull(), 1).when(F.col("page_number").isNotNull(), 2).otherwise(3)
    w = Window.partitionBy("id").orderBy(specific, "rank")
    return refs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
