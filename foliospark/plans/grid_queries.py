"""Grids with merged cells, one an order: a header of two rows, names that run over the code column, bands, totals."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators import merged_grids
from foliospark.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by order, in all partitions, as what comes of them is far larger than they are."""
    return table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = _lines(spark, sf_dir).withColumns({"row": F.row_number().over(line) + 1, "tax": F.round(F.col("l_tax") * 100), "off": F.round(F.col("l_discount") * 100)})

    def cell(pos, row, col, text, down=1, over=1, head=False, band=False, box=None):
        col_, none = F.lit(col), F.lit(None).cast("array<double>")
        return F.struct(pos.alias("pos"), row.cast("int").alias("row"), col_.alias("col"), F.lit(down).alias("row_span"), F.lit(over).alias("col_span"), text.alias("text"), F.lit(head).alias("column_header"), F.lit(band).alias("row_section"), (none if box is None else box).alias("box"))

    zero, one = F.lit(0), F.lit(1)
    top = [cell(F.lit(k), zero, c, F.lit(t), down, over, True) for k, (c, t, down, over) in enumerate([(0, " Item ", 1, 2), (0, " Item ", 1, 2), (2, "Qty", 2, 1), (3, "Amount", 2, 1)])]
    top += [cell(F.lit(10), one, 0, F.lit("Name"), head=True), cell(F.lit(11), one, 1, F.lit("Code"), head=True), cell(F.lit(12), one, 2, F.lit("shadowed"), head=True)]
    row, at = F.col("row"), F.col("row") * 20
    box = lambda a, b: F.array(F.lit(float(a)), F.col("row") * F.lit(10.0), F.lit(float(b)), F.col("row") * F.lit(10.0) + 8)
    total = F.col("tax") >= 7
    name = F.when(F.col("tax") == 8, "Sales  tax").when(F.col("tax") == 7, "Totals").otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")))
    quantity = F.when(total, "").otherwise(F.col("l_quantity").cast("int").cast("string"))
    price = F.when(F.col("l_quantity") < 3, "n/a").otherwise(F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
    wide = [cell(at, row, 0, name, over=2, box=box(0, 40)), cell(at + 1, row, 0, name, over=2, box=box(0, 40))]
    two = [cell(at, row, 0, name, box=box(0, 20)), cell(at + 1, row, 1, F.concat(F.lit("C"), F.col("l_suppkey").cast("string")), box=box(20, 40))]
    rest = [cell(at + 2, row, 2, quantity), cell(at + 3, row, 3, price, box=box(60, 80))]
    band = [cell(at, row, 0, F.lit("Parts"), over=4, band=True)]
    own = F.when(F.col("off") == 10, F.array(*band)).when(F.col("l_returnflag") == "A", F.array(*wide, *rest)).otherwise(F.array(*two, *rest))
    # an order's first line also brings the header
    return x.select(F.col("l_orderkey").alias("id"), F.explode(F.when(row == 2, F.concat(F.array(*top), own)).otherwise(own)).alias("c")).select("id", "c.*")


def _grids(s, d):
    cells = _cells(s, d)
    ids = _lines(s, d).select(F.col("l_orderkey").alias("id")).distinct()
    grids = ids.select("id", F.lit(None).cast("int").alias("num_rows"), F.lit(None).cast("int").alias("num_cols"), F.lit("invoice").alias("family"))
    roles = ids.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(r).alias("role")) for c, r in enumerate(("description", "code", "quantity", "amount"))])).alias("r")).select("id", "r.*")
    return cells, grids, roles


def merged_rows(s, d):
    out = merged_grids.extracted(*_grids(s, d))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("id", "row", "kind", "key", F.col("amount").cast("double").alias("amount"), text.alias("fields"), "reason", F.array_join(F.transform("box", lambda v: v.cast("int").cast("string")), ",").alias("box"))


def merged_labels(s, d):
    cells, grids, _ = _grids(s, d)
    return merged_grids.labels(merged_grids.places(cells, grids)).select("id", F.array_join("labels", "|").alias("labels"), "fingerprint")


QUERIES = {"merged_rows": merged_rows, "merged_labels": merged_labels}

ORACLES = {
    "merged_rows": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1 AS r, round(l_tax * 100) AS tax, round(l_discount * 100) AS off, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem),
    k AS (SELECT *, CASE WHEN tax = 8 AND (l_quantity >= 3 OR l_returnflag <> 'A') THEN 'total' WHEN tax >= 7 THEN 'suppressed' ELSE 'item' END AS kind FROM x WHERE off <> 10)
    SELECT l_orderkey AS id, CAST(r AS INT) AS row, kind, CASE WHEN kind = 'total' THEN 'invoice.tax_total' END AS key, CASE WHEN kind <> 'total' THEN NULL WHEN l_quantity >= 3 THEN CAST(p AS DOUBLE) ELSE CAST(l_suppkey AS DOUBLE) END AS amount,
    CASE WHEN kind = 'item' THEN 'code=' || CASE l_returnflag WHEN 'A' THEN 'Part ' || l_partkey ELSE 'C' || l_suppkey END || ';description=Part ' || l_partkey || CASE WHEN l_quantity >= 3 THEN ';net_amount=' || CAST(p AS DECIMAL(18,4)) ELSE '' END || ';quantity=' || CAST(l_quantity AS DECIMAL(18,4)) END AS fields,
    CASE WHEN kind = 'suppressed' THEN CASE tax WHEN 8 THEN 'totals_row_without_amount' ELSE 'unmapped_totals_row' END END AS reason, '0,' || r * 10 || ',80,' || (r * 10 + 8) AS box FROM k""",
    "merged_labels": """SELECT DISTINCT l_orderkey AS id, 'Item / Name|Item / Code|Qty|Amount' AS labels, sha256('{"labels":["item / name","item / code","qty","amount"],"num_cols":4}') AS fingerprint FROM lineitem""",
}
