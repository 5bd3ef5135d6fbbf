"""Span candidates over order lines laid out on pages: four lines a page, each with a label, a value beside or below it, and a sentence."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.operators import spans
from foliospark.sources.tables import table


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three elements a line.  Places on the page follow part, supplier and quantity.  Lines are dealt out to all partitions, as what comes
    of them is far larger than they are."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    x = lines.withColumn("n", F.row_number().over(line) - 1)
    row = F.col("n") % 4
    price, day = F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd")
    label = F.when(F.col("l_returnflag") == "A", "UNIT PRICE").when(F.col("l_returnflag") == "N", "Amount due:").otherwise("price of the part")
    value = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("$"), price)).otherwise(day)
    note = F.concat(F.lit("Shipped on: "), day, F.lit(" from "), F.lpad("l_suppkey", 5, "0"), F.lit("\nREF-"), F.lpad("l_partkey", 7, "0"), F.lit(" tax "), F.col("l_tax").cast("decimal(4,2)").cast("string"), F.lit(" call (555) 010-"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0"))

    def element(i: int, text, left, top):
        box = F.array(left, top, left + F.lit(60.0), top + F.lit(12.0))
        return F.struct(F.lit(i).alias("i"), text.alias("text"), box.alias("box"))

    down = row * F.lit(60.0)
    x0, x1 = (F.col("l_suppkey") % 300).cast("double"), (F.col("l_partkey") % 500).cast("double")
    parts = F.array(element(0, label, x0, down), element(1, value, x1, down + F.col("l_quantity").cast("double")), element(2, note, F.lit(500.0), down + 40))
    out = x.select(F.col("l_orderkey").alias("doc_id"), (F.floor(F.col("n") / 4) + 1).cast("int").alias("page"), (row * 3).alias("base"), F.explode(parts).alias("e"))
    ordinal = F.col("base") + F.col("e.i")
    page_id = F.concat_ws("-", "doc_id", "page")
    return out.select("doc_id", "page", page_id.alias("page_id"), F.concat_ws("-", "doc_id", "page", ordinal).alias("element_id"), ordinal.alias("ordinal"), "e.text", "e.box")


def adjacent_labels(s, d):
    """Values right of a label, or below it."""
    return spans.beside(elements(s, d)).select("v.doc_id", "v.page", F.col("l.ordinal").alias("label"), F.col("v.ordinal").alias("value"), F.col("v.text").alias("value_text"), "kind")


def span_candidates(s, d):
    return spans.candidates(elements(s, d))


QUERIES = {"adjacent_labels": adjacent_labels, "span_candidates": span_candidates}

ORACLES = {
    "adjacent_labels": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n FROM lineitem),
    lab AS (SELECT l_orderkey AS doc, n // 4 AS page, (n % 4) * 3 AS ordinal, l_suppkey % 300 AS l, (n % 4) * 60 AS t FROM x WHERE l_returnflag IN ('A', 'N')),
    val AS (SELECT l_orderkey AS doc, n // 4 AS page, (n % 4) * 3 + k AS ordinal, CASE k WHEN 0 THEN l_suppkey % 300 WHEN 1 THEN l_partkey % 500 ELSE 500 END AS l, (n % 4) * 60 + CASE k WHEN 0 THEN 0 WHEN 1 THEN l_quantity ELSE 40 END AS t,
        CASE k WHEN 0 THEN 'price of the part' WHEN 1 THEN CASE l_linestatus WHEN 'F' THEN '$' || CAST(l_extendedprice AS DECIMAL(18,2)) ELSE strftime(l_shipdate, '%Y-%m-%d') END
        ELSE 'Shipped on: ' || strftime(l_shipdate, '%Y-%m-%d') || ' from ' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || chr(10) || 'REF-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || ' tax ' || CAST(l_tax AS DECIMAL(4,2)) || ' call (555) 010-' || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 4, '0') END AS text
        FROM x, (SELECT unnest([0, 1, 2]) AS k) WHERE k > 0 OR l_returnflag NOT IN ('A', 'N'))
    SELECT doc AS doc_id, CAST(page + 1 AS INT) AS page, CAST(lo AS INT) AS label, CAST(vo AS INT) AS value, text AS value_text, CASE WHEN beside THEN 'label_right_of' ELSE 'label_below_of' END AS kind
    FROM (SELECT val.doc, val.page, lab.ordinal AS lo, val.ordinal AS vo, text, abs(val.t - lab.t) < 12 AND val.l - lab.l - 60 BETWEEN 0 AND 220 AS beside, abs(val.l - lab.l) < 60 AND val.t - lab.t - 12 BETWEEN 0 AND 30 AS below FROM lab JOIN val ON lab.doc = val.doc AND lab.page = val.page) p WHERE beside OR below""",
}
