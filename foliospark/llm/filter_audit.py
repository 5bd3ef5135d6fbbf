"""Audit of filters that run one after another: what each removes in every order of the filters.

Each document becomes a bit mask of the filters that it fails.  A part (a language) is then a few rows of an incidence
matrix: its documents, its good and its toxic ones, by mask.  What step s of order o keeps, removes, finds removed already or
removes alone is a fixed function of the mask, hence a column of a 0/1 matrix with one row a mask and one column an
(order, step): 32 by 600 for five filters.  Integer products of the two give all counts, so the corpus is read once,
whatever the number of orders.  The products are computed part by part in tasks.

The filters' conditions read the text alone, but for `repeated`: a text that a smaller doc_id has anywhere in the table.
Its rows are counted by text and id and never joined with each other, so the copies of a text need not meet in one task.

Nulls: a null text is empty, a null language is the part ''.  A null doc_id is larger or smaller than none, so such rows
never fail `repeated` and make none fail; they have no label.  Rows of one doc_id and text don't fail by each other.
A doc_id with several label rows is good, or toxic, if any of them says so.  Texts are compared by SHA-256.  An empty table
has no parts and an empty result.  Extra columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import table, words_of

#: Letter, and the failure condition as SQL over text (not null) and ws, its words.  The last one is counted, see `masks`.
RULES = (
    ("A", "size(ws) < 200"),
    ("B", "100L * size(array_distinct(ws)) < 50L * size(ws)"),
    ("C", "100L * regexp_count(text, '[A-Z]') > 3L * length(text)"),
    ("D", "text RLIKE '[#$%&*|]'"),
)
REPEATED = "E"
SALTS = 64
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def masks(docs: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ws", words_of(F.col("text")))
    bits = sum((F.expr(c).cast("int") * (1 << k) for k, (_, c) in enumerate(rules)), F.lit(0))
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    # rows without an id match no label: the salt spreads them
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.select("doc_id", "part", salt.alias("salt"), key.alias("key"), bits.alias("mask"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = rows.join(marks.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    kind = ("key", "part", "mask", "good", "toxic")
    ids = both.groupBy("doc_id", "salt", *kind).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    cells = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("free"), first.alias("first"))
    # a text's cells: at most a few a part; those that hold its smallest id let these rows pass
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    cells = cells.withColumn("passes", F.col("free") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    again = 1 << len(rules)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + again).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    cells = cells.select("part", split.alias("m"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    n = F.col("m.n")
    return cells.groupBy("part", F.col("m.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def outcomes(letters: str) -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """The orders, a 0/1 matrix of masks by (order, step) for each outcome, and the filter's number at each (order, step)."""
    orders = ["".join(p) for p in permutations(letters)]
    which = np.array([[letters.index(c) for c in o] for o in orders])  # order, step
    own = (1 << which).reshape(-1)
    before = (np.cumsum(1 << which, axis=1) - (1 << which)).reshape(-1)
    mask = np.arange(1 << len(letters))[:, None]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    return orders, {k: v.astype(np.int64) for k, v in made.items()}, which


def audit(docs: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row for each part, order and step."""
    letters = "".join(r[0] for r in rules) + REPEATED
    orders, by, which = outcomes(letters)
    steps, size = len(letters), 1 << len(letters)
    m = masks(docs, labels, rules)
    stacked = m.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most `size` structs a part

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, cells in zip(b["part"], b["cells"]):
                h = np.zeros((3, size), np.int64)
                for c in cells:
                    h[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                got = {k: h @ v for k, v in by.items()}
                removed = got["removed"]
                value = np.zeros(steps, np.int64)
                np.add.at(value, which.reshape(-1), removed[0])
                yield pd.DataFrame({
                    "part": part, "filter_order": np.repeat(orders, steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(orders)),
                    "kept": got["kept"][0], "removed": removed[0], "redundant": got["redundant"][0], "unique_fails": got["unique_fails"][0],
                    "good_lost": removed[1], "toxic_lost": removed[2], "shapley": value[which.reshape(-1)],
                })

    return stacked.mapInPandas(multiply, OUT)


def op12(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        coalesce(good, 0) AS good, coalesce(lab.toxic, 0) AS toxic FROM documents d LEFT JOIN lab ON lab.doc_id = d.doc_id),
f AS (SELECT part, good, toxic, len(ws) < 200 AS A, 100 * len(list_distinct(ws)) < 50 * len(ws) AS B,
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS C,
        regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E FROM t),
m AS (SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
        count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
x AS (SELECT *, contains(fails, own) AS bad, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM m, s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
