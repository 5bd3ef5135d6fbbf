"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions.

The tree is domain, language, source.  Supplies add up from the leaves; the token budget flows down.  At each node the
children share what the node got in proportion to their weights; a child that can't use its share (supply times
epochs) gives the shortage to its siblings, again by weight, and only what a whole node can't use reaches its own
siblings.  With the children sorted by capacity per weight this is one running sum a level: child i is full if its
capacity per weight is at most what the others would get per weight.  All arithmetic is in whole numbers, the ratios
as decimals of 38 digits.  Remainders: every share rounds down, so a node's children get fewer than their number of tokens
less than the node, and these tokens are not granted.

A leaf's grant is taken from seeded epochs: whole passes over the leaf, then the prefix of the next epoch's order
(md5 of seed, epoch and doc_id) until the grant is spent; the document that crosses the grant is in.  To find the
prefix no leaf is ever sorted as a whole: token counts by the first hex digits of the order tell in which bucket the grant
ends, and only that bucket is sorted; larger leaves take more digits, so a bucket has about `BUCKET` documents.

Nulls: null domain, lang or source form leaves of their own; a null text has no tokens, and texts without tokens are
never drawn; a null doc_id is ordered as the empty string.  Repeated rows, and all rows of one doc_id in a leaf, are drawn
together; if such a group ends a bucket, it is in as a whole.  A very long text counts with all its words.  An empty table
gives an empty result.  Extra columns are ignored by `draw`, also one named domain.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import stash, table, words_of

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS = 2024, 3
#: Weights a level and name; others weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 2, "d2": 1, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
#: The budget in hundredths of all tokens.
PERCENT = 80
#: Documents in a bucket of a leaf's order, about.
BUCKET = 512


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4, in this tree; sources without a number are in d0."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def _weight(level: str, weights: dict) -> Column:
    w = F.lit(1)
    for name, value in weights.get(level, {}).items():
        w = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(value)).otherwise(w)
    return w.cast("long")


def grants(leaves: DataFrame, weights: dict = WEIGHTS, epochs: int = EPOCHS, percent: int = PERCENT) -> DataFrame:
    """leaves: (domain, lang, source, supply).  Returns the leaves with `tokens`, their grant of `percent` of all supply."""
    nodes = leaves.withColumn("cap", F.col("supply") * epochs)
    got = None
    for d, level in enumerate(LEVELS):
        path = list(LEVELS[: d + 1])
        kids = nodes.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply")).withColumn("w", _weight(level, weights))
        if d:
            up = got.withColumnsRenamed({p: f"_{p}" for p in LEVELS[:d]})
            on = None
            for p in LEVELS[:d]:
                c = kids[p].eqNullSafe(up[f"_{p}"])
                on = c if on is None else on & c
            kids = kids.join(up, on).drop(*[f"_{p}" for p in LEVELS[:d]])
        else:
            kids = kids.withColumn("got", F.expr(f"CAST(CAST(sum(supply) OVER () AS decimal(38,0)) * {percent} div 100 AS bigint)"))
        by = Window.partitionBy(*LEVELS[:d]) if d else Window.partitionBy(F.lit(0))
        # capacity per weight in millionths, whole numbers: the same order in any engine
        run = by.orderBy(F.expr("CAST(cap AS decimal(38,0)) * 1000000 div w"), F.col(level).asc_nulls_first())
        before = run.rowsBetween(Window.unboundedPreceding, -1)
        kids = kids.withColumns({"cap0": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w1": F.sum("w").over(run.rowsBetween(0, Window.unboundedFollowing))})
        fair = F.expr("w * (CASE WHEN got > cap0 THEN got - cap0 ELSE 0 END) div w1")
        # those before the first child that isn't full are full; from it on all share alike
        kids = kids.withColumn("short", F.when(F.col("cap") > fair, F.struct("cap0", "w1")))
        first = F.first("short", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
        kids = kids.withColumn("at", first)
        share = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr("w * (CASE WHEN got > at.cap0 THEN got - at.cap0 ELSE 0 END) div at.w1")))
        got = kids.select(*path, share.alias("got"))
    return leaves.join(got.withColumnsRenamed({p: f"_{p}" for p in LEVELS}), _same(leaves)).drop(*[f"_{p}" for p in LEVELS]).withColumnRenamed("got", "tokens")


def _same(left: DataFrame) -> Column:
    on = F.lit(True)
    for p in LEVELS:
        on = on & left[p].eqNullSafe(F.col(f"_{p}"))
    return on


def draw(df: DataFrame, weights: dict = WEIGHTS, epochs: int = EPOCHS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies): how often each row is drawn, 1 at least; others are left out.

    df needs doc_id, text, lang, source; n_tokens counts white-space words."""
    docs = df.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens")).filter("n_tokens > 0")
    docs = stash(docs, "sizes")
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n"))
    plan = stash(grants(leaves, weights, epochs, percent).withColumns({"whole": F.expr("tokens div supply"), "rest": F.expr("tokens % supply"), "digits": F.expr(f"CAST(greatest(0, least(8, ceil(log(16, n / {BUCKET})))) AS int)")}), "grants")
    names = {p: f"_{p}" for p in LEVELS}
    side = plan.select(*[F.col(p).alias(f"_{p}") for p in LEVELS], "whole", "rest", "digits")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    docs = docs.join(side, _same(docs)).drop(*names.values()).withColumn("o", order)
    docs = docs.withColumn("bucket", F.expr("left(o, digits)"))
    ends = docs.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    up = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).filter("before < rest").select(*[F.col(p).alias(f"_{p}") for p in LEVELS], F.col("bucket").alias("_bucket"), "before", (F.col("before") + F.col("n") > F.col("rest")).alias("last"))
    docs = docs.join(ends, _same(docs) & (docs["bucket"] == ends["_bucket"]), "left").drop(*names.values(), "_bucket")
    inside = docs.filter("last").withColumn("sum", F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("o")) - F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket", "o")))
    inside = inside.withColumn("more", (F.col("before") + F.col("sum") < F.col("rest")).cast("long")).drop("sum")
    other = docs.filter("last IS NULL OR NOT last").withColumn("more", F.col("before").isNotNull().cast("long"))
    return inside.unionByName(other).select("doc_id", *LEVELS, "n_tokens", (F.col("whole") + F.col("more")).alias("copies")).filter("copies > 0")


def op2(spark, sf_dir):
    return draw(table(spark, sf_dir, "documents"))


def _sql_weight(level: str, weights: dict) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights.get(level, {}).items()) + " ELSE 1 END" if weights.get(level) else "1"


def oracle(weights: dict = WEIGHTS, epochs: int = EPOCHS, percent: int = PERCENT, seed: int = SEED, docs: str = "documents", rows: str = "") -> str:
    """The same in DuckDB's SQL: CTEs up to `drawn`."""
    out = [f"""s AS (SELECT * FROM (SELECT *, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % 4) AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {docs}) WHERE n_tokens > 0)""".replace("\\\\", "\\"),
           f"leaves AS (SELECT domain, lang, source, sum(n_tokens) AS supply, sum(n_tokens) * {epochs} AS cap FROM s GROUP BY ALL)"]
    for d, level in enumerate(LEVELS):
        path, up = ", ".join(LEVELS[: d + 1]), " AND ".join(f"k.{p} IS NOT DISTINCT FROM u.{p}" for p in LEVELS[:d])
        part = f"PARTITION BY {', '.join(LEVELS[:d])}" if d else ""
        order = f"{part} ORDER BY cap * 1000000 // w, {level} NULLS FIRST"
        out += [
            f"k{d} AS (SELECT {path}, sum(cap) AS cap, sum(supply) AS supply, {_sql_weight(level, weights)} AS w FROM leaves GROUP BY {path})",
            f"j{d} AS (SELECT k.*, u.got FROM k{d} k JOIN g{d - 1} u ON {up})" if d else f"j0 AS (SELECT *, sum(supply) OVER () * {percent} // 100 AS got FROM k0)",
            f"r{d} AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap0, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w1 FROM j{d})",
            f"f{d} AS (SELECT *, CASE WHEN cap > w * greatest(got - cap0, 0) // w1 THEN [cap0, w1] END AS short FROM r{d})",
            f"a{d} AS (SELECT *, first_value(short IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lim FROM f{d})",
            f"g{d} AS (SELECT {path}, CASE WHEN lim IS NULL THEN cap ELSE least(cap, w * greatest(got - lim[1], 0) // lim[2]) END AS got FROM a{d})",
        ]
    same = " AND ".join(f"s.{p} IS NOT DISTINCT FROM g.{p}" for p in LEVELS)
    also = " AND ".join(f"l.{p} IS NOT DISTINCT FROM g.{p}" for p in LEVELS)
    out += [
        f"p AS (SELECT g.*, got // supply AS whole, got % supply AS rest FROM g2 g JOIN leaves l ON {also})",
        f"o AS (SELECT s.*, g.whole, g.rest, md5(concat_ws(':', '{seed}', CAST(g.whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS o FROM s JOIN p g ON {same})",
        "c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o RANGE UNBOUNDED PRECEDING), 0) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, o) AS before FROM o)",
        "drawn AS (SELECT *, CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c)",
    ]
    return ",\n".join(out)


SQL = "WITH " + oracle() + "\nSELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, copies FROM drawn WHERE copies > 0"
