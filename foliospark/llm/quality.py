"""Quality rules as a short-circuit cascade, in DataFrame functions only.

`order_rules` draws a random sample, writes it to the shared folder and measures there each rule's cost, by the clock over
repeated runs, and its rejections, alone and after others.  The rule with the most rejections per second comes first,
then the one with the most among what it leaves, and so on.  `quality_rules` tests the rules in this order in a CASE, which
stops at the first one that fails; what only a rule reads is computed inside its branch.  The verdict does not depend on
the order; `rejected_by` names the first rule of this run's order.

The sample: each row is in with a chance that makes `sample_rows` of them expected, by a seeded draw over all rows, so a
sorted table gives no other order.

Nulls: a null text is the empty text.  Extra columns pass through; those whose names the result uses are replaced.
Repeated rows are judged one by one.  An empty table gives an empty result, by the rules in the order of their names.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WS, drop, stash, words_of

NGRAM = 8


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measures and text."""

    name: str
    fails: str


#: The defaults look only for plain junk: symbol noise, shouting, table rows, the same lines again and again.
RULES = (
    Rule("symbols", "10 * n_symbols > 2 * word_chars"),
    Rule("dup_lines", "2 * n_dup_lines > n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("shouting", "5 * length(regexp_replace(text, '[^A-Z]', '')) > 3 * word_chars"),
    Rule("bars", "4 * regexp_count(text, '[|]') > n_words"),
)


def measures(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    bare = F.col("_text")
    for ch in WS:
        bare = F.replace(bare, F.lit(ch), F.lit(""))
    # Filters on the measures may be pushed below them, and then stand with all expressions inlined.  So what a lambda uses
    # again and again is bound once, as the parameter of a one-element transform.
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashes = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (NGRAM - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(NGRAM))))
    df = df.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    return df.withColumns({
        "n_words": F.size(words_of(F.col("_text"))).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words_of(F.col("_text")), lambda ws: F.when(F.size(ws) <= NGRAM, F.lit(0)).otherwise(let(hashes(ws), _covered))).cast("long"),
    }).withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def _covered(grams: Column) -> Column:
    """Words in windows that have a twin: one pass over the sorted hashes marks the windows, one over their starts adds up."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twins = lambda s: F.filter(F.transform(s, lambda x, k: F.when(near(s, k - 1, x) | near(s, k + 1, x), x["i"])), lambda y: y.isNotNull())
    starts = F.sort_array(F.element_at(F.transform(F.array(pairs), twins), 1))
    step = lambda a, p: F.struct((a["n"] + p + NGRAM - F.greatest(a["upto"], p)).alias("n"), (p + NGRAM).alias("upto"))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), step, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered)


def _seconds(df: DataFrame, column: Column, runs: int = 3) -> float:
    """The least time of so many runs of an aggregate over the column."""
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        df.agg(F.max(column)).collect()
        took.append(time.perf_counter() - t)
    return min(took)


def order_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 2000, seed: int = 9) -> list[Rule]:
    """Rules by rejections per second among what the earlier ones leave, on about `rows` random rows."""
    by_name = sorted(rules, key=lambda r: r.name)
    total = df.count()  # of a file, from its footers
    if not total:
        return by_name
    looks = stash(df.select("text").sample(fraction=min(1.0, rows / total), seed=seed).select(F.coalesce("text", F.lit("")).alias("text")), "sample")
    own = measures(looks.coalesce(1))  # one task: its time is the rule's work.withColumn("text", F.col("_text"))
    empty = _seconds(looks.coalesce(1), F.octet_length("text"))
    cost = {r.name: max(_seconds(own, F.expr(f"CAST({r.fails} AS INT)")) - empty, 1e-4) for r in rules}
    fails = [F.expr(r.fails).alias(r.name) for r in rules]
    seen = {tuple(x[r.name] for r in rules): x["n"] for x in own.select(*fails).groupBy(*[r.name for r in rules]).agg(F.count("*").alias("n")).collect()}  # at most 2 ** rules rows
    drop(looks)
    order, left = [], list(by_name)
    while left:
        place = {r.name: k for k, r in enumerate(rules)}
        gain = lambda r: sum(n for f, n in seen.items() if f[place[r.name]]) / cost[r.name]  # noqa: E731, B023
        best = max(left, key=gain)
        order.append(best)
        left.remove(best)
        seen = {f: n for f, n in seen.items() if not f[place[best.name]]}
    return order


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Adds the measures, `kept`, and `rejected_by`: the first rule of the cascade that the text fails, else null."""
    ordered = order_rules(df, rules, sample_rows)
    cascade: Column = F.when(F.col("base_failed"), F.lit("base"))
    out = measures(df).withColumn("_given", F.col("text")).withColumn("text", F.col("_text"))
    for r in ordered:
        cascade = cascade.when(F.expr(r.fails), F.lit(r.name))
    out = out.withColumn("rejected_by", cascade).withColumn("kept", F.col("rejected_by").isNull())
    return out.withColumn("text", F.col("_given")).drop("_given", "_text")


def op9(spark, sf_dir):
    from foliospark.llm.common import table

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Extra parts of the oracle that other oracles use too.
SQL_MEASURES = r"""
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 8),
g2 AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS gram FROM g),
tw AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g2) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM tw, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
q AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
k AS (SELECT *, NOT (base_failed OR 10 * n_symbols > 2 * word_chars OR 2 * n_dup_lines > n_words OR word_chars > 40 * n_words
        OR 5 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * word_chars
        OR 4 * (length(text) - length(replace(text, '|', ''))) > n_words) AS kept FROM q)
"""

SQL = "WITH " + SQL_MEASURES.replace("{docs}", "documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM k"
