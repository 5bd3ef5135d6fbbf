"""Line dedup in DataFrame functions only: lines found in several documents stay in the first of them.

1. Lines are reduced to the MD5 of their key (stripped, A-Z lower-cased), 16 bytes, with document and position, and
   written to the shared folder.
2. The frequent hashes of a sample (all lines of one document in `SAMPLE`) get a salt by document: at most `MOST_HOT` of
   them, so no other hash has more than about 1 / `MOST_HOT` of all lines.  Their first documents come from one aggregate with
   map-side combining.  The sample only decides how rows are laid out, never which lines go.
3. All lines are range-partitioned by hash and salt and sorted by document and position inside; each range streams
   through once, and a row whose document isn't the first of its hash is dropped.  Salted ranges compare with the first
   document of step 2 instead of their own.
4. The dropped positions make one bitmap per document, one bit a line, written as the runs of kept lines, and no text.

Nulls: a null text is one empty line; a null doc_id is a document of its own that comes before all others.  doc_id is of
any type with an order.  Rows of one doc_id count as one document; each row is judged on its own lines.  An empty text is
one empty line, which stays.  Extra columns pass through whatever their names, but for n_lines, n_dropped and kept_text,
which are replaced.  An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import WS, lower_ascii, stash, table

MIN_CHARS = 10
SALTS = 64
SAMPLE, OFTEN, MOST_HOT = 64, 12, 10_000


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def line_bitmaps(df: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS, often: int = OFTEN) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep, tail): for each distinct row that loses a line, its keep bitmap as runs.

    keep: runs of kept lines as structs (start, n), from 0, ascending; tail: the first line after the last dropped one.
    text_key is the MD5 of the text.  Rows without a line to drop have no bitmap."""
    body = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(F.split(body, "\n"), lambda x: lower_ascii(F.btrim(x, F.lit(WS))))
    lines = df.select("doc_id", _text_key(body).alias("text_key"), F.posexplode(keys).alias("pos", "key")).filter(F.length("key") >= min_chars)
    lines = stash(lines.select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"), "doc_id", "text_key", "pos"), "lines")
    sample = lines.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(SAMPLE)) == 0).groupBy("h").agg(F.count("*").alias("n"))
    hot = stash(sample.filter(F.col("n") >= often).orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h"), "hot")
    firsts = lines.join(F.broadcast(hot), "h").groupBy("h").agg(F.min(F.struct("doc_id")).alias("hot"))  # at most MOST_HOT rows
    lines = lines.join(F.broadcast(stash(firsts, "firsts")), "h", "left")
    salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(salts))).cast("int")
    run = Window.partitionBy("h", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.withColumn("salt", salt).repartitionByRange("h", "salt").withColumn("first", F.coalesce("hot", F.first(F.struct("doc_id")).over(run)))
    out = seen.filter(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    gaps = F.expr("filter(transform(p, (x, i) -> struct(coalesce(get(p, i - 1), -1) + 1 AS start, x - coalesce(get(p, i - 1), -1) - 1 AS n)), r -> r.n > 0)")
    return out.select("doc_id", "text_key", F.size("p").cast("long").alias("n_dropped"), gaps.alias("keep"), (F.element_at("p", -1) + 1).alias("tail"))


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS, often: int = OFTEN) -> DataFrame:
    """The rows with n_lines, n_dropped and kept_text, the lines that their bitmap keeps."""
    bits = line_bitmaps(df, min_chars, salts, often)
    others = [F.col(c) for c in df.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = df.select(F.struct(*others).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_key", _text_key(F.col("text"))).alias("r")
    both = rows.join(bits.alias("b"), F.col("r.row.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.text_key") == F.col("b.text_key")), "left")
    both = both.select("row", F.split("text", "\n").alias("lines"), "text", "b.n_dropped", "keep", "tail")
    kept = F.expr("array_join(concat(flatten(transform(keep, r -> slice(lines, r.start + 1, r.n))), slice(lines, tail + 1, size(lines))), '\n')")
    whole = F.when(F.col("n_dropped").isNull(), F.col("text")).otherwise(kept)
    return both.select("row.*", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), whole.alias("kept_text"))


def op4(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL_LINES = r"""
l AS (SELECT {rid} AS rid, doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM {docs}),
lk AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM lk WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
ld AS (SELECT lk.*, f.first IS NOT NULL AND lk.doc_id > f.first AS dropped FROM lk LEFT JOIN f USING (key)),
lg AS (SELECT rid, doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept_text FROM ld GROUP BY rid, doc_id)
"""

SQL = "WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents), " + SQL_LINES.replace("{docs}", "d").replace("{rid}", "rid") + "SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM lg"
