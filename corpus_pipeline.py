"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.  Each stage is one of the operators.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents (the last one: the packed pieces), whatever
else docs holds.  `run` writes each stage's rows to the shared folder and reads them again for the next.

In all stages: a null text is the empty text; a null lang or source is a value of its own; rows with a null doc_id, or with
one of another row, are documents of their own, but where a stage says otherwise; texts of any length are read whole; an
empty table gives an empty result; extra columns, whatever their names, are left out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import line_dedup, mixing, near_copies, packing, quality
from foliospark.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; rows that are alike fare alike.  A null text has no words, so it goes."""
    return quality.quality_rules(docs).filter("kept").select(*COLUMNS)


def drop_seen_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; n_chars follows the text.

    No row goes; a text may end empty.  Rows of one doc_id count as one document, those without one as the first one."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share 0.8 of their five-word shingles: the smallest doc_id, nulls last.

    Of the empty texts, null or not, one row stays; ties of one doc_id go by the text."""
    docs = stash(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    gone = near_copies.near_copies(docs, width=5, threshold=0.8).filter("_row <> _keep").select("_row")
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mixture; one epoch, so none comes twice.

    Texts without words are never drawn.  Rows of one doc_id, or of none, in a leaf are drawn together."""
    own = ("doc_id", "lang", "source")
    drawn = mixing.draw(docs, epochs=1).select(*[F.col(c).alias(f"_{c}") for c in own]).distinct()
    same = [docs[c].eqNullSafe(drawn[f"_{c}"]) for c in own]
    return docs.join(drawn, same[0] & same[1] & same[2], "left_semi").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences; an empty text is one piece, its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_seen_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no tokenizer and no SimHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
