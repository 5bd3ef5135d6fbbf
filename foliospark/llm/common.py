"""What several operators share: tables, shared scratch tables, word splitting constants."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  Where none is set, a local session (tests) gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(shared_dir(spark)) or f"/{shared_dir(spark).strip('/')}/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def through_python(df: DataFrame, ids: tuple[str, ...], run: Callable, rest: str) -> DataFrame:
    """df.mapInPandas(run, ids and rest), with the id columns as text on the way and as they were behind it.

    pandas turns the longs of a batch that holds a null into doubles, which changes ids above 2 ** 53."""
    kinds = {c: df.schema[c].dataType for c in ids}
    binary = {c for c, k in kinds.items() if k.typeName() == "binary"}
    sent = df.withColumns({c: F.base64(c) if c in binary else F.col(c).cast("string") for c in ids})
    out = sent.mapInPandas(run, ", ".join([*(f"{c} string" for c in ids), rest]))
    return out.withColumns({c: F.unbase64(c) if c in binary else F.col(c).cast(k) for c, k in kinds.items()})


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS_CLASS + "+"))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
