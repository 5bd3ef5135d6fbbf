"""Folders for tables that the library keeps: indexes and state."""
from __future__ import annotations

import tempfile
import uuid
from hashlib import sha256

from pyspark.sql import SparkSession


def state_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; where none is set, a local session gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{state_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stamp(spark: SparkSession, path: str) -> str:
    """A hash of a table's files, their sizes and times of change: what is built from the table is stale once this differs."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files, found = root.getFileSystem(conf).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return sha256("\n".join(sorted(found)).encode()).hexdigest()
