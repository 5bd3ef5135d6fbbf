"""Folder trees: paths at any depth, and what a folder stands for when a list is opened at it.

Paths come from pointer doubling: every round a folder's pointer jumps to where its target points, so a tree of depth d takes log2(d)
rounds of one equi-join, whatever its shape.  What still points somewhere after log2(n) + 1 rounds is on a cycle or hangs below one.
Each round is written to the state folder, so lineage stays short.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.filters import Filters
from foliospark.operators.saved_queries import parse, to_filters
from foliospark.sources.state import new_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path, schema = new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _doubled(state: DataFrame, carried: str, merged, most: int) -> DataFrame:
    """Rounds over (id, up, carried) until no pointer is left, `most` at most.  merged: of the target's and the own value."""
    for _ in range(most):
        if state.filter("up IS NOT NULL").isEmpty():
            break
        target = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col(carried).alias("_value"))
        both = state.join(target, F.col("up") == F.col("_id"), "left")
        value = F.when(F.col("_id").isNull(), F.col(carried)).otherwise(merged(F.col("_value"), F.col(carried)))
        state = _written(both.select("id", F.col("_up").alias("up"), value.alias(carried)), "folders")
    return state


def paths(folders: DataFrame) -> DataFrame:
    """folders: id (unique), parent, name.  (id, path, depth, cyclic): path of names from the root, which has depth 0.

    A parent that is no folder counts as none.  On a cycle, and below one, path and depth are null."""
    known = folders.select(F.col("id").alias("_id"))
    own = folders.select("id", "parent", "name").join(known, F.col("parent") == F.col("_id"), "left").select("id", F.col("_id").alias("up"), "name")
    own = _written(own, "folders")
    rounds = max(1, own.count().bit_length() + 1)
    hops = _doubled(own.select("id", "up", F.col("up").isNotNull().cast("int").alias("hops")), "hops", lambda theirs, mine: F.when(theirs < 1 << 29, theirs + mine).otherwise(theirs), rounds)
    looped = hops.filter("up IS NOT NULL").select("id")
    good = own.join(looped, "id", "left_anti")
    named = _doubled(good.select("id", "up", F.coalesce("name", F.lit("")).alias("path")), "path", lambda theirs, mine: F.concat(theirs, F.lit("/"), mine), rounds)
    found = named.select("id", "path").join(hops.select("id", F.col("hops").alias("depth")), "id").withColumn("cyclic", F.lit(False))
    return found.unionByName(looped.select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("depth"), F.lit(True).alias("cyclic")))


def below(paths_: DataFrame, path: str) -> DataFrame:
    """Ids of a folder and all under it, by its path."""
    return paths_.filter((F.col("path") == path) | F.startswith(F.col("path"), F.lit(path + "/"))).select("id")


def resolved(folders: DataFrame, folder: object, user: int) -> Filters | None:
    """The filter that a folder stands for: a manual one its own id, a smart one its saved query; None if the user may not read it or there is none.

    folders: id, kind, shared, folder_owner, grants, query (JSON)."""
    open_ = F.col("shared") | (F.col("folder_owner") == user) | F.array_contains("grants", F.lit(user).cast("long"))
    row = folders.filter((F.col("id") == F.lit(folder)) & open_).select("kind", "query").first()  # one folder
    if row is None:
        return None
    return to_filters(parse(row["query"])) if row["kind"] == "smart" else Filters(folders=(str(folder),))


def listed(folders: DataFrame, folder: object | None, user: int, base: Filters) -> Filters | None:
    """A list's own filter within a folder; None if nothing can pass."""
    if folder is None:
        return base
    own = resolved(folders, folder, user)
    return None if own is None else base.intersect(own)
