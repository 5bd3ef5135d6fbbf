"""Approximate nearest neighbours by cosine: a partitioned vector index with trained centroids.

`write_index` trains centroids on a bounded sample, gives every vector to its nearest one and writes a folder a centroid.  A
search compares the query with the centroids while the plan is made, so only the folders of the nearest ones are in the
scan; `probes=None` takes the number that the build has measured, and `probes=0` all folders, which is exact.

The measure: for sampled queries, the exact nearest vectors of the whole table are found, and the place of each one's folder in
the query's order of folders; `probes` is the least number of folders that hold `target` of them.

Vectors of length zero have no direction and are left out, as are nulls.  All vectors must have one length.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.operators.search import semantic, unit_vectors

#: Bounds: vectors that train, folders, sampled queries and their neighbours, vectors a file.
SAMPLE, MOST_LISTS, QUERIES, NEIGHBOURS, FILE_ROWS = 20_000, 4096, 100, 10, 500_000


@dataclass(frozen=True)
class VectorIndex:
    """units: (list, id, chunk, unit), a folder a list; centroids by list; the measured number of probes."""

    units: DataFrame
    centroids: np.ndarray
    lists: np.ndarray
    probes: int

    def nearest_lists(self, query: list[float], probes: int) -> list[int]:
        q = np.asarray(query, float)
        near = np.argsort(-(self.centroids @ (q / np.linalg.norm(q))), kind="stable")
        return [int(x) for x in self.lists[near[:probes]]]


def _top(units: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """(query, id, chunk, list, score): the exact k nearest of each of a few queries; each batch gives its best, k a query."""
    kinds = {f.name: f.dataType for f in units.schema}
    out = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("score", T.DoubleType()), *[T.StructField(c, kinds[c]) for c in ("id", "chunk", "list")]])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(b.schema.get_field_index("unit")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            score = queries @ x.T
            take = np.argpartition(-score, min(k, b.num_rows) - 1, axis=1)[:, :k]
            rows = pa.array(take.ravel())
            keys = pa.array(np.repeat(np.arange(len(queries), dtype=np.int32), take.shape[1]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.take_along_axis(score, take, axis=1).ravel()), *[b.column(b.schema.get_field_index(c)).take(rows) for c in ("id", "chunk", "list")]], out.names)

    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "chunk")
    return units.select("id", "chunk", "list", "unit").mapInArrow(best, out).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def write_index(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, target: float = 0.95, seed: int = 7) -> None:
    """vectors: (id, chunk, embedding).  Written once; a folder holds the vectors of one list, large ones in several files."""
    units = unit_vectors(vectors.filter(F.col("embedding").isNotNull()))
    n = units.count()
    chosen = units.sample(fraction=min(1.0, sample / max(n, 1)), seed=seed) if n > sample else units
    vectorized = units.withColumn("features", array_to_vector("unit"))
    centroids = np.zeros((0, 0))
    given = units.limit(0).withColumn("list", F.lit(0))
    if n:
        k = min(lists or int(np.ceil(n**0.5)), MOST_LISTS, n)
        model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine", predictionCol="list").fit(chosen.withColumn("features", array_to_vector("unit"))) if n > 1 else None
        centroids = np.array(model.clusterCenters()) if model else np.array(units.first()["unit"])[None, :]
        given = model.transform(vectorized).drop("features") if model else units.withColumn("list", F.lit(0))
    sizes = given.groupBy("list").agg(F.ceil(F.count("*") / F.lit(FILE_ROWS)).alias("files"))  # at most MOST_LISTS rows
    dealt = given.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id", "chunk"), F.col("files")))
    dealt.repartition("list", "part").select("list", "id", "chunk", "unit").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark = vectors.sparkSession
    length = np.linalg.norm(centroids, axis=1, keepdims=True)
    centroids = centroids / np.where(length > 0, length, 1)
    probes = _probes(spark.read.schema("id " + units.schema["id"].dataType.simpleString() + ", chunk " + units.schema["chunk"].dataType.simpleString() + ", unit array<double>, list int").parquet(f"{path}/lists"), centroids, target, seed) if n else 0
    rows = [(k, [float(v) for v in c], probes) for k, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def _probes(units: DataFrame, centroids: np.ndarray, target: float, seed: int) -> int:
    """The least number of nearest lists that hold `target` of the true neighbours of sampled queries."""
    asked = units.orderBy(F.xxhash64(F.lit(seed), "id", "chunk"), "id").limit(QUERIES).select("unit").collect()  # at most QUERIES rows
    queries = np.array([r["unit"] for r in asked])
    place = np.argsort(np.argsort(-(queries @ centroids.T), axis=1, kind="stable"), axis=1)
    found = _top(units, queries, NEIGHBOURS).select("query", "list").collect()  # at most QUERIES x NEIGHBOURS rows
    needed = np.sort([place[r["query"], r["list"]] + 1 for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS rows
    units = spark.read.parquet(f"{path}/lists")
    return VectorIndex(units, np.array([r["centroid"] for r in rows]), np.array([r["list"] for r in rows]), rows[0]["probes"] if rows else 0)


def nearest(index: VectorIndex, query: list[float], limit: int, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, chunk, score, rank) of the nearest vectors in the probed lists; allowed: (id), what the user may read."""
    probes = index.probes if probes is None else probes
    units = index.units
    if probes:
        units = units.filter(F.col("list").isin(index.nearest_lists(query, probes)))  # a partition filter: constants of the plan
    return semantic(units, query, limit, allowed)


def recall(index: VectorIndex, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
    """(query, found, recall) for a few query vectors (query, unit): how many of the exact k nearest lie in the probed lists."""
    probes = index.probes if probes is None else probes
    asked = queries.orderBy("query").limit(QUERIES).collect()
    spark = index.units.sparkSession
    reached = [(i, x) for i, r in enumerate(asked) for x in index.nearest_lists(r["unit"], probes or len(index.lists))]
    exact = _top(index.units, np.array([r["unit"] for r in asked]), k)
    hit = exact.join(spark.createDataFrame(reached, "query int, list int").withColumn("hit", F.lit(1)), ["query", "list"], "left")
    names = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(asked)], "at int, name long")
    got = hit.groupBy("query").agg(F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
    return got.join(names, F.col("query") == F.col("at")).select(F.col("name").alias("query"), "found", "recall")
