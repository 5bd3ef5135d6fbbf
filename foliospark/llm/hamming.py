"""Exact top-k search over binary codes by multi-index hashing.

Codes are the signs of a vector's entries, 64 bits.  All rows are dealt by a hash of the row number into blocks of about
`block` codes, so repeated ids spread too.
A block is one key: its codes come first in its sorted partition and are indexed once, by each of `SEGMENTS` 16-bit
segments; then the stated queries stream past the index.  A query probes, radius after radius, all values of
each segment within that radius of its own and verifies what it finds by whole Hamming distance.  After radius r every
code at a distance of at most SEGMENTS * (r + 1) - 1 has been found (one segment must differ in r bits at most), so the
search ends as soon as the kth distance is at most that; ties at it are then complete.  The blocks' top k meet in one
sort per query by distance and id.  There are as many tasks as blocks; a task holds one block, and the queries, 16 bytes
each, are sent to each block once, but never held there.

Nulls: rows without an id or an embedding, or with one of another length, have no code: they are neither queries nor
answers.  Null entries count as not positive.  Repeated rows are answers of their own; equal (distance, id) share any
ranks.  Rows of one id and code are one query; rows of one id with other codes are queries of their own, each with its k answers.  Extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import stash, table

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
K = 10
EVERY = 50


def codes(df: DataFrame) -> DataFrame:
    """(vec_id, code): bit i is set if entry i is positive."""
    bits = F.expr(f"aggregate(transform(embedding, (x, i) -> CASE WHEN x > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, b) -> a | b)")
    return df.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == BITS)).select(F.col("vec_id").cast("long"), bits.alias("code"))


_FLIPS: dict[int, np.ndarray] = {}


def flips(r: int) -> np.ndarray:
    """All segment values with r bits set."""
    if r not in _FLIPS:
        _FLIPS[r] = np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), r)], np.int64)
    return _FLIPS[r]


class MultiIndex:
    def __init__(self, ids: np.ndarray, code: np.ndarray):
        self.ids, self.code, self.tables = ids, code.view(np.uint64), []
        for s in range(SEGMENTS):
            own = self._segment(self.code, s)
            order = np.argsort(own, kind="stable")
            self.tables.append((order, np.searchsorted(own[order], np.arange((1 << WIDTH) + 1))))

    @staticmethod
    def _segment(code, s):
        return ((code >> np.uint64(WIDTH * s)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def search(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest by distance and id."""
        q = np.array([query], np.int64).view(np.uint64)
        own = [int(self._segment(q, s)[0]) for s in range(SEGMENTS)]
        found = np.zeros(0, np.int64)
        dist = np.zeros(0, np.int64)
        for r in range(WIDTH + 1):
            new = []
            for s, (order, start) in enumerate(self.tables):
                probe = own[s] ^ flips(r)
                a, n = start[probe], start[probe + 1] - start[probe]
                hit = n > 0
                a, n = a[hit], n[hit]
                ends = np.cumsum(n)
                if len(ends):
                    new.append(order[np.arange(ends[-1]) + np.repeat(a - ends + n, n)])
            if new:
                found = np.union1d(found, np.concatenate(new))
                dist = np.bitwise_count(self.code[found] ^ q).astype(np.int64)
            if len(found) == len(self.code) or len(found) >= k and np.partition(dist, k - 1)[k - 1] <= SEGMENTS * (r + 1) - 1:
                break
        best = np.lexsort((self.ids[found], dist))[:k]
        return self.ids[found[best]], dist[best]


def top_k(df: DataFrame, k: int = K, every: int = EVERY, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance) for the queries, the rows whose id is divisible by `every`, over all rows.

    block: codes in a block; by default all rows over the session's parallelism, 2**14 at least and 2**21 at most."""
    rows = stash(codes(df).withColumn("row", F.monotonically_increasing_id()), "codes")
    total = rows.count()
    blocks = max(1, -(-total // (block or min(1 << 21, max(1 << 14, total // df.sparkSession.sparkContext.defaultParallelism)))))
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("g"), F.lit(0).alias("kind"), "vec_id", "code")
    queries = stash(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "code").distinct(), "queries")
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("g"), F.lit(1).alias("kind"), "vec_id", "code")
    parted = dealt.unionByName(sent).repartitionById(blocks, "g").sortWithinPartitions("g", "kind")

    def search(batches):
        index, at, ids, code = None, -1, [], []
        for b in batches:
            g, kind, i, c = (b[x].to_numpy(np.int64) for x in ("g", "kind", "vec_id", "code"))
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1), len(g)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if g[lo] != at:
                    index, at, ids, code = None, g[lo], [], []
                if kind[lo] == 0:
                    ids.append(i[lo:hi])
                    code.append(c[lo:hi])
                    continue
                if index is None and ids:
                    index, ids, code = MultiIndex(np.concatenate(ids), np.concatenate(code)), [], []
                if index is not None:
                    got = [(q, *index.search(int(x), k)) for q, x in zip(i[lo:hi], c[lo:hi], strict=True)]
                    yield pd.DataFrame({"query_id": np.repeat([q for q, _, _ in got], [len(x) for _, x, _ in got]), "vec_id": np.concatenate([x for _, x, _ in got]), "distance": np.concatenate([d for _, _, d in got]), "code": np.repeat(c[lo:hi], [len(x) for _, x, _ in got])})

    near = parted.mapInPandas(search, "query_id long, vec_id long, distance long, code long")
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op5(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, q.b AS qb, e.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q.b[i] <> e.b[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
      FROM (SELECT DISTINCT vec_id, b FROM e WHERE vec_id % 50 = 0) q JOIN e ON true)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qb ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance
FROM d QUALIFY row_number() OVER (PARTITION BY query_id, qb ORDER BY distance, vec_id) <= 10
"""
