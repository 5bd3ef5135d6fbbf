"""SimHash near-dedup with pivot distance tables.

1. A fingerprint per text (mapInPandas): XXH64 of each 3-word shingle, majority of each bit.
2. Distinct fingerprints with their smallest document, so copies never meet again as rows.
3. The pivot table holds each fingerprint's Hamming distances to 65 reference fingerprints: an origin, and for each of the
   8 groups of 8 bits eight references that differ from it in Walsh patterns of the group.  A bit that differs between two
   fingerprints changes their relative coordinates (distance to a reference less that to the origin) in its own group alone.
   So two fingerprints with at most `radius` differing bits have equal relative coordinates in all groups but `radius`:
   each row is filed under its relative coordinates outside every choice of `radius` groups, and rows meet by these keys.
   A group's eight coordinates determine its bits, so a file has at most 65,536 fingerprints for a radius of 2: no file is
   unbounded.
4. In a file, by the triangle inequality, every pair whose largest coordinate difference exceeds `radius` is discarded; rows
   are sorted by the origin's coordinate, so a row meets only its window.  The pairs that survive are verified bit by bit.
   Of the links of a file only a spanning forest leaves it, at most one edge a fingerprint.
5. Components by alternating large-star and small-star rounds over the edge table, written to the shared folder each
   round.  A node with very many edges, and a fingerprint of very many documents (empty texts have fingerprint zero), are
   split by the adaptive skew join (spark.sql.adaptive.skewJoin.enabled, on by default): both sides of these joins
   are plain shuffles.

Nulls: a null text has no words: fingerprint zero.  A null doc_id never names a component unless all in it are null.
Rows of one doc_id keep their own fingerprints.  A text of any length is read whole.  Extra columns are ignored.  An empty
table gives an empty result.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import drop, stash, table, through_python

GROUPS, BITS = 8, 8
RADIUS = 2


def _upper_to_lower() -> dict[int, int]:
    return {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one text, the unsigned 64-bit number."""
    from re import findall

    from xxhash import xxh64_intdigest

    words = findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_upper_to_lower()))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < width else list(map(" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return majority(np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams)))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t if isinstance(t, str) else None, width) for t in b["text"]), np.uint64, len(b))
            yield b[["doc_id"]].assign(fp=fp.astype(np.int64))

    return through_python(df.select("doc_id", "text"), ("doc_id",), run, "fp long")


def references() -> np.ndarray:
    """The origin, then each group's eight references; the same on every machine."""
    origin = np.random.default_rng(64).integers(0, 2**64, dtype=np.uint64)
    walsh = [sum(1 << b for b in range(BITS) if (k & b).bit_count() % 2 or not k) for k in range(BITS)]
    return np.array([origin, *(origin ^ np.uint64(w << BITS * g) for g in range(GROUPS) for w in walsh)], np.uint64)


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances (fingerprints, references)."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def file_keys(dist: np.ndarray, radius: int) -> np.ndarray:
    """(fingerprints, choices): for each choice of `radius` groups a key of the relative coordinates in all others."""
    relative = (dist[:, 1:].astype(np.int64) - dist[:, :1] + BITS).reshape(-1, GROUPS, BITS)
    own = (relative * (2 * BITS + 1) ** np.arange(BITS)).sum(2).astype(np.uint64)  # one number a group, no two alike
    keys = []
    for n, out in enumerate(combinations(range(GROUPS), radius)):
        key = np.full(len(dist), n + 1, np.uint64)
        for g in sorted(set(range(GROUPS)) - set(out)):
            key = (key ^ own[:, g]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def _pairs(fp: np.ndarray, refs: np.ndarray, radius: int):
    """Verified pairs of positions within the radius, by the pivot table, in batches."""
    dist = pivot_table(fp, refs)
    order = np.argsort(dist[:, 0], kind="stable")
    fp, dist = fp[order], dist[order]
    upto = np.searchsorted(dist[:, 0], dist[:, 0] + radius, side="right")
    for i in range(len(fp) - 1):
        j = np.arange(i + 1, upto[i])
        j = j[np.abs(dist[j] - dist[i]).max(1, initial=0) <= radius]
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= radius]
        if len(j):
            yield order[i], order[j]


def forest(fp: np.ndarray, refs: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    edges = []
    for i, js in _pairs(fp, refs, radius):
        for j in js:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(i), int(j)))
    return edges


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges of spanning forests that join all distinct fingerprints (column fp) within the radius."""

    def keys(batches):
        refs = references()
        for b in batches:
            yield b.assign(keys=list(file_keys(pivot_table(b["fp"].to_numpy(np.int64).view(np.uint64), refs), radius)))

    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # few bytes, many keys
    filed = spread.mapInPandas(keys, "fp long, keys array<long>").select("fp", F.posexplode("keys").alias("choice", "key"))
    groups = filed.groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches):
        refs = references()
        for b in batches:
            a, z = [], []
            for members in b["fps"]:
                fp = np.sort(np.asarray(members, np.int64)).view(np.uint64)
                for i, j in forest(fp, refs, radius):
                    a.append(fp[i])
                    z.append(fp[j])
            yield pd.DataFrame({"a": np.array(a, np.uint64).view(np.int64), "b": np.array(z, np.uint64).view(np.int64)})

    return groups.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges the smallest node of its component, by large-star and small-star."""
    edges = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stash(both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2.select("u", F.col("m").alias("v")))
        now_edges = stash(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        for done in (edges, least, large, least2):
            drop(done)
        edges = now_edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = now


def near_dedup(df: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable over links."""
    docs = stash(fingerprints(df, width), "fingerprints")
    fps = stash(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = stash(components(links(fps, radius)), "roots")
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stash(named.join(least, "root").select("fp", "component_id"), "named")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def op7(spark, sf_dir):
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
