"""Operator 7 with verified similarity: one row of each group of texts that share 0.8 of their word shingles.

1. The set of a text's shingles of five words, each an XXH64; a text of fewer words is one shingle.  Equal sets meet once.
2. Candidates.  SimHash fingerprints of the sets, whose links come through operator 7's pivot tables; and `BANDS` keys a set,
   each of `ROWS` minimum hashes, as the fingerprints alone do not reach these copies: at 0.8 the cosine is 0.89, so 9.7
   of 64 bits differ on average, and no choice of pivot groups finds so many in files of bounded size.  A pair of similarity
   s shares a key with probability 1 - (1 - s^ROWS)^BANDS: 0.999997 at 0.8.
3. Sets that share a fingerprint, a link or a key form a bucket; of buckets with the same sets one is taken.  A bucket is
   dealt into blocks of about `BLOCK` sets, each with the bucket's first set.  In a block each pair that is not yet joined is
   verified by the exact Jaccard similarity; a spanning forest of its links leaves it.
4. Components of the links, as in operator 7.  In a bucket of several blocks, sets outside its largest component then meet
   all its blocks, and pairs that are not yet joined are verified: so no link of a bucket is lost, and a large group
   of near copies costs one pass over it.

The row kept of a component has the smallest doc_id, nulls last; among rows of one doc_id the order is by text.  Rows are
told apart by a written row number, so null and repeated ids are rows like others.  A null text is the empty text, and equals
only empty texts; extra columns stay; an empty table gives an empty result.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import stash, through_python
from foliospark.llm.simhash import _upper_to_lower, components, links, majority

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
BLOCK = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = _upper_to_lower()


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles; empty for a text without words."""
    from xxhash import xxh64_intdigest

    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    grams = {" ".join(words)} if len(words) < width else set(map(" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.unique(np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams)))


def band_keys(own: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The keys of a set, signed; none for the empty set, which only equals itself."""
    if not len(own):
        return np.zeros(0, np.int64)
    r = np.random.default_rng(5)
    a, b = r.integers(0, 2**64, (2, bands * rows), dtype=np.uint64)
    a |= np.uint64(1)
    low = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 512):
        x = own[i : i + 512, None] * a + b
        low = np.minimum(low, x.min(0))
    key = np.full(bands, 0x9E3779B97F4A7C15, np.uint64)
    for column in low.reshape(bands, rows).T:
        key = (key ^ (column >> np.uint64(7)) ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], threshold: float = THRESHOLD, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets that reach the threshold; roots: what is joined already."""
    first: dict[int, int] = {}
    root, edges = [first.setdefault(r, i) for i, r in enumerate(roots)] if roots else list(range(len(sets))), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = find(i), find(j)
            if a == b or min(len(sets[i]), len(sets[j])) < threshold * max(len(sets[i]), len(sets[j])) - 1e-9:
                continue
            if similarity(sets[i], sets[j]) >= threshold - 1e-12:
                root[max(a, b)] = min(a, b)
                edges.append((i, j))
    return edges


def buckets(sets: DataFrame) -> DataFrame:
    """(bucket, first, n, node): the members of the candidate buckets of sets (node, fp, keys), each kind of bucket once."""
    fps = stash(sets.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("node").alias("node")), "fps")
    pair = stash(links(fps), "links")
    ends = pair.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp")).join(fps, "fp").select(F.lit(-2).alias("band"), "key", "node")
    filed = sets.select(F.posexplode("keys").alias("band", "key"), "node").unionByName(sets.filter("fp IS NOT NULL").select(F.lit(-1).alias("band"), F.col("fp").alias("key"), "node")).unionByName(ends)
    filed = stash(filed, "filed")
    add = lambda seed: F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(38,0)"))
    met = filed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("first"), add(1).alias("s"), add(2).alias("t")).filter("n > 1")
    one = met.groupBy("n", "first", "s", "t").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*", "n", "first")
    return filed.join(one, ["band", "key"]).select(F.struct("band", "key").alias("bucket"), "first", "n", "node")


def verified(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links inside groups with columns nodes, owns, and roots if some are joined already."""
    known = "roots" in groups.columns

    def verify(batches):
        for b in batches:
            a, z = [], []
            for k, (nodes, owns) in enumerate(zip(b["nodes"], b["owns"], strict=True)):
                for i, j in forest([np.frombuffer(x, np.uint64) for x in owns], threshold, list(b["roots"][k]) if known else None):
                    a.append(nodes[i])
                    z.append(nodes[j])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(z, np.int64)})

    return groups.mapInPandas(verify, "a long, b long").distinct()


def _block(n: str, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "node"), F.ceil(F.col(n) / BLOCK)).cast("int")


def near_copies(df: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(_row, _keep) of a table with columns _row (a number of its own each), doc_id, text: the row kept for each row."""
    from hashlib import blake2b

    def keys(batches):
        for b in batches:
            own = [shingles(t if isinstance(t, str) else None, width) for t in b["text"]]
            text = [blake2b((t if isinstance(t, str) else "").encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() for t in b["text"]]
            fp = pd.Series([int(np.uint64(majority(x)).astype(np.int64)) if len(x) else None for x in own], dtype=object)
            yield b[["_row", "doc_id"]].assign(sha=text, whole=[blake2b(x.tobytes(), digest_size=16).hexdigest() for x in own], fp=fp, keys=[band_keys(x) for x in own])

    def hashes(batches):
        for b in batches:
            yield b[["_row"]].rename(columns={"_row": "node"}).assign(own=[shingles(t if isinstance(t, str) else None, width).tobytes() for t in b["text"]])

    rows = stash(through_python(df.select("_row", "doc_id", "text"), ("doc_id",), keys, "_row long, sha string, whole string, fp long, keys array<long>"), "shingles")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "_row"))
    sets = stash(rows.groupBy("whole").agg(order.alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).select("first", F.col("first._row").alias("node"), "whole", "fp", "keys"), "sets")
    members = stash(buckets(sets).withColumn("block", _block("n", 3)), "members")
    own = stash(df.select("_row", "text").join(members.select(F.col("node").alias("_row")).distinct(), "_row", "left_semi").mapInPandas(hashes, "node long, own binary"), "own")

    # each block with the bucket's first set
    with_first = members.unionByName(members.filter("n > %d" % BLOCK).select("bucket", "first", "n", "block").distinct().withColumn("node", F.col("first"))).select("bucket", "block", "node").distinct()
    full = with_first.join(own, "node").groupBy("bucket", "block").agg(F.collect_list(F.struct("node", "own")).alias("m")).filter(F.size("m") > 1)
    found = stash(verified(full.select(F.col("m.node").alias("nodes"), F.col("m.own").alias("owns")), threshold), "found")
    roots = stash(components(found), "roots")
    large = members.filter("n > %d" % BLOCK)
    if not large.isEmpty():
        large = stash(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "large")
        size = large.groupBy("bucket", "root").agg(F.count("*").alias("c"))
        main = size.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("rest"))
        large = large.join(main.filter("rest > 0"), "bucket")
        blocks = large.select("bucket", "block").distinct()
        outside = large.filter("root <> main").withColumn("other", _block("rest", 4)).drop("block").join(blocks, "bucket")
        against = large.join(outside.select("bucket", "other").distinct(), "bucket")
        cells = outside.select("bucket", "block", "other", "node", "root").unionByName(against.select("bucket", "block", "other", "node", "root")).distinct()
        full = cells.join(own, "node").groupBy("bucket", "block", "other").agg(F.collect_list(F.struct("node", "own", "root")).alias("m"))
        more = verified(full.select(F.col("m.node").alias("nodes"), F.col("m.own").alias("owns"), F.col("m.root").alias("roots")), threshold)
        roots = stash(components(found.union(more)), "roots")
    named = sets.select("whole", "first", "node").join(roots, "node", "left").select("whole", "first", F.coalesce("root", F.col("first._row")).alias("root"))
    least = named.groupBy("root").agg(F.min("first").getField("_row").alias("_keep"))
    named = stash(named.join(least, "root").select("whole", "_keep"), "kept")
    return rows.select("_row", "whole").join(named, "whole").select("_row", "_keep")
