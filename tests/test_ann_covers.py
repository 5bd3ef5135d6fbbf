"""The vector index against exact search, and cover density against brute force."""
import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import ann, search


def test_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.35 * rng.normal(size=(3000, 16))
    rows = [(k, 0, [float(v) for v in r]) for k, r in enumerate(x)] + [(9000 + k, 0, [1.0] * 16) for k in range(800)] + [(5000, 0, [0.0] * 16), (5001, 0, None)]
    df = spark.createDataFrame(rows, "id long, chunk int, embedding array<double>")
    path = str(tmp_path / "ann")
    ann.write_index(df, path, lists=40)
    index = ann.open_index(spark, path)
    assert 0 < index.probes < 20 and index.units.count() == 3800
    query = rows[17][2]
    plan = ann.nearest(index, query, 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "IN (" in plan.replace(" in (", " IN (").upper()
    exact = [(r.id, r.score) for r in search.semantic(search.unit_vectors(df.filter("embedding IS NOT NULL")), query, 10).collect()]
    assert [(r.id, r.score) for r in ann.nearest(index, query, 10, probes=0).collect()] == exact
    asked = index.units.filter("id < 3000 AND id % 60 = 0").select(F.col("id").alias("query"), "unit")
    got = ann.recall(index, asked).collect()
    assert len(got) == 50 and sum(r.recall for r in got) / 50 >= 0.9
    readable = df.filter("id % 2 = 0").select("id")
    assert all(r.id % 2 == 0 for r in ann.nearest(index, query, 10, allowed=readable).collect())


def test_small_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0])], "id long, chunk int, embedding array<double>")
    ann.write_index(df, str(tmp_path / "one"))
    assert [r.id for r in ann.nearest(ann.open_index(spark, str(tmp_path / "one")), [1.0, 0.0], 5).collect()] == [1]


def minimal_covers(places):
    """All minimal intervals that hold each term, and the positions in them that hold none."""
    spans = {(min(p), max(p)) for p in product(*places)}
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    flat = sorted(x for p in places for x in p)
    return sum(0.1 / (1 + (b - a) - (sum(a <= x <= b for x in flat) - 1)) for a, b in least)


def test_cover_density(spark):
    r = random.Random(3)
    rows = []
    for k in range(200):
        n = r.randrange(1, 4)
        spots = r.sample(range(25), r.randrange(n, 14))
        places = [[] for _ in range(n)]
        for i, s in enumerate(spots):
            places[i if i < n else r.randrange(n)].append(s)
        rows.append((k, n, sorted((s, t) for t, p in enumerate(places) for s in p), minimal_covers(places)))
    df = spark.createDataFrame(rows, "k int, n int, o array<struct<at: int, term: int>>, want double")
    for n in (1, 2, 3):
        for x in df.filter(F.col("n") == n).withColumn("got", search.cover_density(F.col("o"), n)).collect():
            assert abs(x.got - x.want) < 1e-12


def test_fallback(spark, tmp_path):
    texts = ["red fox and red hen", "hen x x fox red", "fox only", "RED%FOX odd", "none", "red fox hen red fox hen"]
    chunks = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id long, chunk int, text string")
    search.build_index(chunks, str(tmp_path / "ix"), 4)
    index = search.open_index(spark, str(tmp_path / "ix"))
    index = search.LexicalIndex(index.postings, index.chunks, index.average)
    hits = search.covers(index, ["fox", "hen", "red"], buckets=4).collect()
    by = {r.id: r.score for r in hits}
    assert set(by) == {0, 1, 5} and by[5] > by[0] > by[1]
    assert abs(by[5] - 0.4) < 1e-9  # four covers of three words in a row
