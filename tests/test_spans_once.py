"""Span candidates deal their elements out once, and read them once."""
import os

import pytest

from foliospark.operators import spans
from foliospark.plans import span_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_one_exchange(spark):
    plan = span_queries.span_candidates(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("FileScan ") == 1 and "Join" not in plan


def test_matches(spark):
    """Plain classes of ASCII texts find what the classes of all scripts do, and a colon is seen at its full distance."""
    texts = ["a" * 59 + ": x", "a" * 60 + ": x", "a" + "b" * 57 + " \t : y", "Größe: 5", "no colon here", "k:\u00a0v", "x1:y:z", "A:\n b", "end:", "a: b\x01c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: [(m.start, m.value) for m in r.m] for r in df.select("t", spans.matches(df.t, spans.COLON, ":：").alias("m")).collect()}
    want = [[(0, "a" * 59 + ": x")], [(1, "a" * 59 + ": x")], [(0, "a" + "b" * 57 + " \t : y")], [(0, "Größe: 5")], [], [(0, "k:\u00a0v")], [(0, "x1:y:z")], [], [], [(0, "a: b\x02c")]]
    assert got == dict(zip(texts, want, strict=True))
