"""Ids of any size and type come back as they went in, beside nulls; a repeated query is one query."""
import random

import pytest

from foliospark.llm import hamming, html, licenses, near_copies, packing, simhash, token_counts, toxicity

BIG = (1 << 60) + 1
TEXT = "a plain line of words that says nothing much about anything at all, number "


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("ids,kind", [([BIG, None, BIG + 2, 5], "long"), (["a-1", None, "", "7"], "string")])
def test_ids(spark, ids, kind):
    docs = spark.createDataFrame([(i, TEXT + str(k)) for k, i in enumerate(ids)], f"doc_id {kind}, text string").coalesce(1)
    for df in (token_counts.token_counts(docs), simhash.near_dedup(docs), licenses.scan(docs), packing.pack(docs), simhash.fingerprints(docs)):
        assert df.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        same([r.doc_id for r in df.collect()], ids)
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "concat('<p>', text, '</p>') AS html")
    same([r.page_id for r in html.extract(pages, pages=40, epochs=2).collect()], ids)
    rows = near_copies.near_copies(docs.selectExpr("monotonically_increasing_id() AS _row", "*"))
    assert rows.count() == 4


def test_toxicity_ids(spark):
    ids = [BIG, None, BIG + 2]
    docs = spark.createDataFrame([(i, TEXT) for i in ids], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    same([r.doc_id for r in toxicity.toxicity(docs, labels).collect()], ids)


def test_component_of_large_ids(spark):
    docs = spark.createDataFrame([(BIG, TEXT), (None, TEXT), (BIG - 1, TEXT)], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in simhash.near_dedup(docs).collect()} == {BIG - 1}


def test_repeated_queries(spark):
    r = random.Random(2)
    vectors = [(k, [r.choice([-1.0, 1.0]) for _ in range(64)]) for k in range(1, 40)]
    first, other = [1.0] * 64, [-1.0] * 64
    df = spark.createDataFrame([*vectors, (0, first), (0, first), (0, other)], "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.distance) for x in hamming.top_k(df, k=6).filter("query_id = 0").collect())
    sign = {k: v for k, v in vectors}
    want = []
    for q in (first, other):
        near = sorted([(sum((a > 0) != (b > 0) for a, b in zip(q, v)), i) for i, v in [*sign.items(), (0, first), (0, first), (0, other)]])[:6]
        want += [(0, n, i, d) for n, (d, i) in enumerate(near, 1)]
    assert got == sorted(want)
