"""The stages of the pipeline and the whole of it."""
import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["'a' AS keep", "'b' AS kept", "'c' AS row", "'d' AS _row", "'e' AS h", "'f' AS copies", "'g' AS kept_text", "'h' AS n_tokens", "'i' AS _text", "'j' AS piece", "'k' AS domain", "'l' AS length"]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ren", "o", "mi", "lus"]) for _ in range(3)) for _ in range(n))


ROWS = [
    (1, prose(1), "en", "src0", 1),
    (None, prose(2), "en", "src0", 1),
    (None, prose(3), None, None, None),
    (4, prose(4), "en", "src1", 1),
    (4, prose(5), "en", "src1", 1),
    (6, prose(6, 40_000), "de", "src2", 1),
    (7, prose(7), "en", "src0", 1),
    (7, prose(7), "en", "src0", 1),
    (8, "", "en", "src0", 0),
    (9, None, None, "src0", None),
]


def run(spark, name, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *CLASHES)
    out = dict(corpus_pipeline.STAGES)[name](spark, df, "")
    if name != "best_fit_packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    return [tuple(r) for r in out.collect()]


def same(got, want):
    return sorted(got, key=str) == sorted(want, key=str)


def test_quality_rules(spark):
    assert same(run(spark, "quality_rules", ROWS), [r for r in ROWS if r[1] and r[0] != 6] + [r for r in ROWS if r[0] == 6])


def test_line_dedup(spark):
    line = "this one line is in several"
    rows = [(1, f"{line}\na", "en", "s", 0), (None, f"b\n{line}", "en", "s", 0), (3, line, None, None, None), (3, line, "en", "s", 0), (4, None, "en", "s", 0)]
    want = [(1, "a", "en", "s", 1), (None, f"b\n{line}", "en", "s", len(line) + 2), (3, "", None, None, 0), (3, "", "en", "s", 0), (4, "", "en", "s", 0)]
    assert same(run(spark, "line_dedup", rows), want)
    assert same([r[:2] for r in run(spark, "line_dedup", ROWS)], [(r[0], r[1] or "") if r[:1] != (7,) else r[:2] for r in ROWS])


def test_near_dedup(spark):
    got = run(spark, "simhash_near_dedup", ROWS)
    assert same(got, [r for i, r in enumerate(ROWS) if i not in (7, 9)])


def test_mixing(spark):
    got = run(spark, "source_mixing", ROWS)
    assert all(r in ROWS for r in got) and 0 < len(got) <= 8
    assert {r[0] for r in got}.isdisjoint({8, 9}) and got.count(ROWS[6]) in (0, 2)


def test_packing(spark):
    got = run(spark, "best_fit_packing", ROWS)
    assert sum(r[1] == 0 for r in got) == len(ROWS)
    assert sum(r[0] == 6 for r in got) > 5  # a long text is cut, not dropped


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    assert run(spark, name, []) == []


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    text = lambda: "\n".join(" ".join("".join(r.choice(["ta", "ren", "o", "mi"]) for _ in range(3)) for _ in range(12)) for _ in range(4))
    clean = [(i, text(), "en", f"src{i % 3}", 1) for i in range(60)]
    rows = clean + [(100 + i, clean[i][1], "en", "src0", 1) for i in range(10)] + [(200, "too short", "en", "src0", 1), (201, None, None, None, None), (202, "*** " * 60, "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        sizes.append({x["doc_id"] for x in docs.collect()})
    assert sizes[0] == set(range(60)) | set(range(100, 110)) and sizes[1] == sizes[0]
    assert sizes[2] >= set(range(60)) and len(sizes[2] - set(range(60))) <= 1  # what was copied is empty now, one of these stays
    assert sizes[3] < sizes[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == sizes[3]


