"""The audit against a loop over documents, orders and steps, and against its SQL."""
import os
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from foliospark.llm import filter_audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, part string, mask int, n long, key string"
PLAIN = " ".join(f"word{i}" for i in range(200))


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(a, b, c, "x", 1, 1, "k") for a, b, c in docs], DOCS).repartition(3),
        spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, lang string"),
    )


def loop(docs, labels):
    out, parts = [], {}
    for i, t, lang in docs:
        text = t or ""
        words = re.findall("[^\\x20\\x09-\\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs),
        }
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels if i is not None) for k in (1, 2))
        parts.setdefault(lang or "", []).append((fails, good, toxic))
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                c = Counter()
                for fails, good, toxic in rows:
                    bad, gone = fails[own], any(fails[x] for x in order[: step - 1])
                    now = bad and not gone
                    c.update({"kept": not bad and not gone, "removed": now, "redundant": bad and gone, "unique": sum(fails.values()) == 1 and bad, "good": now and good, "toxic": now and toxic})
                shapley[own] += c["removed"]
                out.append((part, "".join(order), step, *(c[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic"))))
        out = [r + (shapley[r[1][r[2] - 1]],) if r[0] == part and len(r) == 9 else r for r in out]
    return sorted(out)


def rows(df):
    return sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect())


def test_brute_force(spark):
    texts = [PLAIN, PLAIN.upper(), PLAIN + " #", "a b c", "a " * 300, "A " * 300, "", None, "  \n\t", PLAIN + " é", "x" * 50_000, "|"]
    docs = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts * 2)]
    docs += [(None, PLAIN, "en"), (None, PLAIN, "de"), (0, PLAIN, "en"), (0, PLAIN, "fr"), ((1 << 60) + 1, PLAIN, "en"), (-5, "a b c", "xx")]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(12)] + [(1, 1, 1), (1, 0, 0), (None, 1, 1), (77, 1, 1), (4, None, None)]
    assert rows(filter_audit.audit(*frames(spark, docs, labels))) == loop(docs, labels)


def test_empty(spark):
    docs, labels = frames(spark, [], [])
    assert filter_audit.audit(docs, labels).count() == 0
    docs, _ = frames(spark, [(1, PLAIN, "en"), (2, PLAIN, "en")], [])
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0}
    assert {r.shapley for r in got if r.filter_order[r.step - 1] == "E"} == {120}


def test_outcomes():
    orders, by, _ = filter_audit.outcomes("ABCDE")
    assert len(orders) == 120 and by["kept"].shape == (32, 600)
    ends = by["removed"].reshape(32, 120, 5).sum(axis=2)
    assert (ends[1:] == 1).all() and (ends[0] == 0).all()  # whoever fails any filter goes once in each order


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(filter_audit.SQL).df()
    got = filter_audit.op12(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in want.itertuples())
