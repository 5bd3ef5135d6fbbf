"""Six invariants come, and a document that has a review and is still auto-accepted breaks one; query and SQL on planted tables."""
import duckdb

from foliospark.plans import report_queries as Q

NAMES = ["admittedWithoutConcreteEvidence", "jobsPastTheirAttempts", "placeholdersAdmitted", "reviewedDocumentsAutoAccepted", "selectedTasksMissingContract", "selectedTasksMissingGrounding"]


def answers(spark, folder, labels):
    docs = [(i, f"text {i}", "en", "s0", 6) for i in range(30)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "lineitem": ([(1, 1, 12, 1, "N", 3.0), (2, 5, 7, 5, "A", 1.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double"),
        "events": ([(7, 1, "view", 2.0, "2024-01-01 00:00:00")], "event_id long, user_id long, event_type string, value double, ts string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    got = sorted(tuple(r) for r in Q.hard_invariants(spark, str(folder)).select("invariant", "violations", "examples").collect())
    assert got == sorted(con.execute(Q.ORACLES["hard_invariants"]).fetchall())
    assert [r[0] for r in got] == NAMES
    return {r[0]: r[1:] for r in got}


def test_reviewed_documents(spark, tmp_path):
    """A verdict that is absent or unknown leaves the document auto-accepted; what has no review may be, and a review of no document counts for none."""
    labels = [(i, 1, 0) for i in range(5)] + [(i, 0, 1) for i in range(5, 10)] + [(i, None, 0) for i in range(10, 22)] + [(22, 2, 0), (99, None, 0), (None, None, None)]
    got = answers(spark, tmp_path, labels)
    assert got["reviewedDocumentsAutoAccepted"] == (13, ",".join(map(str, range(10, 20))))
    assert got["selectedTasksMissingContract"] == (1, "1") and got["admittedWithoutConcreteEvidence"] == (1, "11") and got["jobsPastTheirAttempts"] == (0, "")


def test_reviews_kept(spark, tmp_path):
    assert answers(spark, tmp_path, [(i, i % 2, 0) for i in range(10)])["reviewedDocumentsAutoAccepted"] == (0, "")
