"""Literal cases of rules that an SQL of the same reading cannot catch."""
import pytest
from pyspark.sql import functions as F

from foliospark.operators import extraction, facts, filters, ledger
from foliospark.sources import files

NOW = "2024-01-02 00:00:00"
JOB = "job_id int, queue string, job_type string, status string, attempts int, max_attempts int, priority int, scheduled_at timestamp, lease_until timestamp, title string"


def jobs(spark, *rows):
    df = spark.createDataFrame([(i, "q", "t", s, a, 3, p, at, until, f"Doc {i}") for i, s, a, p, at, until in rows], JOB.replace("timestamp", "string"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("scheduled_at", "lease_until")})


def now():
    return F.lit(NOW).cast("timestamp")


def test_expired_leases_go_last(spark):
    """An expired lease fails and is due now, so of equal priorities a job that waits longer comes first."""
    x = jobs(spark, (1, "running", 1, 5, "2024-01-01 00:00:00", NOW), (2, "queued", 0, 5, "2024-01-01 12:00:00", None), (3, "running", 3, 9, "2024-01-01 00:00:00", "2024-01-01 01:00:00"))
    assert [(r.job_id, r.status, str(r.scheduled_at)) for r in ledger.recovered(x, now()).orderBy("job_id").collect()] == [(1, "failed", NOW), (2, "queued", "2024-01-01 12:00:00"), (3, "dead_letter", "2024-01-01 00:00:00")]
    assert [r.job_id for r in ledger.claimable(x, now()).collect()] == [2]


def test_failures(spark):
    """attempts counts the run that failed: the third of three is the last, the first waits 30 seconds."""
    x = jobs(spark, (1, "running", 1, 0, NOW, None), (2, "running", 2, 0, NOW, None), (3, "running", 3, 0, NOW, None), (4, "cancelled", 3, 0, NOW, None))
    assert [(r.next_status, r.delay_seconds) for r in ledger.after_failure(x).orderBy("job_id").collect()] == [("failed", 30), ("failed", 60), ("dead_letter", 0), ("cancelled", 0)]


def test_bulk_cancel_and_retry(spark):
    x = jobs(spark, *[(i, "queued", 0, i, NOW, None) for i in range(5)], (7, "running", 1, 9, NOW, "2024-01-01 00:00:00"))
    with pytest.raises(ValueError):
        ledger.cancelled(x, queues=("q",))
    with pytest.raises(ValueError):
        ledger.cancelled(x, job_ids=(1,), statuses=("running",))
    with pytest.raises(ValueError):
        ledger.cancelled(x, job_ids=(1,), statuses=("succeeded",))
    stopped = lambda df: {r.job_id for r in df.filter("status = 'cancelled'").collect()}
    assert stopped(ledger.cancelled(x, title_prefix="dOC", most=2)) == {4, 3}
    assert stopped(ledger.cancelled(x, job_ids=(1, 7))) == {1} and stopped(ledger.cancelled(x, job_ids=(1, 7), running=True)) == {1, 7}
    assert [(r.status, r.attempts) for r in ledger.retried(x, now()).filter("job_id = 7").collect()] == [("queued", 0)]


def test_relationships_take_rejections(spark):
    schema = "a long, b long, kind string, status string, evidence array<string>"
    stored = spark.createDataFrame([(2, 1, "x", "confirmed", ["e"]), (3, 4, "x", "suggested", ["e"]), (5, 6, "x", "rejected", ["e"]), (7, 8, "x", "suggested", ["e"])], schema)
    new = spark.createDataFrame([(1, 2, "x", "rejected", []), (4, 3, "x", "confirmed", ["n"]), (6, 5, "x", "suggested", ["n"])], schema)
    assert sorted(map(tuple, files.merge_edges(stored, new).collect())) == [(2, 1, "x", "rejected", ["e"]), (3, 4, "x", "confirmed", ["n"]), (5, 6, "x", "rejected", ["e"]), (6, 5, "x", "suggested", ["n"]), (7, 8, "x", "suggested", ["e"])]


def test_redaction_at_any_depth(spark):
    rows = ['{"outer":{"prompt":"secret"},"n":1}', '[{"Messages":[1]},{"a":["data:x","/srv/x","ok"]}]', '{"image-path":1,"k":{"answers":{"b":2}}}', "no json", None]
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, j string").select("k", extraction.redacted("j").alias("x")).orderBy("k").collect()]
    assert got == ['{"outer":{"prompt":"[redacted]"},"n":1}', '[{"Messages":"[redacted]"},{"a":["[redacted]","[redacted]","ok"]}]', '{"image-path":"[redacted]","k":{"answers":"[redacted]"}}', '"[redacted]"', None]


def test_folders_need_a_grant_that_writes(spark):
    folders = spark.createDataFrame([("read", False, 9, [1], []), ("write", False, 9, [1], [1]), ("own", False, 1, [], []), ("house", True, 9, [], [])], "folder string, shared boolean, folder_owner long, grants array<long>, writers array<long>")
    assert {r.folder for r in filters.writable_folders(folders, 1).collect()} == {"write", "own", "house"}


def test_facets_hide_unreadable_counterparts(spark):
    docs = spark.createDataFrame([(1, "f", "a", "r", "s", "2024-01-01")], "id long, family string, folder string, review_status string, sensitivity string, day string").withColumn("document_date", F.to_date("day"))
    edges = spark.createDataFrame([(1, 2, "seen", "suggested"), (3, 1, "hidden", "confirmed")], "a long, b long, kind string, status string")
    none = spark.createDataFrame([], "id long, kind string, status string")
    visible = spark.createDataFrame([(1,), (2,)], "id long")
    got = filters.facets(docs, filters.Related(tags=spark.createDataFrame([], "id long, tag string"), edges=edges, deadlines=none, visible=visible))
    assert [r.value for r in got.filter("facet = 'relationshipTypes'").collect()] == ["seen"]


def test_both_directed_rules_suggest(spark):
    docs = spark.createDataFrame([(1, "invoice", 7, "2024-01-01", "a"), (2, "receipt", 7, "2024-01-09", "b"), (3, "legal_contract", 7, None, "c"), (4, "legal_contract", 7, None, "d")], "id long, family string, contact long, day string, sha string")
    got = facts.relationship_suggestions(docs.withColumn("day", F.to_date("day"))).collect()
    assert sorted((r.a, r.b, r.kind, r.confidence) for r in got) == [(1, 2, "invoice_for", 0.86), (2, 1, "receipt_for", 0.86), (3, 4, "amendment_to", 0.78)]


def test_families_by_priority_and_support(spark):
    docs = [(1, "whitepaper", None), (2, "invoice", None), (3, "receipt", "insurance_denial"), (4, "medical_bill", "generic_form"), (5, "insurance_document", "document_observation"), (6, " Receipt ", "travel_receipt"), (7, "whitepaper", None)]
    hints = [(1, "service_record", 3), (1, "real_estate_title", 2), (2, "service_record", 5), (2, "retail_order", 9), (3, "medical_eob", 2), (4, "medical_eob", 2), (6, "receipt", 4), (7, "service_record", 3)]
    h = spark.createDataFrame([(i, f, ["x"] * n, True) for i, f, n in hints], "id long, family string, anchors array<string>, hint boolean")
    got = {r.id: (r.family, r.confidence, r.update) for r in extraction.reconciled(spark.createDataFrame(docs, "id long, family string, semantic string"), h).collect()}
    assert got == {
        1: ("real_estate_title", 0.8, True),  # two hints: the order of families decides
        2: ("service_record", 0.92, True),  # not the one with most anchors
        3: ("insurance_denial", 0.8, True),  # supported by another family's anchors
        4: ("medical_bill", 0.62, False), 5: ("generic", 0.68, True), 6: ("receipt", 0.88, False),
        7: ("whitepaper", 0.62, False),  # only some families may be replaced by these
    }
