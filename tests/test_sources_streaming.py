import time

from pyspark.sql import functions as F

from foliospark.sources import files
from foliospark.streaming import ledger


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/my_first-scan.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "in/copy.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "in/fake.pdf").write_bytes(b"hello")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.described(spark.read.format("binaryFile").load(f"{tmp_path}/in")).collect()}
    assert got["my_first-scan.pdf"]["title"] == "My First Scan" and got["fake.pdf"]["mime"] is None
    assert got["copy.pdf"]["sha"] == got["my_first-scan.pdf"]["sha"]
    ok = spark.createDataFrame([(got["copy.pdf"]["uri"],), ("filesystem://original/sha256/00/00/ab/x.blob",)], "uri string").select(files.address_ok(F.col("uri")).alias("ok")).collect()
    assert [r["ok"] for r in ok] == [True, False]
    known = spark.createDataFrame([], "sha string")
    q = ledger.watch(spark, f"{tmp_path}/in", known).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_merges(spark):
    schema = "a long, b long, kind string, status string, evidence array<string>"
    got = files.merge_edges(spark.createDataFrame([(1, 2, "x", "confirmed", ["e"])], schema), spark.createDataFrame([(2, 1, "x", "suggested", []), (3, 4, "x", "suggested", ["n"])], schema))
    assert sorted(map(tuple, got.collect())) == [(1, 2, "x", "confirmed", ["e"]), (3, 4, "x", "suggested", ["n"])]
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int"), spark.createDataFrame([(1, "c", 0)], "k int, v string, t int")
    assert sorted(map(tuple, files.upsert(old, new, "k", order="t").collect())) == [(1, "c", 0), (2, "b", 1)]
    assert sorted(map(tuple, files.replace_for(old, new, "k").collect())) == [(1, "c", 0), (2, "b", 1)]


def test_windows(spark, tmp_path):
    spark.createDataFrame([("q", "queued", "2024-01-01 00:01:00"), ("q", "queued", "2024-01-01 00:09:00"), ("q", "failed", "2024-01-01 00:11:00")], "queue string, status string, at string").select("queue", "status", F.col("at").cast("timestamp").alias("scheduled_at")).write.parquet(f"{tmp_path}/j")
    stream = spark.readStream.schema("queue string, status string, scheduled_at timestamp").parquet(f"{tmp_path}/j")
    q = ledger.queue_windows(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["status"], r["jobs"]) for r in spark.table("win").collect()) == [("failed", 1), ("queued", 2)]


def test_leases(spark, tmp_path):
    rows = [(1, "claim", 0), (1, "complete", 5), (1, "cancel", 6), (2, "claim", 0), (2, "claim", 10000), (3, "cancel", 1), (4, "claim", 0), (4, "claim", 5)]
    spark.createDataFrame(rows, "job_id long, kind string, at long").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("job_id long, kind string, at long").parquet(f"{tmp_path}/e")
    q = ledger.leases(stream, 3000).writeStream.format("memory").queryName("lease").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(90)
    time.sleep(0.1)
    assert sorted((r["job_id"], r["status"], r["attempts"]) for r in spark.table("lease").collect()) == [(1, "succeeded", 1), (2, "leased", 2), (3, "cancelled", 0), (4, "leased", 1)]
