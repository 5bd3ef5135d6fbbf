import pytest

from foliospark.operators import grids, saved_queries


def cells(spark):
    rows = [["Description", "Qty", "Unit price", "Amount"], ["Oil change", "2", "$10.00", "$20.00"], ["Filter", "1", "5.00", "5.00"], ["Total due", "", "", "25.00"]]
    return spark.createDataFrame([("t", r, c, v, r == 0) for r, own in enumerate(rows) for c, v in enumerate(own)], "id string, row int, col int, text string, column_header boolean")


def test_line_items(spark):
    got = {r["row"]: r for r in grids.line_items(cells(spark)).collect()}
    assert got[1]["kind"] == "item" and (got[1]["description"], got[1]["quantity"], got[1]["unit_price"], got[1]["amount"]) == ("Oil change", "2", "$10.00", "$20.00")
    assert got[3]["kind"] == "total" and got[3]["amount"] == "25.00" and set(got) == {1, 2, 3}


def test_header_without_flags(spark):
    from pyspark.sql import functions as F

    bare = cells(spark).withColumn("column_header", F.lit(False))
    assert grids.header_rows(bare).first()["header"] == 1
    assert grids.header_rows(bare.filter("row > 0").withColumn("row", F.col("row") - 1)).first()["header"] == 0
    assert len(grids.fingerprint(bare).first()["fingerprint"]) == 64


def test_markdown_and_quality(spark):
    df = spark.createDataFrame([("t", "| a | b |\n|---|:-:|\n| 1 |  |\ntext")], "id string, markdown string")
    assert [(r["row"], r["cells"]) for r in grids.markdown_rows(df).orderBy("row").collect()] == [(0, ["a", "b"]), (1, ["1", ""])]
    assert grids.quality(cells(spark)).first()["score"] == pytest.approx(0.25 + 0.2 + 0.25 * 14 / 16 + 0.15 + 0.1, abs=1e-4)


def test_saved_queries():
    got = saved_queries.parse({"families": ["Invoice", "invoice "], "document_family": "receipt", "open_review_tasks": True, "dateFrom": "2024-01-02", "amountMin": "1.5", "reviewedOnly": False})
    assert got["families"] == ("Invoice", "receipt") and got["review_statuses"] == ("needs_review",) and str(got["amount_min"]) == "1.5"
    assert saved_queries.applied(got) == 4 and saved_queries.to_filters(got).date_from == "2024-01-02"
    for bad in ({"x": 1}, {"families": 3}, {"families": [3]}, {"reviewedOnly": "yes"}, {"dateFrom": "1/2/24"}, {"amountMin": True}, {"folderIds": "no"}, []):
        with pytest.raises(saved_queries.BadSavedQuery):
            saved_queries.parse(bad if bad != [] else "[1]")
