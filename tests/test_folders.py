"""Folder trees of any depth, cycles, memberships, resolution."""
import random
from decimal import Decimal

from pyspark.sql import functions as F

from foliospark.operators import filters, folders, saved_queries


def test_deep_tree_and_cycles(spark):
    rows = [(0, None, "root")] + [(k, k - 1, f"n{k}") for k in range(1, 21)]  # a chain of twenty levels
    rows += [(30, 31, "a"), (31, 32, "b"), (32, 30, "c"), (33, 31, "below"), (40, 40, "self"), (50, 99, "orphan"), (51, 50, None)]
    random.Random(1).shuffle(rows)
    got = {r.id: (r.path, r.depth, r.cyclic) for r in folders.paths(spark.createDataFrame(rows, "id long, parent long, name string")).collect()}
    assert len(got) == len(rows)
    assert got[20] == ("root/" + "/".join(f"n{k}" for k in range(1, 21)), 20, False) and got[0] == ("root", 0, False)
    assert all(got[k] == (None, None, True) for k in (30, 31, 32, 33, 40))
    assert got[50] == ("orphan", 0, False) and got[51] == ("orphan/", 1, False)
    tree = folders.paths(spark.createDataFrame(rows, "id long, parent long, name string"))
    assert sorted(r.id for r in folders.below(tree, "root/n1/n2").collect()) == list(range(2, 21))
    assert folders.paths(spark.createDataFrame([], "id long, parent long, name string")).count() == 0


def test_memberships(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, folder string")
    related = filters.Related(members=spark.createDataFrame([(2, "a"), (2, "a"), (3, "x"), (1, "a")], "id long, folder string"))
    ids = lambda f: sorted(r.id for r in f.apply(docs, related).collect())
    assert ids(filters.Filters(folders=("a",))) == [1, 2] and ids(filters.Filters(folders=("a",), primary_folder_only=True)) == [1]


def test_resolution(spark):
    rows = [("m", "manual", False, 1, [2], None), ("s", "smart", True, 9, [], '{"families": ["en"], "amountMin": "10.10"}')]
    known = spark.createDataFrame(rows, "id string, kind string, shared boolean, folder_owner long, grants array<long>, query string")
    assert folders.resolved(known, "m", 2) == filters.Filters(folders=("m",)) and folders.resolved(known, "m", 3) is None and folders.resolved(known, "no", 1) is None
    assert folders.resolved(known, "s", 3).families == ("en",)
    assert folders.listed(known, "s", 3, filters.Filters(families=("de",))) is None and folders.listed(known, None, 3, filters.Filters()) == filters.Filters()


def test_amounts_stay_decimals(spark):
    f = saved_queries.to_filters(saved_queries.parse('{"amountMin": "10.10"}'))
    assert f.amount_min == Decimal("10.10")
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    totals = spark.createDataFrame([(1, "10.10"), (2, "10.09")], "id long, t string").select("id", F.col("t").cast("decimal(18,4)").alias("total"))
    assert [r.id for r in f.apply(docs, filters.Related(totals=totals)).collect()] == [1]
