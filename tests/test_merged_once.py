"""Grids lie by their id once: what is made of them deals nothing out again."""
import os

import pytest

from foliospark.operators import merged_grids as M
from foliospark.plans import grid_queries

SF = "/root/testdata/sf0.001"
CELLS = "id int, pos int, row int, col int, row_span int, col_span int, text string, column_header boolean, row_section boolean, box array<double>"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name, scans", [("merged_rows", 5), ("merged_labels", 2)])
def test_exchanges(spark, name, scans):
    """One exchange a scan, of lines or their ids; lists as small as these are broadcast besides."""
    plan = grid_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan ") <= scans


def test_header_runs(spark):
    """Flagged rows count up to the first row without a flag or without a place."""
    c = lambda g, row, col, head: (g, row * 10 + col, row, col, 1, 1, f"t{row}{col}", head, False, None)
    rows = [c(1, 0, 0, False), c(1, 0, 1, True), c(1, 1, 0, True), c(1, 2, 0, False), c(1, 3, 0, True), c(2, 1, 0, True), c(2, 2, 0, True), c(3, 0, 0, True), c(3, 2, 0, True), c(4, 0, 0, False)]
    grids = spark.createDataFrame([(k, None, None, None) for k in (1, 2, 3, 4)], "id int, num_rows int, num_cols int, family string")
    spread = M.places(spark.createDataFrame(rows, CELLS), grids)
    assert {r.id: r.header for r in M.header(spread).collect()} == {1: 2, 2: 1, 3: 1, 4: 1}
    assert {r.id: list(r.labels) for r in M.labels(spread).collect()} == {1: ["t00 / t10", "t01"], 2: [""], 3: ["t00"], 4: ["t00"]}
