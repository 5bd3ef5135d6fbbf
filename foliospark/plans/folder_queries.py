"""Folder trees and memberships: customers as folders below each other, documents in several folders."""
from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import filters, folders
from foliospark.sources.tables import SQL, documents, table


def _tree(s, d):
    """Customers as a binary tree by number; those far in debt hang below their own child, which closes a cycle."""
    c = table(s, d, "customer")
    key = F.col("c_custkey")
    parent = F.when((F.col("c_acctbal") < -950) & (key > 0), key * 2).when(key > 0, F.floor(key / 2))
    return c.select(key.alias("id"), parent.cast("long").alias("parent"), F.col("c_name").alias("name"))


def folder_tree(s, d):
    return folders.paths(_tree(s, d))


def folder_members(s, d):
    """Documents in one of two folders, as their primary one or as members: long documents are members of src1."""
    docs = documents(s, d)
    members = docs.filter("n_chars > 2000").select("id", F.lit("src1").alias("folder"))
    return filters.Filters(folders=("src1", "src2")).apply(docs, filters.Related(members=members)).select("id", "folder")


def smart_folder(s, d):
    """A list opened at a smart folder: its saved query and the list's own filter."""
    rows = [("smart-1", "smart", False, 3, [5], '{"families": ["en", "fr"], "dateFrom": "2024-02-01"}'), ("src1", "manual", True, 0, [], None)]
    known = s.createDataFrame(rows, "id string, kind string, shared boolean, folder_owner long, grants array<long>, query string")
    chosen = folders.listed(known, "smart-1", 5, filters.Filters(families=("en", "de")))
    return chosen.apply(documents(s, d)).select("id", "family")


QUERIES = {"folder_tree": folder_tree, "folder_members": folder_members, "smart_folder": smart_folder}

ORACLES = {
    "folder_tree": """WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < -950 AND c_custkey > 0 THEN c_custkey * 2 WHEN c_custkey > 0 THEN c_custkey // 2 END AS parent, c_name AS name FROM customer),
    t AS (SELECT id, name AS path, 0 AS depth FROM c WHERE parent IS NULL OR parent NOT IN (SELECT id FROM c) UNION ALL SELECT c.id, t.path || '/' || c.name, t.depth + 1 FROM t JOIN c ON c.parent = t.id)
    SELECT c.id, t.path, CAST(t.depth AS INT) AS depth, t.id IS NULL AS cyclic FROM c LEFT JOIN t ON t.id = c.id""",
    "folder_members": f"WITH {SQL['docs']} SELECT id, folder FROM docs WHERE folder IN ('src1', 'src2') OR n_chars > 2000",
    "smart_folder": f"WITH {SQL['docs']} SELECT id, family FROM docs WHERE family = 'en' AND document_date >= DATE '2024-02-01'",
}
