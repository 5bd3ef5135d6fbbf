"""Merges of state tables: each gives the table after the change, to be written in place of the old one."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN = ("open", "due_soon", "overdue", "needs_review")


def upsert_deadlines(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(document, kind, due, status, confidence, evidence, metadata): an open deadline of the same document, kind and day takes the greater
    confidence, the new evidence and status, and the metadata of both, the new one's first; closed ones stay, and a new one comes beside them."""
    open_ = F.col("status").isin(*OPEN)
    rows = stored.filter(open_).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = lambda c: F.max_by(c, "_new").alias(c)
    both = F.transform(F.array_sort(F.collect_list(F.struct("_new", F.map_entries("metadata").alias("m")))), lambda x: x["m"])  # two rows a key at most, by the upsert itself
    merged = F.aggregate(both, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")), lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.exists(m, lambda e: e["key"] == k)), F.map_from_entries(m)))
    out = rows.groupBy("document", "kind", "due").agg(last("status"), F.max("confidence").alias("confidence"), last("evidence"), merged.alias("metadata"))
    return out.unionByName(stored.filter(~open_))


def insert_missing(stored: DataFrame, new: DataFrame, *keys: str, status: str = "open") -> DataFrame:
    """The table with those new rows whose key has no row of that status; of new rows of one key the first by all columns."""
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys]))).filter("_n = 1").drop("_n")
    return stored.unionByName(once.join(stored.filter(F.col("status") == status).select(*keys), [*keys], "left_anti"))


def merge_contacts(contacts: DataFrame, aliases: DataFrame, links: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contacts (id, name, identifiers), aliases (id, alias), links (document, id), mapping (id, into).  What was merged leaves; its name
    and aliases become aliases of the other, its links move, its identifiers are added; nothing comes twice."""
    moved = lambda df: df.join(mapping, "id", "left").withColumn("id", F.coalesce("into", "id")).drop("into")
    gone = contacts.join(mapping, "id")
    own = contacts.join(mapping.select("id"), "id", "left_anti")
    entries = moved(contacts).select("id", F.explode_outer(F.map_entries("identifiers")).alias("e")).filter("e IS NOT NULL").groupBy("id", F.col("e.key").alias("k")).agg(F.min("e.value").alias("v"))
    more = entries.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("_m"))
    kept = own.join(more, "id", "left").select("id", "name", F.when(F.col("_m").isNull(), F.col("identifiers")).otherwise(F.map_concat(F.map_filter("_m", lambda k, v: ~F.map_contains_key("identifiers", k)), F.col("identifiers"))).alias("identifiers"))
    names = gone.select(F.col("into").alias("id"), F.col("name").alias("alias"))
    all_aliases = moved(aliases).select("id", "alias").unionByName(names).withColumn("_k", F.lower("alias")).groupBy("id", "_k").agg(F.min("alias").alias("alias")).drop("_k")
    return kept, all_aliases, moved(links).select("document", "id").distinct()


def supersede(stored: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Versioned rows (key, sha, version, is_active): new content of a key makes the active row inactive and comes as its next version; equal content
    changes nothing."""
    active = stored.filter("is_active").select(*keys, F.col("sha").alias("_sha"), F.col("version").alias("_version"))
    fresh = new.join(active, [*keys], "left").filter("_sha IS NULL OR _sha <> sha")
    added = fresh.select(*keys, "sha", (F.coalesce("_version", F.lit(0)) + 1).cast("int").alias("version"), F.lit(True).alias("is_active"))
    replaced = added.select(*keys, F.lit(True).alias("_r"))
    old = stored.join(replaced, [*keys], "left").withColumn("is_active", F.col("is_active") & F.col("_r").isNull()).select(*keys, "sha", "version", "is_active")
    return old.unionByName(added)


def patch_json(json: Column, patch: Column) -> Column:
    """The top-level keys of two JSON objects, the patch's first, in the order of their names."""
    kind = "map<string,variant>"
    old, new = F.from_json(json, kind), F.from_json(patch, kind)
    joined = F.map_concat(F.map_filter(F.coalesce(old, F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>"))), lambda k, v: ~F.map_contains_key(new, k)), new)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(joined), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))))


def replace_members(stored: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Folder or tag rows (document, name) of `documents` give way to the new ones, each once."""
    return stored.join(documents.select("document"), "document", "left_anti").unionByName(new.distinct())


def filed(documents: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """documents (document, primary_folder, filed_at), changes (document, folder): the new primary folder; the time of the first filing stays."""
    x = documents.join(changes, "document", "left")
    return x.select("document", F.coalesce("folder", "primary_folder").alias("primary_folder"), F.when(F.col("folder").isNotNull(), F.coalesce("filed_at", now)).otherwise(F.col("filed_at")).alias("filed_at"))


def changed_groups(stored: DataFrame, rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, fingerprint) of the groups whose members are not those that the stored fingerprint (key, fingerprint) tells: only these need a new aggregate.
    The fingerprint is a count and two sums of hashes, so a group is never one array."""
    add = lambda seed: F.sum(F.xxhash64(F.lit(seed), member).cast("decimal(38,0)")).cast("string")
    now = rows.groupBy(key).agg(F.concat_ws("/", F.count("*").cast("string"), add(1), add(2)).alias("fingerprint"))
    return now.join(stored, [key, "fingerprint"], "left_anti")


def decided(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """suggestions (id, status), decisions (id, at, decision: accept, reject or defer): pending ones take the last decision; settled ones stay."""
    last = decisions.groupBy("id").agg(F.max_by("decision", "at").alias("_d"))
    new = F.when(F.col("_d") == "accept", "accepted").when(F.col("_d") == "reject", "rejected").when(F.col("_d") == "defer", "deferred").otherwise(F.col("status"))
    return suggestions.join(last, "id", "left").withColumn("status", F.when(F.col("status") == "pending", new).otherwise(F.col("status"))).drop("_d")


def touched(stored: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """stored (key, columns, updated_at), new (key, columns): rows whose columns change take the new values and the time; equal ones keep theirs."""
    columns = [c for c in new.columns if c != key]
    x = stored.join(new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new")), key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    hit = F.coalesce(F.col("_new"), F.lit(False)) & differs
    return x.select(key, *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"))


def persisted(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Extraction runs (document, schema, scope, region, run, is_current): those of the new runs' document, schema, scope and region, nulls alike, are no longer current."""
    keys = ("document", "schema", "scope", "region")
    replaced = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & runs[k].eqNullSafe(F.col(f"_{k}"))
    old = runs.join(replaced.withColumn("_hit", F.lit(True)), same, "left").withColumn("is_current", F.col("is_current") & F.col("_hit").isNull())
    return old.select(*runs.columns).unionByName(new.withColumn("is_current", F.lit(True)).select(*runs.columns))
