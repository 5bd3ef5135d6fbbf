"""Content-addressed files: type by first bytes, address by hash, title from the name, duplicates, manifests, state tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# First bytes of the accepted types.
MAGIC = (("application/pdf", "255044462D"), ("image/jpeg", "FFD8FF"), ("image/png", "89504E470D0A1A0A"), ("image/tiff", "49492A00"), ("image/tiff", "4D4D002A"))


def mime(content: Column) -> Column:
    """The type that the first 16 bytes tell; null for any other."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for name, magic in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), name)
    return out


def address(kind: str, sha: Column, role: str) -> Column:
    """filesystem://kind/sha256/aa/bb/hash/role.blob"""
    return F.concat(F.lit(f"filesystem://{kind}/sha256/"), F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha, F.lit(f"/{role}.blob"))


def address_ok(uri: Column) -> Column:
    """Whether an address is well formed and its folders are the hash's."""
    return uri.rlike(r"^filesystem://[a-z_]+/sha256/([0-9a-f]{2})/([0-9a-f]{2})/\1\2[0-9a-f]{60}/[a-z_]+[.]blob$")


def title(name: Column) -> Column:
    """A file's name without folder and ending, underscores and hyphens as spaces, words capitalized."""
    return F.initcap(F.trim(F.translate(F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "[.][^.]*$", ""), "_-", "  ")))


def described(files: DataFrame) -> DataFrame:
    """path, sha, mime, title, uri, length of binaryFile rows; the content itself goes no further."""
    sha = F.sha2("content", 256)
    return files.select("path", sha.alias("sha"), mime(F.col("content")).alias("mime"), title(F.col("path")).alias("title"), address("original", sha, "original").alias("uri"), "length")


def duplicates_of(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new rows with `duplicate_of`, the oldest stored id of the same (household, sha)."""
    old = stored.groupBy("household", "sha").agg(F.min_by("id", F.struct("created_at", "id")).alias("duplicate_of"))
    return new.join(old, ["household", "sha"], "left")


def manifest(spark: SparkSession, path: str, *required: str) -> DataFrame:
    """A JSON manifest; keys that must be there are checked."""
    df = spark.read.option("multiLine", True).json(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    return df


def replace_for(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace-all load: rows of the keys in `new` give way to the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(stored: DataFrame, new: DataFrame, *keys: str, order: str) -> DataFrame:
    """Keyed upsert: of each key the row with the highest `order`, new rows before stored ones."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of undirected relationships (a, b, kind, status, evidence); new: at most one row a pair and kind.

    A stored suggested or confirmed row takes the new status, but a suggestion does not touch a confirmed one; empty evidence keeps the
    old; the row keeps its direction.  Stored rejected rows stay as they are, and a new row beside them is a row of its own."""
    live = F.col("status").isin("suggested", "confirmed")
    ends = lambda df: df.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    fresh = ends(new).select("_lo", "_hi", "kind", F.struct("a", "b", "status", "evidence").alias("n"))
    both = ends(stored.filter(live)).select("_lo", "_hi", "kind", F.struct("a", "b", "status", "evidence").alias("o")).join(fresh, ["_lo", "_hi", "kind"], "full")
    kept = F.col("n").isNull() | F.coalesce((F.col("o.status") == "confirmed") & (F.col("n.status") == "suggested"), F.lit(False))
    evidence = F.when(kept | (F.col("o").isNotNull() & (F.size("n.evidence") == 0)), F.col("o.evidence")).otherwise(F.col("n.evidence"))
    merged = both.select(F.coalesce("o.a", "n.a").alias("a"), F.coalesce("o.b", "n.b").alias("b"), "kind", F.when(kept, F.col("o.status")).otherwise(F.col("n.status")).alias("status"), evidence.alias("evidence"))
    return merged.unionByName(stored.filter(~live).select("a", "b", "kind", "status", "evidence"))
