"""Shards of equal row counts that keep linked documents together: balanced label propagation in DataFrame functions only.

Documents that share a link key are neighbours.  Every document starts in a shard by hash.  In each round

1. the members of every key are counted by shard (map-side sums; no pairs of members);
2. a document, joined with the counts of its keys, prefers the shard that holds most of its neighbours and itself, ties by
   a hash of key, shard and round, the same for all members of a key.  Every second round only shards with room count;
3. wishes are counted by (from, to).  A pair of shards may exchange as many documents as want to go either way, and what
   room a shard has is divided among the remaining wishes: the quotas, of a table of at most shards x shards rows;
4. wishes with larger gains go first: in each pair, cells of (gain's power of two, hash bucket) are summed up in that order, and
   the cells within the quota move.  No list of wishes is ever sorted as a whole.

Rounds end when nobody moves.  `settle` then makes counts exact: a shard has floor or ceil of rows / shards, the documents
without neighbours, and those beyond a shard's count, fill the gaps.  Places are ranks in (shard, bucket) plus the counts of
the buckets before.

A key of more documents than a shard holds cannot stay whole: it is first split, by hash, into parts of at most about one
shard.  Joins on keys that hold more than 1 / `MOST_HOT` of the documents (so at most `MOST_HOT` keys) are salted.

Nulls: a null text is empty; such rows, and all empty texts, are equal texts.  Rows are documents of their own, whatever
their ids: null, repeated, of any type.  Extra columns are left out.  An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import drop, stash, table

SHARDS, ROUNDS = 24, 8
SALTS, MOST_HOT, BUCKETS = 256, 10_000, 256


def _bucket(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def members_of(links: DataFrame, most: int, least_hot: int) -> DataFrame:
    """(row, key, salt) of keys with several members; keys of more than `most` members are split into parts.

    salt is 0 but for keys of more than `least_hot` members."""
    sizes = links.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    hot = sizes.filter(F.col("n") > least_hot).select(F.col("key").alias("_hot"), F.col("n").alias("_n"))  # at most MOST_HOT rows
    # hot keys meet their sizes by broadcast, the others by a join on the key
    flagged = links.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left")
    spread = F.when(F.col("_n").isNull(), 0).otherwise(_bucket(SALTS, F.col("row"))).cast("int")
    flagged = flagged.select("row", "key", spread.alias("salt"), "_n")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > least_hot, SALTS - 1).otherwise(0)))
    met = flagged.join(sizes.select("key", "n", salts.alias("salt")), ["key", "salt"])
    part = F.when(F.col("n") <= most, 0).otherwise(F.pmod(F.xxhash64(F.lit(3), "row"), F.ceil(F.col("n") / F.lit(most)).cast("long")))
    return met.select("row", F.xxhash64("key", part).alias("part"), "key", "salt").select("row", F.struct("key", "part").alias("key"), "salt")


def wishes(members: DataFrame, at: DataFrame, room: DataFrame | None, seed: int) -> DataFrame:
    """(row, a, b, gain): documents that would rather be in shard b than in a.  room: shards that may be chosen, if not all."""
    here = members.join(at, "row")
    counts = here.groupBy("key", "shard").agg(F.count("*").alias("n"), F.max("salt").alias("top"))
    if room is not None:
        counts = counts.join(F.broadcast(room.select("shard", F.lit(True).alias("open"))), "shard", "left")  # at most one row a shard
    else:
        counts = counts.withColumn("open", F.lit(True))
    each = F.struct("shard", "n", F.coalesce("open", F.lit(False)).alias("open"), F.xxhash64(F.lit(seed), "key", "shard").alias("tie"))
    profile = counts.groupBy("key").agg(F.collect_list(each).alias("profile"), F.max("top").alias("top"))  # at most one struct a shard
    profile = profile.select("key", "profile", F.explode(F.sequence(F.lit(0), F.when(F.col("top") > 0, SALTS - 1).otherwise(0))).alias("salt"))
    near = here.join(profile, ["key", "salt"]).select("row", F.col("shard").alias("a"), F.explode("profile").alias("p"))
    # of several keys, the counts add up; the tie is that of all of them
    score = near.groupBy("row", "a", F.col("p.shard").alias("b")).agg(F.sum("p.n").alias("n"), F.bit_xor("p.tie").alias("tie"), F.first("p.open").alias("open"))
    best = F.max(F.when(F.col("open") | (F.col("a") == F.col("b")), F.struct("n", "tie", "b")))
    out = score.groupBy("row", "a").agg(best.alias("best"), F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("now"))
    return out.select("row", "a", F.col("best.b").alias("b"), (F.col("best.n") - F.col("now")).alias("gain")).filter("a <> b")


def granted(wanted: DataFrame, at: DataFrame, most: int, seed: int) -> DataFrame:
    """(row, b): the wishes within the quotas of their pairs of shards."""
    level = F.when(F.col("gain") < 1, 0).otherwise(F.floor(F.log2(F.col("gain"))) + 1).cast("int")
    wanted = wanted.select("row", "a", "b", level.alias("level"), _bucket(BUCKETS, F.lit(seed), F.col("row")).alias("bucket"))
    cells = wanted.groupBy("a", "b", "level", "bucket").agg(F.count("*").alias("n"))
    pairs = cells.groupBy("a", "b").agg(F.sum("n").alias("n"))
    back = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    room = at.groupBy(F.col("shard").alias("b")).agg(F.greatest(F.lit(0), F.lit(most) - F.count("*")).alias("room"))
    quota = pairs.join(back, ["a", "b"], "left").join(room, "b", "left").withColumn("swap", F.least("n", F.coalesce("m", F.lit(0))))
    rest, asked = F.col("n") - F.col("swap"), F.sum(F.col("n") - F.col("swap")).over(Window.partitionBy("b"))
    free = F.coalesce("room", F.lit(most))
    share = F.when(asked <= free, rest).otherwise(F.floor(free * rest / F.greatest(asked, F.lit(1))))
    quota = quota.select("a", "b", (F.col("swap") + share).alias("quota"))
    order = Window.partitionBy("a", "b").orderBy(F.desc("level"), "bucket")
    going = cells.withColumn("upto", F.sum("n").over(order)).join(quota, ["a", "b"]).filter("upto <= quota")
    return wanted.join(going.select("a", "b", "level", "bucket"), ["a", "b", "level", "bucket"]).select("row", "b")


def propagate(rows: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard) of the documents that have neighbours.  rows: (row); links: (row, key)."""
    total = rows.count()
    most = -(-total // shards)
    members = stash(members_of(links, most, max(64, total // MOST_HOT)), "members")
    at = stash(members.select("row").distinct().withColumn("shard", _bucket(shards, F.lit(17), F.col("row"))), "at")
    for k in range(rounds):
        room = None
        if k % 2:
            every = at.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
            held = at.groupBy("shard").agg(F.count("*").alias("n"))
            room = every.join(held, "shard", "left").filter(F.coalesce("n", F.lit(0)) < most).select("shard")
        wanted = stash(wishes(members, at, room, k), "wanted")
        moves = stash(granted(wanted, at, most, k), "moves")
        moved, asked = moves.count(), wanted.count()  # of files, from their footers
        if moved:
            old, at = at, stash(at.join(moves, "row", "left").select("row", F.coalesce("b", "shard").alias("shard")), "at")
            drop(old)
        drop(wanted)
        drop(moves)
        if not asked or (not moved and k % 2):
            break
    drop(members)
    return at


def settle(rows: DataFrame, at: DataFrame, shards: int) -> DataFrame:
    """(row, shard, slot) of all rows: counts are at most one apart, slots are gapless from 0."""
    total = rows.count()
    bucket = _bucket(BUCKETS * 16, F.lit(29), F.col("row"))
    placed = rows.join(at, "row", "left").select("row", F.coalesce("shard", F.lit(-1)).alias("g"), bucket.alias("bucket"))
    placed = stash(placed, "placed")
    counts = placed.groupBy("g", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n")  # buckets of a shard: a fixed number
    starts = counts.select("g", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("g", "bucket").orderBy("row")) - 1
    ranked = placed.withColumn("within", within).join(starts, ["g", "bucket"]).select("row", "g", (F.col("within") + F.col("before")).alias("rank"))
    # a table of one row a shard: what it may hold, what it has, and the gaps before it
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("s"))
    sizes = every.join(counts.groupBy(F.col("g").alias("s")).agg(F.sum("n").alias("has")), "s", "left").fillna(0, ["has"])
    # the larger counts go to the fuller shards
    big = F.row_number().over(Window.orderBy(F.desc("has"), "s")) <= total % shards
    sizes = sizes.withColumn("may", F.lit(total // shards) + big.cast("int"))
    sizes = sizes.withColumns({"stays": F.least("has", "may"), "over": F.greatest(F.col("has") - F.col("may"), F.lit(0)), "gap": F.greatest(F.col("may") - F.col("has"), F.lit(0))})
    upto = Window.orderBy("s")
    sizes = sizes.withColumns({"over_before": F.sum("over").over(upto) - F.col("over"), "gap_before": F.sum("gap").over(upto) - F.col("gap")})
    known = sizes.orderBy("s").collect()  # one row a shard
    fields = ("s", "may", "stays", "over_before", "gap", "gap_before")
    t = F.array(*[F.struct(*[F.lit(r[f]).cast("long").alias(f) for f in fields]) for r in known])
    overs = F.lit(sum(r["over"] for r in known))
    own = F.get(t, F.col("g"))
    stays = (F.col("g") >= 0) & (F.col("rank") < own["stays"])
    filler = F.when(F.col("g") < 0, overs + F.col("rank")).otherwise(own["over_before"] + F.col("rank") - own["stays"])
    both = ranked.select("row", "g", "rank", stays.alias("keeps"), F.when(~stays, filler).alias("filler"))
    hole = F.element_at(F.filter(t, lambda x: (x["gap_before"] <= F.col("filler")) & (F.col("filler") < x["gap_before"] + x["gap"])), 1)
    both = both.withColumn("hole", F.when(~F.col("keeps"), hole))
    shard = F.when(F.col("keeps"), F.col("g")).otherwise(F.col("hole.s"))
    slot = F.when(F.col("keeps"), F.col("rank")).otherwise(F.col("hole.stays") + F.col("filler") - F.col("hole.gap_before"))
    return both.select("row", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, links: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; rows with equal texts are linked, and equal values of each of `links` too.

    links: columns of df; a null value links nothing."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = F.array(F.md5(body), *[F.when(c.isNotNull(), F.md5(F.concat_ws(":", F.lit(k), c.cast("string")))) for k, c in enumerate(links)])
    docs = df.select("doc_id", (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), keys.alias("keys"))
    docs = stash(docs.withColumn("row", F.monotonically_increasing_id()), "docs")
    rows = docs.select("row")
    at = propagate(rows, docs.select("row", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key")), shards, rounds)
    return docs.join(settle(rows, at, shards), "row").select("doc_id", "size", "text_crc32", "shard", "slot")


def op11(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
