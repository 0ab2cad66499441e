"""Sharding by balanced label propagation over linked documents.

Documents that share a group (here: equal texts) are linked.  Rounds of joins move them
towards the shard where most of their group's bytes lie: votes are summed by (group, shard),
each linked document asks for the leading shard of its group that has room left, unless
more of the group is where it is, and a shard admits as much as its room allows, in the
order of a hash of the group, so members of a group move together and a group too large
for one shard fills one after the other.  After the rounds unlinked documents, and
only if they don't suffice linked ones, move from shards over their share to shards under
it.  Admission and balancing work on histograms of hash buckets: shards times buckets rows
reach the driver, whatever the input.

Cases.  Null text has no bytes and counts 1; null texts are one group, empty texts too.
Repeated rows are rows of one group, each with a place and slot of its own, so that they
too can fill several shards evenly.  A null doc_id is placed like others.  Very long texts weigh what they have; a shard may exceed its share by one
document at most if nothing smaller fits.  Extra columns are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS = 8
ROUNDS = 6
BUCKETS = 4096
#: Room over an even share that propagation may use before the final balancing.
EASE = 0.02


def by_label_propagation(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """``rows``: row (unique), key (hashed), group (null: unlinked), size -> the same and shard."""
    spark = rows.sparkSession
    state = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(shards)).cast("int"))
    state = common.materialise(state, "shard-start")
    total = state.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    linked = state.where(F.col("group").isNotNull())
    settled = state.where(F.col("group").isNull())
    for k in range(rounds):
        # written before they are joined, so that adaptive execution can split a large group
        votes = common.materialise(linked.groupBy("group", "shard").agg(F.sum("size").alias("votes")), f"shard-votes-{k}")
        loads = {r["shard"]: r["load"] for r in votes.groupBy("shard").agg(F.sum("votes").alias("load")).collect()}
        open_ = [i for i in range(shards) if loads.get(i, 0) < share * (1 + EASE / 2)]
        # the leading open shard of a group; ties go by a hash, which spreads them evenly
        best = F.struct("votes", F.xxhash64("group", "shard").alias("tie"), "shard")
        lead = votes.groupBy("group").agg(F.max(F.when(F.col("shard").isin(open_), best)).alias("lead"))
        # a row for each group and shard that has some of it, with the shard that leads
        rated = common.materialise(votes.withColumn("tie", F.xxhash64("group", "shard")).join(lead, "group"), f"shard-rated-{k}")
        rated = linked.join(rated.hint("merge"), ["group", "shard"])
        ahead = F.struct("votes", "tie") < F.struct(F.col("lead.votes").alias("votes"), F.col("lead.tie").alias("tie"))
        asked = rated.withColumn("goal", F.when(ahead, F.col("lead.shard")).otherwise(F.col("shard"))).drop("votes", "tie", "lead")
        bucket = F.pmod(F.xxhash64(F.lit(k), "group"), F.lit(BUCKETS)).cast("int")
        finer = F.pmod(F.xxhash64(F.lit(k), "key"), F.lit(BUCKETS)).cast("int")
        asked = common.materialise(asked.withColumn("bucket", bucket).withColumn("finer", finer), f"shard-ask-{k}")
        moving = asked.where("goal != shard")
        wishes = moving.groupBy("goal", "bucket").agg(F.sum("size").alias("size")).collect()
        if not wishes:
            break
        admitted, partly = [], []
        # unlinked documents can make room in the final balancing; the linked ones' own share is the bound
        kept = {r["shard"]: r["size"] for r in asked.where("goal = shard").groupBy("shard").agg(F.sum("size").alias("size")).collect()}
        for goal in range(shards):
            room = share * (1 + EASE) - kept.get(goal, 0)
            for r in sorted((r for r in wishes if r["goal"] == goal), key=lambda r: (r["size"], r["bucket"])):
                if r["size"] <= room:
                    admitted.append((goal, r["bucket"], BUCKETS))
                    room -= r["size"]
                elif room > 0:  # a group over the room: part of it, by the hash of its rows
                    partly.append((goal, r["bucket"], int(BUCKETS * room / r["size"])))
                    break
        allowed = common.local_frame(spark, admitted + partly, "goal int, bucket int, most int")  # shards * BUCKETS rows at most
        moved = asked.join(F.broadcast(allowed), ["goal", "bucket"], "left")
        goes = (F.col("goal") != F.col("shard")) & (F.col("finer") < F.coalesce("most", F.lit(0)))
        linked = common.materialise(moved.select("row", "key", "group", "size", F.when(goes, F.col("goal")).otherwise(F.col("shard")).alias("shard")), f"shard-{k}")
    return balance(settled.select("row", "key", "group", "size", "shard").unionByName(linked.select("row", "key", "group", "size", "shard")), shards)


def balance(state: DataFrame, shards: int) -> DataFrame:
    """Even out bytes: buckets of unlinked documents leave shards over their share, then whole groups, then parts of groups."""
    spark = state.sparkSession
    by_key, by_group = F.xxhash64(F.lit(1), "key"), F.xxhash64(F.lit(2), "group")
    free = F.col("group").isNull()
    passes = ((F.when(free, by_key), BUCKETS), (F.when(free, by_key), 4 * BUCKETS), (F.when(~free, by_group), BUCKETS), (by_key, BUCKETS))
    for k, (dealt, width) in enumerate(passes):
        bucketed = state.withColumn("bucket", F.pmod(dealt, F.lit(width)).cast("int"))
        cells = bucketed.groupBy("shard", "bucket").agg(F.sum("size").alias("size")).collect()  # shards * (width + 1) rows at most
        loads = dict.fromkeys(range(shards), 0)
        for r in cells:
            loads[r["shard"]] += r["size"]
        share = sum(loads.values()) / shards
        moves: list[tuple] = []
        for r in sorted((r for r in cells if r["bucket"] is not None), key=lambda r: (-r["size"], r["shard"], r["bucket"])):
            over = loads[r["shard"]] - share
            goal = min(loads, key=lambda s: (loads[s], s))
            # a bucket moves if that leaves the two shards nearer to each other than before
            if over > 0 and loads[goal] < share and r["size"] <= min(over, share - loads[goal]) * 1.02 + 1:
                loads[r["shard"]] -= r["size"]
                loads[goal] += r["size"]
                moves.append((r["shard"], r["bucket"], goal))
        if moves:
            plan = common.local_frame(spark, moves, "shard int, bucket int, goal int")
            moved = bucketed.join(F.broadcast(plan), ["shard", "bucket"], "left")
            state = common.materialise(moved.select("row", "key", "group", "size", F.coalesce("goal", "shard").alias("shard")), "shard-balanced")
        # links are cut for balance only where unlinked documents and whole groups leave shards over a percent apart
        if max(abs(x - share) for x in loads.values()) <= max(1.0, (0.001 if k == 0 else 0.01) * share):
            return state
    return state


def slots(state: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, by hash buckets, so no shard is sorted in one task."""
    spark = state.sparkSession
    bucketed = state.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(BUCKETS)).cast("int"))
    counts = bucketed.groupBy("shard", "bucket").count().collect()  # shards * BUCKETS rows at most
    first, offsets = {}, []
    for r in sorted(counts, key=lambda r: (r["shard"], r["bucket"])):
        offsets.append((r["shard"], r["bucket"], first.get(r["shard"], 0)))
        first[r["shard"]] = first.get(r["shard"], 0) + r["count"]
    numbered = bucketed.withColumn("nth", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "row")) - 1)
    at = common.local_frame(spark, offsets, "shard int, bucket int, before long")
    return numbered.join(F.broadcast(at), ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("nth")).cast("long")).drop("bucket", "nth", "before")


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (row, key, ...) with keys of their own for rows that share one.

    Rows of one key are numbered within blocks of row numbers, after the rows of the blocks before: no
    task holds all rows of a key.  Which of them gets which number is open, the set of new keys is not.
    """
    shared = common.materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shard-shared")
    if shared.isEmpty():
        return rows
    joined = common.materialise(rows.join(shared.withColumn("shared", F.lit(True)).hint("merge"), "key", "left"), "shard-alike")
    alike = joined.where("shared").withColumn("block", F.shiftright("row", 16))
    counts = common.materialise(alike.groupBy("key", "block").agg(F.count("*").alias("n")), "shard-blocks")
    before = counts.select("key", "block", (F.sum("n").over(W.partitionBy("key").orderBy("block")) - F.col("n")).alias("before"))
    nth = F.row_number().over(W.partitionBy("key", "block").orderBy("row")) - 1
    numbered = alike.withColumn("nth", nth).join(before.hint("merge"), ["key", "block"])
    apart = numbered.withColumn("key", F.xxhash64("key", F.col("before") + F.col("nth")))
    return joined.where("shared IS NULL").select(*rows.columns).unionByName(apart.select(*rows.columns))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shards of ``docs`` (doc_id, text), equal texts linked, bytes even.

    Returns doc_id, size, text_crc32, shard, slot; one row per row.
    """
    body = F.encode(F.col("text").cast("string"), "UTF-8")
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b"")).alias("text_key"),
    )
    # Placement hashes doc_id and text, which a rerun repeats, and the number of a row among rows alike in both.
    small = common.materialise(small, "shard-rows")
    counts = small.groupBy("text_key").agg(F.count("*").alias("n"))
    # written before it is joined, so that adaptive execution can split a large group of copies
    linked = common.materialise(counts.where("n > 1").select("text_key", F.xxhash64("text_key").alias("group")), "shard-linked")
    keyed = small.join(linked.hint("merge"), "text_key", "left").withColumn("row", F.monotonically_increasing_id())
    keyed = common.materialise(keyed.select("row", "doc_id", "size", "text_crc32", "group"), "shard-keyed")
    placed = by_label_propagation(told_apart(keyed.select("row", F.xxhash64("doc_id", "text_crc32").alias("key"), "group", "size")), shards, rounds)
    numbered = slots(placed).select("row", "shard", "slot")
    return keyed.join(numbered.hint("merge"), "row").select("doc_id", "size", "text_crc32", "shard", "slot")
