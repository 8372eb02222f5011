"""Balanced label propagation: documents into shards of equal counts, linked ones together.

Links are memberships of documents in hubs (equal texts; an edge is a hub of two). Linked documents
start spread evenly. In each round every hub counts its members by shard and names the shard where
most of it could stand together, given the room there; members propose to go where their strongest
hub stands. Proposals are counted by source and target shard, and as many are admitted as leave no
shard above its quota when all of them move at once: places that movers leave count, so full shards
swap. Within a source and target, hubs come whole by hash. A hub larger than a shard's share is split
beforehand. Documents without links are placed last and fill every shard to its quota, so counts
differ by one at most, whatever the links. A round counts if fewer rows stand apart from most of
their hub after it; after one that does not, half of the hubs try any of their shards. Rounds end
when no row stands apart, after three rounds without a gain, or after ``rounds`` if given.

Only counts by pair of shards and quotas by shard leave the tasks; ranks are made of bucket counts
and ranks within small buckets. State is written after each round.

Defined cases. Null text: no link, size 16. Empty texts are equal texts. Null or repeated ids and
repeated rows: each row is placed. Columns besides doc_id and text are not looked at. Fewer rows
than shards: some shards stay empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlife.llm.storage import Workspace

IDLE = 3  # rounds without a gain after which propagation ends


def ranked(df: DataFrame, group: str, order: str, rows: int, name: str = "rank", bucket_rows: int = 4_000) -> DataFrame:
    """``df`` with its rank from 0 within ``group`` by ``order``, a column of well-spread longs; ties in any order.

    The high bits of ``order`` make buckets of about ``bucket_rows``; a rank is the count of the buckets before plus the rank in the bucket.
    """
    bits = max(1, min(40, (max(1, rows // bucket_rows)).bit_length()))
    df = df.withColumn("_bucket", F.shiftright(order, 64 - bits))
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(group, "_bucket", (F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(order)) - 1
    return df.withColumn("_inner", inner).join(before, [group, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_bucket", "_inner", "_before")


def admitted(asked: dict[int, int], free: list[int]) -> dict[int, int]:
    """How many of the ``asked`` moves by way (source * shards + target) go, so that no shard gains more than is ``free``.

    All go at first. A shard with too many refuses some, those first whose source has room to keep them.
    """
    shards = len(free)
    flow = np.zeros((shards, shards), np.int64)
    for way, n in asked.items():
        flow[divmod(way, shards)] = n
    over = flow.sum(0) - flow.sum(1) - np.array(free, np.int64)
    while (over > 0).any():
        t = int(over.argmax())
        need = int(over[t])
        back = np.minimum(flow[:, t], np.maximum(-over, 0))
        if back.sum() < need:
            left = flow[:, t] - back
            back += np.minimum(left, -(-left * (need - back.sum()) // max(1, left.sum())))
        back -= np.maximum(0, np.minimum(back, np.cumsum(back) - need))
        flow[:, t] -= back
        over += back
        over[t] -= need
    return {way: int(flow[divmod(way, shards)]) for way in asked}


def propagate(space: Workspace, rows: DataFrame, members: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """(row, shard) for ``rows(row, spot)`` and ``members(row, hub)``; spot: a well-spread long of its own for each row."""
    spark = space.spark
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    # Results by hub are written before they are joined, so that the join shuffles for itself and
    # adaptive execution can split a hub with many members.
    sizes = space.save(members.groupBy("hub").agg(F.count("*").alias("size")).where("size > 1"), "shared-hubs")
    fit = max(1, int(0.8 * (total // shards)))
    split = members.join(sizes, "hub").join(rows, "row").withColumn("parts", F.ceil(F.col("size") / fit))
    # spot mod 2**20 is as well spread as spot, and independent of the high bits that ranks use.
    split = split.withColumn("hub", F.xxhash64("hub", F.floor(F.pmod("spot", F.lit(1 << 20)) * F.col("parts") / (1 << 20))))
    members = space.save(split.select("row", "hub", "spot"), "members")
    sizes = space.save(members.groupBy("hub").agg(F.count("*").alias("size")), "hub-sizes")
    linked = space.save(members.select("row", "spot").distinct(), "linked")
    n_linked = linked.count()
    start = ranked(linked.withColumn("all", F.lit(0)), "all", "spot", n_linked)
    labels = space.save(start.select("row", "spot", F.pmod("rank", F.lit(shards)).cast("int").alias("shard")), "labels-0")
    kept, kept_counts, least, idle, step = labels, None, None, 0, 0
    while rounds is None or step < rounds:
        counts = space.save(members.join(labels.select("row", "shard"), "row").groupBy("hub", "shard").agg(F.count("*").alias("n")), f"counts-{step}")
        apart = counts.groupBy("hub").agg((F.sum("n") - F.max("n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if least is None or apart < least:
            kept, kept_counts, least, idle = labels, counts, apart, 0
        else:
            idle += 1
        if not least or idle == IDLE:
            break
        step += 1
        load = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a number for each shard
        free = [quota[s] - load.get(s, 0) for s in range(shards)]
        room = F.broadcast(spark.createDataFrame(list(enumerate(free)), "shard int, room long"))
        together = F.least("size", F.col("n") + F.col("room"))
        chance = F.xxhash64("hub", "shard", F.lit(step))
        if idle:  # half of the hubs try any of their shards
            together = F.when(F.pmod(F.xxhash64("hub", F.lit(step)), F.lit(2)) == 0, F.lit(0)).otherwise(together)
        rule = F.struct(together, F.when(together > 0, F.col("n")).otherwise(0), chance)
        best = kept_counts.join(sizes, "hub").join(room, "shard").groupBy("hub").agg(F.max_by(F.struct("shard", "n"), rule).alias("best"))
        best = space.save(best.select("hub", "best.shard", "best.n"), f"best-{step}")
        votes = members.join(best, "hub").groupBy("row").agg(F.max(F.struct("n", "hub", "shard")).alias("vote"))
        moves = kept.join(votes, "row").where(F.col("shard") != F.col("vote.shard"))
        moves = moves.select("row", F.xxhash64("vote.hub", F.lit(step)).alias("turn"), (F.col("shard") * shards + F.col("vote.shard")).alias("way"))
        moves = space.save(moves, f"moves-{step}")
        asked = {r["way"]: r["n"] for r in moves.groupBy("way").agg(F.count("*").alias("n")).collect()}  # at most shards * shards numbers
        let = [(way, n) for way, n in admitted(asked, free).items() if n]
        if not let:
            labels = kept
            continue
        let = F.broadcast(spark.createDataFrame(let, "way int, let long"))
        accepted = ranked(moves, "way", "turn", max(asked.values())).join(let, "way").where("rank < let").select("row", F.pmod("way", F.lit(shards)).alias("target"))
        labels = space.save(kept.join(accepted, "row", "left").select("row", "spot", F.coalesce("target", "shard").alias("shard")), f"labels-{step}")
    labels = kept if kept_counts is not None else labels
    load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, sum_ = [], 0
    for s in range(shards):
        sum_ += quota[s] - load.get(s, 0)
        ends.append(sum_)
    loose = rows.join(labels.select("row"), "row", "left_anti").withColumn("all", F.lit(0))
    loose = ranked(loose, "all", "spot", total - n_linked)
    below = F.array(*(F.lit(e).cast("long") for e in ends))
    filled = loose.select("row", F.size(F.filter(below, lambda e: e <= F.col("rank"))).alias("shard"))
    return labels.select("row", "shard").union(filled)


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): equal texts are linked; law ``rows``."""
    space = Workspace(docs.sparkSession, "sharding")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", size.alias("size"), crc.alias("text_crc32"), F.md5("text").alias("hub"))
    rows = space.save(rows.withColumn("spot", F.xxhash64("row")), "rows")
    placed = space.save(propagate(space, rows.select("row", "spot"), rows.where("hub is not null").select("row", "hub"), shards, rounds), "placed")
    out = ranked(rows.drop("hub").join(placed, "row"), "shard", "spot", -(-rows.count() // shards), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
