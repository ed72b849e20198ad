"""Balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that stays in one shard. A partial partition is k
sums of bytes; differencing takes the two partial partitions of largest
spread and joins them in opposite order, largest with smallest.

Groups are dealt by the hash of their key into batches of about `batch`
groups; each batch is differenced in its own task down to one partial
partition. Those are differenced again, `FAN` at a time, until one is left.
Groups so large that they would unbalance a batch, more than 1/64 of a shard's
share, skip the batches and enter the last differencing one by one: there are
at most 64 for each shard. A group's shard is found by following its slot up
the levels.

A group with more than 1/k of all bytes makes its shard that large: it can't
be split by contract. The batches' tasks see one row per group, so a group
with a third of all rows is one item, summed in the map tasks.

Cases: null text has 0 bytes and forms a group with empty texts; repeated rows
are members of one group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.llm.common import Scratch

BATCH = 4096
FAN = 512
HEAVY = 64
ROW_BYTES = 16


def difference(parts: list[list[int]], k: int) -> np.ndarray:
    """The final slot of each slot of each part: parts[i] holds at most k sums, largest first.

    Returns an array of len(parts) x k, whose entry (i, j) is the slot where sum j of part i ends.
    Slot 0 is the largest of the result.
    """
    n = len(parts)
    where = np.zeros((n, k), np.int32)
    if not n:
        return where
    # Each live partition: sums, largest first, and for each slot the (part, slot) pairs in it.
    live: list[tuple[list[int], list[list[tuple[int, int]]]]] = []
    heap = []
    for i, sums in enumerate(parts):
        sums = [*sums, *[0] * (k - len(sums))]
        live.append((sums, [[(i, j)] for j in range(k)] if k == 1 or sums[1] else [[(i, 0)], *[[] for _ in range(k - 1)]]))
        heap.append((sums[-1] - sums[0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sa, ma), (sb, mb) = live[a], live[b]
        sums = [x + y for x, y in zip(sa, reversed(sb), strict=True)]
        members = []
        for x, y in zip(ma, reversed(mb), strict=True):
            big, small = (x, y) if len(x) >= len(y) else (y, x)
            big.extend(small)
            members.append(big)
        order = sorted(range(k), key=lambda j: -sums[j])
        live[a], live[b] = ([sums[j] for j in order], [members[j] for j in order]), None
        heapq.heappush(heap, (live[a][0][-1] - live[a][0][0], a))
    final = live[heap[0][1]][1]
    for slot, pairs in enumerate(final):
        for i, j in pairs:
            where[i, j] = slot
    return where


def _difference_items(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        slots = difference([[int(b)] for b in pdf["bytes"]], k)[:, 0]
        return pd.DataFrame({"batch": pdf["batch"], "key": pdf["key"], "bytes": pdf["bytes"], "slot": slots})

    return run


def _difference_parts(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for batch, own in pdf.groupby("batch", sort=True):
            own = own.sort_values(["bytes", "slot"], ascending=[False, True])
            parts.append((batch, own["slot"].tolist(), own["bytes"].tolist()))
        where = difference([p[2] for p in parts], k)
        rows = [(b, s, int(pdf["parent"].iloc[0]), int(where[i, j]), int(x)) for i, (b, slots, sums) in enumerate(parts) for j, (s, x) in enumerate(zip(slots, sums, strict=True))]
        return pd.DataFrame(rows, columns=["batch", "slot", "parent", "up", "bytes"])

    return run


def shard(spark: SparkSession, docs: DataFrame, shards: int = 40, batch: int = BATCH) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, group_key for every row; slots are gapless from 0 in a shard."""
    scratch = Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = scratch.table(rows, "rows")
    groups = scratch.table(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    n = max(1, math.ceil(total["n"] / batch))
    heavy = F.col("bytes") * (HEAVY * shards) > F.lit(total["bytes"] or 0)

    dealt = groups.where(~heavy).withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(n)))
    light = dealt.groupBy("batch").applyInPandas(_difference_items(shards), "batch long, key binary, bytes long, slot int")
    number = -F.row_number().over(Window.orderBy(F.desc("bytes"), "key")).cast("long")  # at most HEAVY * shards rows
    large = groups.where(heavy).select(number.alias("batch"), "key", "bytes", F.lit(0).alias("slot"))
    items = scratch.table(light.unionByName(large), "items")
    sums = items.where("batch >= 0").groupBy("batch", "slot").agg(F.sum("bytes").alias("bytes"))
    steps = items.select("batch", "slot").distinct().select(F.col("batch").alias("first"), F.col("slot").alias("first_slot"), "batch", "slot")
    single = items.where("batch < 0").select("batch", "slot", "bytes")
    schema = "batch long, slot int, parent long, up int, bytes long"
    while True:
        last = n <= FAN
        parts = sums.unionByName(single).withColumn("parent", F.lit(0).cast("long")) if last else sums.withColumn("parent", F.expr(f"batch div {FAN}"))
        up = scratch.table(parts.groupBy("parent").applyInPandas(_difference_parts(shards), schema), "level")
        moved = steps.join(up.drop("bytes"), ["batch", "slot"]).select("first", "first_slot", F.col("parent").alias("batch"), F.col("up").alias("slot"))
        if last:
            steps = moved
            break
        steps = moved.unionByName(steps.where("batch < 0"))
        sums = up.groupBy(F.col("parent").alias("batch"), F.col("up").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        n = math.ceil(n / FAN)
    steps = scratch.table(steps.select(F.col("first").alias("batch"), F.col("first_slot").alias("slot0"), F.col("slot").alias("shard")), "steps")
    places = scratch.table(items.withColumnRenamed("slot", "slot0").join(steps, ["batch", "slot0"]).select("key", "shard", (F.col("batch") < 0).alias("large")), "places")
    # The large groups are at most HEAVY * shards: their rows stay where they are.
    few = F.broadcast(places.where("large").drop("large"))
    placed = rows.join(few, "key").unionByName(rows.join(few, "key", "left_anti").join(places.where("not large").drop("large"), "key"))

    # Slots: rows of a shard are counted in chunks, so that no task numbers a whole shard.
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(max(1, math.ceil(rows.count() / (shards * 20_000))))))
    placed = scratch.table(placed, "placed")
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "key")) - 1)
    out = numbered.join(before, ["shard", "chunk"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lower(F.hex("key")).alias("group_key"))
