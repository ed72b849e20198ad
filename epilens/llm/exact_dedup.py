"""Exact deduplication over an extendible-hash index on shared files.

Native: DataFrame functions only. Texts are equal when identical after each
run of ASCII white space became one space; null counts as empty.

* Entries: one row per document with its 64-bit key hash and digest, and the
  distinct keys with their number of rows, are files in the shared folder.
* Directory: keys are counted by their leading bits. The directory doubles
  (one more bit) while a bucket holds more than `capacity` keys; a bucket then
  keeps the smallest depth at which it fits, so it owns a range of keys.
* Owner tasks: the texts of keys that occur more than once are collapsed where
  they are read and in one shuffle, looked up in the directory, and dealt by
  bucket. Its owner task walks each key's chain: texts of one key stand in
  order and are compared byte by byte; each new one is the next link. Keeper
  and size of a group are those of its link. A key that the directory doesn't
  lead to has no group.
* The index's groups go back to the entries by key, and by digest where a key
  has several links: broadcast if they are few, else the groups that hold most
  of the rows are broadcast and the others joined by shuffle.

Cases: null or empty text forms one group; a doc_id that is null is kept only
in groups without any number, and keep_id is null there; of rows that repeat
the smallest doc_id of their group one is kept; an empty table gives no rows;
other columns are ignored, of any type and name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epilens.llm.common import BROADCAST_ROWS, Scratch, intermediates, row_key

CAPACITY = 50_000
#: Directory bits up to which it is broadcast: 2**18 slots of 24 bytes.
BROADCAST_BITS = 18


def normalised(text: Column) -> Column:
    """White space runs as one space. A lone space needs no replacement."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _slot(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for each value of the leading bits of a key, and the number of bits.

    keys holds each key once. A bucket's number is the leading `depth` bits of its keys.
    """
    bits = max(1, math.ceil(math.log2(max(1, keys.count() / capacity))))
    while (keys.groupBy(_slot(bits)).count().agg(F.max("count")).first()[0] or 0) > capacity and bits < 63:
        bits += 1
    counts = keys.groupBy(_slot(bits).alias("slot")).agg(F.count("*").alias("n"))
    slots = keys.sparkSession.range(1 << bits).withColumnRenamed("id", "slot").join(counts, "slot", "left").fillna(0, ["n"])
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(slot, {bits} - depth)"))
    fits = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == bits))
    own = levels.select("slot", "depth", "bucket").join(fits, ["depth", "bucket"]).groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return own.select("slot", F.col("b.bucket").alias("bucket"), F.col("b.depth").alias("depth")), bits


def build_index(scratch: Scratch, source: DataFrame, keys: DataFrame, places: DataFrame, bits: int) -> DataFrame:
    """The links of the chains of keys with several rows: bucket, depth, key, chain, links, text_sha256, keep_id, group_size.

    source has doc_id, key and norm; links is the length of the key's chain.
    """
    several = scratch.table(keys.where("n > 1").select("key"), "several")
    if several.count() <= BROADCAST_ROWS:
        source = source.join(F.broadcast(several), "key", "left_semi")
    copies = source.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    placed = copies.withColumn("slot", _slot(bits)).join(F.broadcast(places) if bits <= BROADCAST_BITS else places, "slot")
    owned = placed.repartition(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    of_key = Window.partitionBy("bucket", "key")
    walk = of_key.orderBy("norm")
    new = F.lag("norm").over(walk).isNull() | (F.lag("norm").over(walk) != F.col("norm"))
    walked = owned.withColumn("new", new.cast("int")).withColumn("chain", F.sum("new").over(walk) - 1).withColumn("links", F.sum("new").over(of_key))
    index = walked.groupBy("bucket", "depth", "key", "chain", "links").agg(F.first(F.sha2("norm", 256)).alias("text_sha256"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return scratch.table(index, "index")


def _attach(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows with the columns of their group, if any, by key, and by digest where that is set."""

    def join(x: DataFrame, g: DataFrame, how: str) -> DataFrame:
        g = g.withColumnsRenamed({"key": "group_key", "digest": "group_digest"})
        on = (F.col("key") == F.col("group_key")) & (F.col("group_digest").isNull() | (F.col("group_digest") == F.col("text_sha256")))
        return x.join(g, on, how)

    if groups.count() <= BROADCAST_ROWS:
        return join(rows, F.broadcast(groups), "left").drop("group_key", "group_digest")
    # Fewer than 4 groups a partition can be this large.
    large = F.col("group_size") > total / (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot, cold = F.broadcast(groups.where(large)), groups.where(~large)
    rest = join(join(rows, hot.select("key", "digest"), "left_anti"), cold, "left")
    return join(rows, hot, "inner").unionByName(rest).drop("group_key", "group_digest")


def exact_groups(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, key, bucket, depth, chain.

    bucket, depth and chain are null for texts whose key no other row has.
    """
    scratch = Scratch(spark)
    source = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    entries = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.sha2("norm", 256).alias("text_sha256"))
    entries = scratch.table(entries, "entries")
    total = entries.count()
    keys = scratch.table(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    places, bits = directory(keys, capacity)
    index = build_index(scratch, source, keys, scratch.table(places, "directory"), bits)

    groups = index.select("key", F.when(F.col("links") > 1, F.col("text_sha256")).alias("digest"), "keep_id", "group_size", "bucket", "depth", "chain")
    found = _attach(entries, groups, total)
    # Rows that repeat the smallest doc_id of their group: the first of them stays.
    first = found.where("group_size > 1 and doc_id <=> keep_id").groupBy("key", F.col("text_sha256").alias("digest")).agg(F.min("row").alias("keep_row"), F.first("group_size").alias("group_size"), F.count("*").alias("n"))
    ties = scratch.table(first.where("n > 1").drop("n"), "ties")
    if ties.isEmpty():
        found = found.withColumn("keep_row", F.lit(None).cast("long"))
    else:
        found = _attach(found.withColumnRenamed("group_size", "size"), ties, total).drop("group_size").withColumnRenamed("size", "group_size")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True))).alias("kept"),
        "text_sha256",
        "key",
        "bucket",
        "depth",
        "chain",
    )


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns: one of each group of equal texts.

    It is the one with the smallest doc_id; rows that repeat it are compared by a hash of all columns.
    """
    scratch = Scratch(spark)
    with intermediates():
        groups = exact_groups(spark, docs).where("group_size > 1").groupBy("key", "text_sha256").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
        groups = scratch.table(groups.withColumnRenamed("text_sha256", "digest"), "groups")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    norm = normalised(F.col("text"))
    rows = docs.select(row.alias("doc"), row_key(docs).alias("doc_key"), F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("text_sha256"))
    found = _attach(rows, groups, groups.agg(F.sum("group_size")).first()[0] or 0)
    alone = found.where("group_size is null").select("doc.*")
    best = F.min_by("doc", "doc_key")
    chosen = found.where("group_size > 1 and doc.doc_id <=> keep_id").groupBy("key", "text_sha256").agg(best.alias("doc"))
    return alone.unionByName(chosen.select("doc.*"))
