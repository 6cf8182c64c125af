"""Sharding by fixed virtual slots.

Records hash into thousands of slots that never change; the bytes of each slot are summed; a versioned
slot-to-shard map says where a slot lives, and rebalancing edits the map instead of rehashing records.
Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import shared_folder, stored

SLOTS = 4096
SHARDS = 24
SLOT_MAP = "virtual_slot int, shard int, bytes long, n long, version int"
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: A key of more rows than these, and than the mean of a slot, is hot.
HOT_ROWS = 1000


def slot_of(key: Column, row: Column, alone: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: from its key alone, or, where that doesn't do (a null or hot key), with the number of its row."""
    return F.pmod(F.when(alone, F.xxhash64(key)).otherwise(F.xxhash64(key, row)), F.lit(slots)).cast("int")


def hot_keys(rows: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """(key) of those that hold more rows than the mean of a slot, and HOT_ROWS: as many as slots at most."""
    least = F.greatest(F.lit(HOT_ROWS), F.lit(rows.count() / slots))
    return stored(rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > least).select(key), "hot-keys")


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot): a null text has no bytes and the checksum of an empty one.

    Rows are numbered when they are written, so that those without a key, and those of a hot one, are spread over all slots and stay where they are.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    rows = stored(rows, "records")
    hot = hot_keys(rows, key, slots).withColumn("_hot", F.lit(True))
    alone = F.col(key).isNotNull() & F.col("_hot").isNull()
    return rows.join(F.broadcast(hot), key, "left").select(key, "size", "text_crc32", slot_of(F.col(key), F.col("_row"), alone, slots).alias("virtual_slot"))


def slot_sizes(recs: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, n) of the slots that hold records: as many rows as slots at most."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def plan_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of a slot map: the largest slot first, each to the shard with the fewest bytes so far.

    (version, virtual_slot, shard, bytes, n). The fold runs over one array of at most SLOTS entries.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "virtual_slot", "n")))
    fold = f"""aggregate(s, named_struct('load', array_repeat(0L, {shards}), 'to', cast(array() as array<int>)),
        (acc, x) -> named_struct(
            'load', transform(acc.load, (l, i) -> if(i = array_position(acc.load, array_min(acc.load)) - 1, l - x.b, l)),
            'to', array_append(acc.to, cast(array_position(acc.load, array_min(acc.load)) - 1 as int))), acc -> acc.to)"""
    planned = sizes.agg(ordered.alias("s")).select("s", F.expr(fold).alias("to"))
    rows = planned.select(F.explode(F.arrays_zip("s", "to")).alias("r"))
    return rows.select(F.lit(1).alias("version"), "r.s.virtual_slot", F.col("r.to").alias("shard"), (-F.col("r.s.b")).alias("bytes"), "r.s.n")


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for `shards` shards: slots move only from shards over the new mean.

    In each shard, in order of slot, those that still fit under the mean stay; the rest fill the new shards by bytes, or, if
    there are none, the shards under the mean.
    """
    by_shard = Window.partitionBy("shard").orderBy("virtual_slot")
    total, last = slot_map.agg(F.sum("bytes"), F.max("shard")).first()
    mean, grows = (total or 0) / shards, last is not None and shards > last + 1
    marked = slot_map.withColumn("upto", F.sum("bytes").over(by_shard))
    stays = (F.col("upto") <= mean) & (F.col("shard") < shards)
    kept = marked.filter(stays)
    loads = F.broadcast(kept.groupBy("shard").agg(F.sum("bytes").alias("load")))
    room = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("to")).join(loads, F.col("to") == F.col("shard"), "left")
    room = room.select("to", F.greatest(F.lit(0.0), F.lit(mean) - F.coalesce("load", F.lit(0))).alias("room")).filter(F.col("to") > last if grows else F.lit(True))
    ends = Window.orderBy("to")  # as many rows as shards
    room = room.select("to", (F.sum("room").over(ends) - F.col("room")).alias("lo"), F.sum("room").over(ends).alias("hi"))
    free = room.agg(F.max("hi")).first()[0] or 0
    moved = marked.filter(~stays).withColumn("at", F.sum("bytes").over(Window.orderBy("virtual_slot")) - F.col("bytes") / 2)  # as many rows as slots
    moved = moved.withColumn("at", F.least("at", F.lit(free * 0.999999)))
    moved = moved.join(F.broadcast(room), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
    cols = [(F.col("version") + 1).alias("version"), "virtual_slot"]
    return kept.select(*cols, "shard", "bytes", "n").unionByName(moved.select(*cols, F.coalesce("to", F.lit(shards - 1)).alias("shard"), "bytes", "n"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored map; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest if none is named; a map without slots has no rows."""
    every = spark.read.schema(SLOT_MAP).parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0] or 0
    return every.filter(F.col("version") == version)


def assign(recs: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, virtual_slot, shard, slot, map_version): slot is the record's place in its shard, from 0.

    A place is the number of records in the shard's earlier slots (from the map) plus the rank in the own
    slot, so no window is wider than a virtual slot. Ties of the key are ordered by size and checksum.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("virtual_slot").orderBy(key, "size", "text_crc32")
    out = recs.withColumn("_rank", F.row_number().over(own)).join(F.broadcast(places), "virtual_slot")
    return out.select(key, "size", "text_crc32", "virtual_slot", "shard", (F.col("_base") + F.col("_rank") - 1).cast("bigint").alias("slot"), "map_version")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id", text: str = "text", grow_to: int | None = None) -> DataFrame:
    """Shards all of docs: see assign. Sizes are near equal, by the bytes of slots.

    With grow_to, version 2 of the map, rebalanced for so many shards, is stored too, and next_shard says where it puts each record.
    A null or empty text counts its overhead alone; null and hot keys are spread over all slots; repeated rows each have a
    place; no records give no rows; texts of any length count whole; columns other than key and text are left out, so names can't clash.
    """
    path = shared_folder(docs.sparkSession, "shard-map")
    recs = records(docs, key, text, slots)  # the texts are read once
    store_map(plan_map(slot_sizes(recs), shards), path)
    out = assign(recs, load_map(docs.sparkSession, path, 1), key)
    if grow_to is None:
        return out
    store_map(rebalance(load_map(docs.sparkSession, path, 1), grow_to), path)
    following = load_map(docs.sparkSession, path, 2).select("virtual_slot", F.col("shard").alias("next_shard"))
    return out.join(F.broadcast(following), "virtual_slot").select(*out.columns, "next_shard")  # a row a slot
