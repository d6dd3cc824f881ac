"""Sharding by fixed virtual slots.

A record goes to one of ``SLOTS`` virtual slots by the hash of its text, so equal texts share a
slot and a shard. A text whose copies weigh more than half a mean shard is spread over the slots
by doc_id. A versioned map sends slots to shards; to rebalance is to edit the map, so that only
the records of moved slots move.

A null text weighs one byte, as an empty one does, and both are equal texts. Rows without doc_id
and repeated rows are records of their own. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyfield.llm.common import id_hash, running_total, text_of
from eddyfield.session import new_path, settle

SLOTS = 4096
SHARDS = 8
TOLERANCE = 0.0005  # of a mean shard; slots stay where they are within it


def records(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), one row per document."""
    rows = settle(
        docs.select(
            "doc_id",
            (F.octet_length(text_of()) + 1).cast("long").alias("size"),
            F.crc32(text_of()).alias("text_crc32"),
            F.xxhash64(text_of()).alias("text_hash"),
        ),
        "records",
    )
    # at most 2 * shards texts can weigh that much: a broadcast of proven size
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("group_bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    heavy = groups.filter(F.col("group_bytes") > total / (2 * shards)).select("text_hash", F.lit(True).alias("heavy"))
    spread = F.when(F.col("heavy"), F.xxhash64("text_hash", "doc_id")).otherwise(F.col("text_hash"))
    return rows.join(F.broadcast(heavy), "text_hash", "left").select(
        "doc_id", "size", "text_crc32", F.pmod(spread, F.lit(SLOTS)).cast("int").alias("virtual_slot")
    )


def edit_map(slot_bytes: DataFrame, old: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot map (version, virtual_slot, shard).

    ``slot_bytes`` has (virtual_slot, bytes), ``old`` one version of the map, empty at the start.
    Slots are visited from heavy to light: one without a shard, or on a shard that is gone, goes
    to the lightest shard; one on a shard above the mean moves to the lightest if it fits below
    the mean there. Both tables have at most ``SLOTS`` rows, and so the visit is one fold.
    """
    known = old.select(F.col("virtual_slot").alias("s"), F.when(F.col("shard") < shards, F.col("shard")).alias("was"), "version")
    every = slot_bytes.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("virtual_slot"))
    slots = (
        every.join(slot_bytes, "virtual_slot", "left")
        .join(known, F.col("virtual_slot") == F.col("s"), "left")
        .select(F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"), "virtual_slot", "was", "version")
    )
    folded = slots.agg(
        F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "was")), asc=False).alias("slots"),
        F.sum("bytes").alias("total"),
        (F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"),
    ).withColumn(
        "start",
        F.expr(
            f"transform(sequence(0, {shards - 1}), i -> "
            "aggregate(slots, 0L, (sum, s) -> sum + if(s.was <=> i, s.bytes, 0L)))"
        ),
    )
    lightest = "cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)"
    limit = f"(total / {float(shards)} * {1 + TOLERANCE})"
    moves = f"s.was is null or (acc.loads[s.was] > {limit} and array_min(acc.loads) + s.bytes <= {limit})"
    fold = f"""
    aggregate(slots,
      named_struct('loads', start, 'placed', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
      (acc, s) -> if({moves},
        named_struct(
          'loads', transform(acc.loads, (b, i) -> b + if(i = {lightest}, s.bytes, 0L) - if(s.was <=> i, s.bytes, 0L)),
          'placed', array_append(acc.placed, named_struct('virtual_slot', s.virtual_slot, 'shard', {lightest}))),
        named_struct(
          'loads', acc.loads,
          'placed', array_append(acc.placed, named_struct('virtual_slot', s.virtual_slot, 'shard', s.was)))))
    """
    return folded.select("version", F.inline(F.expr(f"({fold}).placed")))


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the map stored at ``path``."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("version").alias("v")).first()["v"]
    return stored.filter(F.col("version") == newest)


def rebalance(rows: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Store the next version of the map at ``path`` by the bytes that ``rows`` now have per slot."""
    spark = rows.sparkSession
    schema = "version int, virtual_slot int, shard int"
    try:
        old = latest(spark, path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = spark.createDataFrame([], schema)
    slot_bytes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    new = edit_map(slot_bytes, old, shards).select(F.col("version").cast("int"), "virtual_slot", "shard")
    new.write.mode("append").parquet(path)
    return latest(spark, path)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with shard and ``slot``: the place within the shard, gapless from 0. The map has
    at most ``SLOTS`` rows: a broadcast of proven size."""
    placed = rows.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot")
    placed = placed.withColumn("_order", id_hash(F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    return running_total(placed, "shard", "_order", F.lit(1), "slot").drop("_order")


def assign(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot), one row per document."""
    rows = records(docs, shards)
    slot_map = rebalance(rows, path or new_path(docs.sparkSession, "slot_map"), shards)
    return place(rows, slot_map)
