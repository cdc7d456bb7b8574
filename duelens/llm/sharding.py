"""Sharding through fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots for good. Only the bytes of each slot are counted, and a
map from slots to shards is made from them: the largest slot first, each to the shard that holds least. The
map is a small table with a version; growing or rebalancing edits it into the next version and
moves as few slots as it can. Records never have to be hashed anew.

A null text has no bytes; a record's size is its bytes plus one. Repeated rows hash alike and share a slot;
their places are interchangeable. Rows with a null id are hashed by their text. Empty tables give a map
all the same, since every slot is in it. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int")
    return measured.withColumn("virtual_slot", slot)


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, held): one row for each slot in use."""
    return rows.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("held")
    )


def _all_slots(spark: SparkSession, sizes: DataFrame, slots: int) -> DataFrame:
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sizes, "virtual_slot", "left").select(
        "virtual_slot",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("held", F.lit(0)).alias("held"),
    )


def _dealt(loose: Column, loads: Column) -> Column:
    """Slots of ``loose`` (bytes, virtual_slot), largest first, each to the least of ``loads``."""

    def step(state: Column, slot: Column) -> Column:
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        grown = F.transform(
            state["loads"], lambda held, i: held + F.when(i == least, slot["bytes"]).otherwise(0)
        )
        place = F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard"))
        return F.struct(
            grown.alias("loads"), F.concat(state["placed"], F.array(place)).alias("placed")
        )

    empty = F.expr("CAST(array() AS array<struct<virtual_slot:int,shard:int>>)")
    start = F.struct(loads.alias("loads"), empty.alias("placed"))
    return F.aggregate(
        F.reverse(F.sort_array(loose)), start, step, lambda state: state["placed"]
    )


def _spread(loose: DataFrame, loads: DataFrame, version: int) -> DataFrame:
    """Map rows for loose slots; both sides are one row each, bounded by the number of slots."""
    return (
        loose.join(loads, "one")
        .select(F.explode(_dealt(F.col("loose"), F.col("loads"))).alias("placed"))
        .select("placed.virtual_slot", "placed.shard", F.lit(version).alias("version"))
    )


def _one_row(rows: DataFrame, *columns: Column) -> DataFrame:
    return rows.agg(*columns).withColumn("one", F.lit(1))


def first_map(spark: SparkSession, sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, shard, version 1) for every slot."""
    loose = _one_row(
        _all_slots(spark, sizes, slots), F.collect_list(F.struct("bytes", "virtual_slot")).alias("loose")
    )
    loads = spark.range(1).select(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.lit(1).alias("one")
    )
    return _spread(loose, loads, 1)


def next_map(current: DataFrame, sizes: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The next version, for ``shards`` shards: only slots beyond a shard's fair share move.

    In each shard, slots are kept from the largest on as long as they fit the share; slots of
    shards that no longer exist all move. What is loose goes to the shards that hold least.
    """
    spark = current.sparkSession
    version = (current.agg(F.max("version")).first()[0] or 0) + 1
    known = _all_slots(spark, sizes, slots).join(
        current.select("virtual_slot", "shard"), "virtual_slot"
    )
    judged = known.selectExpr(
        "*",
        f"(sum(bytes) OVER () + {shards - 1}) DIV {shards} AS share",
        "sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, virtual_slot) AS filled",
    ).withColumn("stays", (F.col("shard") < shards) & (F.col("filled") <= F.col("share")))
    held = judged.where("stays")
    slot = F.struct("bytes", "virtual_slot")
    loose = _one_row(judged.where("NOT stays"), F.collect_list(slot).alias("loose"))
    by_shard = [
        F.coalesce(F.sum(F.when(F.col("shard") == n, F.col("bytes"))), F.lit(0)) for n in range(shards)
    ]
    loads = _one_row(held, F.array(*by_shard).alias("loads"))
    kept = held.select("virtual_slot", "shard", F.lit(version).alias("version"))
    return kept.unionByName(_spread(loose, loads, version))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; versions already there stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest if none is asked for."""
    kept = spark.read.parquet(path)
    if version is None:
        version = kept.agg(F.max("version")).first()[0]
    return kept.where(F.col("version") == version)


def placed(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with their shard and ``slot``, the place in the shard, gapless from 0.

    Places are counted within a virtual slot; the slots before it in the shard are added from their counts.
    """
    starts = sizes.join(slot_map, "virtual_slot").selectExpr(
        "virtual_slot",
        "shard",
        "version",
        "sum(held) OVER (PARTITION BY shard ORDER BY virtual_slot) - held AS before",
    )
    counted = rows.selectExpr(
        "*",
        "row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, size, text_crc32) - 1"
        " AS place",
    )
    return (
        counted.join(starts, "virtual_slot")
        .withColumn("slot", (F.col("before") + F.col("place")).cast("long"))
        .drop("before", "place")
    )
