"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's key hashes to one of ``SLOTS`` virtual slots for ever.  The map gives
each slot a shard; it is built from the bytes per slot (largest slot first, to the
shard with least bytes), stored with a version, and only edited afterwards: a
rebalance moves as few slots as needed and writes the next version.

Only DataFrame and SQL functions are used.  What is gathered in one row is the
list of slots, whose number is fixed, never records.

Defined cases: a null or empty text has size 8; a null id takes the slot of its
text; repeated rows share a slot and get consecutive places; an empty table gives
an empty map and no rows; other columns are carried along, and columns named like
the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stellwerk.llm.common import fresh_folder

SLOTS = 8192
OVERHEAD = 8  # bytes that a record costs besides its text
ADDED = ("virtual_slot", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "map_version")


def _slot(id_column: str, text_column: str) -> F.Column:
    key = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.col(text_column), F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % SLOTS).cast("int")


def with_slots(records: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``virtual_slot`` and ``size`` (UTF-8 bytes of the text and the overhead)."""
    return records.drop(*ADDED).withColumns(
        {
            "virtual_slot": _slot(id_column, text_column),
            "size": F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + OVERHEAD,
        }
    )


def slot_sizes(slotted: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _dealt(slots: F.Column, loads: F.Column) -> F.Column:
    """Fold over slots, largest first: each goes to the shard with least bytes so far."""
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<int>)").alias("shards"))

    def give(state, slot):
        target = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: load + F.when(i == target, slot["bytes"]).otherwise(F.lit(0))).alias("loads"),
            F.concat(state["shards"], F.array(target)).alias("shards"),
        )

    return F.aggregate(slots, start, give, lambda state: state["shards"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: (version, virtual_slot, shard, bytes, rows) of every slot that has records."""
    listed = sizes.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "rows"))).alias("slots")
    )
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    return (
        listed.select("slots", _dealt(F.col("slots"), loads).alias("shards"))
        .select(F.explode(F.arrays_zip("slots", "shards")).alias("z"))
        .select(
            F.lit(1).alias("version"),
            F.col("z.slots.virtual_slot").alias("virtual_slot"),
            F.col("z.shards").alias("shard"),
            F.col("z.slots.bytes").alias("bytes"),
            F.col("z.slots.rows").alias("rows"),
        )
    )


def grown_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """Next version for more shards: slots only move into the new ones.

    Each old shard gives its smallest slots away as long as it keeps at least an
    equal share; the moved slots are dealt to the new shards, largest first.
    """
    held = slot_map.agg(F.max("shard").alias("top"), F.sum("bytes").alias("all"), F.max("version").alias("old")).first()
    if held.top is None or held.top >= shards - 1:
        return slot_map.withColumn("version", F.col("version") + 1)
    order = Window.partitionBy("shard").orderBy("bytes", "virtual_slot")
    ranked = (
        slot_map.withColumn("given", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("own", F.sum("bytes").over(Window.partitionBy("shard")))
        .withColumn("moves", F.col("own") - F.col("given") >= held["all"] / shards)
    )
    version = F.lit(held.old + 1).alias("version")
    stay = ranked.where(~F.col("moves")).select(version, "virtual_slot", "shard", "bytes", "rows")
    listed = ranked.where("moves").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes", "rows"))).alias("slots")
    )
    loads = F.array_repeat(F.lit(0).cast("long"), shards - 1 - held.top)
    moved = (
        listed.select("slots", _dealt(F.col("slots"), loads).alias("shards"))
        .select(F.explode(F.arrays_zip("slots", "shards")).alias("z"))
        .select(
            version,
            F.col("z.slots.virtual_slot").alias("virtual_slot"),
            (held.top + 1 + F.col("z.shards")).cast("int").alias("shard"),
            F.col("z.slots.bytes").alias("bytes"),
            F.col("z.slots.rows").alias("rows"),
        )
    )
    return stay.unionByName(moved)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append one version to the stored map; at most ``SLOTS`` rows."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, by default the newest."""
    stored = spark.read.schema("virtual_slot INT, shard INT, bytes LONG, rows LONG, version INT").parquet(path)
    wanted = F.lit(version) if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == wanted)


def assign(slotted: DataFrame, slot_map: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    Places are counted within virtual slots and moved by the rows of the shard's
    earlier slots, so no task ever holds a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"), F.col("version").alias("map_version")
    )
    within = Window.partitionBy("virtual_slot").orderBy(id_column, "size", "text_crc32")
    return (
        slotted.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(placed), "virtual_slot")  # at most SLOTS rows
        .withColumn("slot", (F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_before", "_place")
    )


def shard_documents(documents: DataFrame, shards: int, path: str | None = None) -> DataFrame:
    """Documents with size, text_crc32, law, shard and place; the map is stored at ``path``."""
    spark = documents.sparkSession
    path = path or fresh_folder(spark, "slot-map")
    slotted = with_slots(documents).withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    save_map(first_map(slot_sizes(with_slots(documents)), shards), path)
    narrow = slotted.drop("text")
    return assign(narrow, load_map(spark, path, 1)).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )
