"""Shards by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of slots, never into shards.  The bytes of each slot are
summed, and a small map says which shard owns a slot.  Rebalancing edits the map: a new
version stores the moved slots only, everything else stays where it was.  The number of
slots is a parameter, so the map and all planning over it stay that small at any input size.

Law: ``bytes``, the shards' sizes are near equal (apart by at most about one slot).

Defined cases: a null text has size 1 and the checksum of the empty text; null ids are
hashed like any value; rows equal in id, size and checksum are counted before they are
shuffled and numbered, and each number is hashed for itself, so copies of one row spread
over all slots.  Texts of any length are one row, counted by their bytes.  Empty tables give empty results.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import stored

SLOTS = 4096
COPIES_A_STEP = 1024


def records(df: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, copy, virtual_slot), a row for each row of ``df``."""
    body = F.coalesce(F.col(text), F.lit(""))
    counted = (df.select(F.col(id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
               .groupBy("doc_id", "size", "text_crc32").count())
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / COPIES_A_STEP)))
    stepped = counted.select("*", step.alias("step"))
    first = F.col("step") * COPIES_A_STEP
    single = stepped.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, F.least(first + COPIES_A_STEP, F.col("count")) - 1)).alias("copy"))
    return single.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "copy"), F.lit(slots)))


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1, made before any size is known: slots dealt in turn."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def at_version(versions: DataFrame, version: int | None = None) -> DataFrame:
    """The map as of a version (the newest if not given): each slot's last entry up to it."""
    seen = versions if version is None else versions.where(F.col("version") <= version)
    return seen.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def rebalance(versions: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.0) -> DataFrame:
    """The edits that even the bytes out, as a new version: only slots that move.

    Slots are taken from the largest to the smallest.  A slot stays with its owner while that
    fits the equal share (times 1 + ``tolerance``), else it goes to the least loaded shard.
    """
    entry = F.struct((-F.coalesce("bytes", F.lit(0))).alias("less"), "virtual_slot", "shard")
    held = at_version(versions).join(sizes.select("virtual_slot", "bytes"), "virtual_slot", "left")
    one = held.agg(F.array_sort(F.collect_list(entry)).alias("slots"), (F.ceil(F.sum(F.coalesce("bytes", F.lit(0))) / shards * (1 + tolerance))).cast("long").alias("most"))

    def take(state, slot):
        weight = -slot["less"]
        owner = F.when((slot["shard"] < shards) & (F.get(state["loads"], slot["shard"]) + weight <= F.col("most")), slot["shard"]).otherwise(
            (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int"))
        loads = F.transform(state["loads"], lambda load, k: load + F.when(k == owner, weight).otherwise(F.lit(0).cast("long")))
        return F.struct(loads.alias("loads"), F.concat(state["owners"], F.array(owner)).alias("owners"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("owners"))
    owners = F.aggregate("slots", start, take)["owners"]
    moved = one.select(F.explode(F.arrays_zip(F.col("slots"), owners.alias("owner"))).alias("x")).select("x.slots.virtual_slot", "x.slots.shard", F.col("x.owner").alias("owner"))
    newest = versions.agg(F.max("version").alias("newest"))
    return (moved.where(F.col("owner") != F.col("shard")).join(F.broadcast(newest), how="cross")
            .select((F.col("newest") + 1).alias("version"), "virtual_slot", F.col("owner").alias("shard")))


def placed(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """``rows`` with their shard and a gapless position from 0 within it.

    A slot's rows follow those of the shard's smaller slots; only within one slot are rows sorted.
    """
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shard_map.join(counts, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "copy")
    ranked = rows.withColumn("at", F.row_number().over(within) - 1)
    return ranked.join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("before") + F.col("at")).drop("before", "at")  # a row for each slot, their number is a parameter


def shard(df: DataFrame, shards: int, slots: int = SLOTS, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with shard and position, and all versions of the map they follow (both stored)."""
    rows = stored(records(df, id, text, slots), "records")
    first = first_map(df.sparkSession, shards, slots)
    versions = stored(first.unionByName(rebalance(first, slot_sizes(rows), shards)), "shard_map")
    return placed(rows, at_version(versions)), versions
