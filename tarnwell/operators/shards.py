"""Bounded shards: filling free slots, opening new shards, releasing slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.functions.vectors import percentage
from tarnwell.operators.skew import ordered_positions
from tarnwell.settings import INDEX


def _block(position: Column, size: int) -> Column:
    return F.floor((position - 1) / F.lit(size))


def _slot_ranges(room: DataFrame, size: int) -> DataFrame:
    """(kb_collection_id, shard_id, slot_start, slot_end, _block): the positions that fill a shard's free slots, a row for each block touched."""
    by_shard = W.partitionBy("kb_collection_id").orderBy("shard_id")
    ends = room.where(F.col("free") > 0).withColumn("slot_end", F.sum("free").over(by_shard)).withColumn("slot_start", F.col("slot_end") - F.col("free") + 1)
    blocks = F.sequence(_block(F.col("slot_start"), size), _block(F.col("slot_end"), size))
    return ends.select("kb_collection_id", "shard_id", "slot_start", "slot_end", F.explode(blocks).alias("_block"))


def assign_shards(docs: DataFrame, registry: DataFrame, key: str = "doc_id", order_value=None, max_size: int = INDEX.shard_size) -> DataFrame:
    """Give every new document a shard: lowest shard with room first, then new shards.

    ``docs``: kb_collection_id and ``key`` (``order_value``: a number rising with the key, by
    default the key itself); ``registry``: kb_collection_id, shard_id, doc_count, max_shard_size.
    Only shards with room are kept in the running sum, full ones never reach it. Documents are numbered per collection in key order without gathering a collection in one
    task. Overflow shards follow by arithmetic, only the open slots need a join: a shard's slots
    are a range of positions, told once for each block of ``max_size`` positions that it touches, so a document meets the ranges of
    its block by an equi-join. What is joined has some two rows a shard with room, however many slots are free.
    """
    value = F.col(key).cast("double") if order_value is None else order_value
    placed = ordered_positions(docs, ["kb_collection_id"], [value, F.col(key)], value, "position")
    room = registry.withColumn("free", F.greatest(F.lit(0), F.col("max_shard_size") - F.col("doc_count")))
    slots = _slot_ranges(room, max_size)
    totals = room.groupBy("kb_collection_id").agg(
        F.sum("free").alias("total_free"), F.max("shard_id").alias("last_shard")
    )
    told = placed.join(totals, "kb_collection_id", "left").withColumn("_block", _block(F.col("position"), max_size)).alias("d")
    same = [F.col(f"d.{c}") == F.col(f"s.{c}") for c in ("kb_collection_id", "_block")] + [F.col("d.position").between(F.col("s.slot_start"), F.col("s.slot_end"))]
    joined = told.join(slots.alias("s"), same, "left").select("d.*", "s.shard_id").drop("_block")
    overflow = (
        F.coalesce(F.col("last_shard"), F.lit(-1)) + 1
        + F.floor((F.col("position") - F.coalesce("total_free", F.lit(0)) - 1) / F.lit(max_size))
    )
    return joined.withColumn("shard_id", F.coalesce(F.col("shard_id"), overflow).cast("int")).drop("total_free", "last_shard", "position")


def update_registry(registry: DataFrame, assigned: DataFrame, max_size: int = INDEX.shard_size) -> DataFrame:
    """Registry with the counts of the assigned documents added."""
    added = assigned.groupBy("kb_collection_id", "shard_id").agg(F.count(F.lit(1)).alias("_added"))
    return registry.join(added, ["kb_collection_id", "shard_id"], "full_outer").select(
        "kb_collection_id", "shard_id",
        (F.coalesce("doc_count", F.lit(0)) + F.coalesce("_added", F.lit(0))).alias("doc_count"),
        F.coalesce("max_shard_size", F.lit(max_size)).alias("max_shard_size"),
    )


def release_slots(registry: DataFrame, removed: DataFrame) -> DataFrame:
    """Registry with the counts of the removed documents taken off, never below zero."""
    gone = removed.groupBy("kb_collection_id", "shard_id").agg(F.count(F.lit(1)).alias("_gone"))
    return registry.join(gone, ["kb_collection_id", "shard_id"], "left").withColumn(
        "doc_count", F.greatest(F.lit(0), F.col("doc_count") - F.coalesce("_gone", F.lit(0)))
    ).drop("_gone")


def shard_utilisation(registry: DataFrame) -> DataFrame:
    return registry.select(
        "kb_collection_id", "shard_id", "doc_count", "max_shard_size",
        percentage("doc_count", "max_shard_size", 1).alias("utilisation_pct"),
    ).orderBy("kb_collection_id", "shard_id")


def shard_ids(registry: DataFrame) -> DataFrame:
    """Shard ids in order; the single shard 0 when there are none."""
    found = registry.select("shard_id").distinct()
    default = registry.sparkSession.range(1).select(F.lit(0).alias("shard_id"))
    missing = default.where(found.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)
    return found.unionByName(missing).orderBy("shard_id")
