"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of slots. Each shard owns several virtual nodes; a row's slot is the hash of its doc_id,
and its home is the owner of the first node clockwise. No shard takes more than its capacity. All rows are placed in
rounds: in each round the rows without a place turn to the next other shard clockwise, and a shard with room for m
more takes the m first of them in the order of a hash of each row. After as many rounds as there are shards
every row has a place, since the capacities add up to the number of rows. The order of two rows never depends on other
rows, so another row moves few: those that it displaces, one after another, and those of shards whose capacity changed by one.

A round needs only one number per shard, the position up to which it accepts. These are found by counting in ever finer
intervals, so the driver sees a few thousand counts for any number of rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import dense_ranks, materialise, text_column
from tarnwell.llm.ordered import KEY_BITS, random_order_sums

#: Intervals that are counted at once, per shard.
INTERVALS = 1_024
#: Rows that are numbered in one task's window, on average.
RANK_ROWS = 20_000
#: The table of the ring may hold so many numbers at most; it is sent to every executor.
RING_ENTRIES = 4_000_000


def ring_table(shards: int, nodes: int) -> list[list[int]]:
    """For each slot of the ring, the shards in the order in which they come clockwise from it."""
    slots = 1 << max(6, math.ceil(math.log2(4 * shards * nodes)))
    if slots * shards > RING_ENTRIES:
        raise ValueError(f"a ring of {shards} shards with {nodes} virtual nodes each is too large to send to executors; use fewer nodes")
    taken: dict[int, int] = {}
    for node in range(nodes):
        for shard in range(shards):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{node}".encode()).digest()[:8], "big") * slots >> 64
            while at in taken:
                at = (at + 1) % slots
            taken[at] = shard
    points = sorted(taken)
    table = []
    for slot in range(slots):
        first, order = bisect.bisect_left(points, slot), []
        for k in range(len(points)):
            owner = taken[points[(first + k) % len(points)]]
            if owner not in order:
                order.append(owner)
                if len(order) == shards:
                    break
        table.append(order)
    return table


def ring_slot(key: Column, slots: int) -> Column:
    """The slot of a 64-bit key: its leading bits, so that a ring of more slots leaves keys at their place on the circle."""
    return F.shiftrightunsigned(key, 64 - (slots.bit_length() - 1)).cast("int")


def row_order() -> Column:
    """The place of a row among all: a hash of its doc_id, size, text and number among equal rows, from 0 to 2^60."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32", "copy", F.lit("order")), 64 - KEY_BITS)


def _placed(thresholds: list[list[int]]) -> Column:
    """The shard that has taken a row in the rounds so far; null if none has."""
    where = F.lit(None).cast("int")
    for k in reversed(range(len(thresholds))):
        limit = F.element_at(F.array(*[F.lit(int(t)).cast("long") for t in thresholds[k]]), F.col("prefs")[k] + 1)
        where = F.when(F.col("position") < limit, F.col("prefs")[k]).otherwise(where)
    return where


def bounded_ring_shards(docs: DataFrame, shards: int = 8, nodes: int = 64) -> DataFrame:
    """Shard and slot of every document; the numbers of rows of any two shards differ by one at most.

    Gives one row per input row: ``doc_id``, ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``shard`` (from 0),
    ``slot`` (gapless from 0 in its shard), ``home`` (the shard that the ring alone would choose). The key is the doc_id;
    equal texts may lie in different shards, as a group may be larger than a shard. A null text has size 1; a null doc_id
    is a key like any other. Rows that repeat in all of these are counted before they are shuffled and then dealt like
    others. An empty table gives no rows. Other columns are not read.
    """
    if shards < 1 or nodes < 1:
        raise ValueError("shards and nodes must be positive")
    spark = docs.sparkSession
    table = ring_table(shards, nodes)
    text = text_column(docs)
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", F.xxhash64("doc_id"))
    alike = materialise(alike, "ring-rows")
    total = int(alike.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"])

    # A position for every row, 0 to n - 1, in the order of a hash of the row alone.
    spread = alike.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    spread = spread.withColumn("order", row_order())
    ranked = random_order_sums(spread, [], ["order", "doc_id", "size", "text_crc32", "copy"], F.lit(1), total, "position")
    ring = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(table)), "array<array<int>>")).alias("ring_slot", "prefs"))
    placed = ranked.withColumn("ring_slot", ring_slot(F.col("key"), len(table))).join(F.broadcast(ring), "ring_slot")
    state = materialise(placed.select("doc_id", "size", "text_crc32", "position", "prefs"), "ring-positions")

    room = [total // shards + (s < total % shards) for s in range(shards)]
    thresholds: list[list[int]] = []
    for k in range(shards):
        asking = state.where(_placed(thresholds).isNull()).select("position", F.col("prefs")[k].alias("shard"))
        limits, taken = _acceptance(asking, room, total)
        if not sum(taken) and not any(room):
            break
        thresholds.append(limits)
        room = [r - t for r, t in zip(room, taken, strict=True)]
        if not any(room):
            break
    where = state.select("doc_id", "size", "text_crc32", "position", _placed(thresholds).alias("shard"), F.col("prefs")[0].alias("home")) if thresholds else state.select(
        "doc_id", "size", "text_crc32", "position", F.lit(0).alias("shard"), F.lit(0).alias("home")
    )
    width = max(1, RANK_ROWS * shards)
    slots = dense_ranks(where, ["shard"], F.floor(F.col("position") / width), [F.col("position")], "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot", "home")


def _acceptance(asking: DataFrame, room: list[int], total: int) -> tuple[list[int], list[int]]:
    """For each shard the position below which it accepts, and how many rows that gives it."""
    shards = len(room)
    low = [0] * shards  # all rows below are accepted
    taken = [0] * shards
    limits = [0 if not r else None for r in room]
    width = max(1, total)
    while any(x is None for x in limits):
        step = max(1, math.ceil(width / INTERVALS))
        open_shards = [s for s in range(shards) if limits[s] is None]
        base = F.element_at(F.array(*[F.lit(x).cast("long") for x in low]), F.col("shard") + 1)
        inside = asking.where(F.col("shard").isin(open_shards) & (F.col("position") >= base) & (F.col("position") < base + width))
        counts = inside.groupBy("shard", F.floor((F.col("position") - base) / step).alias("part")).count().collect()
        found = {(r["shard"], r["part"]): r["count"] for r in counts}
        parts = math.ceil(width / step)
        for s in open_shards:
            part = 0
            while part < parts and taken[s] + found.get((s, part), 0) <= room[s]:
                taken[s] += found.get((s, part), 0)
                part += 1
            low[s] += part * step
            if part == parts or step == 1 or taken[s] == room[s]:
                limits[s] = total if part == parts else low[s]
        width = step
    return limits, taken
