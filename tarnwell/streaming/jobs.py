"""Structured Streaming jobs over transcripts, sessions, calls, requests and source changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnwell.functions.jsonops import content_to_text
from tarnwell.operators.sessions import LATENCY_METRICS
from tarnwell.plans.index import run_sync
from tarnwell.plans.models import Extractor, local_extractor
from tarnwell.plans.state import commit_call_updates
from tarnwell.schemas import schema_of
from tarnwell.sources.sinks import current_note, read_current, replace_table
from tarnwell.sources.store import Store

TRANSCRIPT_OUT = schema_of(
    "call_id string, sequence_number long, event_type string, speaker string, content_text string, item_id string"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Numbering(StatefulProcessor):
    """Running number of the turns of a call, kept in state; a turn seen before is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", schema_of("n long"))
        self._seen = handle.getMapState("seen", schema_of("item_id string"), schema_of("n long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["turn", "item_id"])
        last = self._last.get()[0] if self._last.exists() else 0
        kept, numbers = [], []
        for item in batch["item_id"]:
            fresh = not self._seen.containsKey((item,))
            kept.append(fresh)
            if fresh:
                last += 1
                numbers.append(last)
                self._seen.updateValue((item,), (last,))
        self._last.update((last,))
        out = batch[kept].assign(sequence_number=numbers, event_type="message")
        yield out[["call_id", "sequence_number", "event_type", "speaker", "content_text", "item_id"]]

    def close(self) -> None:
        pass


def transcript_stream(items: DataFrame) -> DataFrame:
    """Sequenced message events of user and assistant turns.

    ``items``: call_id, item_id, turn, role, content. State is per call, so one call's turns of
    one micro-batch meet in one task; ``maxFilesPerTrigger`` on the source bounds them.
    """
    turns = items.where(F.col("role").isin("user", "assistant")).select(
        F.col("call_id").cast("string"), F.col("item_id").cast("string"), F.col("turn").cast("long"),
        F.col("role").alias("speaker"), content_to_text("content").alias("content_text"),
    )
    return turns.groupBy("call_id").transformWithStateInPandas(
        statefulProcessor=_Numbering(), outputStructType=TRANSCRIPT_OUT, outputMode="Append", timeMode="None"
    )


def session_rollup_stream(items: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Turn counts, latency figures and the last usage record per session.

    A session is closed by a gap without items and then emitted once. The watermark bounds the
    state; items later than it are dropped. ``items``: call_id, ts, seq, role, metrics map, usage.
    """
    timed = items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    number = {m: F.try_element_at("metrics", F.lit(m)).try_cast("double") for m in LATENCY_METRICS}
    figures = [
        agg(number[m]).alias(f"{m}_{name}")
        for m in LATENCY_METRICS
        for name, agg in (("count", F.count), ("avg", F.avg), ("max", F.max), ("min", F.min))
    ]
    return timed.groupBy("call_id", F.session_window("ts", gap).alias("w")).agg(
        F.count_if(F.col("role") == "user").alias("user_turn_count"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turn_count"),
        F.count("usage").alias("usage_update_count"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.struct("ts", "seq"))).alias("usage"),
        *figures,
    ).select(F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "*").drop("w")


def unique_requests(requests: DataFrame, key: list[str], ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Requests without the repeats that arrive within the watermark."""
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(key)


def table_stream(
    updates: DataFrame, root: str, schema: T.StructType, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str,
    partition_by: list[str] | None = None,
) -> DataStreamWriter:
    """Apply a batch job to a stored table for every micro-batch.

    ``step(current, batch)`` gives the next table. The pointer of the table names the run of the stream, which its
    checkpoint identifies, and the last batch of it that the table holds. So a batch that is tried again after a failure
    is not applied twice, also if it left the table empty, and a stream with a new checkpoint is read from its start:
    its batches are applied whatever their numbers are, so after the loss of a checkpoint ``step`` must bear replays.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        last = (current_note(spark, root) or "").rpartition(" ")
        if last[0] == run and int(last[2]) >= batch_id:
            return
        replace_table(step(read_current(spark, root, schema), batch), root, partition_by, note=f"{run} {batch_id}")

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def store_stream(updates: DataFrame, store: Store, step: Callable[[Store, DataFrame, str], object], checkpoint: str) -> DataStreamWriter:
    """Apply a committing job to a store for every micro-batch; one stream writes a store.

    ``step(store, batch, note)`` commits with the note given. The manifest so names the run of the stream and the last batch that
    the tables hold, and a batch that is tried again after a failure is not applied twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        own = replace(store, spark=spark)
        last = (own.snapshot().note or "").rpartition(" ")
        if last[0] == run and int(last[2]) >= batch_id:
            return
        step(own, batch, f"{run} {batch_id}")

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def call_update_stream(updates: DataFrame, store: Store, now: Column, checkpoint: str, order: str = "arrived") -> DataStreamWriter:
    """Call updates into the stored calls, batch by batch."""
    return store_stream(updates, store, lambda s, batch, note: commit_call_updates(s, batch, now, order, note), checkpoint)


def source_sync_stream(changes: DataFrame, store: Store, now: Column, checkpoint: str, extract: Extractor = local_extractor) -> DataStreamWriter:
    """A feed of changed and deleted source documents into the stored index, batch by batch."""
    return store_stream(changes, store, lambda s, batch, note: run_sync(s, batch, now, extract, partial=True, note=note), checkpoint)


def event_sink(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append stream events to parquet files exactly once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def run_available(writer: DataStreamWriter) -> None:
    """Process everything there is and stop."""
    writer.trigger(availableNow=True).start().awaitTermination()
