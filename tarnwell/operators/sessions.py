"""Per-session rollups of turns, latencies and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.vectors import duration_seconds
from tarnwell.operators.ranking import latest_per_key

# Latency metrics of a conversation item and number fields of a usage entry.
LATENCY_METRICS = [
    "e2e_latency", "llm_node_ttft", "tts_node_ttfb", "transcription_delay", "end_of_turn_delay", "on_user_turn_completed_delay",
]
USAGE_NUMBERS = [
    "input_tokens", "output_tokens", "input_cached_tokens", "input_text_tokens", "output_text_tokens",
    "input_audio_tokens", "output_audio_tokens", "characters_count", "audio_duration",
]


def turn_counts(items: DataFrame, call: str = "call_id") -> DataFrame:
    return items.groupBy(call).agg(
        F.count_if(F.col("role") == "user").alias("user_turn_count"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turn_count"),
    )


def latency_summary(items: DataFrame, call: str = "call_id", metrics: str = "metrics") -> DataFrame:
    """(call, metric, count, avg, max, min); values that are no numbers are left out.

    ``metrics`` is a map of text or number values.
    """
    wanted = F.transform(
        F.array(*[F.lit(m) for m in LATENCY_METRICS]),
        lambda m: F.struct(m.alias("metric"), F.try_element_at(F.col(metrics), m).try_cast("double").alias("value")),
    )
    rows = items.select(call, F.explode(wanted).alias("m")).select(call, "m.metric", "m.value").where(F.col("value").isNotNull())
    return rows.groupBy(call, "metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min")
    )


def usage_snapshot(usage: DataFrame, call: str = "call_id", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Last usage record of every call and how many there were."""
    return usage.groupBy(call).agg(
        F.max_by("usage", F.struct(ts, seq)).alias("usage"), F.count(F.lit(1)).alias("usage_update_count")
    )


def usage_entries(snapshots: DataFrame, call: str = "call_id", usage: str = "usage") -> DataFrame:
    """One row per model entry of a usage record, with its kinds and number fields.

    ``usage`` is JSON text with ``model_usage`` (or ``modelUsage``).
    """
    rows = snapshots.select(call, F.posexplode(_entries(usage)).alias("ord", "e"))
    return rows.select(call, "ord", _entry(F.col("e")).alias("e")).select(call, "ord", "e.*")


def _entries(usage: str) -> Column:
    parsed = F.try_parse_json(usage)
    return F.coalesce(
        F.try_variant_get(parsed, "$.model_usage", "array<map<string,variant>>"),
        F.try_variant_get(parsed, "$.modelUsage", "array<map<string,variant>>"),
    )


def _entry(e: Column) -> Column:
    """Model, kinds and numbers of one entry (a map of variants) of a usage record."""

    def text(*keys: str):
        return F.coalesce(*[F.nullif(F.try_variant_get(F.try_element_at(e, F.lit(k)), "$", "string"), F.lit("")) for k in keys])

    def has(*keys: str):
        return F.greatest(*[F.map_contains_key(e, k) for k in keys])

    kind = F.lower(F.coalesce(text("type", "usage_type", "kind"), F.lit("")))
    tts_marks = has("characters_count", "audio_duration")
    says_llm, says_tts = F.contains(kind, F.lit("llm")), F.contains(kind, F.lit("tts"))
    return F.struct(
        F.concat_ws(":", F.coalesce(text("provider"), F.lit("unknown")), F.coalesce(text("model"), F.lit("unknown"))).alias("model_key"),
        (says_llm | (~says_tts & ~tts_marks & has("input_tokens", "output_tokens", "input_cached_tokens"))).alias("is_llm"),
        (says_tts | tts_marks | (~says_llm & has("input_audio_tokens", "output_audio_tokens"))).alias("is_tts"),
        *[F.try_variant_get(F.try_element_at(e, F.lit(k)), "$", "double").alias(k) for k in USAGE_NUMBERS],
    )


def token_usage(usage: str, kind: str) -> Column:
    """Numbers by model of one usage record, as ``usage_by_model``, without rows of their own; null where the record is no usage."""
    entries = F.transform(_entries(usage), _entry)
    some = F.filter(entries, lambda e: e["is_llm" if kind == "llm" else "is_tts"] & F.coalesce(*[e[k] for k in USAGE_NUMBERS]).isNotNull())
    numbers = F.transform(some, lambda e: F.struct(e["model_key"], F.struct(*[e[k].alias(k) for k in USAGE_NUMBERS]).alias("numbers")))
    # Of a repeated model the last entry counts.
    last = F.filter(numbers, lambda e, i: ~F.exists(F.slice(numbers, i + 2, F.size(numbers)), lambda o: o["model_key"] == e["model_key"]))
    return F.map_from_entries(last)


def _counted(entries: DataFrame, kind: str) -> DataFrame:
    some = F.coalesce(*[F.col(k) for k in USAGE_NUMBERS]).isNotNull()
    return entries.where(F.col("is_llm" if kind == "llm" else "is_tts") & some)


def usage_by_model(entries: DataFrame, kind: str, call: str = "call_id") -> DataFrame:
    """Numbers per (call, model); the last entry of a repeated model is the one that counts."""
    return latest_per_key(_counted(entries, kind), [call, "model_key"], [F.desc("ord")]).select(call, "model_key", *USAGE_NUMBERS)


def usage_totals(entries: DataFrame, kind: str, call: str = "call_id") -> DataFrame:
    """Sums per call over all entries, repeated models included."""
    return _counted(entries, kind).groupBy(call).agg(*[F.sum(k).alias(k) for k in USAGE_NUMBERS])


def session_summary(items: DataFrame, sessions: DataFrame, call: str = "call_id") -> DataFrame:
    """One row per session: duration, turn counts and the latency figures that are reported."""
    lat = latency_summary(items, call)
    figures = lat.groupBy(call).agg(
        F.max(F.when(F.col("metric") == "e2e_latency", F.col("avg"))).alias("avg_e2e_latency_seconds"),
        F.max(F.when(F.col("metric") == "e2e_latency", F.col("max"))).alias("max_e2e_latency_seconds"),
        F.max(F.when(F.col("metric") == "llm_node_ttft", F.col("avg"))).alias("avg_llm_ttft_seconds"),
        F.max(F.when(F.col("metric") == "tts_node_ttfb", F.col("avg"))).alias("avg_tts_ttfb_seconds"),
    )
    return (
        sessions.withColumn("duration_seconds", duration_seconds("started_at", "ended_at"))
        .join(turn_counts(items, call), call, "left").join(figures, call, "left")
        .na.fill(0, ["user_turn_count", "assistant_turn_count"])
    )


def transcript_views(turns: DataFrame, role: str | None = None, call: str = "call_id", seq: str = "seq") -> DataFrame:
    """(call, seq, role, content) of all turns or of one role, in order."""
    rows = turns if role is None else turns.where(F.col("role") == role)
    return rows.select(call, seq, "role", "content").orderBy(call, seq)
