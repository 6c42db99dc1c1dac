"""Fusing the vector and full-text signals of a query into one score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.functions.vectors import signal_count
from tarnwell.operators.ranking import minmax_norm
from tarnwell.settings import RETRIEVAL, RetrievalSettings

SIGNALS = ("vector_distance", "fts_keywords_rank", "fts_summaries_rank")
_FLAGS = [
    f"{signal}_{kind}_match" for signal in ("vector", "fts_keywords", "fts_summaries") for kind in ("exact", "phrase")
]
ATTRIBUTES = ("category", "article_type", "primary_topic")


def merge_signals(vector: DataFrame, keywords: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with every signal it has; the same rows a full outer join gives.

    The three inputs are stacked and grouped once, which costs one shuffle where two full
    outer joins would cost more. Attributes come from the first input that has the row, in
    the order vector, keywords, summaries; flags are combined with OR.
    """
    def shaped(df: DataFrame, order: int) -> DataFrame:
        have = set(df.columns)
        cols = [F.col(k) for k in keys]
        cols += [(F.col(s) if s in have else F.lit(None)).cast("double").alias(s) for s in SIGNALS]
        cols += [(F.col(f) if f in have else F.lit(False)).cast("boolean").alias(f) for f in _FLAGS]
        cols += [(F.col(a) if a in have else F.lit(None)).cast("string").alias(a) for a in ATTRIBUTES]
        return df.select(*cols, F.lit(order).alias("_order"))

    stacked = shaped(vector, 0).unionByName(shaped(keywords, 1)).unionByName(shaped(summaries, 2))
    aggregates = [
        F.min("vector_distance").alias("vector_distance"),
        F.max("fts_keywords_rank").alias("fts_keywords_rank"),
        F.max("fts_summaries_rank").alias("fts_summaries_rank"),
        *[F.max(f).alias(f) for f in _FLAGS],
        F.min_by(F.struct(*ATTRIBUTES), "_order").alias("_attributes"),
    ]
    merged = stacked.groupBy(*keys).agg(*aggregates)
    return merged.select("*", *[F.col(f"_attributes.{a}").alias(a) for a in ATTRIBUTES]).drop("_attributes")


def fuse_signals(
    vector: DataFrame,
    keywords: DataFrame,
    summaries: DataFrame,
    within: Sequence[str],
    doc: str = "kbid",
    settings: RetrievalSettings = RETRIEVAL,
) -> DataFrame:
    """Weighted sum of the min-max normalised signals with bonuses, per ``within`` keys."""
    s = settings
    merged = merge_signals(vector, keywords, summaries, [*within, doc])

    def part(signal: str, weight: float, lower: bool):
        return F.coalesce(minmax_norm(signal, within, lower), F.lit(0.0)) * F.lit(weight)

    count = signal_count(*SIGNALS)
    exact = F.greatest(*[F.col(f) for f in _FLAGS if "exact" in f])
    phrase = F.greatest(*[F.col(f) for f in _FLAGS if "phrase" in f])
    score = (
        part("vector_distance", s.vector_weight, True)
        + part("fts_keywords_rank", s.keyword_weight, False)
        + part("fts_summaries_rank", s.summary_weight, False)
        + (count - 1) * F.lit(s.extra_signal_bonus)
        + F.when(exact, F.lit(s.exact_bonus)).otherwise(0.0)
        + F.when(phrase, F.lit(s.phrase_bonus)).otherwise(0.0)
    )
    matched = F.filter(
        F.array(*[F.when(F.col(sig).isNotNull(), F.lit(name)) for sig, name in zip(SIGNALS, ("vector", "fts_keywords", "fts_summaries"))]),
        lambda x: x.isNotNull(),
    )
    return (
        merged.withColumn("rrf_score", score)
        .withColumn("signals", count)
        .withColumn("exact_match", exact)
        .withColumn("phrase_match", phrase)
        .withColumn("matched_in", matched)
    )


def select_candidates(
    scored: DataFrame, within: Sequence[str], doc: str = "kbid", score: str = "rrf_score",
    settings: RetrievalSettings = RETRIEVAL,
) -> DataFrame:
    """Keep the rows worth reranking, with ``position`` and ``mode`` (direct or rerank)."""
    s = settings
    span = W.partitionBy(*within)
    ordered = span.orderBy(F.desc(score), F.asc(doc))
    nth = lambda n: F.max(F.when(F.col("position") == n, F.col(score))).over(span)
    rows = (
        scored.withColumn("position", F.row_number().over(ordered))
        .withColumn("_n", F.count(F.lit(1)).over(span))
        .withColumn("_s1", nth(1))
        .withColumn("_s2", F.coalesce(nth(2), F.lit(0.0)))
        .withColumn("_s3", F.coalesce(nth(3), F.lit(0.0)))
    )
    direct = (
        (F.col("_n") == 1)
        | ((F.col("_s2") > 0) & (F.col("_s1") >= F.col("_s2") * s.auto_pick_ratio))
        | (F.col("_s1") - F.col("_s2") >= s.auto_pick_gap)
    )
    top_two = (F.col("_n") >= 3) & (F.col("_s3") > 0) & (F.col("_s2") >= F.col("_s3") * s.top2_ratio)
    kept = F.greatest(
        F.lit(s.min_candidates),
        F.least(
            F.lit(s.max_candidates),
            F.count_if(F.col(score) >= F.col("_s1") * s.keep_ratio).over(span),
        ),
    )
    limit = F.when(direct, F.lit(1)).when(top_two, F.lit(2)).otherwise(kept)
    return (
        rows.withColumn("mode", F.when(direct, F.lit("direct")).otherwise(F.lit("rerank")))
        .withColumn("_limit", limit)
        .where(F.col("position") <= F.col("_limit"))
        .drop("_n", "_s1", "_s2", "_s3", "_limit")
    )


def empty_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An absent signal: the key columns of ``df`` and no rows."""
    schema = T.StructType([df.schema[c] for c in columns])
    return df.sparkSession.createDataFrame([], schema)
