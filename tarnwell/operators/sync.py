"""Comparing a source with the index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.vectors import epoch_default_utc
from tarnwell.operators.ranking import latest_per_key, top_n


Keys = str | Sequence[str]


def _listed(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def latest_source(source: DataFrame, key: Keys = "doc_key") -> DataFrame:
    """Newest row per document key; the higher id wins equal times."""
    return latest_per_key(source, _listed(key), [F.desc("updated_at"), F.desc("id")])


def snapshot_diff(source: DataFrame, index: DataFrame, key: Keys = "doc_key", ts: str = "updated_at") -> DataFrame:
    """Label of every key of either side: new, updated (strictly newer), deleted or unchanged."""
    key = _listed(key)
    left = source.select(*key, epoch_default_utc(ts).alias("source_ts"))
    right = index.select(*key, epoch_default_utc(ts).alias("index_ts"))
    label = (
        F.when(F.col("index_ts").isNull(), "new").when(F.col("source_ts").isNull(), "deleted")
        .when(F.col("source_ts") > F.col("index_ts"), "updated").otherwise("unchanged")
    )
    return left.join(right, key, "full_outer").withColumn("label", label)


def purge_guard(diff: DataFrame, index: DataFrame, sampled: bool = False) -> DataFrame:
    """Drop the deletes of a sync that would remove every indexed row and write none."""
    if sampled:
        return diff.where(F.col("label") != "deleted")
    indexed = index.agg(F.count(F.lit(1)).alias("n")).scalar()
    removed = diff.agg(F.count_if(F.col("label") == "deleted").alias("n")).scalar()
    written = diff.agg(F.count_if(F.col("label").isin("new", "updated")).alias("n")).scalar()
    purge = (removed >= indexed) & (written == 0)
    return diff.where((F.col("label") != "deleted") | ~purge)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def preview(diff: DataFrame, n: int, key: str = "doc_key") -> DataFrame:
    return top_n(diff, ["label"], [F.asc(key)], n, "place")


def existing_keys(batch: DataFrame, index: DataFrame, key: Keys = "doc_key") -> DataFrame:
    """Every batch key with whether it is indexed and in which shard."""
    key = _listed(key)
    known = index.select(*key, F.col("shard_id").alias("existing_shard_id"))
    return batch.join(known, key, "left").withColumn("exists", F.col("existing_shard_id").isNotNull())


def usable_articles(docs: DataFrame, key: str = "doc_key", body: str = "content", max_chars: int | None = None) -> DataFrame:
    """Keyed documents with a cleaned, non-blank body; ``max_chars`` cuts bodies where a caller asks for it."""
    from tarnwell.functions.text import clean_content

    keyed = docs.where(F.coalesce(F.trim(F.col(key)), F.lit("")) != "")
    return keyed.withColumn(body, clean_content(body, max_chars)).where(F.trim(F.col(body)) != "")


def skipped_articles(docs: DataFrame, key: str = "doc_key", body: str = "content") -> DataFrame:
    """(reason, n): how many documents ``usable_articles`` leaves out, for want of a key or of a body; the key is asked for first."""
    from tarnwell.functions.text import clean_content

    no_key = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    no_body = F.trim(F.coalesce(clean_content(body), F.lit(""))) == ""
    reason = F.when(no_key, "key missing").when(no_body, "content missing")
    return docs.select(reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def article_outcome(batch: DataFrame, update_if_exists: bool = True) -> DataFrame:
    """Outcome and reason of every article, from its key, body, existence and extraction state."""
    key_missing = F.coalesce(F.trim("doc_key"), F.lit("")) == ""
    body_missing = F.coalesce(F.trim("content"), F.lit("")) == ""
    skip = F.col("exists") & F.lit(not update_if_exists)
    failed = F.col("error").isNotNull()
    outcome = (
        F.when(key_missing | body_missing, "failed").when(skip, "skipped").when(failed, "failed")
        .when(F.col("exists"), "updated").otherwise("inserted")
    )
    reason = (
        F.when(key_missing, "key missing").when(body_missing, "content missing")
        .when(skip, "exists and updates are off")
        .when(failed, F.concat(F.lit("failed at "), F.col("stage"), F.lit(": "), F.col("error")))
    )
    return batch.withColumn("outcome", outcome).withColumn("reason", reason)


def outcome_stats(outcomes: DataFrame) -> DataFrame:
    kinds = ["inserted", "updated", "skipped", "failed"]
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds]
    )
    return counts.withColumn("successful", F.col("inserted") + F.col("updated") + F.col("skipped"))


def trace_summary(trace: DataFrame) -> DataFrame:
    return trace.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped", "deleted")],
    )


def trace_details(trace: DataFrame) -> DataFrame:
    """Failed and skipped records per key, one row per distinct reason with its count."""
    bad = trace.where(F.col("status").isin("failed", "skipped"))
    return bad.groupBy("kbid", "status", "reason").agg(F.count(F.lit(1)).alias("n")).orderBy("kbid", "status", "reason")
