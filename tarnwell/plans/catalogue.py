"""The catalogue of named items per shard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.jsonops import parse_items
from tarnwell.plans.models import extract_items

ITEM_ARRAY = "array<struct<item:string,purpose:string,method:string>>"


def consolidate_items(items: DataFrame, within: list[str], order: str = "ord") -> DataFrame:
    """One row per item name ignoring case: first spelling, longest purpose and method.

    ``items``: within, item, purpose, method and an ordinal. All folds are aggregates, so
    copies are combined before the shuffle.
    """
    pos = F.col(order)

    def longest(c: str):
        text = F.coalesce(F.col(c), F.lit(""))
        return F.min_by(text, F.struct((-F.length(text)).alias("n"), pos.alias("o"))).alias(c)

    named = items.where(F.trim("item") != "")
    return (
        named.groupBy(*within, F.lower("item").alias("item_key"))
        .agg(F.min_by("item", pos).alias("item"), longest("purpose"), longest("method"))
        .orderBy(*within, "item_key")
    )


def extraction_counts(results: DataFrame, within: list[str]) -> DataFrame:
    """``results``: within, doc_id, status and the exploded item (null when there is none)."""
    per_doc = F.struct("doc_id")
    return results.groupBy(*within).agg(
        F.count_distinct(per_doc).alias("records"),
        F.count_distinct(F.when(F.col("status") == "success", per_doc)).alias("success"),
        F.count_distinct(F.when(F.col("status") == "error", per_doc)).alias("errors"),
        F.count_distinct(F.when(F.col("status") != "invalid_json", per_doc)).alias("valid_json"),
        F.count_distinct(F.lower("item")).alias("unique_items"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """(keys, status, ord, item, purpose, method) of extraction responses; no item gives nulls."""
    parsed = responses.withColumn("_r", parse_items("response"))
    return parsed.select(
        *[c for c in responses.columns if c != "response"], F.col("_r.status").alias("status"), F.posexplode_outer("_r.items").alias("item_pos", "_i")
    ).select("*", "_i.item", "_i.purpose", "_i.method").drop("_i")


def catalogue_rows(items: DataFrame) -> DataFrame:
    """One JSON array of items per (collection, shard); a shard holds a bounded number of documents."""
    return items.groupBy("kb_collection_id", "shard_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("item", "purpose", "method")))).alias("data")
    )


def replace_scope(catalogue: DataFrame, fresh: DataFrame) -> DataFrame:
    """Catalogue with the rows of the fresh (collection, shard) keys replaced."""
    keys = ["kb_collection_id", "shard_id"]
    return catalogue.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def load_catalogue(scopes: DataFrame, unified: DataFrame, legacy: DataFrame) -> DataFrame:
    """Items of every scope: the unified table first, the older per-shard table as fallback."""
    joined = (
        scopes.join(unified.select("kb_collection_id", "shard_id", F.col("data").alias("_new")), ["kb_collection_id", "shard_id"], "left")
        .join(legacy.select("shard_id", F.col("data").alias("_old")), "shard_id", "left")
    )
    items = F.from_json(F.coalesce("_new", "_old", F.lit("[]")), ITEM_ARRAY)
    return joined.select("kb_collection_id", "shard_id", F.explode_outer(items).alias("_i")).select(
        "kb_collection_id", "shard_id", "_i.item", "_i.purpose", "_i.method"
    )


def build_catalogue(summaries: DataFrame, extract: Callable[[DataFrame], DataFrame] = extract_items) -> dict[str, DataFrame]:
    """Items of all shards in one job: extraction, folding, JSON rows and counts."""
    found = extract(summaries.select("kb_collection_id", "shard_id", "doc_id", F.concat_ws("\n\n", "summary", "content").alias("content")))
    # First seen follows document order, then the place in the text.
    ordered = found.withColumn("_seen", F.struct("doc_id", "ord"))
    for c in ("purpose", "method"):
        if c not in ordered.columns:
            ordered = ordered.withColumn(c, F.lit(""))
    items = consolidate_items(ordered, ["kb_collection_id", "shard_id"], "_seen")
    return {"items": items, "rows": catalogue_rows(items)}
