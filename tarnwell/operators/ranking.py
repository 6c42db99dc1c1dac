"""Latest row per key, top-k, normalisation and rank comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell.functions.text import ColumnLike, col
from tarnwell.operators.skew import ordered_positions
from tarnwell.settings import RETRIEVAL


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    Spark limits every input partition to one row per key before the shuffle, so a hot
    key sends one row per partition.
    """
    by_key = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(by_key)).where(F.col("_rn") == 1).drop("_rn")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | str, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key; ``n`` is a number or a column constant within the key."""
    name = rank or "_rn"
    bound = F.col(n) if isinstance(n, str) else F.lit(n)
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= bound)
    return out if rank else out.drop(name)


def search_limit(top_k: ColumnLike, category: ColumnLike, oversample: int = RETRIEVAL.oversample,
                 category_factor: int = RETRIEVAL.category_oversample) -> Column:
    """Rows fetched before boosting: more when a category will reorder them."""
    wanted = F.lower(F.trim(F.coalesce(col(category), F.lit(""))))
    factor = F.when(wanted.isin("", "both"), F.lit(1)).otherwise(F.lit(category_factor))
    return (col(top_k) * F.lit(oversample) * factor).cast("int")


def group_top_k(group: ColumnLike, top_k: ColumnLike | int, factor: int = RETRIEVAL.phrase_group_factor) -> Column:
    """Phrases and acronyms search twice as deep."""
    base = F.lit(top_k) if isinstance(top_k, int) else col(top_k)
    return F.when(col(group).isin("search_phrases", "acronyms"), base * F.lit(factor)).otherwise(base).cast("int")


def minmax_norm(value: ColumnLike, keys: Sequence[str], lower_is_better: bool = False) -> Column:
    """Value scaled to 0..1 within the keys; 1.0 when all are equal, null stays null."""
    span = W.partitionBy(*keys)
    low, high = F.min(col(value)).over(span), F.max(col(value)).over(span)
    share = (col(value) - low) / (high - low)
    scaled = (F.lit(1.0) - share) if lower_is_better else share
    return F.when(col(value).isNull(), F.lit(None).cast("double")).when(high == low, F.lit(1.0)).otherwise(scaled)


def best_per_doc(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], smallest: bool) -> DataFrame:
    """Row with the best value per key, ties by ``tie``; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    score = F.col(value) if smallest else -F.col(value)
    picked = F.min_by(F.struct(*rest), F.struct(score.alias("_s"), *tie))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*")


def winner_gap(scores: DataFrame, keys: Sequence[str], doc: str, score: str, winner: str | None = None) -> DataFrame:
    """One row per key: winner, its score, the best other score and the gap.

    ``winner`` names a column with the chosen document; without it the best score wins.
    """
    rows = scores
    if winner is None:
        rows = rows.withColumn("_winner", F.first(doc).over(W.partitionBy(*keys).orderBy(F.desc(score), doc)))
    else:
        rows = rows.withColumn("_winner", F.col(winner))
    is_winner = F.col(doc) == F.col("_winner")
    out = rows.groupBy(*keys, F.col("_winner").alias("winner")).agg(
        F.coalesce(F.max(F.when(is_winner, F.col(score))), F.lit(0.0)).alias("winner_score"),
        F.coalesce(F.max(F.when(~is_winner, F.col(score))), F.lit(0.0)).alias("runner_up_score"),
    )
    gap = F.greatest(F.lit(0.0), F.col("winner_score") - F.col("runner_up_score"))
    return out.withColumn("score_gap", gap).withColumn(
        "margin", F.when(F.col("winner_score") > 0, gap / F.greatest(F.col("winner_score"), F.lit(1e-6))).otherwise(0.0)
    )


def rank_compare(df: DataFrame, keys: Sequence[str], doc: str, first: str, second: str, top: int) -> DataFrame:
    """Rank by one score beside the rank by another, for the top of the first."""
    by_first = W.partitionBy(*keys).orderBy(F.desc(first), doc)
    by_second = W.partitionBy(*keys).orderBy(F.desc_nulls_last(second), doc)
    return (
        df.withColumn("first_rank", F.row_number().over(by_first))
        .withColumn("second_rank", F.when(F.col(second).isNotNull(), F.row_number().over(by_second)).otherwise(0))
        .where(F.col("first_rank") <= top)
    )


def deal_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int, small_pool: int = 0) -> DataFrame:
    """Deal the ordered rows of a key round-robin into ceil(count / size) groups.

    Pools of at most ``small_pool`` rows stay in one group.
    """
    span = W.partitionBy(*keys)
    count = F.count(F.lit(1)).over(span)
    groups = F.when(count <= small_pool, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(count / F.lit(size)))).cast("int")
    return df.withColumn("deal_group", ((F.row_number().over(span.orderBy(*order)) - 1) % groups).cast("int"))


def family_representatives(df: DataFrame, keys: Sequence[str], family: str, score: str, doc: str) -> DataFrame:
    """Best scored member of every family."""
    return latest_per_key(df, [*keys, family], [F.desc(score), F.asc(doc)])


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of ``n`` rows; all rows when there are no more than ``n``."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def restore_order(df: DataFrame, position: str, doc: str) -> DataFrame:
    """Rows by position; those without one come last."""
    return df.orderBy(F.col(position).asc_nulls_last(), doc)


def first_seen(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], bucket_on: Column, name: str = "place", buckets: int | None = None) -> DataFrame:
    """Distinct values of each key as numbered rows (keys, value, order columns folded to their least, place), in the order first seen.

    ``order`` are columns of ``df`` that rise; a key with very many values is numbered in buckets of ``bucket_on``.
    """
    least = df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    names = [f.name for f in least.schema["_first"].dataType]
    rows = least.select(*keys, value, *[F.col(f"_first.{n}").alias(n) for n in names])
    return ordered_positions(rows, keys, [*[F.asc(n) for n in names], F.asc(value)], bucket_on, name, buckets)


def distinct_shown(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """(keys, n, shown): how many distinct non-blank values a key has, and the first ``n`` of them joined by a comma."""
    some = df.where(F.coalesce(F.col(value), F.lit("")) != "").select(*keys, value).distinct()
    few = top_n(some, keys, [F.asc(value)], n).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("shown"))
    return some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(few, list(keys))
