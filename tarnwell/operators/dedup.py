"""Apply a costly step once per distinct content and spread the result to every copy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.session import materialise

# At most 1 / HOT_SHARE keys can each hold more than this share of the rows.
HOT_SHARE = 0.001
HOT_ROWS = 100_000


def join_to_copies(rows: DataFrame, unique: DataFrame, key: str, copies: str, spread_by: list[str]) -> DataFrame:
    """Join ``rows`` to one row per key, splitting keys with very many copies.

    ``unique`` carries the number of copies of its key. Keys over ``HOT_ROWS`` and over a
    thousandth of all rows are salted in proportion to their copies. By that definition
    there are at most a thousand of them, which is the bound on what is broadcast.
    """
    total = unique.agg(F.sum(copies).alias("n")).scalar()
    threshold = F.greatest(F.lit(float(HOT_ROWS)), total * F.lit(HOT_SHARE))
    counted = unique.withColumn("_salts", F.when(F.col(copies) > threshold, F.ceil(F.col(copies) / threshold)).otherwise(1).cast("int"))
    hot = counted.where(F.col("_salts") > 1).select(key, "_salts")
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    ).drop("_salts")
    salted_unique = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", copies)
    return salted_rows.join(salted_unique, [key, "_salt"]).drop("_salt")


def dedup_apply(
    df: DataFrame, content: str, apply: Callable[[DataFrame], DataFrame], row_id: list[str], key: str = "content_hash"
) -> DataFrame:
    """``apply`` gets (key, content) of the distinct contents and returns key + result columns."""
    keyed = df.withColumn(key, F.md5(F.col(content).cast("binary")))
    unique = keyed.groupBy(key).agg(F.min(content).alias(content), F.count(F.lit(1)).alias("_copies"))
    # Two branches read the results; a costly step must not run for each of them.
    results = materialise(apply(unique.select(key, content)), "applied")
    counted = results.join(unique.select(key, "_copies"), key)
    return join_to_copies(keyed, counted, key, "_copies", row_id)


def occurrences(df: DataFrame, content: str, place: list[str], key: str = "content_hash") -> DataFrame:
    """One row per occurrence with its content hash, copy number and how many copies there are.

    Copies stay rows: a content repeated a million times is a million short rows, not one list.
    """
    keyed = df.select(F.md5(F.col(content).cast("binary")).alias(key), *place)
    counts = keyed.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*place)).alias("_first")
    ).withColumn("_n", F.col("copies"))
    joined = join_to_copies(keyed, counts, key, "_n", place)
    return joined.withColumn("is_first", F.struct(*place) == F.col("_first")).drop("_first")
