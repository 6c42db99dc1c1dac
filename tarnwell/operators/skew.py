"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def salted_join(
    small: DataFrame,
    big: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    salts: int = 16,
    how: str = "inner",
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    Rows of ``big`` take a salt from their ``spread_by`` columns, rows of ``small`` are
    repeated once per salt, so a key holding a third of ``big`` is split evenly.
    ``how`` is seen from ``big``: inner, left (keep ``big``), left_semi or left_anti.
    """
    tagged = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return tagged.join(spread, [*on, "_salt"], how).drop("_salt")


#: Rows of a bucket, on average, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 200_000, 1_024


def bucketed(df: DataFrame, bucket_on: Column, buckets: int | None = None, name: str = "_bucket") -> tuple[DataFrame, bool]:
    """Add a bucket that rises with a number, and whether there is more than one; nulls lie before all others.

    There are as many buckets as ``BUCKET_ROWS`` asks for, and no fewer than ``buckets``. Their bounds are quantiles; equal numbers
    share a bucket.
    """
    buckets = max(buckets or 0, min(MOST_BUCKETS, -(-df.count() // BUCKET_ROWS)))
    if buckets <= 1:
        return df.withColumn(name, F.lit(0)), False
    value = bucket_on.cast("double")
    numbered = df.withColumn("_order", value)
    bounds = sorted(set(numbered.approxQuantile("_order", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    return numbered.withColumn(name, F.when(F.col("_order").isNull(), -1).otherwise(_bounds_below("_order", bounds))).drop("_order"), True


def dealt_evenly(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The ``rows`` rows of a frame by keys and bucket, in no fewer tasks than ``BUCKET_ROWS`` asks for.

    Partitions of a shuffle of Spark's own are merged by their compressed bytes, and rows that compress well then make one huge task.
    """
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(at_least, -(-rows // BUCKET_ROWS)), *keys, "_bucket")


def _bounds_below(value: str, bounds: Sequence[float], at: int = 0) -> Column:
    """``at`` and how many of the sorted bounds lie below a value: halved, so a thousand bounds are ten comparisons."""
    if not bounds:
        return F.lit(at)
    middle = len(bounds) // 2
    above = _bounds_below(value, bounds[middle + 1 :], at + middle + 1)
    return F.when(F.col(value) > float(bounds[middle]), above).otherwise(_bounds_below(value, bounds[:middle], at))


def same_keys(keys: Sequence[str]) -> tuple[list[Column], Column]:
    """Keys and bucket under other names, and the null-safe condition that joins them."""
    named = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)] + [F.col("_bucket").alias("_key_bucket")]
    same = F.col("_bucket") == F.col("_key_bucket")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return named, same


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket_on: Column,
    name: str = "position",
    buckets: int | None = None,
) -> DataFrame:
    """``row_number`` per key, computed without bringing a key into one task; null keys are a key too.

    ``bucket_on`` is a number that rises with ``order`` (a time in seconds, an id). Rows are numbered inside (key, bucket), and
    the rows in earlier buckets of the key are added. The counts table has a row per key and bucket.
    """
    return running(df, keys, order, bucket_on, {name: ("sum", F.lit(1).cast("long"))}, buckets)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket_on: Column,
    measures: dict[str, tuple[str, Column]], buckets: int | None = None,
) -> DataFrame:
    """Running sums and maxima per key up to and including each row, without bringing a key into one task.

    ``measures``: name -> ("sum" or "max", value). Rows are accumulated inside (key, bucket) and joined, null-safe,
    with what the earlier buckets of the key give.
    """
    numbered, several = bucketed(df, bucket_on, buckets)
    numbered = numbered.withColumns({f"_value_{n}": value for n, (_, value) in measures.items()})
    fold = {"sum": F.sum, "max": F.max}
    span = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = numbered.withColumns({f"_inside_{n}": fold[how](f"_value_{n}").over(span) for n, (how, _) in measures.items()})
    if several:
        totals = numbered.groupBy(*keys, "_bucket").agg(*[fold[how](f"_value_{n}").alias(f"_total_{n}") for n, (how, _) in measures.items()])
        before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        named, same = same_keys(keys)
        offsets = totals.select(*named, *[fold[how](f"_total_{n}").over(before).alias(f"_before_{n}") for n, (how, _) in measures.items()])
        inside = inside.join(offsets, same)
    else:
        inside = inside.withColumns({f"_before_{n}": F.lit(None) for n in measures})
    done = {
        n: F.coalesce(f"_before_{n}", F.lit(0)) + F.coalesce(f"_inside_{n}", F.lit(0)) if how == "sum"
        else F.greatest(f"_before_{n}", f"_inside_{n}") if several else F.col(f"_inside_{n}")
        for n, (how, _) in measures.items()
    }
    return inside.withColumns(done).select(*df.columns, *measures)
