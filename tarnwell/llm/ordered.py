"""Prefix sums over frames of any size: bounded parts are summed in their own tasks, and the sums of the parts in two levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.llm.common import free_name, log2_up, materialise

#: Rows that are sorted in one window, on average.
PART_ROWS = 4_000
#: Sort keys are whole numbers of so many bits, from 0.
KEY_BITS = 60


def random_key(*parts: Column) -> Column:
    """A pseudo-random number of ``KEY_BITS`` bits that follows from the values alone (the first bits of an MD5 digest)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def random_order_sums(rows: DataFrame, keys: list[str], order: list[str], amount: Column, total_rows: int, name: str) -> DataFrame:
    """Add as ``name`` the sum of ``amount`` over the rows of the same ``keys`` that come before a row.

    ``order[0]`` is a random key (see ``random_key``), further columns break its ties; ``keys`` hold no nulls. The range of
    the random key is cut into equal parts of ``PART_ROWS`` rows at most on average, which are sorted each in a task. Sums of
    parts are added up inside groups of parts and over groups, so that no task sees more than the square root of their number.
    """
    part, group, own, before_part, before_group, value = (free_name(rows, f"prefix_{x}") for x in ("part", "group", "own", "before_part", "before_group", "value"))
    bits = log2_up(total_rows / PART_ROWS)
    fine = bits - bits // 2
    rows = rows.withColumn(part, F.shiftright(F.col(order[0]), KEY_BITS - bits)).withColumn(value, amount)
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias(own)).withColumn(group, F.shiftright(F.col(part), fine))
    groups = sums.groupBy(*keys, group).agg(F.sum(own).alias(own))

    upto = groups.select(*keys, group, _sum_before(F.col(own), W.partitionBy(*keys).orderBy(group)).alias(before_group))
    inside = sums.withColumn(before_part, _sum_before(F.col(own), W.partitionBy(*keys, group).orderBy(part)))
    offsets = inside.join(upto, [*keys, group]).select(*keys, part, (F.col(before_part) + F.col(before_group)).alias(before_part))
    sorted_rows = rows.withColumn(name, _sum_before(F.col(value), W.partitionBy(*keys, part).orderBy(*order)))
    joined = sorted_rows.join(offsets, [*keys, part])
    return joined.withColumn(name, (F.col(name) + F.col(before_part)).cast("long")).drop(part, value, before_part)


def range_sums(rows: DataFrame, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """Add for each entry of ``sums`` the sum over all rows up to and with a row, in the order of the columns ``order``.

    The rows are sorted into ranges by Spark and written; a range is summed in one task and the totals of the ranges,
    one row per ``PART_ROWS`` rows, in another. Sums are decimals of 38 digits. ``order`` tells all rows apart.
    """
    part = free_name(rows, "range_part")
    parts = max(1, math.ceil(rows.count() / PART_ROWS))
    ranged = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    written = materialise(ranged.withColumn(part, F.spark_partition_id()), name)
    for k, v in sums.items():
        written = written.withColumn(k, v.cast("decimal(38,0)"))
    totals = written.groupBy(part).agg(*[F.sum(k).alias(f"{part}_{k}") for k in sums])
    before = totals.select(part, *[_sum_before(F.col(f"{part}_{k}"), W.partitionBy(F.lit(0)).orderBy(part)).alias(f"{part}_{k}") for k in sums])
    inside = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = written.select(*rows.columns, part, *[F.sum(k).over(inside).alias(k) for k in sums]).join(before, part)
    return out.select(*rows.columns, *[(F.col(k) + F.col(f"{part}_{k}")).cast("decimal(38,0)").alias(k) for k in sums])


def _sum_before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
