"""Exact dedup: counting quotient filters per partition, merged without loss, then the bytes decide.

Every partition of the documents turns its 64-bit fingerprints into counting quotient filters, one for each
segment of the fingerprint space: the leading bits of a fingerprint (its quotient) are implied by two bitmaps, the
rest (its remainder) is stored in sorted order with a count. Filters of a segment are merged by their sorted
remainders; counts add up and nothing is lost. A fingerprint whose merged count is one belongs to a text that occurs
once. All others go to byte verification: rows of such fingerprints are grouped by their whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import free_name, log2_up, materialise, salts_of, sizes, text_column

#: Fingerprints that one segment is to hold at most, on average.
SEGMENT_ROWS = 1 << 20


def encode_filter(fingerprints: np.ndarray, counts: np.ndarray, fixed_bits: int) -> bytes:
    """Counting quotient filter of sorted distinct fingerprints that share their leading ``fixed_bits``.

    Layout: quotient bits (1 byte), entries (8 bytes), bitmap of the quotients that occur, bitmap that marks the end
    of each quotient's run, remainders (8 bytes each), counts (8 bytes each).
    """
    n = len(fingerprints)
    q = min(max(1, log2_up(n)), 64 - fixed_bits - 1)
    tail = np.uint64(64 - fixed_bits - q)
    quotient = (fingerprints >> tail) & np.uint64((1 << q) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient.astype(np.int64)] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    remainder = fingerprints & np.uint64((1 << int(tail)) - 1)
    head = bytes([q]) + int(n).to_bytes(8, "little")
    return b"".join((head, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainder.tobytes(), counts.astype(np.uint64).tobytes()))


def decode_filter(blob: bytes, segment: int, fixed_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints and counts that a filter holds."""
    q, n = blob[0], int.from_bytes(blob[1:9], "little")
    at = 9
    size = (1 << q) + 7 >> 3
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, at))[: 1 << q])
    at += size
    size = n + 7 >> 3
    ends = np.unpackbits(np.frombuffer(blob, np.uint8, size, at))[:n]
    at += size
    remainder = np.frombuffer(blob, np.uint64, n, at)
    counts = np.frombuffer(blob, np.uint64, n, at + 8 * n)
    run = np.cumsum(ends) - ends
    tail = np.uint64(64 - fixed_bits - q)
    lead = np.uint64(segment << (64 - fixed_bits) if fixed_bits else 0)
    return lead | (occupied[run].astype(np.uint64) << tail) | remainder, counts


def merge_filters(blobs: list[bytes], segment: int, fixed_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of all filters of a segment with their summed counts."""
    parts = [decode_filter(b, segment, fixed_bits) for b in blobs]
    prints = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.uint64)
    if not len(prints):
        return prints, counts
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts, first)


def partition_filters(fingerprints: DataFrame, fixed_bits: int) -> DataFrame:
    """(segment, filter) of each partition of a one-column frame of fingerprints."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True) for b in batches if b.num_rows]
        if not got:
            return
        prints = np.concatenate([p for p, _ in got])
        counts = np.concatenate([c for _, c in got])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        prints, counts = prints[first], np.add.reduceat(counts, first)
        segments = (prints >> np.uint64(64 - fixed_bits)).astype(np.int64) if fixed_bits else np.zeros(len(prints), np.int64)
        cuts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(prints)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(segments[a])], pa.int32()), pa.array([encode_filter(prints[a:b], counts[a:b], fixed_bits)], pa.binary())], ["segment", "filter"]
            )

    return fingerprints.mapInArrow(build, "segment int, filter binary")


def repeated_fingerprints(filters: DataFrame, fixed_bits: int) -> DataFrame:
    """(fingerprint, n) of the fingerprints whose merged count is above one."""

    def merge(key, table):
        segment = key[0].as_py()
        prints, counts = merge_filters(table.column("filter").to_pylist(), segment, fixed_bits)
        more = counts > 1
        return pa.table({"fingerprint": prints[more].view(np.int64), "n": counts[more].view(np.int64)})

    return filters.groupBy("segment").applyInArrow(merge, "fingerprint long, n long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Class of every document under equality of whole texts.

    Gives one row per input row: ``doc_id``, ``keep_id`` (largest doc_id of the equal texts), ``group_size``, ``kept``,
    ``text_sha256``. A null text counts as empty, and all empty texts are equal. A null doc_id loses against any other;
    rows that repeat both doc_id and text are told apart by nothing, count in ``group_size`` and share ``kept``. A group
    without any doc_id has a null ``keep_id`` and keeps its rows. An empty table gives no rows. Other columns are not read.

    No text is ever sent to one task for a hot text: copies are combined before the shuffle, and the rows of a class
    with over a thousandth of all rows are salted when the class is joined back.
    """
    rows = docs.select("doc_id", text_column(docs).alias("text")).withColumn("fingerprint", F.xxhash64("text"))
    total, _ = sizes(rows, F.lit(""))
    fixed_bits = max(6, log2_up(total / SEGMENT_ROWS))
    repeated = materialise(repeated_fingerprints(partition_filters(rows.select("fingerprint"), fixed_bits), fixed_bits), "repeated")

    hot = salts_of(repeated, ["fingerprint"], "n", total)
    salt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.coalesce("salts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), "fingerprint", "left").withColumn("salt", salt).drop("salts")
    spread = repeated.join(F.broadcast(hot), "fingerprint", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    suspects = salted.join(spread.select("fingerprint", "salt"), ["fingerprint", "salt"], "left_semi")
    same_bytes = suspects.groupBy("fingerprint", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    digests = same_bytes.select("fingerprint", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    # Members find their class by digest, which is sound as long as no two classes share one.
    classes = materialise(
        digests.groupBy("fingerprint", "text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .select("fingerprint", "text_sha256", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest"))).otherwise(F.col("keep_id")).alias("keep_id"), "group_size"),
        "classes",
    )
    spread = classes.join(F.broadcast(hot), "fingerprint", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    members = salted.select("doc_id", "fingerprint", "salt", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    joined = members.join(spread, ["fingerprint", "salt", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no kept row has, with all their columns; rows that repeat doc_id and text stay together."""
    digest, doc = free_name(docs, "dedup_digest"), free_name(docs, "dedup_doc")
    gone = exact_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("text_sha256").alias(digest)).distinct()
    own = F.sha2(text_column(docs).cast("binary"), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(doc)) & (own == F.col(digest)), "left_anti")


def one_of_each(docs: DataFrame) -> DataFrame:
    """As ``keep_one``, and of kept rows that repeat doc_id and text, null doc_ids included, a single one stays.

    Repeated rows are combined before the shuffle, so a hot class is a row a task. Without any, nothing more is shuffled.
    """
    kept = keep_one(docs)
    digest, doc = free_name(docs, "dedup_digest"), free_name(docs, "dedup_doc")
    own = F.sha2(text_column(docs).cast("binary"), 256)
    classes = docs.groupBy(docs["doc_id"].alias(doc), own.alias(digest)).agg(F.count(F.lit(1)).alias("n"))
    if classes.where("n > 1").isEmpty():
        return kept
    whole = kept.groupBy(kept["doc_id"].alias(doc), F.sha2(text_column(kept).cast("binary"), 256).alias(digest)).agg(F.first(F.struct(*[kept[c] for c in docs.columns])).alias("row"))
    return whole.select("row.*")
