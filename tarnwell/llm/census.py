"""A census of hashes: which of its own hashes each chunk of documents shares with other chunks.

Documents are dealt into chunks by a hash of their doc_id. Every chunk sends its sorted distinct hashes, cut to a width
that follows the size of the corpus, as one packed row per segment of the hash space. The merge of a segment answers
every chunk with one small number per hash, in the order in which the chunk sent them; so no hash travels back, no
document travels with its hashes, and a hash that is in every document is one entry per chunk.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import log2_up

#: Bytes of text in a chunk, on average; its arrays take some ten times as much in a worker.
CHUNK_BYTES = 4 << 20
#: Hashes in a segment, on average.
SEGMENT_HASHES = 2 << 20
#: Bytes of text for each word, at least; only used to size segments.
WORD_BYTES = 4

BLOB = "chunk int, segment int, keys binary, aux binary"


class Layout:
    """Numbers of chunks and segments for a corpus of so many bytes."""

    def __init__(self, text_bytes: int, chunk_bytes: int = CHUNK_BYTES):
        self.chunks = max(1, math.ceil(text_bytes / chunk_bytes))
        self.bits = max(6, log2_up(text_bytes / WORD_BYTES / SEGMENT_HASHES))

    def chunk(self, key: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(self.chunks)).cast("int")

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def short(self, hashes: np.ndarray) -> np.ndarray:
        """The segment and the 32 bits after it: what the first census compares."""
        return hashes >> np.uint64(32 - self.bits)


def by_segment(segments: np.ndarray, total: int) -> list[tuple[int, int, int]]:
    """(segment, from, to) of each segment in sorted segments."""
    if not total:
        return []
    cuts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
    ends = np.append(cuts[1:], total)
    return [(int(segments[a]), int(a), int(b)) for a, b in zip(cuts, ends, strict=True)]


def grouped_totals(keys: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """For each entry the sum of the amounts of all entries with the same key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    sums = np.add.reduceat(amounts[order], np.flatnonzero(new))
    out = np.empty(len(keys), sums.dtype)
    out[order] = sums[np.cumsum(new) - 1]
    return out


def answer(blobs: DataFrame, merge) -> DataFrame:
    """Apply ``merge(list of keys, list of aux) -> list of bytes`` to each segment; gives (chunk, segment, keys = answer)."""
    import pyarrow as pa

    def run(key, table):
        chunks = table.column("chunk").to_pylist()
        replies = merge([x.as_py() for x in table.column("keys")], [x.as_py() for x in table.column("aux")])
        n = len(chunks)
        return pa.table({
            "chunk": pa.array(chunks, pa.int32()), "segment": pa.array([key[0].as_py()] * n, pa.int32()),
            "keys": pa.array(replies, pa.binary()), "aux": pa.array([None] * n, pa.binary()),
        })

    return blobs.groupBy("segment").applyInArrow(run, BLOB)
