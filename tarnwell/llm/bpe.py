"""Byte-level BPE: encoding as a tree reduction over a monoid, decoding as concatenation.

The elements are token sequences that are the encoding of their own bytes. A piece is encoded by encoding its halves,
down to single bytes, and joining them. Joining re-encodes a window around the boundary: first one token on either side,
then, as long as a token next to the window would not stand where it stands, twice as many. It is enough to look at
neighbours: merges go by rank, so a sequence is an encoding exactly if each two neighbours encode to themselves. Inside
the halves and inside the window that holds already, so when it holds at both edges of the window, all tokens outside are final.

Decoding is a homomorphism: the bytes of a sequence are the bytes of its parts, one after another.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm import pieces
from tarnwell.llm.common import text_column, worker_cache

#: Encodings of parts of pieces, and of pairs of neighbours, that a worker remembers.
REMEMBERED_PARTS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token; a line of the file has the token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder over the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.stands: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merge by rank, lowest first and leftmost among equals, until no pair is a token: the definition."""
        ranks = self.ranks
        got = [data[i : i + 1] for i in range(len(data))]
        pair = [ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == 1 << 60:
                break
            i = pair.index(low)
            got[i : i + 2] = [got[i] + got[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(got[i] + got[i + 1], 1 << 60)
            if i:
                pair[i - 1] = ranks.get(got[i - 1] + got[i], 1 << 60)
        return tuple(ranks[g] for g in got)

    def neighbours(self, a: int, b: int) -> bool:
        """Do the bytes of two tokens encode to these two?"""
        key = (a, b)
        found = self.stands.get(key)
        if found is None:
            if len(self.stands) >= REMEMBERED_PARTS:
                self.stands.clear()
            found = self.stands[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == key
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings put together."""
        if not left or not right or self.neighbours(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            window = left[len(left) - i :] + right[:j]
            inner = self.merged(b"".join([self.bytes_of[t] for t in window]))
            left_stands = i == len(left) or self.neighbours(left[len(left) - i - 1], inner[0])
            right_stands = j == len(right) or self.neighbours(inner[-1], right[j])
            if left_stands and right_stands:
                return left[: len(left) - i] + inner + right[j:]
            if not left_stands:
                i = min(len(left), 2 * i)
            if not right_stands:
                j = min(len(right), 2 * j)

    def encode_part(self, data: bytes) -> tuple[int, ...]:
        """Encode halves and join them. Parts of up to eight bytes are remembered."""
        if len(data) == 1:
            return (self.ranks[data],)
        short = len(data) <= 8
        found = self.parts.get(data) if short else None
        if found is not None:
            return found
        half = len(data) // 2
        out = self.join(self.encode_part(data[:half]), self.encode_part(data[half:]))
        if short:
            if len(self.parts) >= REMEMBERED_PARTS:
                self.parts.clear()
            self.parts[data] = out
        return out

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """A piece that is a token is that token, whether merges lead to it or not."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return self.encode_part(data) if data else ()

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.encode_piece(t.encode()), "<u4").tobytes() for t in texts]


def _encoder(path: str) -> Bpe:
    return worker_cache(f"bpe {path}", lambda: Bpe(read_ranks(path)))


def encode_texts(texts: list[str], bpe: Bpe, memory: pieces.Memory) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers."""
    out = []
    for lo, hi in pieces.portions(texts):
        whole, points, bounds = pieces.joined(texts[lo:hi])
        starts, _ = pieces.cut(points, bounds, leading_space=True, single_numbers=False)
        ids, n = pieces.encode_pieces(whole, points, starts, np.append(starts[1:], len(points)), memory, bpe.encode_pieces)
        data = ids.astype("<u4", copy=False).tobytes()
        after = np.append(0, np.cumsum(n))[np.searchsorted(starts, bounds)] * 4
        out += [data[a:b] for a, b in zip(after[:-1].tolist(), after[1:].tolist(), strict=True)]
    return out


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode the whole text of every row, each piece of the public pattern separately and without special tokens.

    Gives one row per input row: ``doc_id``, ``ids`` (little-endian unsigned 32-bit numbers). A null or empty text has no
    ids. A row depends on itself alone, so repeated rows and null doc_ids need no rule. An empty table gives no rows.
    Other columns are not read. ``vocabulary`` is the path of a rank file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memory = _encoder(vocabulary), worker_cache(f"memory {vocabulary}", pieces.Memory)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in pieces.portions(texts):
                ids = encode_texts(texts[lo:hi], bpe, memory)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``, to (doc_id, ids). No ids give no bytes; a null gives a null."""

    def table():
        by = {rank: token for token, rank in read_ranks(vocabulary).items()}
        tokens = [by.get(i, b"") for i in range(max(by) + 1)]
        lengths = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, offsets, lengths = worker_cache(f"bytes {vocabulary}", table)
        for batch in batches:
            out = []
            for x in batch.column("ids"):
                ids = np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else None
                out.append(None if ids is None else pieces.gather(flat, offsets, lengths, ids)[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
