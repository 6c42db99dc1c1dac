"""Best-fit packing with exact complements: fill sequences of a fixed length with as few of them as possible.

Token pieces are packed by length alone, so the plan needs only how many pieces there are of each length: at most as
many numbers as a sequence has tokens, for any corpus. The plan takes the longest piece left and fills its gap. Sums of one,
two and three available lengths are indexed; a combination that fills the gap exactly is consumed if the counts
allow it, and the same combination is repeated as often as they do. Without one, the longest piece that fits goes in
and the smaller gap is tried again.

Pieces of a length are numbered without bringing them into one task, and a piece finds its place by its number.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm import pieces
from tarnwell.llm.common import dense_ranks, materialise, text_column, worker_cache

#: Pieces of a length that are numbered in one task's window, on average.
RANK_ROWS = 20_000
#: Distinct words that go to the tokenizer in one call.
CALL_WORDS = 2_000


# --- tokens ----------------------------------------------------------------------------------


def _make_plain() -> np.ndarray:
    """Characters whose normal form, lower case and kind depend on nothing around them and have been the same for long."""
    plain = np.zeros(0x110000, bool)
    old = unicodedata.ucd_3_2_0
    for point in range(0x3000):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind != old.category(c) or kind[0] in "CM" or kind in ("Zs", "Zl", "Zp") or 0x1100 <= point < 0x1200 or c in "İΣ":
            continue
        low = c.lower()
        plain[point] = len(low) == 1 and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", low) == low
    plain[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return plain


class WordTokenizer:
    """Ids of a public word-level BPE vocabulary that lower-cases and drops white space.

    Texts of plain characters are cut into words here, and the tokenizer sees every distinct word of a batch once. All
    other texts, and those that hold the string of an added token in any case of letters, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.plain = worker_cache("plain points", _make_plain)
        self.memory = pieces.Memory()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(words), CALL_WORDS):
            part = words[lo : lo + CALL_WORDS]
            ids = self.whole([" ".join(part)])[0]
            after = np.flatnonzero(self.ends[ids]) + 1
            if len(after) != len(part):  # words that the tokenizer cuts otherwise: one by one
                out += [x.tobytes() for x in self.whole(part)]
                continue
            data = ids.astype("<u4").tobytes()
            cuts = [0, *(after * 4).tolist()]
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for lo, hi in pieces.portions(texts):
            _, points, bounds = pieces.joined(texts[lo:hi])
            bad = np.append(0, np.cumsum(~self.plain[points]))[bounds]
            whole = np.array([any(a in t for a in self.added) for t in map(str.lower, texts[lo:hi])]) | (np.diff(bad) > 0)
            odd, fine = np.flatnonzero(whole) + lo, np.flatnonzero(~whole) + lo
            for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
                out[i] = ids
            whole, points, bounds = pieces.joined([texts[i].lower() for i in fine])
            starts, kind = pieces.cut(points, bounds, leading_space=False, single_numbers=True)
            ends = np.append(starts[1:], len(points))
            keep = kind != pieces.SPACE
            starts, ends = starts[keep], ends[keep]
            ids, n = self._pieces(whole, points, starts, ends)
            cuts = np.append(0, np.cumsum(n))[np.searchsorted(starts, bounds)]
            for i, a, b in zip(fine, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    def _pieces(self, whole, points, starts, ends):
        return pieces.encode_pieces(whole, points, starts, ends, self.memory, self.encode_words)


def token_pieces(docs: DataFrame, tokenizer_file: str, length: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and one end id, cut where they are longer than ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = worker_cache(f"words {tokenizer_file}", lambda: WordTokenizer(tokenizer_file))
        for batch in batches:
            texts, docs_ = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi in pieces.portions(texts):
                rows = []
                for doc, ids in zip(docs_[lo:hi], tokenizer.encode(texts[lo:hi]), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), length)):
                        part = ids[at : at + length]
                        rows.append((doc, k, at, len(part), part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


# --- plan ------------------------------------------------------------------------------------


class SumIndex:
    """Which sums two available lengths have, and combinations of one to three that give a sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.top = len(counts) - 1
        self._pairs: np.ndarray | None = None

    def changed(self) -> None:
        self._pairs = None

    def pairs(self) -> np.ndarray:
        """For each sum up to the longest sequence, whether two available lengths give it."""
        if self._pairs is None:
            have, bits = np.flatnonzero(self.counts), 0
            base = 0
            for a in have.tolist():
                base |= 1 << a
            for a in have.tolist():
                bits |= base << a
            bits &= (1 << (self.top + 1)) - 1
            raw = np.frombuffer(bits.to_bytes(self.top // 8 + 1, "little"), np.uint8)
            self._pairs = np.unpackbits(raw, bitorder="little")[: self.top + 1].astype(bool)
        return self._pairs

    def _allowed(self, combination: tuple[int, ...], used: Counter) -> bool:
        return all(self.counts[x] >= n + used[x] for x, n in Counter(combination).items())

    def _pair(self, gap: int, used: Counter, most: int) -> tuple[int, ...] | None:
        have = self.counts[1:gap] > 0
        for a in (np.flatnonzero(have & have[::-1]) + 1)[::-1].tolist():
            if a <= most and a >= gap - a and self._allowed((a, gap - a), used):
                return a, gap - a
        return None

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """Available lengths, at most three and long ones first, that fill the gap."""
        if self._allowed((gap,), used):
            return (gap,)
        pairs = self.pairs()
        if pairs[gap] and (found := self._pair(gap, used, gap)):
            return found
        firsts = np.flatnonzero((self.counts[1:gap] > 0) & pairs[gap - 1 : 0 : -1]) + 1
        for a in firsts[::-1].tolist():
            if 3 * a < gap:
                break
            if (found := self._pair(gap - a, used, a)) and self._allowed((a, *found), used):
                return a, *found
        return None


def plan(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), from how many pieces there are of each length."""
    left = np.zeros(length + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    index, out = SumIndex(left), []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        pattern, used, gap = [longest], Counter((longest,)), length - longest
        while gap:
            found = index.exact(gap, used)
            if found is None:
                fits = [x for x in np.flatnonzero(left[: gap + 1])[::-1].tolist() if left[x] > used[x]]
                if not fits:
                    break
                found = (fits[0],)
            pattern += found
            used.update(found)
            gap -= sum(found)
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        if any(left[x] == 0 for x in used):
            index.changed()
        out.append((tuple(pattern), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length, (number of the first piece, sequence of that piece, offset) of each stretch of numbers."""
    taken: Counter = Counter()
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            out[x].append((taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return out


def pack(parts: DataFrame, length: int) -> DataFrame:
    """Add ``sequence_id`` (from 0) and ``offset`` to pieces (doc_id, piece, length, ...) of at most ``length`` tokens.

    The frame is read twice and should be a written table. Pieces that repeat are all packed; a null doc_id is packed as
    any other. No pieces give no rows.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length at most
    total = sum(counts.values())
    where = places(plan(counts, length))
    rows = [(n, [w[0] for w in ws], [w[1] for w in ws], [w[2] for w in ws]) for n, ws in where.items()]
    table = spark.createDataFrame(rows, "length long, firsts array<long>, sequences array<long>, offsets array<long>")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, math.ceil(total / RANK_ROWS))))
    ranked = dense_ranks(parts, ["length"], bucket, [F.col("doc_id"), F.col("piece")], "number")
    # One row for each length, with all stretches of the plan: bounded by the length of a sequence.
    joined = ranked.join(F.broadcast(table), "length")
    stretch = F.size(F.filter("firsts", lambda f: f <= F.col("number")))
    joined = joined.withColumn("stretch", stretch)
    return joined.select(
        *parts.columns, (F.element_at("sequences", F.col("stretch")) + F.col("number") - F.element_at("firsts", F.col("stretch"))).alias("sequence_id"),
        F.element_at("offsets", F.col("stretch")).alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer_file: str, length: int = 2_048) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens.

    A document is its ids and one end id 0; only longer ones are cut. Gives one row per piece: ``doc_id``, ``piece``,
    ``start``, ``length``, ``ids_crc32`` (of little-endian 32-bit ids), ``sequence_id``, ``offset``. A null or empty text is one
    end id. Rows that share a doc_id are packed each for itself. An empty table gives no rows. Other columns are not read.
    ``tokenizer_file`` must be readable by every executor. The ids themselves come from ``token_pieces``.
    """
    parts = token_pieces(docs, tokenizer_file, length).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(materialise(parts, "pieces"), length)
