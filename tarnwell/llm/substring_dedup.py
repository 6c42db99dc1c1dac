"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark, merged into removal intervals.

A window is a fixed number of consecutive words of one document. Its hash is a Rabin-Karp polynomial modulo 2^61 - 1 over the
digests of its words. Two counts run over chunks of documents (see ``census``):

1. the hash, cut to a few bytes, of every window of every document; windows whose short hash no other document has are done;
2. a hash of 96 bits and more, with the smallest doc_id of the chunk, of the windows that are left.

The second answer says for each window whether a document with a smaller doc_id has it elsewhere; inside a chunk that is
seen on the spot. Windows found this way are merged into maximal intervals of words, which are removed.

Words are told apart by cryptographic digests. Two different windows of w words agree in the first hash with a chance of
2w / 2^61 at most and in the 32 bits of the second, over another base and other digest bits, with 2^-32: for 13 words under
2^-88, whatever the words are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.census import BLOB, Layout, answer, by_segment, grouped_totals
from tarnwell.llm.common import WINDOW_BASES, sizes, text_bytes, text_column, window_hashes, word_digests

NO_DOC = np.iinfo(np.int64).max


class _Windows:
    """The windows of the documents of a chunk: two hashes, the document, the word at which each begins."""

    def __init__(self, table: pa.Table, width: int):
        raw, bounds = text_bytes(table.column("text"))
        ids = table.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc_ids = ids.fill_null(NO_DOC).to_numpy(zero_copy_only=False)
        self.raw, self.bounds = raw, bounds
        self.first, *hashes = word_digests(raw, bounds)
        self.a, self.b = (window_hashes(h, width, base) for h, base in zip(hashes, WINDOW_BASES, strict=True))
        n = len(self.a)
        row = np.searchsorted(self.first, np.arange(n), side="right") - 1
        inside = np.arange(n) + width <= self.first[row + 1] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(inside & self.known[row])
        self.row = row[self.at]
        self.a, self.b = self.a[self.at], self.b[self.at]
        self.doc = self.doc_ids[self.row]


def _distinct(shorts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whether two documents have them, and for each window the number of its hash."""
    order = np.argsort(shorts, kind="stable")
    ordered = shorts[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    if not len(starts):
        return ordered, np.zeros(0, bool), number
    low, high = np.minimum.reduceat(docs[order], starts), np.maximum.reduceat(docs[order], starts)
    return ordered[starts], low != high, number


def _short_entries(w: _Windows, layout: Layout):
    return _distinct(layout.short(w.a), w.doc)


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8))[:n].astype(bool)


def _merge_short(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    """For each hash: does more than one document of the corpus have it?"""
    parts = [np.frombuffer(k, np.uint32) for k in keys]
    counts = np.concatenate([_bits(x, len(p)) for x, p in zip(aux, parts, strict=True)]).astype(np.int64) + 1
    more = grouped_totals(np.concatenate(parts), counts) > 1
    cuts = np.cumsum([0, *map(len, parts)])
    return [np.packbits(more[x:y]).tobytes() for x, y in itertools.pairwise(cuts)]


STRONG = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<u2")])


def _merge_strong(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
    """For each hash of a chunk: does a document outside with a smaller doc_id than the chunk's smallest have it?"""
    parts = [np.frombuffer(k, STRONG) for k in keys]
    docs = np.concatenate([np.frombuffer(x, np.int64)[p["doc"]] for p, x in zip(parts, aux, strict=True)])
    a, b = (np.concatenate([p[f] for p in parts]) for f in ("a", "b"))
    order = np.lexsort((docs, b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    least = docs[order][np.flatnonzero(new)]  # sorted by doc_id inside a hash
    earlier = np.empty(len(docs), bool)
    earlier[order] = least[np.cumsum(new) - 1] < docs[order]
    cuts = np.cumsum([0, *map(len, parts)])
    return [np.packbits(earlier[x:y]).tobytes() for x, y in itertools.pairwise(cuts)]


def _replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("segment").to_pylist(), (x.as_py() for x in table.column("keys")), strict=True))


def _flags(segments: np.ndarray, n: int, replies: dict[int, bytes]) -> np.ndarray:
    """The answers of all segments, in the order in which the chunk's entries were sent."""
    out = np.zeros(n, bool)
    for segment, x, y in by_segment(segments, n):
        out[x:y] = _bits(replies[segment], y - x)
    return out


def _blobs(chunk: int, pieces: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table({
        "chunk": pa.array([chunk] * len(pieces), pa.int32()), "segment": pa.array([p[0] for p in pieces], pa.int32()),
        "keys": pa.array([p[1] for p in pieces], pa.binary()), "aux": pa.array([p[2] for p in pieces], pa.binary()),
    })


class _Suspects:
    """The windows of a chunk that another document may have, as distinct strong hashes in sending order."""

    def __init__(self, w: _Windows, layout: Layout, replies: dict[int, bytes]):
        shorts, _, number = _short_entries(w, layout)
        more = _flags((shorts >> np.uint64(32)).astype(np.int64), len(shorts), replies)
        self.windows = np.flatnonzero(more[number]) if len(number) else np.zeros(0, np.int64)
        a, b, doc = w.a[self.windows], (w.b[self.windows] >> np.uint64(32)).astype(np.uint32), w.doc[self.windows]
        order = np.lexsort((doc, b, a))
        a, b, doc = a[order], b[order], doc[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
        self.number = np.empty(len(a), np.int64)
        self.number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.a, self.b, self.least = a[first], b[first], doc[first]
        self.segments = layout.segment(self.a)


def remove_repeated_windows(docs: DataFrame, width: int = 13) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller doc_id.

    Words are runs without ASCII white space, unchanged; windows are judged on the input. Gives one row per input row:
    ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (the maximal removal intervals as first word and word after the last),
    ``kept_text`` (kept words joined by one space). A null or empty text has no words; a text shorter than the window
    loses none. Repeated windows inside one document, and in rows that share a doc_id, are not removed, as no
    doc_id is smaller. A row with a null doc_id is compared with nothing and keeps its words. An empty table
    gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", text_column(docs).alias("text"))
    _, total = sizes(rows, F.col("text"))
    layout = Layout(total)
    chunked = rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("chunk", layout.chunk()).groupBy("chunk")

    def send_short(key, table):
        w = _Windows(table, width)
        shorts, several, _ = _short_entries(w, layout)
        low = (shorts & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        segments = (shorts >> np.uint64(32)).astype(np.int64)
        return _blobs(key[0].as_py(), [(s, low[x:y].tobytes(), np.packbits(several[x:y]).tobytes()) for s, x, y in by_segment(segments, len(low))])

    def send_strong(key, left, right):
        w = _Windows(left, width)
        found = _Suspects(w, layout, _replies(right))
        pieces = []
        for s, x, y in by_segment(found.segments, len(found.a)):
            for lo in range(x, y, 60_000):  # the documents of an entry are numbered with two bytes
                hi = min(y, lo + 60_000)
                ids, which = np.unique(found.least[lo:hi], return_inverse=True)
                entries = np.empty(hi - lo, STRONG)
                entries["a"], entries["b"], entries["doc"] = found.a[lo:hi], found.b[lo:hi], which
                pieces.append((s, entries.tobytes(), ids.tobytes()))
        # Parts of a segment are told apart by their first hash when they come back.
        return _blobs(key[0].as_py(), pieces)

    first_answer = answer(chunked.applyInArrow(send_short, BLOB), _merge_short)
    second_sent = chunked.cogroup(first_answer.groupBy("chunk")).applyInArrow(send_strong, BLOB)

    def merge_second(keys: list[bytes], aux: list[bytes]) -> list[bytes]:
        replies = _merge_strong(keys, aux)
        return [k[:8] + r for k, r in zip(keys, replies, strict=True)]

    second_answer = answer(second_sent, merge_second)
    answers = first_answer.withColumn("aux", F.lit(b"1")).unionByName(second_answer.withColumn("aux", F.lit(b"2")))

    def remove(key, left, right):
        w = _Windows(left, width)
        stage = np.array([x.as_py() for x in right.column("aux")], dtype=object)
        one = right.filter(pa.array(stage == b"1", pa.bool_()))
        two = right.filter(pa.array(stage == b"2", pa.bool_()))
        found = _Suspects(w, layout, _replies(one))
        earlier = np.zeros(len(found.a), bool)
        by_first = {(s, blob[:8]): blob[8:] for s, blob in zip(two.column("segment").to_pylist(), (x.as_py() for x in two.column("keys")), strict=True)}
        for s, x, y in by_segment(found.segments, len(found.a)):
            for lo in range(x, y, 60_000):
                hi = min(y, lo + 60_000)
                earlier[lo:hi] = _bits(by_first[s, found.a[lo].tobytes()], hi - lo)
        gone = earlier[found.number] | (w.doc[found.windows] > found.least[found.number]) if len(found.number) else np.zeros(0, bool)
        at = w.at[found.windows[gone]]
        steps = np.zeros(int(w.first[-1]) + 1, np.int32)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + width, -1)
        removed = np.cumsum(steps)[:-1] > 0
        kept_texts, spans, n_removed = [], [], []
        data = w.raw.tobytes()
        for i in range(left.num_rows):
            text = data[w.bounds[i] : w.bounds[i + 1]].split()
            cut = removed[w.first[i] : w.first[i + 1]]
            if cut.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0]))))
                spans.append([{"first": int(x), "after": int(y)} for x, y in edges.reshape(-1, 2)])
                text = list(itertools.compress(text, ~cut))
            else:
                spans.append([])
            n_removed.append(int(cut.sum()))
            kept_texts.append(b" ".join(text))
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))), "kept_text": pa.array(kept_texts, pa.binary()).cast(pa.string()),
        })

    return chunked.cogroup(answers.groupBy("chunk")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, spans array<struct<first: long, after: long>>, kept_text string"
    )
