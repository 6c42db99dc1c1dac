"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Labelled texts are the examples. Every word of a text is a term, and so is every stem; document frequencies are counted over
all documents. The postings of the rarer terms of a text are added up over all examples. The frequent ones are held by blocks
of similar examples with the largest weight in each block; their products are taken only in blocks that can, by these bounds,
still hold one of the k nearest. So the k nearest are exact.

Terms that no example has only make a text longer. They are counted by Spark and joined to the texts that have them.

The votes of the nearest examples, weighted by their similarity, are calibrated on the examples themselves, each
searched without itself. The examples that voted are returned as evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import BYTE_MIX, HOT_SHARE, LOWER, materialise, mixed, portions_of, sizes, text_bytes, text_column, words

#: Labelled rows of each label that become examples at most, the first by a hash of doc_id.
MOST_EXAMPLES = 2_000
#: Bytes of a word's beginning that are a term too, for words that are longer.
STEM = 5
#: Examples in a block of the index; texts that are searched at once.
BLOCK, QUERIES = 64, 64
#: Terms in at least so many examples are held by blocks, the most frequent ones up to a number; the others as postings.
FREQUENT, MOST_FREQUENT = 64, 1_024

GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
TERM_MIX = np.where(GAPS, np.uint64(0), np.where(BYTE_MIX == 0, np.uint64(1), BYTE_MIX))


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each text.

    Terms are the words, runs of letters, digits and bytes above ASCII with A to Z lower-cased, and the stems of longer words.
    """
    raw, bounds = text_bytes(column)
    raw = LOWER[raw]
    first, (hashes,) = words(raw, bounds, gaps=GAPS, mix=TERM_MIX)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(rows):
        inside = ~GAPS[raw]
        begins = inside & np.append(True, ~inside[:-1])
        edges = bounds[(bounds > 0) & (bounds < len(raw))]
        begins[edges] = inside[edges]
        starts = np.flatnonzero(begins)
        padded = np.append(raw, np.zeros(STEM, np.uint8))
        stem, long_ = np.full(len(starts), 1, np.uint64), np.ones(len(starts), bool)
        limit = bounds[rows + 1]
        for k in range(STEM + 1):
            at = starts + k
            long_ &= (at < limit) & ~GAPS[padded[at]]
            if k < STEM:
                stem = stem * np.uint64(256) + padded[at]
        rows, hashes = np.concatenate([rows, rows[long_]]), np.concatenate([hashes, mixed(stem[long_])])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])) if len(rows) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return rows[at], hashes[at].view(np.int64), np.diff(np.append(at, len(rows)))


def numbers_of(found: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The places of terms among the sorted ``terms``, -1 for others."""
    if not len(terms):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
    return np.where(terms[at] == found, at, -1)


def _weights(rows, terms, counts, idf: np.ndarray, n: int) -> np.ndarray:
    """(1 + log tf) * idf, each row scaled to length one."""
    w = (1 + np.log(counts)) * idf[terms]
    norms = np.sqrt(np.bincount(rows, w * w, minlength=n))
    return w / np.where(norms > 0, norms, 1)[rows]


@dataclass
class BlockMaxIndex:
    """Examples as postings of the rarer terms, and of the frequent ones as blocks with the largest weight of each term."""

    ids: np.ndarray
    labels: np.ndarray
    column: np.ndarray  # of each term in the blocks, -1 for those with postings
    dense: np.ndarray  # blocks x frequent terms x BLOCK
    largest: np.ndarray  # frequent terms x blocks
    lengths: np.ndarray  # of the frequent part of each example
    starts: np.ndarray  # terms + 1: where postings begin
    postings: np.ndarray  # example numbers
    weights: np.ndarray

    @staticmethod
    def build(ids, labels, rows, terms, weights, n_terms: int, frequent: int = FREQUENT) -> BlockMaxIndex:
        """Examples are ordered by their heaviest term, so that a block holds similar ones."""
        n = len(ids)
        heaviest = np.full(n, n_terms)
        order = np.lexsort((-weights, rows))
        first = np.append(True, rows[order][1:] != rows[order][:-1]) if len(order) else np.zeros(0, bool)
        heaviest[rows[order][first]] = terms[order][first]
        place = np.lexsort((ids, heaviest))
        number = np.empty(n, np.int64)
        number[place] = np.arange(n)
        blocks = max(1, -(-n // BLOCK))
        example = number[rows]
        counts = np.bincount(terms, minlength=n_terms)
        most = np.argsort(-counts, kind="stable")[:MOST_FREQUENT]
        most = most[counts[most] >= frequent]
        column = np.full(n_terms, -1)
        column[most] = np.arange(len(most))
        held = column[terms] >= 0
        dense = np.zeros((blocks, len(most), BLOCK))
        dense[example[held] // BLOCK, column[terms[held]], example[held] % BLOCK] = weights[held]
        rare = np.flatnonzero(~held)
        rare = rare[np.lexsort((example[rare], terms[rare]))]
        starts = np.searchsorted(terms[rare], np.arange(n_terms + 1))
        lengths = np.sqrt((dense * dense).sum(axis=1)).ravel()
        return BlockMaxIndex(ids[place], labels[place], column, dense, dense.max(axis=2).T.copy(), lengths, starts, example[rare].astype(np.int32), weights[rare])

    def nearest(self, rows, terms, weights, n: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, example) of the k nearest examples with a similarity above zero; -1 where there are fewer.

        ``without``: an example number for each row that is not to be found. Ties, to twelve digits, go to the lower example number.
        """
        sims, best = np.zeros((n, k)), np.full((n, k), -1)
        begin = np.searchsorted(rows, np.arange(n + 1))
        for lo in range(0, n, QUERIES):
            hi = min(n, lo + QUERIES)
            a, b = begin[lo], begin[hi]
            if a < b:
                scores = self._scores(rows[a:b] - lo, terms[a:b], weights[a:b], hi - lo, k, None if without is None else without[lo:hi])
                least = np.partition(scores, -min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
                row, example = np.nonzero((scores >= least[:, None]) & (scores > 0))
                order = np.lexsort((example, -scores[row, example], row))
                row, example = row[order], example[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, example, rank = row[rank < k], example[rank < k], rank[rank < k]
                sims[lo + row, rank], best[lo + row, rank] = scores[row, example], example
        return sims, best

    def _scores(self, rows, terms, weights, n: int, k: int, without: np.ndarray | None) -> np.ndarray:
        """Similarity of each row with all examples; -1 in blocks that cannot hold one of its k nearest."""
        blocks, width = len(self.dense), len(self.dense) * BLOCK
        column = self.column[terms]
        held = column >= 0
        asked = np.zeros((n, self.dense.shape[1]))
        asked[rows[held], column[held]] = weights[held]
        rows, terms, weights = rows[~held], terms[~held], weights[~held]
        low, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        posting = np.arange(int(length.sum())) + np.repeat(low - np.cumsum(length) + length, length)
        slot = np.repeat(rows * width, length) + self.postings[posting]
        part = np.bincount(slot, self.weights[posting] * np.repeat(weights, length), minlength=n * width).reshape(n, width)
        if without is not None:
            part[np.arange(n), without] = -np.inf
        # The k-th best of the parts is a floor. The rest is at most what the largest weights of a block give, and at most the product of lengths.
        floor = np.partition(part, -min(k, width), axis=1)[:, -min(k, width)]
        by_block = part.reshape(n, blocks, BLOCK)
        rest = np.minimum((asked @ self.largest)[:, :, None], np.linalg.norm(asked, axis=1)[:, None, None] * self.lengths.reshape(1, blocks, BLOCK))
        reach = (by_block + rest).max(axis=2) * (1 + 1e-9) + 1e-11  # rounding must not lower a bound
        scores = np.full((n, blocks, BLOCK), -1.0)
        for block in range(blocks):
            open_ = np.flatnonzero(reach[:, block] >= floor)
            if len(open_):
                scores[open_, block] = by_block[open_, block] + asked[open_] @ self.dense[block]
        return np.round(scores.reshape(n, width), 12)


def _steps(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the labels on the votes: pooled (vote, share) points in rising order."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # vote sum, label sum, weight
    for v, y, w in zip(votes[order], labels[order], weights[order], strict=True):
        pools.append([v * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a, b, c = pools.pop()
            pools[-1][0] += a
            pools[-1][1] += b
            pools[-1][2] += c
    array = np.array(pools)
    return array[:, 0] / array[:, 2], array[:, 1] / array[:, 2]


@dataclass
class ToxicityModel:
    """Terms of the examples, their idf, the documents, the index, and the calibration; ``base`` is the score of a text without a neighbour."""

    terms: np.ndarray
    idf: np.ndarray
    total: int
    index: BlockMaxIndex
    k: int
    label_weights: np.ndarray
    base: float
    calibration: tuple[np.ndarray, np.ndarray]

    def votes(self, sims: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the neighbours; the sampling of examples by label is undone."""
        labels = np.where(best >= 0, self.index.labels[best], 0) if len(self.index.labels) else np.zeros(best.shape)
        w = sims * self.label_weights[labels.astype(int)]
        return (w * labels).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-12)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(score, similarities, examples, square of the length) of each text as far as examples have its terms, and (row, term, count) of all others."""
        n = len(column)
        rows, found, counts = term_counts(column)
        number = numbers_of(found, self.terms)
        known = number >= 0
        others = rows[~known], found[~known], counts[~known]
        rows, terms, counts = rows[known], number[known], counts[known]
        w = (1 + np.log(counts)) * self.idf[terms]
        sims, best = self.index.nearest(rows, terms, _weights(rows, terms, counts, self.idf, n), n, self.k)
        scores = np.interp(self.votes(sims, best), *self.calibration)  # the length of the text does not change its votes
        return np.where(sims[:, 0] > 0, scores, self.base), sims, best, np.bincount(rows, w * w, minlength=n), others


def _constant(base: float, k: int) -> ToxicityModel:
    none = np.zeros(0, np.int64)
    index = BlockMaxIndex.build(none, none, none, none, np.zeros(0), 0)
    return ToxicityModel(none, np.zeros(0), 0, index, k, np.ones(2), base, (np.array([0.0, 1.0]), np.array([base, base])))


def examples(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of the examples, and how many labelled rows of each label may be learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(fold != held_out)
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("label"))
    known = {int(r["label"]): int(r["n"]) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id", F.lit(29)), F.col("doc_id")]
    chosen = rows.where("label = 0").orderBy(*order).limit(most).unionByName(rows.where("label = 1").orderBy(*order).limit(most))
    # `most` bounds the number of ids that are broadcast, whatever the size of the tables.
    picked = docs.select("doc_id", text_column(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    return picked.dropDuplicates(["text", "label"]), known


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many of all documents each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in (part for whole in batches for part in portions_of(whole, "text")):
            number = numbers_of(term_counts(batch.column(0))[1], terms)
            total += np.bincount(number[number >= 0], minlength=len(terms))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    found = docs.select(text_column(docs).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = found.toArrow()  # one row a term of the examples at most
    out = np.zeros(len(terms), np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def inverse_frequency(total: int, n):
    """The idf of terms in ``n`` of ``total`` documents."""
    return np.log((total + 1) / (n + 0.5)).clip(min=1e-6)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, k: int = 15, most: int = MOST_EXAMPLES) -> ToxicityModel:
    """Build the index and calibrate it. With one label only, or examples without a word, every score is the smoothed share of label 1."""
    chosen, known = examples(docs, labels, label, modulus, held_out, most)
    base = (known.get(1, 0) + 0.5) / (sum(known.values()) + 1)
    if len(known) < 2:
        return _constant(base, k)
    texts = materialise(chosen, "toxicity-examples")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions_of(whole, "text")):
            rows, found, counts = term_counts(batch.column("text"))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (found, counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *packed], ["doc_id", "label", "terms", "counts"])

    shape = "doc_id long, label int, terms binary, counts binary"
    rows_ = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(vectors, shape).collect()  # 2 * most rows
    rows_.sort(key=lambda r: (r["doc_id"], r["terms"]))
    n = len(rows_)
    ids, marks = np.array([r["doc_id"] for r in rows_], np.int64), np.array([r["label"] for r in rows_], np.int64)
    rows = np.repeat(np.arange(n), [len(r["terms"]) // 8 for r in rows_])
    terms, found = np.unique(np.frombuffer(b"".join(r["terms"] for r in rows_), np.int64), return_inverse=True)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows_), np.int32)
    if not len(terms):
        return _constant(base, k)
    total, _ = sizes(docs, F.lit(""))
    idf = inverse_frequency(total, document_frequencies(docs, terms))
    weights = _weights(rows, found, counts, idf, n)
    index = BlockMaxIndex.build(ids, marks, rows, found, weights, len(terms))
    sampled = np.bincount(marks, minlength=2)
    if not sampled.all():
        return _constant(base, k)
    label_weights = np.array([known[y] / sampled[y] for y in (0, 1)])
    model = ToxicityModel(terms, idf, total, index, k, label_weights, base, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    number = np.empty(n, np.int64)  # where build() has put each example
    where = {int(i): [] for i in ids}
    for j, i in enumerate(index.ids.tolist()):
        where[i].append(j)
    for j, i in enumerate(ids.tolist()):
        number[j] = where[i].pop(0)
    sims, best = index.nearest(rows, found, weights, n, k, without=number)
    near = sims[:, 0] > 0
    w = label_weights[marks]
    if near.any():
        model.calibration = _steps(model.votes(sims, best)[near], marks[near], w[near])
    alone = ~near
    model.base = float((w[alone] * marks[alone]).sum() + base) / float(w[alone].sum() + 1)
    return model


def _squares_of_others(found: DataFrame, total: int) -> DataFrame:
    """(key, more): what terms outside the examples add to the square of a text's length beyond ``alone``, which takes each as of one document."""
    pairs = found.select("key", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("key", F.col("p.terms").alias("term"), F.col("p.counts").alias("n"))
    repeated = materialise(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "toxicity-terms")
    idf = F.greatest(F.log(F.lit(float(total + 1)) / (F.col("df") + 0.5)), F.lit(1e-6))
    changed = repeated.select("term", "df", (idf * idf - float(inverse_frequency(total, np.float64(1))) ** 2).alias("change"))
    # Each occurrence counts as one of a thousand at most, so the frequent terms are few; their pairs are not shuffled by term.
    limit = max(10_000, int(repeated.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]) // HOT_SHARE)
    hot, others = F.broadcast(changed.where(F.col("df") > limit)), changed.where(F.col("df") <= limit)
    joined = pairs.join(hot, "term").unionByName(pairs.join(hot.select("term"), "term", "left_anti").join(others, "term"))
    tf = 1 + F.log(F.col("n").cast("double"))
    return joined.groupBy("key").agg(F.sum(tf * tf * F.col("change")).alias("more"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, k: int = 15) -> DataFrame:
    """Score of every document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``, ``evidence`` (nearest examples, nearest first).

    The search reads text alone. Gives one row per input row; a null or empty text, and one that shares no term with an example, has
    no neighbour and the score of such examples. ``held_out`` is null for a null doc_id, which no label reaches. Rows
    that repeat are scored alike. Without labels every score is 0.5. An empty table gives no rows. Other columns
    are not read.
    """
    model = fit(docs, labels, "toxic", modulus, held_out, k)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
    once = float(inverse_frequency(model.total, np.float64(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions_of(whole, "text")):
            scores, sims, best, known, (rows, terms, counts) = model.score(batch.column("text"))
            evidence = [
                [{"doc_id": int(model.index.ids[b]), "similarity": float(s), "label": int(model.index.labels[b])} for s, b in zip(ss, bb, strict=True) if b >= 0]
                for ss, bb in zip(sims, best, strict=True)
            ]
            alone = np.bincount(rows, ((1 + np.log(counts)) * once) ** 2, minlength=batch.num_rows)
            cuts = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (terms, counts)]
            columns = [batch.column("doc_id"), pa.array(scores), pa.array(evidence, kind), pa.array(known, pa.float64()), pa.array(alone, pa.float64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence", "known", "alone", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    shape = "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double, label: int>>, known double, alone double, terms array<long>, counts array<long>"
    found = rows.mapInArrow(run, shape)
    if len(model.terms):
        found = materialise(found.withColumn("key", F.monotonically_increasing_id()), "toxicity-scores")
        more = _squares_of_others(found, model.total)
        square = F.greatest(F.col("known") + F.col("alone") + F.coalesce("more", F.lit(0.0)), F.col("known"))
        share = F.when(square > 0, F.sqrt(F.col("known") / square)).otherwise(0.0)
        whole = F.transform("evidence", lambda e: e.withField("similarity", e["similarity"] * F.col("share")))
        found = found.drop("terms", "counts").join(more, "key", "left").withColumn("share", share).withColumn("evidence", whole)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out
    return found.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
