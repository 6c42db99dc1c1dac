"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of every whole text are taken in one pass over its bytes.
2. Small trees are grown on labelled rows; every path from the root to a node is a conjunctive rule.
3. A logistic model with an L1 penalty weighs the rules; most weights become zero.
4. The rules that are left are compiled into Spark column expressions, so scoring is a sum of comparisons in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import IS_SPACE, free_name, materialise, portions_of, text_bytes, text_column, words

#: Labelled rows that the trees and weights are fitted to at most, the first by a hash of doc_id.
FIT_ROWS = 20_000
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "mark_share", "symbol_share", "space_share", "high_share", "stop_share",
    "distinct_words", "top_word_share", "repeat_share", "lines_per_word", "distinct_lines", "marked_words", "upper_words", "doubled_marks",
)
#: Bytes that prose has few of (fixed values).
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
MARKS = b"!\"'(),-.:;?"


def _share(flags: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(of, 1)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics per text, in the order of STATISTICS; an empty text has zeros throughout."""
    raw, bounds = text_bytes(column)
    n = np.diff(bounds)
    first, (hashes,) = words(raw, bounds)
    n_words = np.diff(first)
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    marks, symbols = _table(MARKS)[raw], _table(SYMBOLS)[raw]
    letters = np.append(0, np.cumsum(upper | lower))
    letters = letters[bounds[1:]] - letters[bounds[:-1]]
    out = np.zeros((len(n), len(STATISTICS)))
    out[:, 0], out[:, 1] = np.log1p(n), np.log1p(n_words)
    spaces = _share(IS_SPACE[raw], bounds, n)
    out[:, 2] = n * (1 - spaces) / np.maximum(n_words, 1)
    out[:, 3] = _share(upper, bounds, letters)
    out[:, 4] = _share((raw >= 48) & (raw <= 57), bounds, n)
    out[:, 5], out[:, 6], out[:, 7] = _share(marks, bounds, n), _share(symbols, bounds, n), spaces
    out[:, 8] = _share(raw >= 128, bounds, n)
    stops = _table(b".!?")[raw]
    out[:, 9] = _share(stops, bounds, n)
    space = IS_SPACE[raw]
    ends = np.append(space[1:], True) & ~space if len(raw) else space  # last byte of each word
    if len(raw):
        ends[bounds[1:][n > 0] - 1] |= ~space[bounds[1:][n > 0] - 1]
    out[:, 15] = _share(ends & symbols, bounds, n_words)
    begins = np.append(True, space[:-1]) & upper if len(raw) else upper
    second = np.append(upper[1:], False) if len(raw) else upper
    out[:, 16] = _share(begins & second, bounds, n_words)
    same = np.append(False, (raw[1:] == raw[:-1])) & (marks | symbols) if len(raw) else marks
    out[:, 17] = _share(same, bounds, n_words)
    newline = raw == 0x0A
    out[:, 13] = _share(newline, bounds, n_words)
    data = raw.tobytes() if len(raw) else b""
    repeat = np.append(False, hashes[1:] == hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        _, counts = np.unique(hashes[a:b], return_counts=True)
        out[i, 10], out[i, 11], out[i, 12] = len(counts) / (b - a), counts.max() / (b - a), repeat[a + 1 : b].mean() if b - a > 1 else 0.0
        lines = [x for x in data[bounds[i] : bounds[i + 1]].split(b"\n") if x]
        out[i, 14] = len(set(lines)) / max(1, len(lines))
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and one column per statistic; a null text counts as empty."""
    rows = docs.select(*keep, text_column(docs).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions_of(whole, "text")):
            got = text_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(got[:, k]) for k in range(got.shape[1]))], [*keep, *STATISTICS])

    return rows.mapInArrow(run, f"{kinds}, " + ", ".join(f"{s} double" for s in STATISTICS))


# --- rules -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above or not, threshold) with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self, features: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, [features[k] > t if above else features[k] <= t for k, above, t in self.terms])


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights and an intercept."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self, features: list[Column]) -> Column:
        """Probability of label 1 as one column expression."""
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(features), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)")


def tree_paths(description: str) -> list[tuple[tuple[int, bool, float], ...]]:
    """The conditions from the root to every node below it, from the printed form of a tree model."""
    out, path = [], []
    for line in description.splitlines():
        m = _NODE.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (int(m[3]), m[4] == ">", float(m[5]))))
        out.append(tuple(t for _, t in path))
    return out


def _tightest(terms) -> tuple[tuple[int, bool, float], ...]:
    """The same conjunction with one bound a side for each statistic."""
    best: dict[tuple[int, bool], float] = {}
    for k, above, t in terms:
        best[k, above] = max(best.get((k, above), t), t) if above else min(best.get((k, above), t), t)
    return tuple(sorted((k, above, t) for (k, above), t in best.items()))


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 17) -> RuleModel:
    """Fit rules and weights to (label, statistics...) rows.

    Rows without a 0 or 1 label are left out. With one label only, or none, the model has no rules and its score is
    the smoothed share of label 1.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.where(F.col("label").isin(0, 1)).select(F.col("label").cast("double").alias("label"), *STATISTICS)
    known = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(known) < 2:
        share = (known.get(1, 0) + 0.5) / (sum(known.values()) + 1)
        return RuleModel((), float(np.log(share / (1 - share))))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", maxBins=64, minInstancesPerNode=5, seed=seed).fit(vectors)
    found = list(dict.fromkeys(_tightest(p) for p in tree_paths(forest.toDebugString)))
    if not found:
        share = known[1] / sum(known.values())
        return RuleModel((), float(np.log(share / (1 - share))))
    features = [F.col(s) for s in STATISTICS]
    fired = rows.select("label", *[Rule(t).column(features).cast("double").alias(f"rule{k}") for k, t in enumerate(found)])
    fired = VectorAssembler(inputCols=[f"rule{k}" for k in range(len(found))], outputCol="features").transform(fired).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False).fit(fired)
    weights = lasso.coefficients.toArray()
    return RuleModel(tuple(Rule(t, float(w)) for t, w in zip(found, weights, strict=True) if w), float(lasso.intercept))


def train_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label) of the labelled rows that may be learned from, at most ``most`` of them, the first by a hash of doc_id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(fold != held_out)
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("label"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(most)


def fit_on(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most: int = FIT_ROWS) -> RuleModel:
    """Fit to the texts of labelled documents outside the held-out fold. The sample has ``most`` doc_ids, so it may be broadcast."""
    chosen = train_rows(docs, labels, "quality", modulus, held_out, most)
    # `limit` bounds the sample, whatever the size of the tables.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit(materialise(with_statistics(picked.select("doc_id", "text", "label"), ["doc_id", "label"]), "quality-fit"))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Score of every document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``.

    The model reads text alone. Gives one row per input row; a null text counts as empty and is scored. ``held_out`` is
    null for a null doc_id, which no label reaches. Rows that repeat are scored alike. Without labels every score is 0.5. An
    empty table gives no rows. Other columns are not read.
    """
    model = fit_on(docs, labels, modulus, held_out)
    scored = with_statistics(docs, ["doc_id"])
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out
    out = scored.select("doc_id", fold.alias("held_out"), model.score([F.col(s) for s in STATISTICS]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """The rows that are not predicted to be of low quality, with all their columns unchanged."""
    model = fit_on(docs, labels, modulus, held_out)
    packed = free_name(docs, "quality_row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(packed), F.col("text"))
    scored = with_statistics(whole, [packed])
    good = scored.where(model.score([F.col(s) for s in STATISTICS]) >= 0.5)
    return good.select(f"{packed}.*")
