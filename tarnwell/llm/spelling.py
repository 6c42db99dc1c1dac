"""Spelling variants: words one letter apart, found in a trie of letter-group counts, and the form each of them stands for.

The letters of the vocabulary are dealt into groups, about equally frequent. A word is the vector of how many of its letters
each group has; the vectors of all words, count by count, are a trie. One inserted letter raises one count by one; one replaced
letter raises one count and lowers another, or changes none. So a depth-first search from a word goes on along equal counts and
may spend one surplus and one deficit. Surpluses come first: a replacement that lowers the earlier count is found from the other
word, a deletion from the shorter word; each pair is met once. The words of the leaves reached are compared letter by letter.

Spark deals the trie out by its first levels: the length of a word and as many counts as make the largest part small enough. Each
part of the trie is one group; words travel to the parts that their budget reaches, with what of it is spent. A leaf that is too large
even with all counts is cut by halves of its words, one of which survives any single change.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import materialise, text_column

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letter groups, so many levels has the trie below the length.
GROUPS = 16
#: Words of one part of the trie at most, as long as there are counts left to split by.
PART_WORDS = 4_000
#: A leaf with more words is entered by halves of words.
PLAIN_LEAF = 16

_ASKED = "part string, word string, n long, state int"
_PAIRS = "a string, a_n long, b string, b_n long"


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, slip: int = 199) -> DataFrame:
    """(word, n): words of at least so many letters and occurrences, counted over whole texts.

    A run of letters is lower-cased (A-Z only). Where ``slip`` divides the CRC-32 h of ``<doc_id>:<run>``, the run loses its code
    point h % length: planted misspellings. Null texts have no words; a null doc_id is written as nothing before the colon.
    """
    runs = docs.select(docs["doc_id"], F.explode(F.regexp_extract_all(text_column(docs), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[str, int]:
    """The group of each letter: the most frequent letters first, each into the group with the fewest occurrences so far."""
    counts = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    load, found = [0] * groups, {}
    for r in sorted(counts, key=lambda r: (-r["count"], r["letter"])):
        found[r["letter"]] = load.index(min(load))
        load[found[r["letter"]]] += r["count"]
    return found


def counts_of(words: list[str], group: dict[str, int], groups: int) -> np.ndarray:
    """The vector of each word: letters of each group."""
    out = np.zeros((len(words), groups), np.int32)
    table = np.zeros(max([ord(c) for c in group], default=0) + 1, np.int64)
    for letter, g in group.items():
        table[ord(letter)] = g
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    np.add.at(out, (np.repeat(np.arange(len(words)), lengths), table[points]), 1)
    return out


def one_apart(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one longer, has exactly one letter replaced or inserted."""
    i, end = 0, len(a)
    while i < end and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(b) > end else i < end and a[i + 1 :] == b[i + 1 :]


def _reachable(counts: tuple[int, ...], longer: bool):
    """(counts, state) of the first levels that a word with these counts may go to; the state says what is spent: 0 nothing, 1 the surplus, 2 both."""
    yield counts, 0
    for i in range(len(counts)):
        up = counts[:i] + (counts[i] + 1,) + counts[i + 1 :]
        yield up, 1
        if not longer:
            for j in range(i + 1, len(counts)):
                if up[j]:
                    yield up[:j] + (up[j] - 1,) + up[j + 1 :], 2


class Trie:
    """The words of a part, sorted by their vectors: a node is a stretch of words that agree in the counts so far."""

    def __init__(self, words: list[str], vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1]) if vectors.shape[1] else np.arange(len(words))
        self.words, self.order, self.vectors = [words[i] for i in order], order, vectors[order]

    def near(self, asked: list[str], asked_vectors: np.ndarray, states: np.ndarray):
        """(number of the asked word, number of a word) of all pairs of which the second is one replacement or insertion away."""
        stack = [(0, 0, len(self.words), np.arange(len(asked)), states)]
        levels = self.vectors.shape[1]
        while stack:
            level, lo, hi, who, state = stack.pop()
            if not len(who):
                continue
            if level == levels or (self.vectors[lo, level:] == self.vectors[hi - 1, level:]).all():
                alive, state = self._spent(self.vectors[lo, level:] - asked_vectors[who, level:], state)
                yield from self._leaf(lo, hi, asked, who[alive], state[alive])
                continue
            column = self.vectors[lo:hi, level]
            cuts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
            for at, to in zip(cuts, np.append(cuts[1:], hi - lo), strict=True):
                alive, after = self._spent((column[at] - asked_vectors[who, level])[:, None], state)
                stack.append((level + 1, lo + int(at), lo + int(to), who[alive], after[alive]))

    @staticmethod
    def _spent(steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked words can go these steps, and what they have spent then."""
        up, down = steps == 1, steps == -1
        ups, downs = up.sum(axis=1), down.sum(axis=1)
        alive = (np.abs(steps) <= 1).all(axis=1) & (ups <= (state == 0)) & (downs <= 1) & ((downs == 0) | (state + ups == 1))
        both = alive & (ups == 1) & (downs == 1)
        if both.any():
            alive &= ~both | (np.argmax(up, axis=1) < np.argmax(down, axis=1))
        return alive, state + ups + downs

    def _leaf(self, lo: int, hi: int, asked: list[str], who: np.ndarray, state: np.ndarray):
        length = len(self.words[lo]) if lo < hi else 0
        halves: dict[int, tuple[dict, dict]] = {}
        for q, s in zip(who.tolist(), state.tolist(), strict=True):
            a = asked[q]
            if length - len(a) != (s == 1):
                continue  # the budget was not spent as the lengths need it
            if hi - lo <= PLAIN_LEAF:
                others = range(lo, hi)
            else:
                h = len(a) // 2
                if len(a) not in halves:
                    halves[len(a)] = (defaultdict(list), defaultdict(list))
                    for k in range(lo, hi):
                        halves[len(a)][0][self.words[k][:h]].append(k)
                        halves[len(a)][1][self.words[k][length - len(a) + h :]].append(k)
                first, second = halves[len(a)]
                others = {*first.get(a[:h], ()), *second.get(a[h:], ())}
            for k in others:
                b = self.words[k]
                if (s or a < b) and one_apart(a, b):
                    yield q, int(self.order[k])


def _part_sizes(words: DataFrame, group: dict[str, int], groups: int) -> tuple[int, set[str]]:
    """How many counts besides the length make up a part, and the parts that stay too large with all counts."""
    letters = ["".join(c for c in group if group[c] == g) for g in range(groups)]
    counts = [(F.length("word") - F.length(F.translate("word", x, ""))).alias(f"c{g}") if x else F.lit(0).alias(f"c{g}") for g, x in enumerate(letters)]
    vectors = words.select(F.length("word").alias("len"), *counts)
    vectors = materialise(vectors.groupBy(*vectors.columns).count(), "spelling-vectors")
    for depth in range(groups + 1):
        by = ["len", *[f"c{g}" for g in range(depth)]]
        large = vectors.groupBy(*by).agg(F.sum("count").alias("n")).where(F.col("n") > PART_WORDS)
        if depth == groups:
            return depth, {_name(r["len"], tuple(r[c] for c in by[1:])) for r in large.collect()}
        if large.isEmpty():
            return depth, set()
    raise AssertionError


def _name(length: int, counts: tuple[int, ...]) -> str:
    return ",".join(map(str, (length, *counts)))


def near_words(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(a, a_n, b, b_n): every pair of different words of (word, n) that are one insertion, deletion or replacement apart, once.

    ``words`` holds each word once; an empty one gives no pairs. ``b`` is as long as ``a`` or one letter longer.
    """
    group = letter_groups(words, groups)
    depth, large = _part_sizes(words, group, groups)

    def deal(batches):
        for batch in batches:
            names, numbers = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            out: list[tuple[str, str, int, int]] = []
            for word, n, vector in zip(names, numbers, counts_of(names, group, groups).tolist(), strict=True):
                first = tuple(vector[:depth])
                own, m = _name(len(word), first), len(word)
                if own not in large:
                    out.append((own, word, n, -1))
                else:  # under both halves, for asking words of the same length and for those one shorter
                    for q in (m, m - 1):
                        out += [(f"{own}|{q}<{word[: q // 2]}", word, n, -1), (f"{own}|{q}>{word[m - q + q // 2 :]}", word, n, -1)]
                for longer in (False, True):
                    for counts, state in _reachable(first, longer):
                        part = _name(m + longer, counts)
                        if part not in large:
                            out.append((part, word, n, state))
                        else:
                            out += [(f"{part}|{m}<{word[: m // 2]}", word, n, state), (f"{part}|{m}>{word[m // 2 :]}", word, n, state)]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)], ["part", "word", "n", "state"])

    def search(key, table):
        states = table.column("state").to_numpy()
        names, numbers = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
        own, asking = np.flatnonzero(states < 0), np.flatnonzero(states >= 0)
        pairs = []
        if len(own) and len(asking):
            mine, asked = names[own].tolist(), names[asking].tolist()
            trie = Trie(mine, counts_of(mine, group, groups)[:, depth:])
            pairs = list(trie.near(asked, counts_of(asked, group, groups)[:, depth:], states[asking].astype(np.int64)))
        part = key[0].as_py()
        if part.partition("|")[2].lstrip("0123456789").startswith(">"):  # equal first halves were met there
            pairs = [(q, w) for q, w in pairs if asked[q][: len(asked[q]) // 2] != mine[w][: len(asked[q]) // 2]]
        q, w = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        a, b = asking[q] if len(q) else q, own[w] if len(w) else w
        return pa.table({
            "a": pa.array(names[a].tolist(), pa.string()), "a_n": pa.array(numbers[a], pa.int64()),
            "b": pa.array(names[b].tolist(), pa.string()), "b_n": pa.array(numbers[b], pa.int64()),
        })

    return words.select("word", "n").mapInArrow(deal, _ASKED).groupBy("part").applyInArrow(search, _PAIRS)


def spelling_forms(words: DataFrame, ratio: int = 5, groups: int = GROUPS) -> DataFrame:
    """The form and the root of every word of (word, n).

    Two words are near if one inserted, deleted or replaced letter makes one of the other. The form of a word is its near word
    with the largest n, ties to the smallest word by code points, if that has at least ``ratio`` times the word's n, else null. The
    root follows the forms to the last. Gives ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``. As counts rise along
    forms, their number bounds the rounds of pointer doubling. An empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be two at least")
    words = materialise(words.select("word", "n"), "spelling-words")
    pairs = materialise(near_words(words, groups), "spelling-pairs")
    both = pairs.select("a", F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    formed = joined.select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")
    )
    formed = materialise(formed, "spelling-forms")
    top = words.agg(F.max("n").alias("n")).first()["n"] or 1
    steps = max(1, math.floor(math.log(max(top, 2), ratio)) + 1)
    up = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        further = up.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        up = materialise(up.join(further, up["root"] == further["at"], "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, slip: int = 199) -> DataFrame:
    """``spelling_forms`` of the ``vocabulary`` of documents; copies of texts count as often as they occur, other columns are not read."""
    return spelling_forms(vocabulary(docs, least_length, least_count, slip), ratio)
