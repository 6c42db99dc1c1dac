"""Mixing sources to target weights: hash-random keys, a sort inside each source, prefix sums of sizes, a cut at the budget.

Targets come first. Sources, in code-point order, get the weights in turn and share the budget by weight, up to a number of
epochs of their own size; what is above that is shared again among the others until nobody is above. The level at which this
ends is found without a loop: with sources sorted by (cap / weight), a source is full if filling all up to its level would not
use up the budget, which needs two prefix sums.

A source is then read in the order of its hash-random keys, whole epochs first and the last one up to the budget. The document
at the cut gives its first words only, so a source gives its budget exactly. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import materialise, text_column
from tarnwell.llm.ordered import random_key, random_order_sums, range_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: A document is taken so many times at most.
EPOCHS = 3
#: Equal rows that are written out by one task at a time.
COPIES_AT_ONCE = 10_000

_SOURCE = ["no_source", "source_name"]


def _sized(docs: DataFrame) -> DataFrame:
    """The source in two columns without nulls, the size and the key of every document."""
    text, source = text_column(docs), docs["source"].cast("string")
    return docs.select(
        docs["doc_id"], source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), random_key(docs["doc_id"], F.md5(text.cast("binary"))).alias("key"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(no_source, source_name, source_size, target, budget) from (no_source, source_name, source_size), one row per source.

    The budget is the target as a whole number of words. Sources without words have target 0.
    """
    if epochs < 1 or not weights or min(weights) < 1:
        raise ValueError("weights and epochs must be positive")
    common = math.lcm(*weights)
    numbered = range_sums(sizes, _SOURCE, {"nth": F.lit(1)}, "mix-sources")
    turn = F.pmod((F.col("nth") - 1).cast("long"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    weighed = numbered.withColumn("weight", weight.cast("long")).drop("nth")
    weighed = weighed.withColumn("level", F.col("source_size").cast("decimal(38,0)") * (F.lit(common) / F.col("weight")).cast("long"))
    levels = range_sums(weighed, ["level", *_SOURCE], {"full_size": F.col("source_size") * epochs, "full_weight": F.col("weight")}, "mix-levels")
    levels = materialise(levels, "mix-filled")
    all_ = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    words, weight_sum = int(all_["words"]), int(all_["weight"])
    used = F.col("full_size") * F.col("weight") + F.col("source_size").cast("decimal(38,0)") * epochs * (F.lit(weight_sum).cast("decimal(38,0)") - F.col("full_weight"))
    full = used <= F.lit(words).cast("decimal(38,0)") * F.col("weight")
    marked = levels.withColumn("full", full)
    left = marked.where("NOT full").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    taken = marked.where("full").agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    rest, weights_left = words - epochs * int(taken["words"]), max(1, int(left["weight"]))
    target = F.when(F.col("full"), (F.col("source_size") * epochs).cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(weights_left)))
    return marked.select(*_SOURCE, F.col("source_size").cast("long").alias("source_size"), target.alias("target")).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Groups of equal rows with the words before them in their source, and what concerns their source."""
    rows = _sized(docs).groupBy(*_SOURCE, "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialise(rows, "mix-rows")
    sizes = rows.groupBy(*_SOURCE).agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = materialise(source_targets(materialise(sizes, "mix-sizes"), weights, epochs), "mix-targets")
    placed = random_order_sums(rows, _SOURCE, ["key", "doc_id", "size"], F.col("size") * F.col("copies"), rows.count(), "before")
    return placed.join(targets, _SOURCE)


def _epochs() -> tuple[Column, Column]:
    """Whole epochs of a source, and words of the last one, from the columns ``budget`` and ``source_size``."""
    budget, source_size = F.col("budget"), F.col("source_size")
    whole = F.when(source_size > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    return whole, budget - whole * source_size


def _between(value: Column, top: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(value, top))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """How many words of every document a mix takes that has as many words as all documents together.

    Gives one row per input row: ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``, ``before`` (words before it
    in the order of its source), ``taken`` (words, repeats counted: at most ``epochs`` times the size). A null text has size 0,
    null sources are one source, the last. Equal rows are combined before any shuffle and stand side by side in the order, so a
    hot group is one row until it is written out; a source with most rows is many tasks. Ties of the random key go by doc_id and
    size. The result depends on the rows alone, not on their order or partitioning. An empty table gives no rows; of other
    columns none is read.
    """
    placed = _mixed(docs, weights, epochs)
    placed = placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES_AT_ONCE}"))))
    many = placed.repartition("key", "doc_id", "lot") if placed.where(F.col("copies") > COPIES_AT_ONCE).limit(1).count() else placed
    last = F.least(F.col("copies") - 1, (F.col("lot") + 1) * COPIES_AT_ONCE - 1)
    single = many.withColumn("copy", F.explode(F.sequence(F.col("lot") * COPIES_AT_ONCE, last)))
    before = F.col("before") + F.col("copy") * F.col("size")
    whole, rest = _epochs()
    return single.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source_name")).alias("source"), "size", "source_size", "target", before.alias("before"),
        (whole * F.col("size") + _between(rest - before, F.col("size"))).alias("taken"),
    )


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: ``doc_id``, ``source``, ``text``, ``times`` (how often the whole text is taken), ``part`` (a cut text besides, or null).

    One row per different (doc_id, source, text); equal rows add up in ``times``. At the cut of a source, ``part`` has the first words
    of the text, joined by one space. Texts without words, and those that the mix does not reach, are absent. Nulls, ties, empty
    tables and further columns are as in ``mix_sources``; a null text is never in the mix.
    """
    placed = _mixed(docs, weights, epochs)
    whole, rest = _epochs()
    words = F.col("size") * F.col("copies")
    last = _between(rest - F.col("before"), words)
    plan = placed.where(F.col("size") > 0).select(
        "doc_id", "key", *_SOURCE, (whole * F.col("copies") + F.floor(last / F.col("size"))).cast("long").alias("times"), (last % F.col("size")).alias("part_words")
    ).where("times > 0 OR part_words > 0")
    one = docs.groupBy(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), text_column(docs).alias("text")).agg(F.lit(1).alias("one"))
    keyed = one.withColumn("key", random_key(F.col("doc_id"), F.md5(F.col("text").cast("binary")))).withColumn("no_source", F.col("source").isNull())
    keyed = keyed.withColumn("source_name", F.coalesce("source", F.lit("")))
    same = reduce(lambda a, b: a & b, [F.col(f"k.{c}") == F.col(f"p.{c}") for c in ("key", *_SOURCE)]) & F.col("k.doc_id").eqNullSafe(F.col("p.doc_id"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("part_words").cast("int")), " ")
    return keyed.alias("k").join(plan.alias("p"), same).select("k.doc_id", "source", "text", "times", F.when(F.col("part_words") > 0, cut).alias("part"))
