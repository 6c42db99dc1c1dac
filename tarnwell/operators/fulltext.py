"""Weighted full-text matching of a query table against a document table.

A query text is read as web search syntax: words must all occur, a quoted phrase must be
contiguous, ``or`` separates alternatives, ``-`` excludes. Every alternative is looked up by its rarest word only, and
the remaining conditions are checked on the candidate documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions.text import ColumnLike, col, search_text
from tarnwell.operators.skew import salted_join
from tarnwell.session import materialise
from tarnwell.settings import LABEL_WEIGHTS

_ITEM = r'-?"[^"]*"|\S+'
_OR_OUTSIDE_QUOTES = r'(?i)\s+or\s+(?=(?:[^"]*"[^"]*")*[^"]*$)'


def search_document(df: DataFrame, fields: dict[str, str], name: str = "fts") -> DataFrame:
    """Add the searchable form: one lower-case token string and the label runs in it.

    ``fields`` maps columns to labels A to D, in the order their tokens are numbered.
    ``<name>_text`` is blank-padded so that a word or phrase is found by containment, and
    ``<name>_fields`` is a list of (label, tokens).
    """
    parts = F.array(
        *[F.struct(F.lit(label).alias("label"), search_text(c).alias("tokens")) for c, label in fields.items()]
    )
    kept = F.filter(parts, lambda p: p["tokens"] != "")
    joined = F.concat_ws(" ", *[F.nullif(search_text(c), F.lit("")) for c in fields])
    return df.withColumn(f"{name}_fields", kept).withColumn(f"{name}_text", F.concat(F.lit(" "), joined, F.lit(" ")))


def token_index(df: DataFrame, keys: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row per token occurrence: keys, token, pos (over all fields, from 1), label."""
    doc = search_document(df, fields)
    labelled = F.flatten(
        F.transform(
            F.col("fts_fields"),
            lambda p: F.transform(F.split(p["tokens"], " "), lambda t: F.struct(t.alias("token"), p["label"].alias("label"))),
        )
    )
    return doc.select(*keys, F.posexplode(labelled).alias("_at", "_t")).select(
        *keys, F.col("_t.token").alias("token"), (F.col("_at") + 1).alias("pos"), F.col("_t.label").alias("label")
    )


def postings(doc: DataFrame, keys: Sequence[str], name: str = "fts") -> DataFrame:
    """Distinct (token, keys) pairs of a frame made by ``search_document``."""
    tokens = F.array_distinct(F.split(F.trim(F.col(f"{name}_text")), " "))
    return doc.select(*keys, F.explode(tokens).alias("token")).where(F.col("token") != "")


def search_clauses(queries: DataFrame, query_id: str, text: str, exclude_only: bool = False) -> DataFrame:
    """One row per alternative of a query: required words and phrases, excluded ones.

    A word with inner punctuation is a phrase of its parts. An alternative that only excludes is kept if wanted: an index
    can answer it, ``fts_match`` has nothing to look up for it.
    """
    alternatives = queries.select(
        query_id, F.posexplode(F.split(F.trim(F.col(text)), _OR_OUTSIDE_QUOTES)).alias("alternative", "_clause")
    )
    items = F.regexp_extract_all(F.col("_clause"), F.lit(_ITEM), F.lit(0))
    negated = F.filter(items, lambda x: F.startswith(x, F.lit("-")))
    positive = F.filter(items, lambda x: ~F.startswith(x, F.lit("-")))

    def forms(xs: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(xs, lambda x: search_text(x)), lambda x: x != ""))

    return (
        alternatives.select(query_id, "alternative", forms(positive).alias("required"), forms(negated).alias("excluded"))
        .where((F.size("required") > 0) | (F.lit(exclude_only) & (F.size("excluded") > 0)))
        .withColumn(
            "terms",
            F.array_distinct(F.flatten(F.transform(F.col("required"), lambda p: F.split(p, " ")))),
        )
    )


def fts_match(
    clauses: DataFrame,
    doc: DataFrame,
    query_id: str,
    keys: Sequence[str],
    carry: Sequence[str] = (),
    name: str = "fts",
    salts: int = 16,
) -> DataFrame:
    """Matching (query, document) pairs with the terms they matched on.

    Each alternative takes the one of its words found in fewest documents, joins that
    word's postings (spread over salts), and then reads the candidate documents to test
    every word, phrase and exclusion by containment.

    The wanted words, their postings and the candidates are written tables, so Spark knows their sizes: words and
    candidates that are small enough are broadcast, and then neither a posting that nobody asks for nor
    the body of a document is shuffled. Documents are tokenised once.
    """
    wanted = clauses.select(query_id, "alternative", F.explode("terms").alias("token"))
    words = materialise(wanted.select("token").distinct(), "fts-words")
    found = materialise(postings(doc, keys, name).join(words, "token", "left_semi"), "fts-postings")
    frequency = found.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    # A word no document holds rules its alternative out, hence the left join and the null check.
    rarest = (
        wanted.join(frequency, "token", "left")
        .groupBy(query_id, "alternative")
        .agg(
            F.min_by("token", F.struct("_df", "token")).alias("token"),
            F.count_if(F.col("_df").isNull()).alias("_absent"),
        )
        .where(F.col("_absent") == 0)
        .drop("_absent")
    )
    candidates = materialise(salted_join(rarest, found, ["token"], keys, salts).select(query_id, "alternative", *keys), "fts-candidates")
    with_terms = candidates.join(clauses, [query_id, "alternative"])
    bodies = doc.join(candidates.select(*keys).distinct(), list(keys), "left_semi")
    checked = with_terms.join(bodies.select(*keys, f"{name}_text", f"{name}_fields", *carry), list(keys))
    text = F.col(f"{name}_text")

    def holds(p: Column) -> Column:
        return F.contains(text, F.concat(F.lit(" "), p, F.lit(" ")))

    return checked.where(
        F.forall("required", holds) & ~F.exists("excluded", holds)
    ).select(query_id, "alternative", "terms", *keys, f"{name}_fields", *carry)


def label_weight(label: ColumnLike) -> Column:
    value = col(label)
    chain = F.when(value == "A", LABEL_WEIGHTS["A"])
    for name in ("B", "C", "D"):
        chain = chain.when(value == name, LABEL_WEIGHTS[name])
    return chain.otherwise(0.0)


def weighted_hits(fields: ColumnLike, terms: ColumnLike) -> Column:
    """Sum of the label weights of the matched token occurrences."""
    wanted = col(terms)
    return F.aggregate(
        col(fields),
        F.lit(0.0),
        lambda acc, p: acc
        + label_weight(p["label"])
        * F.size(F.filter(F.split(p["tokens"], " "), lambda t: F.array_contains(wanted, t))),
    )


def cover_density(hits: Sequence[tuple[int, int, float]], n_terms: int) -> float:
    """Cover density of one document from its hits (position, term number, weight).

    A cover is a shortest stretch holding every term. It adds the harmonic mean weight of
    the hits inside it, divided by one plus the number of other words inside.
    """
    last = [-1] * n_terms
    total, previous_start = 0.0, -1
    for i, (pos, term, _) in enumerate(hits):
        last[term] = i
        start = min(last)
        if start < 0 or start == previous_start:
            continue
        previous_start = start
        inside = hits[start : i + 1]
        harmonic = len(inside) / sum(1.0 / w for _, _, w in inside)
        noise = (pos - hits[start][0]) - (len(inside) - 1)
        total += harmonic / (1.0 + max(noise, 0))
    return total


def term_hits(labels: Sequence[str], tokens: Sequence[str], terms: Sequence[str]) -> list[tuple[int, int, float]]:
    """Hits (position, term number, weight) over the fields of one document."""
    number = {t: i for i, t in enumerate(terms)}
    hits, pos = [], 0
    for label, text in zip(labels, tokens):
        for word in text.split(" "):
            if word in number:
                hits.append((pos, number[word], LABEL_WEIGHTS.get(label, 0.0)))
            pos += 1
    return hits


@F.pandas_udf(T.DoubleType())
def _cover_rank(labels: pd.Series, tokens: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([cover_density(term_hits(l, x, t), len(t)) for l, x, t in zip(labels, tokens, terms)], dtype="float64")


def cover_density_rank(fields: ColumnLike, terms: ColumnLike) -> Column:
    """Cover density rank; runs on matched pairs only, so it sees few rows per query."""
    return _cover_rank(col(fields)["label"], col(fields)["tokens"], col(terms))


RANKERS = {"hits": weighted_hits, "cover": cover_density_rank}
