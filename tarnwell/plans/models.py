"""Model steps as injected functions, with deterministic local defaults.

An embedder is a function from a list of texts to a matrix; an extractor is a function from
a documents frame to the same frame with a ``raw`` struct, ``stage`` and ``error``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.functions import text as tx
from tarnwell.operators.dedup import dedup_apply
from tarnwell.settings import INDEX

Embedder = Callable[[list[str]], np.ndarray]
Extractor = Callable[[DataFrame], DataFrame]

_WORD = re.compile(r"[^\W_]+")

RAW_FIELDS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("article_type", T.StringType()),
        T.StructField("primary_topic", T.StringType()),
        *[
            T.StructField(n, T.ArrayType(T.StringType()))
            for n in ("primary_specific", "primary_generic", "secondary_entities", "acronyms", "usecase")
        ],
        T.StructField("article_title", T.StringType()),
        T.StructField("kb_id", T.StringType()),
        T.StructField("primary_intent", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("query_triggers", T.ArrayType(T.StringType())),
        T.StructField("secondary_mentions", T.ArrayType(T.StringType())),
    ]
)


def hash_embedder(dim: int = INDEX.vector_dim) -> Embedder:
    """Feature hashing: a word adds one to the component its md5 names."""

    def slot(word: str) -> int:
        return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % dim

    def embed(texts: list[str]) -> np.ndarray:
        found = [_WORD.findall(text.lower()) for text in texts]
        words = list(chain.from_iterable(found))
        known = {word: slot(word) for word in set(words)}  # of one batch
        slots = np.fromiter((known[w] for w in words), np.int64, len(words))
        rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        return np.bincount(rows * dim + slots, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)

    return embed


def embedding_column(embed: Embedder):
    """Arrow function from a text column to its vectors; blank texts and zero vectors are null."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            usable = [t or "" for t in texts.to_pylist()]
            matrix = np.asarray(embed(usable), dtype=np.float32)
            if len(matrix) != len(usable):
                raise ValueError(f"expected {len(usable)} vectors, got {len(matrix)}")
            dim = matrix.shape[1] if len(usable) else 0
            empty = ~matrix.any(axis=1) | np.array([not t.strip() for t in usable], dtype=bool)
            offsets = np.arange(len(usable) + 1, dtype=np.int32) * dim
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()), mask=pa.array(empty))

    return vectors


def embed_terms(
    df: DataFrame, text: str, embed: Embedder | None = None, name: str = "embedding", row_id: list[str] | None = None
) -> DataFrame:
    """Add the vector of a text column.

    The local default is cheap and runs in place, without a shuffle. A given embedder is
    taken to be costly: each distinct text is embedded once and joined back to its copies,
    which ``row_id`` spreads when a text is very frequent.
    """
    if embed is None:
        return df.withColumn(name, embedding_column(hash_embedder())(F.col(text)))
    column = embedding_column(embed)
    done = dedup_apply(
        df, text, lambda u: u.select("content_hash", column(F.col(text)).alias(name)), row_id or [text]
    )
    return done.drop("content_hash")


def local_extractor(docs: DataFrame) -> DataFrame:
    """Names, long words, acronyms, numbered models and sentences found in the whole body, all of them.

    How many are kept is for the normaliser to say. ``docs``: doc_key, title, content. Everything is an expression, so no Python runs.
    """
    body = F.coalesce(F.col("content"), F.lit(""))

    def found(pattern: str):
        return tx.distinct_ignoring_case(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))

    sentences = F.filter(F.transform(F.split(body, r"[.\n]+"), lambda s: tx.clean_phrase(s)), lambda s: s != "")
    words = F.array_distinct(F.filter(tx.tokenize(body), lambda w: F.length(w) >= 8))
    raw = F.struct(
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("article_type"),
        tx.clean_phrase("title").alias("primary_topic"),
        found(r"\p{Lu}[\p{Ll}\p{Lu}0-9]*[\p{Lu}0-9][\p{L}0-9]*").alias("primary_specific"),
        words.alias("primary_generic"),
        found(r"\p{Lu}\p{Ll}+[ -]\d+").alias("secondary_entities"),
        found(tx.ACRONYM_PATTERN).alias("acronyms"),
        F.array_distinct(sentences).alias("usecase"),
        tx.clean_phrase("title").alias("article_title"),
        F.col("doc_key").alias("kb_id"),
        F.lit(None).cast("string").alias("primary_intent"),
        tx.clean_phrase(F.element_at(F.concat(sentences, F.array(F.lit(""))), 1)).alias("summary"),
        words.alias("query_triggers"),
        found(tx.ACRONYM_PATTERN).alias("secondary_mentions"),
    )
    return docs.select("*", raw.cast(RAW_FIELDS).alias("raw"), F.lit("completed").alias("stage"), F.lit(None).cast("string").alias("error"))


def pandas_extractor(fn: Callable[[pd.DataFrame], pd.DataFrame]) -> Extractor:
    """Wrap a batch function: doc_key, title, content in; doc_key, raw, stage, error out.

    A batch that raises is not lost: its documents come out with the error and the stage.
    """

    def extract(docs: DataFrame) -> DataFrame:
        schema = T.StructType(
            [*docs.schema.fields, T.StructField("raw", RAW_FIELDS), T.StructField("stage", T.StringType()), T.StructField("error", T.StringType())]
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                try:
                    yield batch.merge(fn(batch[["doc_key", "title", "content"]]), on="doc_key", how="left")
                except Exception as exc:  # the outcome ladder reports it per document
                    yield batch.assign(raw=None, stage="extraction", error=str(exc))

        return docs.mapInPandas(run, schema)

    return extract


def extract_items(docs: DataFrame, key: str = "doc_id", body: str = "content") -> DataFrame:
    """Names that appear verbatim: capitalised phrases and model numbers, in text order."""
    pattern = r"\p{Lu}[\p{L}0-9]+(?: \p{Lu}[\p{L}0-9]+)+|\p{Lu}[\p{L}]*\d[\p{L}0-9]*"
    found = F.regexp_extract_all(F.coalesce(F.col(body), F.lit("")), F.lit(pattern), F.lit(0))
    return docs.select("*", F.posexplode(found).alias("ord", "item")).withColumn("item", tx.normalize_name("item"))
