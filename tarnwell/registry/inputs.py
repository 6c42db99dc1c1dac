"""Input frames of the registered queries, derived from the whole test tables.

Each frame has its SQL form beside it; the ``*_SQL`` texts are CTE bodies for the twins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import text as tx
from tarnwell.operators.textindex import TextIndex, open_index
from tarnwell.plans.models import embed_terms
from tarnwell.session import work_dir
from tarnwell.sources.readers import spread_small

BASE_SECONDS = 1_704_067_200  # 2024-01-01 UTC


# Tables with long texts, and their keys.
_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_small(df, _TEXT_KEYS[name]) if name in _TEXT_KEYS else df


# --- source documents and index state -------------------------------------------------------

SOURCE_SQL = f"""
source AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id,
    CASE WHEN doc_id % 3 = 0 THEN 'kb 0' || doc_id WHEN doc_id % 3 = 1 THEN 'Kb-' || doc_id END AS number,
    CASE WHEN doc_id % 2 = 0 THEN 'KB-0' || doc_id || '_' ELSE '' END
      || split_part(text, chr(10), 1)
      || CASE WHEN n_chars % 7 = 0 THEN chr(160) || chr(8211) || ' Scenario ' || (n_chars % 10) ELSE '' END
      || CASE WHEN n_chars % 2 = 0 THEN '.pdf' ELSE '' END AS name,
    CAST({BASE_SECONDS} + doc_id * 3600 AS BIGINT) AS updated_s,
    lang = 'es' AS is_deleted, source AS collection, lang AS org_id, text AS content
  FROM documents)"""


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("kb 0"), doc)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Kb-"), doc))
    name = F.concat(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("KB-0"), doc, F.lit("_"))).otherwise(""),
        F.substring_index("text", "\n", 1),
        F.when(F.col("n_chars") % 7 == 0, F.concat(F.lit(" – Scenario "), (F.col("n_chars") % 10).cast("string"))).otherwise(""),
        F.when(F.col("n_chars") % 2 == 0, ".pdf").otherwise(""),
    )
    return d.select(
        doc.alias("id"), "doc_id", number.alias("number"), name.alias("name"),
        F.timestamp_seconds(F.lit(BASE_SECONDS) + F.col("doc_id") * 3600).alias("updated_at"),
        (F.col("lang") == "es").alias("is_deleted"),
        F.col("source").alias("knowledgebase_collection_id"), F.col("lang").alias("org_id"), F.col("text").alias("content"),
    )


# The labelled documents stand for what is already indexed; the times differ by the labels.
INDEX_STATE_SQL = f"""
index_state AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS doc_key,
    CAST({BASE_SECONDS} + l.doc_id * 3600 + (quality - toxic * 2) * 60 - 30 AS BIGINT) AS updated_s,
    CAST(l.doc_id // 200 AS INTEGER) AS shard_id
  FROM labels l)"""


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    at = F.lit(BASE_SECONDS) + F.col("doc_id") * 3600 + (F.col("quality") - F.col("toxic") * 2) * 60 - 30
    return l.select(
        F.col("doc_id").cast("string").alias("doc_key"), F.timestamp_seconds(at).alias("updated_at"),
        F.floor(F.col("doc_id") / 200).cast("int").alias("shard_id"),
    )


LIVE_SQL = "live AS (SELECT id AS doc_key, updated_s FROM source WHERE NOT is_deleted)"


def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_documents(spark, sf_dir).where(~F.col("is_deleted"))
    return rows.select(F.col("id").alias("doc_key"), "updated_at", "content")


# --- the index: sentences, capitalised words and acronyms of every document ---------------------

SENTENCES_SQL = r"""
sentences AS (
  SELECT DISTINCT doc_id, lower(trim(regexp_replace(s, '\s+', ' ', 'g'), ' ,;:-')) AS term
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]+')) AS s FROM documents)
  WHERE trim(regexp_replace(s, '\s+', ' ', 'g'), ' ,;:-') <> '')"""


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    parts = docs.select(key, F.explode(F.split(text, r"[.\n]+")).alias("s"))
    return parts.select(key, F.lower(tx.clean_phrase("s")).alias("term")).where(F.col("term") != "").distinct()


KEYWORDS_SQL = SENTENCES_SQL + r""",
names AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS term FROM documents),
kw AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS kbid, CAST(d.doc_id // 200 AS INTEGER) AS shard_id,
    CASE d.lang WHEN 'en' THEN 'Software' WHEN 'de' THEN 'Hardware' ELSE 'Both' END AS category,
    'How-To' AS article_type, d.source AS primary_topic, k.kind, k.term
  FROM documents d JOIN (
    SELECT doc_id, 'usecase' AS kind, term FROM sentences
    UNION ALL SELECT doc_id, 'specific', term FROM names) k ON d.doc_id = k.doc_id)"""


def keyword_frame(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """Wide keyword rows: every distinct sentence as a use case, every long name as specific."""
    d = table(spark, sf_dir, "documents")
    attributes = d.select(
        "doc_id", F.col("doc_id").cast("string").alias("kbid"), F.floor(F.col("doc_id") / 200).cast("int").alias("shard_id"),
        F.col("source").alias("kb_collection_id"),
        F.when(F.col("lang") == "en", "Software").when(F.col("lang") == "de", "Hardware").otherwise("Both").alias("category"),
        F.lit("How-To").alias("article_type"), F.col("source").alias("primary_topic"), "text",
    )
    keep = [c for c in attributes.columns if c not in ("doc_id", "text")]
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
    lines = F.array_distinct(
        F.filter(F.transform(F.split("text", r"[.\n]+"), lambda s: F.lower(tx.clean_phrase(s))), lambda s: s != "")
    )

    def tagged(kind: str, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("term")))

    rows = attributes.select(*keep, F.explode(F.concat(tagged("usecase", lines), tagged("specific", names))).alias("k")).select(
        *keep, "k.kind", "k.term"
    )
    if with_vectors:
        rows = embed_terms(rows, "term")
    empty_text = F.lit(None).cast("string")
    out = rows.select(
        *keep,
        F.when(F.col("kind") == "specific", F.col("term")).alias("specific_keyword"),
        empty_text.alias("generic_keyword"),
        F.when(F.col("kind") == "usecase", F.col("term")).alias("usecase"),
        empty_text.alias("secondary_entity"), empty_text.alias("acronym"),
        *([] if not with_vectors else [
            F.when(F.col("kind") == "specific", F.col("embedding")).alias("specific_keyword_embedding"),
            F.lit(None).cast("array<float>").alias("generic_keyword_embedding"),
            F.when(F.col("kind") == "usecase", F.col("embedding")).alias("usecase_embedding"),
            F.lit(None).cast("array<float>").alias("secondary_entity_embedding"),
            F.lit(None).cast("array<float>").alias("acronym_embedding"),
        ]),
    )
    return out


SUMMARIES_SQL = r"""
sm AS (
  SELECT CAST(doc_id AS VARCHAR) AS kbid, CAST(doc_id // 200 AS INTEGER) AS shard_id,
    split_part(text, chr(10), 1) AS primary_intent, lang AS query_triggers, text AS content, source AS secondary_mentions
  FROM documents)"""


def summary_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("kb_collection_id"),
        F.floor(F.col("doc_id") / 200).cast("int").alias("shard_id"),
        first.alias("article_title"), first.alias("primary_intent"), F.col("lang").alias("query_triggers"),
        F.col("source").alias("secondary_mentions"), F.lit("").alias("summary"), F.col("text").alias("content"),
    )


# --- stored full-text indexes ------------------------------------------------------------------

_STORED: dict[tuple[str, str, str], str] = {}


def stored_folder(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> str:
    """A folder made of a table folder by the first query of the application that asks for it."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _STORED:
        root = work_dir(spark, name)
        build(root)
        _STORED[at] = root
    return _STORED[at]


def stored_index(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], TextIndex]) -> TextIndex:
    """A stored full-text index of a table folder."""
    return open_index(spark, stored_folder(spark, sf_dir, f"{name}-index", build))


# --- query units: every sentence of every benchmark passage -------------------------------------

UNITS_SQL = r"""
units AS (
  SELECT item_id || ':' || md5(term) AS unit_id, item_id AS query_id, term AS query_text, 8 AS top_k, 'software' AS wanted
  FROM (SELECT DISTINCT item_id, lower(trim(regexp_replace(s, '\s+', ' ', 'g'), ' ,;:-')) AS term
        FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.\n]+')) AS s FROM benchmark))
  WHERE term <> '')"""


def unit_frame(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    b = sentences(table(spark, sf_dir, "benchmark"), "item_id")
    units = b.select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.md5(F.col("term").cast("binary"))).alias("unit_id"),
        F.col("item_id").alias("query_id"), F.lit("usecase").alias("term_group"), F.lit("usecase").alias("kind"),
        F.col("term").alias("query_text"), F.lit("software").alias("category"), F.lit(8).alias("top_k"),
    )
    return embed_terms(units, "query_text") if with_vectors else units


# Term vectors by feature hashing, kept sparse: (key, slot, value) and the squared length.
def vectors_sql(name: str, source: str, key: str, text: str) -> str:
    return rf"""
{name}_tok AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS tok FROM {source}),
{name}_slot AS (
  SELECT {key}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS slot, CAST(count(*) AS DOUBLE) AS v FROM {name}_tok GROUP BY ALL),
{name}_len AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}_slot GROUP BY ALL)"""


# Full-text form of a text, and how a twin counts weighted hits.
def fts_text_sql(expr: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({expr}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
