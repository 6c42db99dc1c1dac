"""Sync, sharding, catalogue, document assembly and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.functions import text as tx
from tarnwell.operators import dedup, layout, shards, sync
from tarnwell.plans import catalogue as cat
from tarnwell.plans import index as ix
from tarnwell.plans.models import extract_items, local_extractor
from tarnwell.registry import query
from tarnwell.registry.inputs import (
    BASE_SECONDS,
    INDEX_STATE_SQL,
    KEYWORDS_SQL,
    LIVE_SQL,
    SOURCE_SQL,
    index_state,
    keyword_frame,
    live_documents,
    source_documents,
    table,
)
from tarnwell.registry.text_queries import DOC_KEY_SQL, clean_sql, dedupe_sql, index_generic_sql, phrase_list_sql, phrase_sql
from tarnwell.sources import readers, sinks

_DIFF_SQL = f"""{SOURCE_SQL}, {LIVE_SQL}, {INDEX_STATE_SQL},
diff AS (
  SELECT coalesce(l.doc_key, i.doc_key) AS doc_key, CASE WHEN i.doc_key IS NULL THEN 'new' WHEN l.doc_key IS NULL THEN 'deleted'
    WHEN l.updated_s > i.updated_s THEN 'updated' ELSE 'unchanged' END AS label
  FROM live l FULL JOIN index_state i ON l.doc_key = i.doc_key)"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    return sync.snapshot_diff(live_documents(spark, sf), index_state(spark, sf))


@query("snapshot_diff", f"WITH {_DIFF_SQL} SELECT doc_key, label FROM diff")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf).select("doc_key", "label")


@query("sync_counts", f"WITH {_DIFF_SQL} SELECT label, count(*) AS n FROM diff GROUP BY label")
def sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sync.diff_counts(_diff(spark, sf))


@query("purge_guard", f"WITH {_DIFF_SQL} SELECT doc_key, label FROM diff WHERE label <> 'deleted'")
def purge_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Two guarded syncs: an empty source keeps the index, a normal one deletes as it should."""
    state = index_state(spark, sf)
    kept = sync.purge_guard(_diff(spark, sf), state, sampled=True)
    emptied = sync.snapshot_diff(live_documents(spark, sf).where(F.lit(False)), state)
    none_left = sync.purge_guard(emptied, state).select("doc_key", "label")
    return kept.select("doc_key", "label").unionByName(none_left)


@query("diff_preview", f"WITH {_DIFF_SQL} SELECT doc_key, label, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_key) AS r FROM diff) WHERE r <= 10")
def diff_preview(spark: SparkSession, sf: str) -> DataFrame:
    return sync.preview(_diff(spark, sf), 10).select("doc_key", "label", F.col("place").cast("long").alias("place"))


@query("key_sets", f"WITH {_DIFF_SQL} SELECT doc_key, CASE label WHEN 'new' THEN 'only source' WHEN 'deleted' THEN 'only index' ELSE 'both' END AS side FROM diff")
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = live_documents(spark, sf).select("doc_key"), index_state(spark, sf).select("doc_key")
    return (
        a.exceptAll(b).withColumn("side", F.lit("only source"))
        .unionByName(b.join(a, "doc_key", "left_anti").withColumn("side", F.lit("only index")))
        .unionByName(a.intersect(b).withColumn("side", F.lit("both")))
    )


@query(
    "existing_keys",
    f"""WITH {_DIFF_SQL} SELECT l.doc_key, i.doc_key IS NOT NULL AS exists, i.shard_id AS existing_shard_id
    FROM live l LEFT JOIN index_state i ON i.doc_key = l.doc_key""",
)
def existing_keys(spark: SparkSession, sf: str) -> DataFrame:
    return sync.existing_keys(live_documents(spark, sf).select("doc_key"), index_state(spark, sf))


@query(
    "source_scan",
    f"WITH {SOURCE_SQL} SELECT id, number, name, collection AS kb_collection_id, length(content) AS n FROM source WHERE collection = 'src3' AND org_id = 'en' AND NOT is_deleted",
)
def source_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.source_documents(source_documents(spark, sf), "src3", "en")
    return rows.select("id", "number", "name", "kb_collection_id", F.length("content").cast("long").alias("n"))


@query(
    "latest_source",
    f"""WITH {SOURCE_SQL}, keyed AS (SELECT CASE WHEN n = 1 THEN id ELSE k END AS doc_key, id, s FROM (
      SELECT md5(content) AS k, id, CAST({BASE_SECONDS} + (doc_id % 7) * 60 AS BIGINT) AS s, count(*) OVER (PARTITION BY md5(content)) AS n FROM source))
    SELECT doc_key, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY s DESC, id DESC) AS r FROM keyed) WHERE r = 1""",
)
def latest_source(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of one text are versions of one document: the newest stays."""
    from pyspark.sql import Window as W

    s = source_documents(spark, sf).withColumn("k", F.md5(F.col("content").cast("binary")))
    counts = s.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    keyed = s.join(counts, "k").select(
        F.when(F.col("n") == 1, F.col("id")).otherwise(F.col("k")).alias("doc_key"), "id",
        F.timestamp_seconds(F.lit(BASE_SECONDS) + (F.col("doc_id") % 7) * 60).alias("updated_at"),
    )
    return sync.latest_source(keyed).select("doc_key", "id")


@query(
    "usable_articles",
    f"WITH {SOURCE_SQL} SELECT {DOC_KEY_SQL} AS doc_key, md5(c) AS digest FROM (SELECT *, {clean_sql('content')} AS c FROM source) WHERE trim(c) <> ''",
)
def usable_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = source_documents(spark, sf).withColumn("doc_key", tx.doc_key("number", "name", "id"))
    return sync.usable_articles(rows).select("doc_key", F.md5(F.col("content").cast("binary")).alias("digest"))


# The number of documents per source and the labelled ones stand for a registry that is partly full.
_REGISTRY_SQL = """
reg AS (SELECT source AS kb_collection_id, (doc_id % 4)::INTEGER AS shard_id, least(count(*), 9) AS doc_count, 9 + (doc_id % 4) AS max_shard_size
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source, doc_id % 4)"""


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return known.groupBy(F.col("source").alias("kb_collection_id"), (F.col("doc_id") % 4).cast("int").alias("shard_id")).agg(
        F.least(F.count(F.lit(1)), F.lit(9)).cast("int").alias("doc_count"), (F.lit(9) + F.max(F.col("doc_id") % 4)).cast("int").alias("max_shard_size")
    )


_ASSIGN_SQL = f"""{_REGISTRY_SQL},
slots AS (SELECT kb_collection_id, shard_id, greatest(0, max_shard_size - doc_count) AS free,
  sum(greatest(0, max_shard_size - doc_count)) OVER (PARTITION BY kb_collection_id ORDER BY shard_id) AS slot_end FROM reg),
tot AS (SELECT kb_collection_id, sum(free) AS total_free, max(shard_id) AS last_shard FROM slots GROUP BY ALL),
docs AS (SELECT source AS kb_collection_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
assigned AS (
  SELECT d.kb_collection_id, d.doc_id, coalesce(s.shard_id, coalesce(t.last_shard, -1) + 1 + floor((d.p - coalesce(t.total_free, 0) - 1) / 12.0))::INTEGER AS shard_id
  FROM docs d LEFT JOIN tot t ON t.kb_collection_id = d.kb_collection_id
  LEFT JOIN slots s ON s.kb_collection_id = d.kb_collection_id AND d.p > s.slot_end - s.free AND d.p <= s.slot_end)"""


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    docs = new.select(F.col("source").alias("kb_collection_id"), "doc_id")
    return shards.assign_shards(docs, _registry(spark, sf), "doc_id", max_size=12)


@query("shard_assign", f"WITH {_ASSIGN_SQL} SELECT kb_collection_id, doc_id, shard_id FROM assigned")
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select("kb_collection_id", "doc_id", "shard_id")


@query(
    "shard_utilisation",
    f"""WITH {_ASSIGN_SQL}, a AS (SELECT kb_collection_id, shard_id, count(*) AS n FROM assigned GROUP BY ALL)
    SELECT coalesce(r.kb_collection_id, a.kb_collection_id) AS kb_collection_id, coalesce(r.shard_id, a.shard_id) AS shard_id,
      coalesce(r.doc_count, 0) + coalesce(a.n, 0) AS doc_count,
      round_even((coalesce(r.doc_count, 0) + coalesce(a.n, 0)) * 100.0 / coalesce(r.max_shard_size, 12), 1)::DOUBLE AS utilisation_pct
    FROM reg r FULL JOIN a ON a.kb_collection_id = r.kb_collection_id AND a.shard_id = r.shard_id""",
)
def shard_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    updated = shards.update_registry(_registry(spark, sf), _assigned(spark, sf), 12)
    return shards.shard_utilisation(updated).select("kb_collection_id", "shard_id", F.col("doc_count").cast("long").alias("doc_count"), "utilisation_pct")


@query(
    "release_slots",
    f"""WITH {_REGISTRY_SQL}, gone AS (SELECT source, doc_id % 4 AS shard_id, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY ALL)
    SELECT r.kb_collection_id, r.shard_id, greatest(0, r.doc_count - coalesce(g.n, 0)) AS doc_count
    FROM reg r LEFT JOIN gone g ON g.source = r.kb_collection_id AND g.shard_id = r.shard_id""",
)
def release_slots(spark: SparkSession, sf: str) -> DataFrame:
    removed = table(spark, sf, "documents").where("lang = 'es'").select(F.col("source").alias("kb_collection_id"), (F.col("doc_id") % 4).cast("int").alias("shard_id"))
    return shards.release_slots(_registry(spark, sf), removed).select("kb_collection_id", "shard_id", F.col("doc_count").cast("long").alias("doc_count"))


@query("shard_ids", f"WITH {_REGISTRY_SQL} SELECT DISTINCT shard_id FROM reg UNION ALL SELECT 0 WHERE (SELECT count(*) FROM reg) = 0")
def shard_ids(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_shard_ids(_registry(spark, sf))


# --- enrichment ------------------------------------------------------------------------------


def _raw_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_key"), F.col("source").alias("kb_collection_id"), F.floor(F.col("doc_id") / 200).cast("int").alias("shard_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
    )


_RAW_SQL = r"""
raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_key, source AS kb_collection_id, split_part(text, chr(10), 1) AS title, text AS content,
    regexp_extract_all(text, '[A-Z][a-z]{5,}') AS spec, regexp_extract_all(text, '[a-z]{9,}') AS gen, string_split(text, '.') AS uses,
    regexp_extract_all(text, '[A-Z][a-z]+, [a-z]+') AS ents, lang FROM documents)"""


def _metadata(docs: DataFrame) -> DataFrame:
    """Raw metadata with lists found by plain patterns, so that SQL can find the same."""
    found = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(0))
    blank = F.lit(None).cast("string")
    raw = F.struct(
        F.when(F.col("shard_id") % 2 == 0, "hardware").alias("category"), F.lit("policy").alias("article_type"), blank.alias("primary_topic"),
        found("[A-Z][a-z]{5,}").alias("primary_specific"), found("[a-z]{9,}").alias("primary_generic"), found("[A-Z][a-z]+, [a-z]+").alias("secondary_entities"),
        F.array().cast("array<string>").alias("acronyms"), F.split("content", r"\.").alias("usecase"), blank.alias("article_title"), F.col("doc_key").alias("kb_id"),
        blank.alias("primary_intent"), blank.alias("summary"), found("[a-z]{9,}").alias("query_triggers"), found("[A-Z][a-z]+, [a-z]+").alias("secondary_mentions"),
    )
    return docs.withColumn("raw", raw).withColumn("stage", F.lit("completed")).withColumn("error", blank)


_SPEC = phrase_list_sql("spec", 12)
_GEN = phrase_list_sql("gen", 12, True)
_LOOKS = "(regexp_matches(t, '\\d|[A-Z]{2,}') OR (regexp_matches(t, '\\S\\s+\\S') AND regexp_matches(t, '(^|\\s)\\p{Lu}')))"


@query(
    "normalize_metadata",
    f"""WITH {_RAW_SQL}, lists AS (SELECT *, {_SPEC} AS s12, {_GEN} AS g12 FROM raw),
    split AS (SELECT *, list_concat(list_filter(s12, lambda t: {_LOOKS}), list_filter(g12, lambda t: {_LOOKS})) AS named,
      list_concat(list_transform(list_filter(s12, lambda t: NOT {_LOOKS}), lambda t: lower(t)), list_filter(g12, lambda t: NOT {_LOOKS})) AS plain,
      regexp_extract_all(title, '[A-Za-z0-9][A-Za-z0-9\\-\\._]{{2,}}')[1:5] AS words FROM lists),
    fin AS (SELECT *, CASE WHEN len({dedupe_sql('named')}) > 0 THEN {dedupe_sql('named')}[1:10] ELSE {dedupe_sql('words')} END AS sp,
      {index_generic_sql('plain')}[1:12] AS ge FROM split)
    SELECT doc_key, array_to_string(sp, '|') AS specific,
      array_to_string(CASE WHEN len(ge) > 0 THEN ge WHEN len({index_generic_sql('sp')}) > 0 THEN {index_generic_sql('sp')}[1:8] ELSE ['it support'] END, '|') AS generic,
      array_to_string({phrase_list_sql('ents', 12)}[1:10], '|') AS entities,
      array_to_string(CASE WHEN len({phrase_list_sql('uses', 8, True)}) > 0 THEN {phrase_list_sql('uses', 8, True)} ELSE ['help with ' || lower(coalesce(nullif({phrase_sql('title')}, ''), 'support article'))] END, '|') AS usecases,
      coalesce(nullif({phrase_sql('title')}, ''), doc_key) AS topic, CASE WHEN (doc_key::BIGINT // 200) % 2 = 0 THEN 'Hardware' ELSE 'Software' END AS category, 'Policy/Process' AS article_type
    FROM fin""",
)
def normalize_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = ix.normalize_metadata(_metadata(_raw_docs(spark, sf)))
    return rows.select(
        "doc_key", F.array_join("primary_specific", "|").alias("specific"), F.array_join("primary_generic", "|").alias("generic"),
        F.array_join("secondary_entities", "|").alias("entities"), F.array_join("usecases", "|").alias("usecases"),
        F.col("primary_topic").alias("topic"), "category", "article_type",
    )


@query(
    "normalize_summary",
    f"""WITH {_RAW_SQL} SELECT doc_key, {phrase_sql('title')} AS article_title, 'Help with ' || coalesce(nullif({phrase_sql('title')}, ''), 'this KB') AS primary_intent,
      'This KB provides guidance related to: ' || coalesce(nullif({phrase_sql('title')}, ''), 'this article') || '.' AS summary,
      array_to_string(CASE WHEN len({_GEN}) > 0 THEN {_GEN} WHEN {phrase_sql('title')} <> '' THEN [lower({phrase_sql('title')})] ELSE ['help with this issue'] END, ', ') AS query_triggers,
      array_to_string({phrase_list_sql('ents', 10)}, ', ') AS secondary_mentions FROM raw""",
)
def normalize_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = ix.summary_rows(ix.normalize_summary(_metadata(_raw_docs(spark, sf))))
    return rows.select(F.col("doc_id").alias("doc_key"), F.col("article_title"), "primary_intent", "summary", "query_triggers", "secondary_mentions")


@query(
    "keyword_rows",
    f"""WITH {_RAW_SQL}, lists AS (SELECT doc_key, {phrase_list_sql('uses', 8, True)} AS u, {phrase_list_sql('ents', 12)}[1:10] AS e, title FROM raw)
    SELECT doc_key AS kbid, unnest(CASE WHEN len(u) > 0 THEN u ELSE ['help with ' || lower(coalesce(nullif({phrase_sql('title')}, ''), 'support article'))] END) AS usecase, NULL AS secondary_entity FROM lists
    UNION ALL SELECT doc_key, NULL, unnest(e) FROM lists""",
)
def keyword_rows(spark: SparkSession, sf: str) -> DataFrame:
    enriched = ix.enrich_documents(_raw_docs(spark, sf), _metadata)
    rows = ix.keyword_rows(enriched, with_vectors=False)
    return rows.where("usecase IS NOT NULL OR secondary_entity IS NOT NULL").select("kbid", "usecase", "secondary_entity")


@query("enrich_documents")
def enrich_documents(spark: SparkSession, sf: str) -> DataFrame:
    done = ix.enrich_documents(_raw_docs(spark, sf), local_extractor)
    return done.select(
        "doc_key", "category", "article_type", F.size("primary_specific").alias("specific"), F.size("primary_generic").alias("generic"),
        F.size("usecases").alias("usecases"), "stage", "error",
    )


@query("embed_terms")
def embed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of every document, embedded once per distinct text."""
    from tarnwell.plans.models import embed_terms as embed
    from tarnwell.plans.models import hash_embedder
    from tarnwell.registry.inputs import sentences

    rows = embed(sentences(table(spark, sf, "documents")), "term", hash_embedder(64), row_id=["doc_id"])
    return rows.select("doc_id", "term", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("words"))


@query(
    "keyword_rollup",
    f"""WITH {KEYWORDS_SQL} SELECT kbid, md5(string_agg(DISTINCT CASE WHEN kind = 'specific' THEN trim(term) END, ', ' ORDER BY CASE WHEN kind = 'specific' THEN trim(term) END)) AS names,
      count(DISTINCT CASE WHEN kind = 'usecase' THEN trim(term) END) AS usecases, max(primary_topic) AS topic, max(category) AS category FROM kw GROUP BY kbid""",
)
def keyword_rollup(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.plans.retrieval import keyword_rollup as roll

    k = keyword_frame(spark, sf, False)
    counts = k.groupBy("kbid").agg(F.count_distinct(F.trim("usecase")).alias("n_usecases"))
    return roll(k).join(counts, "kbid").select(
        "kbid", F.md5(F.col("specific_keywords").cast("binary")).alias("names"), F.col("n_usecases").alias("usecases"), F.col("primary_topic").alias("topic"), "category"
    )


@query(
    "article_outcome",
    f"""WITH {_DIFF_SQL} SELECT l.doc_key, CASE WHEN length(trim(d.text)) < 40 THEN 'failed' WHEN d.n_chars % 9 = 0 THEN 'failed' WHEN i.doc_key IS NOT NULL THEN 'updated' ELSE 'inserted' END AS outcome,
      CASE WHEN length(trim(d.text)) < 40 THEN 'content missing' WHEN d.n_chars % 9 = 0 THEN 'failed at summary: broken' END AS reason
    FROM live l JOIN documents d ON CAST(d.doc_id AS VARCHAR) = l.doc_key LEFT JOIN index_state i ON i.doc_key = l.doc_key""",
)
def article_outcome(spark: SparkSession, sf: str) -> DataFrame:
    rows = sync.existing_keys(live_documents(spark, sf), index_state(spark, sf))
    broken = F.col("n_chars") % 9 == 0
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), "n_chars")
    batch = rows.join(d, "doc_key").withColumns({
        "content": F.when(F.length(F.trim("content")) < 40, " ").otherwise(F.col("content")),
        "error": F.when(broken, "broken"), "stage": F.when(broken, "summary").otherwise("completed"),
    })
    return sync.article_outcome(batch).select("doc_key", "outcome", "reason")


_OUTCOMES_SQL = """
o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'inserted' WHEN 'O' THEN 'updated' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'skipped' END END AS outcome FROM orders)"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    other = F.when(F.col("o_orderpriority") == "1-URGENT", "failed").otherwise("skipped")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_key"), F.when(status == "F", "inserted").when(status == "O", "updated").otherwise(other).alias("outcome"),
        F.col("o_orderpriority").alias("reason"), F.lit("completed").alias("stage"), F.col("o_custkey").cast("string").alias("kbid"),
    )


@query(
    "outcome_stats",
    f"""WITH {_OUTCOMES_SQL} SELECT count(*) AS total, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated,
      count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome <> 'failed') AS successful FROM o""",
)
def outcome_stats(spark: SparkSession, sf: str) -> DataFrame:
    return sync.outcome_stats(_outcomes(spark, sf))


@query(
    "trace_summary",
    f"""WITH {_OUTCOMES_SQL} SELECT count(*) AS total, count(*) FILTER (outcome IN ('inserted', 'updated')) AS success, count(*) FILTER (outcome = 'failed') AS failed,
      count(*) FILTER (outcome = 'skipped') AS skipped, 0::BIGINT AS deleted FROM o""",
)
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(BASE_SECONDS))
    return sync.trace_summary(sinks.trace_rows(_outcomes(spark, sf), now))


@query(
    "trace_details",
    """SELECT CAST(o_custkey AS VARCHAR) AS kbid, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'skipped' END AS status, o_orderpriority AS reason, count(*) AS n
    FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY ALL""",
)
def trace_details(spark: SparkSession, sf: str) -> DataFrame:
    return sync.trace_details(_outcomes(spark, sf).withColumnRenamed("outcome", "status"))


@query("sync_job")
def sync_job(spark: SparkSession, sf: str) -> DataFrame:
    """A whole sync of the documents against an index that holds the labelled ones: articles by outcome, and rows of each table after it."""
    state = index_state(spark, sf).join(
        table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.col("source").alias("kb_collection_id")), "doc_key"
    )
    summaries = schemas.align(state.withColumn("doc_id", F.col("doc_key")), schemas.KB_SUMMARIES)
    keywords = schemas.align(state.withColumn("kbid", F.col("doc_key")), schemas.KB_KEYWORDS)
    registry = state.groupBy("kb_collection_id", "shard_id").agg(F.count(F.lit(1)).cast("int").alias("doc_count")).withColumn("max_shard_size", F.lit(200))
    source = source_documents(spark, sf).withColumn("number", F.lit(None).cast("string")).withColumn("name", F.lit("plain"))
    out = ix.sync_job(source, keywords, summaries, registry)
    counts = out.outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    for name, after in (("keywords", out.keywords), ("summaries", out.summaries), ("registry", out.registry)):
        counts = counts.unionByName(after.agg(F.lit(f"rows of {name}").alias("outcome"), F.count(F.lit(1)).alias("n")))
    return counts


@query(
    "sample_documents",
)
def sample_documents(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.ranking import sample_n

    return sample_n(live_documents(spark, sf), "doc_key", 250, 7).select("doc_key")


# --- catalogue --------------------------------------------------------------------------------

_ITEM = r"[A-Z][a-z]+ [A-Z][a-z]+|[A-Z][a-z]+"
_ITEMS_SQL = rf"""
items AS (
  SELECT source, doc_id, doc_id * 100000 + i AS ord, m[i] AS item, lang AS purpose, m[i + 1] AS method
  FROM (SELECT source, doc_id, lang, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT source, doc_id, lang, regexp_extract_all(text, '{_ITEM}') AS m FROM documents)))"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("m", F.regexp_extract_all("text", F.lit(_ITEM), F.lit(0)))
    return d.select("source", "doc_id", "lang", "m", F.posexplode("m").alias("i", "item")).select(
        "source", "doc_id", (F.col("doc_id") * 100000 + F.col("i") + 1).alias("ord"), "item", F.col("lang").alias("purpose"), F.get("m", F.col("i") + 1).alias("method")
    )


@query(
    "consolidate_items",
    f"""WITH {_ITEMS_SQL} SELECT source, lower(item) AS item_key, arg_min(item, ord) AS item,
      arg_min(coalesce(purpose, ''), struct_pack(n := -length(coalesce(purpose, '')), o := ord)) AS purpose,
      arg_min(coalesce(method, ''), struct_pack(n := -length(coalesce(method, '')), o := ord)) AS method FROM items GROUP BY source, lower(item)""",
)
def consolidate_items(spark: SparkSession, sf: str) -> DataFrame:
    return cat.consolidate_items(_items(spark, sf), ["source"])


@query(
    "extraction_counts",
    f"""WITH {_ITEMS_SQL} SELECT source, count(DISTINCT doc_id) AS records, count(DISTINCT doc_id) FILTER (purpose <> 'de') AS success,
      count(DISTINCT doc_id) FILTER (purpose = 'de') AS errors, count(DISTINCT doc_id) AS valid_json, count(DISTINCT lower(item)) AS unique_items FROM items GROUP BY source""",
)
def extraction_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _items(spark, sf).withColumn("status", F.when(F.col("purpose") == "de", "error").otherwise("success"))
    return cat.extraction_counts(rows, ["source"])


_EXTRACT_SQL = r"\p{Lu}[\p{L}0-9]+(?: \p{Lu}[\p{L}0-9]+)+|\p{Lu}[\p{L}]*\d[\p{L}0-9]*"


@query("extract_items", f"SELECT doc_id, count(*) AS n, count(DISTINCT item) AS names FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EXTRACT_SQL}')) AS item FROM documents) GROUP BY doc_id")
def extract_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract_items(table(spark, sf, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("names"))


@query("build_catalogue")
def build_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.registry.inputs import summary_frame

    return cat.build_catalogue(summary_frame(spark, sf))["items"]


@query(
    "load_catalogue",
    """SELECT n_name AS kb_collection_id, n_nationkey AS shard_id, p_name AS item FROM nation n JOIN (
      SELECT DISTINCT p_size % 25 AS k, p_name FROM part) p ON p.k = n.n_nationkey""",
)
def load_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand for items: even nations are in the unified table, odd ones only in the older one."""
    items = table(spark, sf, "part").select((F.col("p_size") % 25).alias("shard_id"), F.col("p_name").alias("item"), F.lit("").alias("purpose"), F.lit("").alias("method")).distinct()
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("kb_collection_id"), F.col("n_nationkey").alias("shard_id"))
    rows = cat.catalogue_rows(items.join(nations, "shard_id"))
    unified = cat.replace_scope(rows.where("shard_id % 2 = 0").withColumn("data", F.lit("[]")), rows.where("shard_id % 2 = 0"))
    legacy = rows.where("shard_id % 2 = 1").select("shard_id", "data")
    return cat.load_catalogue(nations, unified, legacy).where("item IS NOT NULL").select("kb_collection_id", "shard_id", "item")


@query("sorted_items", f"WITH {_ITEMS_SQL} SELECT DISTINCT lower(item) AS item_key, source FROM items")
def sorted_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select(F.lower("item").alias("item_key"), "source").distinct().orderBy(F.lower("item_key"), F.asc_nulls_last("source"))


# --- copies and layout ---------------------------------------------------------------------------


@query("dedup_hash_join", "SELECT doc_id, md5(text) AS content_hash, length(text) AS n, upper(lang) AS lang FROM documents")
def dedup_hash_join(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.upper("lang").alias("lang"))
    done = dedup.dedup_apply(d, "text", lambda u: u.select("content_hash", F.length("text").cast("long").alias("n")), ["doc_id"])
    return done.select("doc_id", "content_hash", "n", "lang")


@query(
    "occurrences",
    "SELECT md5(text) AS content_hash, source, doc_id, count(*) OVER w AS copies, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1 AS is_first FROM documents WINDOW w AS (PARTITION BY md5(text))",
)
def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.occurrences(table(spark, sf, "documents"), "text", ["source", "doc_id"])


@query("cap_per_doc", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3")
def cap_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.cap_per_doc(table(spark, sf, "lineitem"), ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 3)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


# Every sentence of a document is a line; its y grows with the length of the lines before it.
_LINES_SQL = r"""
parts AS (SELECT doc_id, unnest(a) AS content, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[.\n]+') AS a FROM documents)),
lines AS (SELECT doc_id, i, trim(content) AS content, CAST(i * 10 + length(content) % 7 + (i // 5) * 30 AS DOUBLE) AS y, i % 6 = 0 AS is_image FROM parts)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"[.\n]+")).alias("i0", "content")).withColumn("i", F.col("i0") + 1)
    y = F.col("i") * 10 + F.length("content") % 7 + F.floor(F.col("i") / 5) * 30
    return p.select("doc_id", "i", F.trim("content").alias("content"), y.cast("double").alias("y"), F.lit(0.0).alias("x"), (F.col("i") % 6 == 0).alias("is_image"))


@query(
    "merge_layout",
    f"""WITH {_LINES_SQL}, sized AS (SELECT doc_id, count(*) FILTER (NOT is_image) AS n, min(y) FILTER (NOT is_image) AS a, max(y) FILTER (NOT is_image) AS b FROM lines GROUP BY doc_id),
    gaps AS (SELECT l.doc_id, content, y, is_image, y - lag(y) OVER w AS gap, row_number() OVER w AS r, CASE WHEN n >= 2 THEN (b - a) / (n - 1) ELSE 15 END AS usual
      FROM lines l JOIN sized s ON s.doc_id = l.doc_id WHERE content <> '' WINDOW w AS (PARTITION BY l.doc_id ORDER BY y, is_image, content))
    SELECT doc_id, md5(string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > usual * 1.5 THEN chr(10) || chr(10) ELSE ' ' END || content, '' ORDER BY r)) AS digest FROM gaps GROUP BY doc_id""",
)
def merge_layout(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.merge_layout(_lines(spark, sf), ["doc_id"])
    return rows.select("doc_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    "words_to_lines",
    r"""WITH w AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents)),
    p AS (SELECT doc_id, word, CAST((i // 8) * 12 + i % 3 AS DOUBLE) AS y, CAST(i AS DOUBLE) AS x FROM w),
    g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x, word) >= 5 THEN 1 ELSE 0 END AS opened FROM p),
    n AS (SELECT *, sum(opened) OVER (PARTITION BY doc_id ORDER BY y, x, word ROWS UNBOUNDED PRECEDING) AS line FROM g)
    SELECT doc_id, round(avg(y), 6) AS y, min(x) AS x, string_agg(word, ' ' ORDER BY x, y, word) AS content FROM n GROUP BY doc_id, line""",
)
def words_to_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i0", "text")).withColumn("i", F.col("i0") + 1)
    words = w.select("doc_id", "text", (F.floor(F.col("i") / 8) * 12 + F.col("i") % 3).cast("double").alias("y"), F.col("i").cast("double").alias("x"))
    return layout.words_to_lines(words, ["doc_id"]).withColumn("y", F.round("y", 6))


@query(
    "margin_images",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_quantity < 50 AND l_linenumber * 20 < 50) AND l_returnflag <> 'R' AND l_linestatus <> 'X'
      AND (l_extendedprice / 100 + l_linenumber * 10) / 1000 BETWEEN 0.08 AND 0.92""",
)
def margin_images(spark: SparkSession, sf: str) -> DataFrame:
    top = F.col("l_extendedprice") / 100
    images = table(spark, sf, "lineitem").withColumns({
        "x0": F.lit(0.0), "x1": F.col("l_quantity"), "y0": top, "y1": top + F.col("l_linenumber") * 20, "page_height": F.lit(1000.0),
        "has_content": F.col("l_returnflag") != "R", "is_decorative": F.col("l_linestatus") == "X",
    })
    return layout.filter_margin_images(images).select("l_orderkey", "l_linenumber", "l_partkey")


@query("document_assembly")
def document_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and described images become pages, pages become documents."""
    lines = _lines(spark, sf).withColumn("page_no", F.floor(F.col("i") / 40).cast("int"))
    described = dedup.dedup_apply(
        lines.where("is_image"), "content", lambda u: u.select("content_hash", F.concat(F.lit("[Image: "), F.col("content"), F.lit("]")).alias("told")), ["doc_id", "i"]
    )
    images = layout.cap_per_doc(described, ["doc_id"], [F.asc("content_hash"), F.asc("i")], 50)
    elements = lines.where(~F.col("is_image")).select("doc_id", "page_no", "y", "x", "content", "is_image").unionByName(
        images.select("doc_id", "page_no", "y", "x", F.col("told").alias("content"), "is_image")
    )
    pages = layout.merge_layout(elements, ["doc_id", "page_no"])
    return layout.join_pages(pages, "doc_id")


# --- tables -------------------------------------------------------------------------------------


@query("align_schema", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS kb_collection_id, CAST(0 AS INTEGER) AS shard_id, length(text) AS n, NULL::VARCHAR AS summary FROM documents")
def align_schema(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("kb_collection_id"), F.col("text").alias("content"))
    shaped = schemas.align(d, schemas.KB_SUMMARIES, {"shard_id": 0})
    return shaped.select("doc_id", "kb_collection_id", "shard_id", F.length("content").cast("long").alias("n"), "summary")


@query("scan_columns", "SELECT doc_id, source AS picked, text FROM documents")
def scan_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    slim = schemas.existing_columns(d, ["doc_id", "title", "source", "text"])
    return slim.select("doc_id", schemas.first_column(d, ["collection", "source"]).alias("picked"), "text")


@query("scoped_summaries", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS summary, text AS content FROM documents WHERE source = 'src4' AND doc_id // 200 = 1")
def scoped_summaries(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.registry.inputs import summary_frame

    return readers.read_summaries(summary_frame(spark, sf), "src4", 1)


@query("index_state_scan", f"WITH {INDEX_STATE_SQL} SELECT doc_key AS doc_id, updated_s FROM index_state")
def index_state_scan(spark: SparkSession, sf: str) -> DataFrame:
    s = index_state(spark, sf).withColumn("kb_collection_id", F.lit("c")).withColumnRenamed("doc_key", "doc_id")
    return readers.index_state(s, "c").select("doc_id", F.unix_seconds("updated_at").alias("updated_s"))


@query("labelled_cases", "SELECT CAST(item_id AS VARCHAR) AS expected_kb, 'generic' AS query_type, unnest(string_split(text, ',')) AS query FROM benchmark UNION ALL SELECT CAST(item_id AS VARCHAR), 'specific', unnest(string_split(text, '.')) FROM benchmark")
def labelled_cases(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("KB_number"), F.lit(None).cast("string").alias("name"),
        F.split("text", ",").alias("generic_queries"), F.split("text", r"\.").alias("specific_queries"),
    )
    return readers.labelled_cases(b).select("expected_kb", "query_type", "query")


@query(
    "upsert_summaries",
    f"""WITH {INDEX_STATE_SQL}, nw AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS n FROM documents WHERE lang = 'en')
    SELECT coalesce(nw.doc_id, i.doc_key) AS doc_id, coalesce(i.updated_s, {BASE_SECONDS}) AS created_s, nw.n FROM nw FULL JOIN index_state i ON i.doc_key = nw.doc_id""",
)
def upsert_summaries(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.plans.state import upsert_keep_created

    now = F.timestamp_seconds(F.lit(BASE_SECONDS))
    old = index_state(spark, sf).select(F.col("doc_key").alias("doc_id"), F.lit(None).cast("string").alias("content"), F.col("updated_at").alias("created_at"), "updated_at")
    new = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    rows = upsert_keep_created(old, new, ["doc_id"], [F.desc("seq")], now)
    return rows.select("doc_id", F.unix_seconds("created_at").alias("created_s"), F.length("content").cast("long").alias("n"))


@query("delete_by_key", f"WITH {INDEX_STATE_SQL} SELECT doc_key, shard_id FROM index_state WHERE doc_key NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'es')")
def delete_by_key(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.inventory import cascade_delete

    gone = table(spark, sf, "documents").where("lang = 'es'").select(F.col("doc_id").cast("string").alias("doc_key"))
    return cascade_delete(index_state(spark, sf), gone, "doc_key").select("doc_key", "shard_id")


@query("keyword_table_form", f"WITH {KEYWORDS_SQL} SELECT kbid, shard_id, count(*) AS n FROM kw GROUP BY ALL")
def keyword_table_form(spark: SparkSession, sf: str) -> DataFrame:
    rows = sinks.prepare_keyword_rows(keyword_frame(spark, sf))
    return rows.groupBy("kbid", "shard_id").agg(F.count(F.lit(1)).alias("n"))


@query("report_lines", "SELECT 'Document ID: ' || doc_id || chr(10) || 'Status: ' || lang || chr(10) || 'Valid JSON: ' || CASE WHEN n_chars > 500 THEN 'True' ELSE 'False' END || chr(10) || repeat('-', 40) || chr(10) || source || chr(10) || repeat('-', 80) AS value FROM documents")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report_lines(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("status"), (F.col("n_chars") > 500).alias("json_valid"), F.col("source").alias("response")))
