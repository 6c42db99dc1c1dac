"""Building and syncing the knowledge index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.functions import text as tx
from tarnwell.operators import shards, sync
from tarnwell.operators.ranking import sample_n
from tarnwell.plans.models import Embedder, Extractor, embed_terms, local_extractor
from tarnwell.plans.retrieval import KIND_COLUMNS
from tarnwell.session import materialise
from tarnwell.settings import INDEX, IndexSettings
from tarnwell.sources.store import Affected, Change, Store, TableSpec

_TITLE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-\._]{2,}"


def _first_text(*options: Column | str) -> Column:
    """First option that is a non-blank phrase."""
    return F.coalesce(*[F.nullif(tx.clean_phrase(o), F.lit("")) for o in options])


def _split_terms(specific: Column, generic: Column) -> tuple[Column, Column]:
    """Terms that look specific, and the rest in lower case."""
    named = F.concat(F.filter(specific, tx.looks_specific), F.filter(generic, tx.looks_specific))
    plain = F.concat(
        F.transform(F.filter(specific, lambda t: ~tx.looks_specific(t)), lambda t: F.lower(t)),
        F.filter(generic, lambda t: ~tx.looks_specific(t)),
    )
    return named, plain


def normalize_metadata(df: DataFrame) -> DataFrame:
    """Index-side clean-up of extracted metadata (``raw``), with fallbacks from the title.

    Adds category, article_type, primary_topic and the five term lists, each capped.
    """
    steps = df.withColumn("_spec", tx.clean_phrase_list("raw.primary_specific", 12)).withColumn(
        "_gen", tx.clean_phrase_list("raw.primary_generic", 12, lowercase=True)
    )
    named, plain = _split_terms(F.col("_spec"), F.col("_gen"))
    steps = (
        steps.withColumn("primary_specific", F.slice(tx.distinct_ignoring_case(named), 1, 10))
        .withColumn("primary_generic", F.slice(tx.index_generic_terms(plain), 1, 12))
        .withColumn("secondary_entities", F.slice(tx.clean_phrase_list("raw.secondary_entities", 12), 1, 10))
        .withColumn("acronyms", F.slice(tx.clean_phrase_list("raw.acronyms", 12), 1, 10))
        .withColumn("usecases", tx.clean_phrase_list("raw.usecase", 8, lowercase=True))
    )
    title_words = F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(_TITLE_TOKEN), F.lit(0))
    steps = steps.withColumn(
        "primary_specific",
        F.when(F.size("primary_specific") > 0, F.col("primary_specific")).otherwise(
            tx.distinct_ignoring_case(F.slice(title_words, 1, 5))
        ),
    ).withColumn("_from_spec", F.slice(tx.index_generic_terms("primary_specific"), 1, 8))
    topic = F.coalesce(_first_text("raw.primary_topic", "title"), F.lit("support article"))
    return (
        steps.withColumn(
            "primary_generic",
            F.when(F.size("primary_generic") > 0, F.col("primary_generic"))
            .when(F.size("_from_spec") > 0, F.col("_from_spec"))
            .otherwise(F.array(F.lit("it support"))),
        )
        .withColumn(
            "usecases",
            F.when(F.size("usecases") > 0, F.col("usecases")).otherwise(
                F.array(F.concat(F.lit("help with "), F.lower(topic)))
            ),
        )
        .withColumn("category", tx.index_category("raw.category"))
        .withColumn("article_type", tx.article_type("raw.article_type"))
        .withColumn("primary_topic", F.coalesce(_first_text("raw.primary_topic", "title", "doc_key"), F.lit("IT support article")))
        .drop("_spec", "_gen", "_from_spec")
    )


def normalize_summary(df: DataFrame) -> DataFrame:
    """Summary fields with defaults from the title."""
    steps = df.withColumn("article_title", F.coalesce(_first_text("raw.article_title", "title"), F.lit("")))
    named = F.nullif(F.col("article_title"), F.lit(""))
    title = tx.clean_phrase("title")
    return (
        steps.withColumn("kb_id", F.coalesce(_first_text("raw.kb_id", "doc_key"), F.lit("")))
        .withColumn(
            "primary_intent",
            F.coalesce(_first_text("raw.primary_intent"), F.concat(F.lit("Help with "), F.coalesce(named, F.lit("this KB")))),
        )
        .withColumn(
            "summary",
            F.coalesce(
                _first_text("raw.summary"),
                F.concat(F.lit("This KB provides guidance related to: "), F.coalesce(named, F.lit("this article")), F.lit(".")),
            ),
        )
        .withColumn("_triggers", tx.clean_phrase_list("raw.query_triggers", 12, lowercase=True))
        .withColumn(
            "query_triggers",
            F.when(F.size("_triggers") > 0, F.col("_triggers")).otherwise(
                F.array(F.when(title != "", F.lower(title)).otherwise(F.lit("help with this issue")))
            ),
        )
        .withColumn("secondary_mentions", tx.clean_phrase_list("raw.secondary_mentions", 10))
        .drop("_triggers")
    )


def enrich_documents(docs: DataFrame, extract: Extractor = local_extractor) -> DataFrame:
    """Documents with normalised metadata and summary; failures keep their stage and error."""
    done = normalize_summary(normalize_metadata(extract(docs)))
    empty = (F.size("primary_specific") == 0) & (F.size("primary_generic") == 0) & (F.size("usecases") == 0)
    return done.withColumn(
        "error", F.coalesce("error", F.when(empty, F.lit("nothing extracted")))
    ).withColumn("stage", F.when(F.col("error").isNotNull() & (F.col("stage") == "completed"), "metadata_extraction").otherwise(F.col("stage"))).drop("raw")


_KIND_LISTS = {
    "specific": "primary_specific",
    "generic": "primary_generic",
    "usecase": "usecases",
    "entity": "secondary_entities",
    "acronym": "acronyms",
}


def keyword_rows(enriched: DataFrame, embed: Embedder | None = None, with_vectors: bool = True) -> DataFrame:
    """One row per term; exactly one of the five text columns and its vector is set."""
    def tag(kind: str, column: str) -> Column:
        return F.transform(F.col(column), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    tagged = F.concat(*[tag(kind, column) for kind, column in _KIND_LISTS.items()])
    keep = ["doc_key", "kb_collection_id", "shard_id", "category", "article_type", "primary_topic"]
    rows = enriched.select(*[c for c in keep if c in enriched.columns], F.explode(tagged).alias("_t")).select(
        "*", F.col("_t.kind").alias("kind"), F.col("_t.term").alias("term")
    ).drop("_t")
    rows = rows.withColumnRenamed("doc_key", "kbid")
    if with_vectors:
        rows = embed_terms(rows, "term", embed, row_id=["kbid", "kind"])
    for kind, (text_col, vector_col) in KIND_COLUMNS.items():
        rows = rows.withColumn(text_col, F.when(F.col("kind") == kind, F.col("term")))
        if with_vectors:
            rows = rows.withColumn(vector_col, F.when(F.col("kind") == kind, F.col("embedding")))
    return rows.drop("kind", "term", "embedding")


def summary_rows(enriched: DataFrame) -> DataFrame:
    keep = [c for c in ("kb_collection_id", "shard_id") if c in enriched.columns]
    return enriched.select(
        F.col("doc_key").alias("doc_id"), *keep,
        F.trim("article_title").alias("article_title"), F.trim("primary_intent").alias("primary_intent"),
        tx.join_list("query_triggers").alias("query_triggers"),
        tx.join_list("secondary_mentions").alias("secondary_mentions"),
        F.trim("summary").alias("summary"), "content",
    )


def keyed_source(source: DataFrame, collection: str | None = None, org: str | None = None) -> DataFrame:
    """Live source documents of a scope with key and title; scenario articles left out."""
    rows = source.where(~F.coalesce("is_deleted", F.lit(False)))
    if collection:
        rows = rows.where(F.col("knowledgebase_collection_id") == collection)
    if org:
        rows = rows.where(F.col("org_id") == org)
    return (
        rows.where(~tx.is_scenario_title(F.coalesce("name", F.lit(""))))
        .select(
            "id", "updated_at", "content",
            F.col("knowledgebase_collection_id").alias("kb_collection_id"),
            tx.normalize_title(tx.strip_file_suffix("name")).alias("title"),
            tx.doc_key("number", "name", "id").alias("doc_key"),
        )
    )


@dataclass(frozen=True)
class SyncChanges:
    """What a sync does: owners that go (collection and key), rows that come, the next registry, and how every article fared."""

    gone: DataFrame
    keywords: DataFrame
    summaries: DataFrame
    registry: DataFrame
    outcomes: DataFrame
    diff: DataFrame


@dataclass(frozen=True)
class SyncResult:
    keywords: DataFrame
    summaries: DataFrame
    registry: DataFrame
    outcomes: DataFrame
    diff: DataFrame


_ARTICLE = ["kb_collection_id", "doc_key"]


def sync_changes(
    source: DataFrame, state: DataFrame, registry: DataFrame, extract: Extractor = local_extractor, embed: Embedder | None = None,
    sample: int | None = None, seed: int = 7, settings: IndexSettings = INDEX, partial: bool = False,
) -> SyncChanges:
    """What brings an index in step with its source, from the keys and times of both; texts are read for changed articles only.

    A document is named by its collection and its key, so collections may use the same keys; a null collection counts as blank.
    ``source``: id, number, name, content, updated_at, is_deleted, collection and org; ``state``: doc_key, kb_collection_id,
    shard_id, updated_at of what is indexed. A ``partial`` source has changed rows only: articles that it does not name stay, and
    those that it marks as deleted go.
    """
    blank = F.coalesce("kb_collection_id", F.lit("")).alias("kb_collection_id")
    state = state.where(F.trim("doc_key") != "").select("doc_key", "updated_at", "shard_id", blank)
    docs = keyed_source(source).withColumn("kb_collection_id", blank)
    narrow = sync.latest_source(docs.select(*_ARTICLE, "updated_at", "id"), _ARTICLE)
    if sample is not None:
        narrow = sample_n(narrow, "doc_key", sample, seed)
    if partial:
        named = keyed_source(source.withColumn("is_deleted", F.lit(False))).withColumn("kb_collection_id", blank).select(*_ARTICLE).distinct()
        diff = sync.snapshot_diff(narrow, state.join(named, _ARTICLE, "left_semi"), _ARTICLE)
    else:
        diff = sync.purge_guard(sync.snapshot_diff(narrow, state, _ARTICLE), state, sample is not None)
    diff = materialise(diff, "diff")

    changed = diff.where(F.col("label").isin("new", "updated")).select(*_ARTICLE, "label").join(narrow, _ARTICLE)
    changed = changed.select(*[F.col(c).alias(f"_{c}") for c in _ARTICLE], F.col("updated_at").alias("_at"), F.col("id").alias("_id"), "label")
    same = [F.col(c) == F.col(f"_{c}") for c in _ARTICLE] + [F.col("updated_at").eqNullSafe(F.col("_at")), F.col("id").eqNullSafe(F.col("_id"))]
    taken = docs.join(changed, same).select(*docs.columns, "label").dropDuplicates(_ARTICLE)
    batch = materialise(sync.existing_keys(taken, state, _ARTICLE), "sync-batch")
    ready = sync.usable_articles(batch)
    enriched = materialise(enrich_documents(ready, extract), "enriched")
    outcomes = sync.article_outcome(
        batch.join(enriched.select(*_ARTICLE, "stage", "error", F.col("content").alias("_clean")), _ARTICLE, "left")
        .withColumn("content", F.coalesce("_clean", F.lit(""))).drop("_clean")
    ).select(*_ARTICLE, "outcome", "reason", "stage")

    good = enriched.where(F.col("error").isNull())
    gone = diff.where(F.col("label") == "deleted").select(*_ARTICLE).unionByName(good.where("exists").select(*_ARTICLE))
    gone = materialise(gone, "sync-gone")
    freed = shards.release_slots(registry, state.join(gone, _ARTICLE, "left_semi"))
    numbered = F.xxhash64("doc_key").cast("double")
    placed = shards.assign_shards(good.drop("shard_id"), freed, "doc_key", numbered, settings.shard_size)
    placed = materialise(placed, "placed")
    notes = summary_rows(placed).join(placed.select("kb_collection_id", F.col("doc_key").alias("doc_id"), "updated_at"), ["kb_collection_id", "doc_id"])
    return SyncChanges(gone, keyword_rows(placed, embed), notes, shards.update_registry(freed, placed, settings.shard_size), outcomes, diff)


def sync_job(
    source: DataFrame,
    keywords: DataFrame,
    summaries: DataFrame,
    registry: DataFrame,
    extract: Extractor = local_extractor,
    embed: Embedder | None = None,
    sample: int | None = None,
    seed: int = 7,
    settings: IndexSettings = INDEX,
) -> SyncResult:
    """``sync_changes`` applied to whole frames; ``run_sync`` commits them to a store instead.

    The next tables are written whole, so the rows that go, stay and come are made whichever of them the caller reads.
    """
    state = summaries.select(F.col("doc_id").alias("doc_key"), "kb_collection_id", "shard_id", "updated_at")
    done = sync_changes(source, state, registry, extract, embed, sample, seed, settings)
    keys = done.gone.select(F.col("kb_collection_id").alias("_collection"), F.col("doc_key").alias("_key"))

    def without_gone(table: DataFrame, key: str) -> DataFrame:
        same = (F.coalesce(table["kb_collection_id"], F.lit("")) == F.col("_collection")) & (table[key] == F.col("_key"))
        return table.join(keys, same, "left_anti")

    return SyncResult(
        materialise(without_gone(keywords, "kbid").unionByName(done.keywords, allowMissingColumns=True), "sync-keywords"),
        materialise(without_gone(summaries, "doc_id").unionByName(done.summaries, allowMissingColumns=True), "sync-summaries"),
        materialise(done.registry, "sync-registry"), done.outcomes, done.diff,
    )


#: The tables of an index: keyword rows and summaries belong to an article, the registry to a collection.
INDEX_TABLES = {
    "keywords": TableSpec(schemas.KB_KEYWORDS, ("kb_collection_id", "kbid")),
    "summaries": TableSpec(schemas.KB_SUMMARIES, ("kb_collection_id", "doc_id")),
    "registry": TableSpec(schemas.SHARD_REGISTRY, ("kb_collection_id",), 8),
}


@dataclass(frozen=True)
class SyncReport:
    """What a committed sync did: articles and rows of each table, outcomes, and the diff that it came from."""

    affected: dict[str, Affected]
    outcomes: DataFrame
    diff: DataFrame
    changes: SyncChanges


def run_sync(
    store: Store, source: DataFrame, now: Column, extract: Extractor = local_extractor, embed: Embedder | None = None,
    sample: int | None = None, seed: int = 7, settings: IndexSettings = INDEX, partial: bool = False, note: str | None = None,
) -> SyncReport:
    """Sync a stored index with its source: keywords, summaries and registry change in one commit, in touched buckets only.

    Rows that come get ``now`` as creation time. A sync without changes commits nothing but its note.
    """
    before = store.snapshot()
    state = before.read("summaries").select(F.col("doc_id").alias("doc_key"), "kb_collection_id", "shard_id", "updated_at")
    registry = before.read("registry")
    done = sync_changes(source, state, registry, extract, embed, sample, seed, settings, partial)
    fresh = materialise(done.registry.join(registry.select("kb_collection_id", "shard_id", "created_at"), ["kb_collection_id", "shard_id"], "left").withColumn("created_at", F.coalesce("created_at", now)), "sync-registry")
    # Of the registry only collections that changed are written.
    same = fresh.join(registry, fresh.columns, "left_semi") if registry.columns else fresh.limit(0)
    moved = fresh.join(same.select("kb_collection_id", "shard_id"), ["kb_collection_id", "shard_id"], "left_anti").select("kb_collection_id").distinct()
    changes = {
        "keywords": Change(done.keywords.withColumn("created_at", now).withColumn("updated_at", now), done.gone.withColumnRenamed("doc_key", "kbid")),
        "summaries": Change(done.summaries.withColumn("created_at", now), done.gone.withColumnRenamed("doc_key", "doc_id")),
        "registry": Change(fresh.join(moved, "kb_collection_id", "left_semi")),
    }
    return SyncReport(store.commit(changes, before, note), done.outcomes, done.diff, done)


def delete_articles(store: Store, articles: DataFrame, note: str | None = None) -> dict[str, Affected]:
    """Remove articles (kb_collection_id, doc_key) from keywords and summaries and give their slots back, in one commit.

    Gives what was done to each table; articles that are not there count nowhere.
    """
    before = store.snapshot()
    keys = materialise(articles.select(F.coalesce("kb_collection_id", F.lit("")).alias("kb_collection_id"), "doc_key").distinct(), "delete-articles")
    held = before.read("summaries").select(F.coalesce("kb_collection_id", F.lit("")).alias("kb_collection_id"), F.col("doc_id").alias("doc_key"), "shard_id")
    removed = materialise(held.join(keys, _ARTICLE, "left_semi"), "delete-held")
    registry = before.read("registry")
    freed = shards.release_slots(registry.join(removed.select("kb_collection_id").distinct(), "kb_collection_id", "left_semi"), removed)
    return store.commit(
        {"keywords": Change(gone=keys.withColumnRenamed("doc_key", "kbid")), "summaries": Change(gone=keys.withColumnRenamed("doc_key", "doc_id")), "registry": Change(freed)}, before, note
    )


# --- query side ------------------------------------------------------------------------------


def normalize_queries(queries: DataFrame) -> DataFrame:
    """Raw questions and their extracted JSON as normalised query records.

    ``queries``: query_id, raw_query, extracted (JSON text, may be null or broken). Terms move
    between the specific and generic lists by their looks, missing parts are derived from
    the question, and a question that yields nothing gets the plain-words fallback.
    """
    from tarnwell.functions.jsonops import json_list, json_text

    parsed = F.try_parse_json("extracted")
    raw = F.coalesce("raw_query", F.lit(""))
    base = queries.withColumn("raw_query", raw).withColumn("_p", parsed)
    steps = (
        base.withColumn("_spec", tx.clean_phrase_list(json_list(F.col("_p"), "$.keywords.specific", "$.keywords.primary_specific"), 8))
        .withColumn("_gen", tx.clean_phrase_list(json_list(F.col("_p"), "$.keywords.generic", "$.keywords.primary_generic"), 8, True))
        .withColumn("_issues", tx.clean_phrase_list(json_list(F.col("_p"), "$.issues"), 8, True))
        .withColumn("_use", tx.clean_phrase_list(json_list(F.col("_p"), "$.usecase"), 8, True))
        .withColumn("_acr", tx.clean_phrase_list(json_list(F.col("_p"), "$.acronyms"), 8))
        .withColumn("_phr", tx.clean_phrase_list(json_list(F.col("_p"), "$.search_phrases"), 8, True))
        .withColumn("category", tx.query_category(json_text(F.col("_p"), "$.category")))
        .withColumn("article_type", tx.clean_phrase(json_text(F.col("_p"), "$.article_type")))
    )
    named, plain = _split_terms(F.col("_spec"), F.col("_gen"))
    whole = tx.clean_phrase("raw_query")
    steps = (
        steps.withColumn("_named", named)
        .withColumn("generic", tx.query_generic_terms(plain))
        .withColumn(
            "specific",
            tx.clean_phrase_list(
                F.when(F.size("_named") > 0, F.col("_named")).otherwise(F.filter("_acr", tx.looks_specific)), 8
            ),
        )
        .withColumn("issues", tx.query_generic_terms("_issues"))
        .withColumn("_use6", F.slice(F.col("_use"), 1, 6))
        .withColumn("acronyms", F.slice(tx.distinct_ignoring_case(F.concat("_acr", tx.infer_acronyms("raw_query"))), 1, 8))
    )
    steps = steps.withColumn(
        "usecase",
        F.when(F.size("_use6") > 0, F.col("_use6")).when(whole != "", F.array(F.lower(whole))).otherwise(F.col("_use6")),
    )
    derived = tx.derive_search_phrases("raw_query", "specific", "generic", "issues", "usecase")
    steps = steps.withColumn("search_phrases", F.slice(tx.distinct_ignoring_case(F.concat("_phr", derived)), 1, 8))

    nothing = (F.size("specific") == 0) & (F.size("generic") == 0) & (F.size("usecase") == 0)
    words = F.transform(F.regexp_extract_all("raw_query", F.lit(r"[A-Za-z0-9][A-Za-z0-9._+-]*"), F.lit(0)), lambda w: F.lower(w))
    plain_words = F.slice(
        tx.distinct_ignoring_case(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(tx.GENERIC_STOPWORDS))), 1, 6
    )
    own = F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    fallback = {
        "category": F.lit("both"), "article_type": F.lit(""), "specific": empty, "generic": plain_words,
        "issues": empty, "usecase": own, "acronyms": tx.infer_acronyms("raw_query"), "search_phrases": own,
    }
    return steps.withColumn("_nothing", nothing).select(
        "query_id", "raw_query", *[F.when(F.col("_nothing"), v).otherwise(F.col(k)).alias(k) for k, v in fallback.items()]
    )
