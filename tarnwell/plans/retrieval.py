"""Hybrid retrieval for a whole table of queries.

Frames that flow between the steps:

* units: one row per (query, term group): ``unit_id, query_id, term_group, kind, query_text,
  embedding, category, top_k``;
* keywords: the wide keyword rows of the index (one of five text columns set per row);
* summaries: one row per document.

Every step is keyed by (unit, shard) or (query, shard), so all queries and all shards are
answered by one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tarnwell.functions import text as tx
from tarnwell.functions import vectors as vx
from tarnwell.functions.fuzzy import best_fit, fuzzy_ratio
from tarnwell.operators.fulltext import search_clauses
from tarnwell.operators.fusion import fuse_signals, select_candidates
from tarnwell.operators.knn import Refinement, knn_join
from tarnwell.operators.ranking import (
    best_per_doc,
    deal_groups,
    family_representatives,
    first_seen,
    group_top_k,
    latest_per_key,
    search_limit,
    top_n,
    winner_gap,
)
from tarnwell.operators.textindex import INDEX_RANKERS, TextIndex, build_index, hit_weights_of_counts, match_index
from tarnwell.operators.vectorlists import VectorLists, build_lists, search_lists
from tarnwell.session import materialise, work_dir
from tarnwell.settings import KEYWORD_LABELS, RETRIEVAL, SUMMARY_LABELS, TOPIC_LABEL, RetrievalSettings

# Text column and vector column of every keyword kind.
KIND_COLUMNS = {
    "specific": ("specific_keyword", "specific_keyword_embedding"),
    "generic": ("generic_keyword", "generic_keyword_embedding"),
    "usecase": ("usecase", "usecase_embedding"),
    "entity": ("secondary_entity", "secondary_entity_embedding"),
    "acronym": ("acronym", "acronym_embedding"),
}
# Which vectors a term group is compared with.
GROUP_KINDS = {
    "specific": "specific",
    "generic": "generic",
    "usecase": "usecase",
    "search_phrases": "usecase",
    "acronyms": "specific",
}
_ATTRIBUTES = ["category", "article_type", "primary_topic"]


def keyword_terms(keywords: DataFrame) -> DataFrame:
    """Wide keyword rows as (kbid, shard_id, kind, term, embedding, attributes)."""
    kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, (c, _) in KIND_COLUMNS.items()])
    term = F.coalesce(*[F.col(c) for c, _ in KIND_COLUMNS.values()])
    vector = F.coalesce(*[F.col(v) for _, v in KIND_COLUMNS.values()])
    return keywords.select(
        "kbid", "shard_id", kind.alias("kind"), term.alias("term"), vector.alias("embedding"), *_ATTRIBUTES
    )


def scope_filter(df: DataFrame, collection: str | None = None, shard: int | None = None) -> DataFrame:
    """Rows of one collection and shard; a blank part of the scope is not applied."""
    if collection and collection.strip():
        df = df.where(F.col("kb_collection_id") == collection)
    if shard is not None:
        df = df.where(F.col("shard_id") == shard)
    return df


def _exact(query: Column, fields: Sequence[str | Column]) -> Column:
    return F.greatest(*[F.coalesce(F.lower(F.trim(tx.col(f))) == query, F.lit(False)) for f in fields])


def _contains(query: Column, fields: Sequence[str | Column]) -> Column:
    return F.greatest(*[F.coalesce(F.contains(F.lower(tx.col(f)), query), F.lit(False)) for f in fields])


def vector_flags(query_text: str, fields: Sequence[str]) -> tuple[Column, Column]:
    """Exact hit, and containment in either direction, of a query against short fields."""
    query = F.lower(tx.collapse_spaces(query_text))
    values = [F.lower(F.trim(F.col(f))) for f in fields]
    exact = F.greatest(*[F.coalesce((query != "") & (v == query), F.lit(False)) for v in values])
    phrase = F.greatest(
        *[F.coalesce((query != "") & (v != "") & (F.contains(v, query) | F.contains(query, v)), F.lit(False)) for v in values]
    )
    return exact, phrase


def keyword_lists(keywords: DataFrame, root: str) -> VectorLists:
    """Stored inverted lists of the vectors of keyword rows."""
    return build_lists(keyword_terms(keywords), root)


def _documents_of_best(s: RetrievalSettings, fused: bool, most: int | None):
    """Kernel step: of the best rows of a (unit, shard) the best one of each document, boosted, with its flags.

    Texts come folded (``_text``, ``_term``, ``_topic``), so they are only compared. With ``fused`` those rows are left out that cannot
    be among the first ``_top_k`` of the fused signals: what other signals found (``_beside``) stays, and so do the least and the
    greatest distance, which scale the others; of the rest, which score by their distance alone, as many as are asked for, and ties.
    With ``most`` only so many documents of a (unit, shard) are given, the nearest.
    """

    def change(*columns: pa.ChunkedArray) -> np.ndarray:
        codes = [pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in columns]
        return np.cumsum(np.append(False, np.any([c[1:] != c[:-1] for c in codes], axis=0)))

    def make(queries: pa.Table, rows: pa.Table):
        asked, wanted = queries.column("_text").to_pylist(), queries.column("_wanted").to_pylist()
        terms, topics, own = (rows.column(c).to_pylist() for c in ("_term", "_topic", "_own"))
        # Rows are sorted by cell and document, so equal ones lie together.
        docs, cells = (change(rows.column("shard_id"), rows.column("kbid")), change(rows.column("shard_id"))) if len(rows) else (None, None)
        number = {key: n for key, n in zip(zip(rows.column("shard_id").to_pylist(), rows.column("kbid").to_pylist()), docs.tolist())} if fused and len(rows) else {}
        hits = [{number.get((x["shard_id"], x["kbid"])) for x in told or ()} for told in queries.column("_beside").to_pylist()] if fused else None

        def best(q: np.ndarray, r: np.ndarray, distance: np.ndarray, rank: np.ndarray) -> pa.Table:
            if not len(q):
                return found(q, r, distance, distance, distance > 0, distance > 0)
            exact, phrase, factor = np.zeros(len(q), bool), np.zeros(len(q), bool), np.ones(len(q))
            starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            for start, end in zip(starts, np.append(starts[1:], len(q))):
                text, want, by_topic = asked[q[start]], wanted[q[start]], {}
                for i, j in enumerate(r[start:end].tolist(), start):
                    if want not in ("", "both"):
                        factor[i] = s.distance_match if own[j] == want else s.distance_both if own[j] == "both" else s.distance_other
                    if not text:
                        continue
                    term, topic = terms[j], topics[j]
                    if topic not in by_topic:
                        by_topic[topic] = (topic == text, bool(topic) and (text in topic or topic in text))
                    exact[i] = by_topic[topic][0] or term == text
                    phrase[i] = by_topic[topic][1] or (bool(term) and (text in term or term in text))
            boosted = distance * factor * np.where(exact, s.exact_distance_factor, np.where(phrase, s.phrase_distance_factor, 1.0))
            doc = docs[r]
            order = np.lexsort((rank, boosted, doc, q))
            kept = order[np.append(True, (q[order][1:] != q[order][:-1]) | (doc[order][1:] != doc[order][:-1]))]
            if most is not None:
                kept = kept[np.lexsort((doc[kept], boosted[kept], cells[r[kept]], q[kept]))]
                cell = cells[r[kept]]
                first = np.maximum.accumulate(np.where(np.append(True, (q[kept][1:] != q[kept][:-1]) | (cell[1:] != cell[:-1])), np.arange(len(kept)), 0))
                kept = kept[np.arange(len(kept)) - first < most]
            if fused:
                hit = np.fromiter((j in hits[i] for i, j in zip(q[kept].tolist(), doc[kept].tolist())), bool, len(kept))
                top_k = queries.column("_top_k").to_numpy()[q[kept]]
                kept = kept[_may_be_fused_first(s, q[kept], cells[r[kept]], hit, top_k, boosted[kept], exact[kept], phrase[kept])]
            return found(q[kept], r[kept], distance[kept], boosted[kept], exact[kept], phrase[kept])

        def found(q, r, distance, boosted, exact, phrase) -> pa.Table:
            qi, ri = pa.array(q, pa.int64()), pa.array(r, pa.int64())
            told = {"unit_id": queries.column("unit_id").take(qi)} | {c: rows.column(c).take(ri) for c in ("shard_id", "kbid", *_ATTRIBUTES)}
            told |= {"vector_distance_raw": pa.array(distance), "vector_distance": pa.array(boosted), "vector_exact_match": pa.array(exact), "vector_phrase_match": pa.array(phrase)}
            return pa.table(told)

        return best

    return make


def _may_be_fused_first(s: RetrievalSettings, q, cell, hit, top_k, distance, exact, phrase) -> np.ndarray:
    """Whether documents, sorted by query and cell, can be among the first of their query and cell when fused; see ``_documents_of_best``."""
    starts = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (cell[1:] != cell[:-1])))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(q))))
    low, high = np.minimum.reduceat(distance, starts)[group], np.maximum.reduceat(distance, starts)[group]
    scaled = np.where(high > low, 1.0 - (distance - low) / np.where(high > low, high - low, 1.0), 1.0)
    score = scaled * s.vector_weight + np.where(exact, s.exact_bonus, 0.0) + np.where(phrase, s.phrase_bonus, 0.0)
    keep = hit | (distance == low) | (distance == high)
    alone = np.flatnonzero(~hit)
    order = alone[np.lexsort((-score[alone], group[alone]))]
    of = group[order]
    nth = np.minimum(np.searchsorted(of, of) + np.maximum(top_k[order], 1), np.searchsorted(of, of, side="right")) - 1
    # Sums are rounded, so what is nearly as good stays as well.
    keep[order] |= score[order] >= score[order][nth] - 1e-9
    return keep


def vector_search(
    units: DataFrame, keywords: DataFrame, settings: RetrievalSettings = RETRIEVAL, lists: VectorLists | None = None, probes: int | None = None,
    beside: DataFrame | None = None, most: int | None = None,
) -> DataFrame:
    """Boosted distance of the nearest documents per (unit, shard).

    With stored ``lists`` the nearest rows of a unit are taken over all shards together, so what comes out is bounded per unit
    whatever the number of shards; ``probes`` lists are looked into at most (see ``search_lists``), all that can matter if not given.
    Without lists, ``beside`` (unit_id, shard_id, kbid of what other signals found) leaves out rows that cannot be among the first
    ``top_k`` of a (unit, shard) when the signals are fused. With ``most`` a (unit, shard) gives so many documents, its nearest.
    """
    if beside is not None and most is not None:
        raise ValueError("the fusion needs the whole range of distances")
    limited = units.select(
        "unit_id", "kind", "embedding",
        search_limit("top_k", "category", settings.oversample, settings.category_oversample).alias("fetch"),
    )
    # Units that share an id are told apart by nothing: their rows are put together after the search.
    if lists is None and units.groupBy("unit_id").count().where("count > 1").isEmpty():
        return _refined_search(units, limited, keyword_terms(keywords), settings, beside, most)
    if lists is not None:
        found = search_lists(lists, limited, "unit_id", ["kbid", "term"], "fetch", probes, match=["kind"])
    else:
        found = knn_join(limited, keyword_terms(keywords), "unit_id", ["kbid", "term"], "fetch", match=["kind"], cell="shard_id")
    # The query texts are joined back afterwards: the kernel moves ids, not texts.
    near = found.join(units.select("unit_id", "query_text", F.col("category").alias("wanted_category")), "unit_id")
    exact, phrase = vector_flags("query_text", ["primary_topic", "term"])
    factor = vx.distance_multiplier("wanted_category", "category", settings)
    boosted = near.select(
        "unit_id", "shard_id", "kbid", *_ATTRIBUTES, "rank",
        F.col("distance").alias("vector_distance_raw"),
        vx.boost_distance(F.col("distance") * factor, exact, phrase, settings).alias("vector_distance"),
        exact.alias("vector_exact_match"),
        phrase.alias("vector_phrase_match"),
    )
    best = best_per_doc(boosted, ["unit_id", "shard_id", "kbid"], "vector_distance", ["rank"], True).drop("rank")
    return best if most is None else top_n(best, ["unit_id", "shard_id"], [F.asc("vector_distance"), F.asc("kbid")], most)


def _refined_search(units: DataFrame, limited: DataFrame, terms: DataFrame, settings: RetrievalSettings, beside: DataFrame | None, most: int | None) -> DataFrame:
    """``vector_search`` of units with ids of their own: a shard lies in one task, so documents are put together where they are found."""
    blank = F.lit("")
    told = units.where(F.col("unit_id").isNotNull()).select(
        "unit_id", F.coalesce(F.lower(tx.collapse_spaces("query_text")), blank).alias("_text"),
        F.lower(F.trim(F.coalesce("category", blank))).alias("_wanted"), F.col("top_k").cast("long").alias("_top_k"),
    )
    asked = limited.join(told, "unit_id")
    # Rows of kinds that no unit asks for are not sent.
    rows = terms.join(F.broadcast(units.select("kind").distinct()), "kind", "left_semi").select(
        "*", F.coalesce(F.lower(F.trim("term")), blank).alias("_term"), F.coalesce(F.lower(F.trim("primary_topic")), blank).alias("_topic"),
        F.lower(F.trim(F.coalesce("category", blank))).alias("_own"),
    )
    schema = T.StructType(
        [units.schema["unit_id"], *[terms.schema[c] for c in ("shard_id", "kbid", *_ATTRIBUTES)]]
        + [T.StructField(c, T.DoubleType()) for c in ("vector_distance_raw", "vector_distance")]
        + [T.StructField(c, T.BooleanType()) for c in ("vector_exact_match", "vector_phrase_match")]
    )
    refine = Refinement(_documents_of_best(settings, beside is not None, most), schema, beside)
    return knn_join(asked, rows, "unit_id", ["kbid", "term"], "fetch", match=["kind"], cell="shard_id", refine=refine)


def merge_shards(found: DataFrame, value: str, smallest: bool, top_k: int | None = None) -> DataFrame:
    """Best value per (unit, document) over all shards, best first, at most ``top_k``."""
    best = best_per_doc(found, ["unit_id", "kbid"], value, ["shard_id"], smallest)
    order = [F.asc(value) if smallest else F.desc(value), F.asc("kbid")]
    return top_n(best, ["unit_id"], order, top_k) if top_k else best


def vector_search_all(units: DataFrame, keywords: DataFrame, top_k: int, settings: RetrievalSettings = RETRIEVAL) -> DataFrame:
    """The nearest ``top_k`` documents per unit over all shards: each is among the nearest of the shard that has it best."""
    return merge_shards(vector_search(units, keywords, settings, most=top_k), "vector_distance", True, top_k)


#: Labels of the searched columns of a keyword row, in the order in which their words are numbered.
KEYWORD_FIELDS = {
    "specific_keyword": KEYWORD_LABELS["specific"],
    "generic_keyword": KEYWORD_LABELS["generic"],
    "usecase": KEYWORD_LABELS["usecase"],
    "primary_topic": TOPIC_LABEL,
    "acronym": KEYWORD_LABELS["acronym"],
    "secondary_entity": KEYWORD_LABELS["entity"],
}


def _keyed_rows(keywords: DataFrame) -> DataFrame:
    """Keyword rows with ``_row``, a hash of what they say; rows that say the same of an article are one."""
    columns = [c for c, _ in KIND_COLUMNS.values()]
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns] + [F.col(c).isNotNull() for c in columns]
    return keywords.withColumn("_row", F.xxhash64("kbid", *parts))


def keyword_index(keywords: DataFrame, root: str) -> TextIndex:
    """A stored full-text index over keyword rows."""
    return build_index(_keyed_rows(keywords), root, ["kbid", "_row"], KEYWORD_FIELDS, ["shard_id", *_ATTRIBUTES])


def summary_index(summaries: DataFrame, root: str) -> TextIndex:
    """A stored full-text index over summaries."""
    return build_index(summaries.withColumnRenamed("doc_id", "kbid"), root, ["kbid"], SUMMARY_LABELS, ["shard_id"])


def _ranked(units: DataFrame, index: TextIndex, ranker: str) -> DataFrame:
    """Every match of a unit with its rank, without positions; written, as the cut and the flags both read it."""
    clauses = search_clauses(units, "unit_id", "query_text", exclude_only=True)
    if ranker == "hits":
        matched = match_index(index, clauses, "unit_id", counts=True).withColumn("_rank", hit_weights_of_counts())
    else:
        matched = match_index(index, clauses, "unit_id").withColumn("_rank", INDEX_RANKERS[ranker]("hits", "terms"))
    return materialise(matched.select("unit_id", *index.keys, *index.manifest["carry"], "_rank"), "fts-ranked")


def fts_keywords(
    units: DataFrame, keywords: DataFrame, settings: RetrievalSettings = RETRIEVAL, ranker: str = "cover", index: TextIndex | None = None
) -> DataFrame:
    """Full-text rank over keyword rows, best row per document, top k per (unit, shard).

    ``index`` is the stored index of the rows; without one it is built for this call. Texts are read for the rows of fetched
    documents only, to see exact and contained matches.
    """
    index = index or keyword_index(keywords, work_dir(units.sparkSession, "keyword-index"))
    ranked = _ranked(units, index, ranker)
    doc = ["unit_id", "shard_id", "kbid"]
    told = ranked.join(units.select("unit_id", F.col("category").alias("wanted_category"), "top_k"), "unit_id")
    per_doc = told.groupBy(*doc, "wanted_category", "top_k").agg(F.max("_rank").alias("fts_keywords_rank_raw"), *[F.max(a).alias(a) for a in _ATTRIBUTES])
    fetched = materialise(
        top_n(
            per_doc.withColumn("_fetch", search_limit("top_k", "wanted_category", settings.oversample, settings.category_oversample)),
            ["unit_id", "shard_id"], [F.desc("fts_keywords_rank_raw"), F.asc("kbid")], "_fetch",
        ),
        "fts-fetched",
    )
    columns = [c for c, _ in KIND_COLUMNS.values()]
    wanted = materialise(ranked.select(*doc, "_row").distinct().join(fetched.select(*doc), doc, "left_semi"), "fts-flagged")
    texts = _keyed_rows(keywords).select("kbid", "_row", "primary_topic", *columns)
    query = F.lower(F.trim("query_text"))
    flags = (
        texts.join(wanted, ["kbid", "_row"]).join(units.select("unit_id", "query_text"), "unit_id").groupBy(*doc)
        .agg(
            F.max(_exact(query, ["specific_keyword", "acronym", "primary_topic", "usecase"])).alias("fts_keywords_exact_match"),
            F.max(_contains(query, columns + ["primary_topic"])).alias("fts_keywords_phrase_match"),
        )
    )
    scored = fetched.join(flags, doc).withColumn(
        "fts_keywords_rank",
        vx.bonus_rank(
            F.col("fts_keywords_rank_raw") * vx.rank_multiplier("wanted_category", "category", settings),
            "fts_keywords_exact_match", "fts_keywords_phrase_match",
            settings.keyword_exact_bonus, settings.keyword_phrase_bonus,
        ),
    )
    return top_n(scored, ["unit_id", "shard_id"], [F.desc("fts_keywords_rank"), F.asc("kbid")], "top_k").drop(
        "wanted_category", "top_k", "_fetch"
    )


def fts_summaries(
    units: DataFrame, summaries: DataFrame, settings: RetrievalSettings = RETRIEVAL, ranker: str = "cover", index: TextIndex | None = None
) -> DataFrame:
    """Full-text rank over summaries; cut on the raw rank, bonuses added afterwards. ``index`` as in ``fts_keywords``."""
    index = index or summary_index(summaries, work_dir(units.sparkSession, "summary-index"))
    doc = ["unit_id", "shard_id", "kbid"]
    best = _ranked(units, index, ranker).groupBy(*doc).agg(F.max("_rank").alias("fts_summaries_rank_raw"))
    told = best.join(units.select("unit_id", "top_k"), "unit_id").withColumn("_fetch", F.col("top_k") * settings.oversample)
    cut = materialise(top_n(told, ["unit_id", "shard_id"], [F.desc("fts_summaries_rank_raw"), F.asc("kbid")], "_fetch"), "fts-fetched")
    query = F.lower(F.trim("query_text"))
    short, long = ["primary_intent", "query_triggers"], ["summary", "content"]
    texts = summaries.select(F.col("doc_id").alias("kbid"), *short, *long)
    flags = texts.join(cut.select(*doc), "kbid").join(units.select("unit_id", "query_text"), "unit_id").select(
        *doc, _exact(query, short).alias("fts_summaries_exact_match"), _contains(query, [*short, *long]).alias("fts_summaries_phrase_match")
    )
    # A summary table that repeats an article gives its flags together.
    flags = flags.groupBy(*doc).agg(*[F.max(c).alias(c) for c in ("fts_summaries_exact_match", "fts_summaries_phrase_match")])
    return cut.join(flags, doc).withColumn(
        "fts_summaries_rank",
        vx.bonus_rank("fts_summaries_rank_raw", "fts_summaries_exact_match", "fts_summaries_phrase_match",
                      settings.summary_exact_bonus, settings.summary_phrase_bonus),
    ).drop("top_k", "_fetch")


@dataclass(frozen=True)
class Indexes:
    """Stored indexes. A full-text index that is absent is built for each call; without lists the vector arm searches every shard."""

    keywords: TextIndex | None = None
    summaries: TextIndex | None = None
    lists: VectorLists | None = None
    probes: int | None = None


def hybrid_search(
    units: DataFrame, keywords: DataFrame, summaries: DataFrame,
    settings: RetrievalSettings = RETRIEVAL, ranker: str = "cover", indexes: Indexes = Indexes(),
) -> DataFrame:
    """Fused top k per (unit, shard).

    What the full-text arms find is few and is written; the vector arm then gives only what can be among the first.
    """
    key = ["unit_id", "shard_id", "kbid"]
    texts = materialise(fts_keywords(units, keywords, settings, ranker, indexes.keywords), "keyword-hits")
    notes = materialise(fts_summaries(units, summaries, settings, ranker, indexes.summaries), "summary-hits")
    beside = texts.select(*key).union(notes.select(*key)).distinct() if indexes.lists is None else None
    fused = fuse_signals(
        vector_search(units, keywords, settings, indexes.lists, indexes.probes, beside), texts, notes, ["unit_id", "shard_id"], settings=settings,
    )
    told = fused.join(units.select("unit_id", "query_id", "term_group", "top_k"), "unit_id")
    return top_n(told, ["unit_id", "shard_id"], [F.desc("rrf_score"), F.asc("kbid")], "top_k").drop("top_k")


def hybrid_search_all(
    units: DataFrame, keywords: DataFrame, summaries: DataFrame,
    settings: RetrievalSettings = RETRIEVAL, ranker: str = "cover", indexes: Indexes = Indexes(),
) -> DataFrame:
    """Fused top k per unit with the shards merged before the fusion."""
    k = settings.top_k
    fused = fuse_signals(
        merge_shards(vector_search(units, keywords, settings, indexes.lists, indexes.probes), "vector_distance", True, k),
        merge_shards(fts_keywords(units, keywords, settings, ranker, indexes.keywords), "fts_keywords_rank", False, k),
        merge_shards(fts_summaries(units, summaries, settings, ranker, indexes.summaries), "fts_summaries_rank", False, k),
        ["unit_id"], settings=settings,
    )
    return top_n(fused, ["unit_id"], [F.desc("rrf_score"), F.asc("kbid")], k, "rank")


def term_units(queries: DataFrame, embed: Callable[[DataFrame, str], DataFrame], top_k: int = RETRIEVAL.top_k) -> DataFrame:
    """Explode normalised queries into term groups and embed each distinct text once.

    ``queries``: query_id, category, specific, generic, usecase, search_phrases, acronyms.
    """
    groups = F.array(
        *[
            F.struct(
                F.lit(i).alias("group_order"),
                F.lit(name).alias("term_group"),
                F.lit(GROUP_KINDS[name]).alias("kind"),
                tx.collapse_spaces(F.array_join(F.col(name), " ")).alias("query_text"),
            )
            for i, name in enumerate(GROUP_KINDS)
        ]
    )
    units = (
        queries.select("query_id", "category", F.explode(groups).alias("_g"))
        .select("query_id", "category", "_g.*")
        .where(F.col("query_text") != "")
        .withColumn("unit_id", F.concat_ws(":", F.col("query_id").cast("string"), "term_group"))
        .withColumn("top_k", group_top_k("term_group", top_k))
        .withColumn("category", F.when(F.col("category") != "both", F.col("category")))
    )
    return embed(units, "query_text")


def best_across_groups(found: DataFrame, top_k: int) -> DataFrame:
    """Highest fused score per (query, shard, document); the earlier group wins ties."""
    order = F.element_at(F.create_map(*[x for i, g in enumerate(GROUP_KINDS) for x in (F.lit(g), F.lit(i))]), F.col("term_group"))
    best = best_per_doc(
        found.withColumn("_group", order), ["query_id", "shard_id", "kbid"], "rrf_score", ["_group"], False
    ).drop("_group", "unit_id")
    return top_n(best, ["query_id", "shard_id"], [F.desc("rrf_score"), F.asc("kbid")], top_k)


def keyword_rollup(keywords: DataFrame) -> DataFrame:
    """Per document: distinct non-blank values of every text column joined by a comma."""
    def listed(column: str, name: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(tx.blank_to_null(column))), ", ").alias(name)

    rolled = keywords.groupBy("kbid").agg(
        listed("category", "category"),
        listed("article_type", "article_type"),
        listed("specific_keyword", "specific_keywords"),
        listed("generic_keyword", "generic_keywords"),
        listed("usecase", "usecases"),
        listed("secondary_entity", "secondary_entities"),
        listed("acronym", "acronyms"),
        F.max(tx.blank_to_null("primary_topic")).alias("primary_topic"),
    )
    return rolled.select("kbid", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in rolled.columns[1:]])


def passages(body: Column, size: int = RETRIEVAL.passage_chars, step: int = RETRIEVAL.passage_step) -> Column:
    """The paragraphs of a text as an array; a paragraph over ``size`` characters gives overlapping windows."""
    paragraphs = F.filter(F.transform(F.split(body, "\n{2,}"), lambda p: F.trim(p, F.lit(" \t\n\r"))), lambda p: p != "")

    def windows(p: Column) -> Column:
        begins = F.sequence(F.lit(1), F.char_length(p), F.lit(step))
        return F.when(F.char_length(p) > size, F.transform(begins, lambda i: F.substring(p, i, F.lit(size)))).otherwise(F.array(p))

    return F.flatten(F.transform(paragraphs, windows))


def best_snippets(rows: DataFrame, content: str, query: str, limit: int = RETRIEVAL.snippet_chars, name: str = "snippet") -> DataFrame:
    """Add the passage of each text that fits its question best, the first of equal ones; no shuffle.

    Word overlap is an expression over the passages. Only the string similarity of a question with the beginnings of the
    passages is a batched function; it leaves out passages whose overlap and letters cannot reach the best. Without words in the
    question, the beginning of the text is the snippet.
    """
    blanks = F.lit(" \t\n\r")
    told = rows.withColumn("_body", F.trim(F.coalesce(F.col(content), F.lit("")), blanks)).withColumn("_asked", F.trim(F.coalesce(F.col(query), F.lit("")), blanks))
    told = told.withColumn("_passages", passages(F.col("_body"))).withColumn("_terms", F.array_distinct(tx.tokenize("_asked")))
    beginnings = F.transform("_passages", lambda p: F.substring(p, 1, 300))

    # The words of a passage are a value of their own: an expression that names them thrice would split the passage thrice.
    told = told.withColumn("_words", F.transform("_passages", lambda p: F.array_distinct(tx.tokenize(p))))

    def overlap(words: Column) -> Column:
        shared = F.size(F.array_intersect(words, F.col("_terms")))
        return F.struct(shared.alias("shared"), F.size(words).alias("own"))

    told = told.withColumn("_counts", F.transform("_words", overlap)).withColumn("_asked_words", F.size("_terms"))
    overlaps = F.transform("_counts", lambda c: F.when(c["own"] > 0, c["shared"] / (c["own"] + F.col("_asked_words") - c["shared"])).otherwise(0.0))
    told = told.withColumn("_place", best_fit(F.col("_asked"), beginnings, overlaps))
    best = F.get("_passages", F.col("_place"))
    picked = F.when((F.size("_passages") == 0) | (F.size("_terms") == 0), F.col("_body")).otherwise(best)
    return told.withColumn(name, F.substring(picked, 1, limit)).drop("_body", "_asked", "_passages", "_terms", "_words", "_counts", "_asked_words", "_place")


def hydrate(candidates: DataFrame, summaries: DataFrame, keywords: DataFrame, query_texts: DataFrame) -> DataFrame:
    """Candidates with the article fields, keyword rollup and best passage.

    Candidates without a summary are dropped, missing keyword fields become blank, the
    candidate position is kept. Only keyword rows of candidate documents are rolled up.
    The candidates are few; they are written once because they are read twice.
    """
    candidates = materialise(candidates, "candidates")
    ids = candidates.select("kbid").distinct()
    rollup = keyword_rollup(keywords.join(ids, "kbid", "left_semi"))
    texts = [c for c in rollup.columns if c not in ("kbid", *_ATTRIBUTES)]
    article = summaries.select(
        F.col("doc_id").alias("kbid"), "article_title", "primary_intent", "query_triggers", "secondary_mentions", "summary", "content"
    )
    rows = (
        candidates.drop(*_ATTRIBUTES).join(article, "kbid")
        .join(rollup, "kbid", "left")
        .join(query_texts.select("query_id", "raw_query"), "query_id")
        .na.fill("", [*texts, *_ATTRIBUTES])
    )
    return best_snippets(rows, "content", "raw_query")


# --- reranking -----------------------------------------------------------------------------

PairScorer = Callable[[Column, Column], Column]


def lexical_score(raw_query: str, within: Sequence[str]) -> Column:
    """0.7 of the normalised retrieval score + 0.3 of word and string similarity."""
    span = W.partitionBy(*within)
    low, high = F.min("rrf_score").over(span), F.max("rrf_score").over(span)
    scaled = (F.col("rrf_score") - low) / F.when(high > low, high - low).otherwise(1.0)
    brief = F.concat_ws(
        " ",
        *[F.when(F.col(c) != "", F.col(c)) for c in ("article_title", "primary_intent")],
        F.when(F.col("query_triggers") != "", F.substring("query_triggers", 1, 200)),
    )
    words = 0.6 * tx.jaccard(tx.tokenize(raw_query), tx.tokenize(brief)) + 0.4 * fuzzy_ratio(F.col(raw_query), brief)
    return 0.70 * scaled + 0.30 * words


def _windowed(candidates: DataFrame, within: Sequence[str], size: int) -> DataFrame:
    return top_n(candidates, within, [F.asc("position"), F.asc("kbid")], max(1, size), "_place")


def lexical_rerank(candidates: DataFrame, within: Sequence[str], settings: RetrievalSettings = RETRIEVAL) -> DataFrame:
    """Winner per key by the lexical score; the earlier candidate wins ties."""
    rows = _windowed(candidates, within, settings.rerank_window).withColumn("rerank_score", lexical_score("raw_query", within))
    return latest_per_key(rows, within, [F.desc("rerank_score"), F.asc("_place")]).drop("_place")


def scorer_rerank(
    candidates: DataFrame, within: Sequence[str], scorer: PairScorer, settings: RetrievalSettings = RETRIEVAL
) -> DataFrame:
    """Winner per key by a pair scorer, with near-ties settled by article family.

    When the best and the next score are closer than the margin and some candidates belong
    to one family, the best representative's family is chosen and its best member wins.
    """
    s = settings
    query = F.coalesce(F.col("rerank_query"), F.col("raw_query")) if "rerank_query" in candidates.columns else F.col("raw_query")
    body = tx.candidate_text("article_title", "summary", "query_triggers", "snippet", "acronyms", "secondary_entities")
    rows = (
        _windowed(candidates, within, s.rerank_window)
        .withColumn("rerank_score", scorer(query, body))
        .withColumn("family", tx.canonical_key("primary_topic", "article_title", "kbid"))
    )
    span = W.partitionBy(*within)
    by_score = span.orderBy(F.desc("rerank_score"), F.asc("_place"))
    kth = max(2, s.tie_topk)
    rows = (
        rows.withColumn("_rank", F.row_number().over(by_score))
        .withColumn("_n", F.count(F.lit(1)).over(span))
        .withColumn("_families", F.size(F.collect_set("family").over(span)))
        .withColumn(
            "_margin",
            F.max(F.when(F.col("_rank") == 1, F.col("rerank_score"))).over(span)
            - F.max(F.when(F.col("_rank") == kth, F.col("rerank_score"))).over(span),
        )
    )
    tied = (F.col("_n") >= kth) & (F.col("_margin") < s.tie_margin) & (F.col("_families") < F.col("_n"))
    clear = rows.where(~tied & (F.col("_rank") == 1))
    contested = rows.where(tied)
    reps = family_representatives(contested, within, "family", "rrf_score", "kbid")
    best_family = latest_per_key(reps, within, [F.desc("rerank_score"), F.desc("rrf_score"), F.asc("kbid")]).select(*within, "family")
    members = contested.join(best_family, [*within, "family"], "left_semi")
    member_order = F.desc("rerank_score") if s.rescore_families else F.desc("rrf_score")
    settled = latest_per_key(members, within, [member_order, F.desc("rrf_score"), F.asc("kbid")])
    return clear.unionByName(settled).drop("_place", "_rank", "_n", "_families", "_margin")


def tournament_rerank(
    candidates: DataFrame, within: Sequence[str], scorer: PairScorer, settings: RetrievalSettings = RETRIEVAL
) -> DataFrame:
    """Large pools are dealt into groups; group winners meet in a final."""
    body = tx.candidate_text("article_title", "summary", "query_triggers", "snippet", "acronyms", "secondary_entities")
    scored = candidates.withColumn("rerank_score", scorer(F.col("raw_query"), body))
    dealt = deal_groups(scored, within, [F.asc("position"), F.asc("kbid")], settings.group_size, settings.small_pool)
    finalists = latest_per_key(dealt, [*within, "deal_group"], [F.desc("rerank_score"), F.asc("position")])
    return latest_per_key(finalists, within, [F.desc("rerank_score"), F.asc("position")])


def overlap_scorer(query: Column, body: Column) -> Column:
    """Default pair scorer: word overlap of the two texts."""
    return tx.jaccard(tx.tokenize(query), tx.tokenize(body))


def rerank(
    candidates: DataFrame, within: Sequence[str], strategy: str = "lexical", scorer: PairScorer = overlap_scorer,
    settings: RetrievalSettings = RETRIEVAL,
) -> DataFrame:
    """Rerank by a named strategy: lexical, scorer or tournament; anything else is lexical."""
    name = (strategy or "").strip().lower()
    if name == "scorer":
        return scorer_rerank(candidates, within, scorer, settings)
    if name == "tournament":
        return tournament_rerank(candidates, within, scorer, settings)
    return lexical_rerank(candidates, within, settings)


def selection_confidence(winners: DataFrame, scores: DataFrame, within: Sequence[str]) -> DataFrame:
    """Confidence of the chosen document per key, from all scores of the key.

    ``winners``: within + kbid; ``scores``: within + kbid, rrf_score, signals, exact_match, phrase_match.
    """
    told = scores.join(winners.select(*within, F.col("kbid").alias("_chosen")), list(within))
    gap = winner_gap(told, within, "kbid", "rrf_score", "_chosen")
    own = scores.select(*within, F.col("kbid").alias("winner"), "signals", "exact_match", "phrase_match")
    rows = gap.join(own, [*within, "winner"], "left").na.fill(0, ["signals"]).na.fill(False, ["exact_match", "phrase_match"])
    value = vx.confidence_value("winner_score", "runner_up_score", "signals", "exact_match", "phrase_match")
    return rows.withColumn("_c", value).select(
        *within, "winner",
        F.bround("_c", 4).alias("confidence"),
        vx.confidence_label("_c").alias("confidence_label"),
        F.bround("winner_score", 4).alias("winner_score"),
        F.bround("runner_up_score", 4).alias("runner_up_score"),
        F.bround("score_gap", 4).alias("score_gap"),
        F.col("signals").alias("supporting_signals"), "exact_match", "phrase_match",
    )


def two_level_select(
    queries: DataFrame, keywords: DataFrame, summaries: DataFrame, embed: Callable[[DataFrame, str], DataFrame],
    strategy: str = "lexical", scorer: PairScorer = overlap_scorer, settings: RetrievalSettings = RETRIEVAL,
    ranker: str = "cover", indexes: Indexes = Indexes(),
) -> dict[str, DataFrame]:
    """Pick one document per query: candidates per shard, then one final rerank.

    Returns ``selected`` (one row per query, also for queries that found nothing),
    ``shard_winners`` and ``retrieved``. The retrieved frame is written once and shared.
    Every shard has a winner, its best candidate where none of them has a summary; ``selected`` lists them by shard in
    ``shard_winners``. All candidates go to the final rerank, not the winners alone.
    """
    units = materialise(term_units(queries, embed, settings.per_shard_top_k), "units")
    found = best_across_groups(hybrid_search(units, keywords, summaries, settings, ranker, indexes), settings.per_shard_top_k)
    retrieved = materialise(found, "retrieved")
    texts = queries.select("query_id", "raw_query")

    chosen = materialise(select_candidates(retrieved, ["query_id", "shard_id"], settings=settings), "chosen")
    per_shard = materialise(hydrate(chosen, summaries, keywords, texts), "candidates")
    shard_winners = rerank(per_shard, ["query_id", "shard_id"], strategy, scorer, settings)
    ranked = shard_winners.select("query_id", "shard_id", F.col("kbid").alias("_reranked"))
    first = chosen.where(F.col("position") == 1).select("query_id", "shard_id", "kbid").join(ranked, ["query_id", "shard_id"], "left")
    by_shard = F.struct("shard_id", F.coalesce("_reranked", "kbid").alias("kbid"))
    listed = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(by_shard)), lambda w: w["kbid"]).alias("shard_winners"))

    pool = best_per_doc(per_shard, ["query_id", "kbid"], "rrf_score", ["shard_id"], False)
    # Only the best few of the pool are reranked, where the strategy does not itself deal them into groups; the literal bound
    # cuts every partition before the shuffle, however many shards a query has candidates in.
    best_first = [F.desc("rrf_score"), F.asc("kbid")]
    whole = (strategy or "").strip().lower() == "tournament"
    window = W.partitionBy("query_id").orderBy(*best_first)
    pool = pool.drop("position")
    pool = pool.withColumn("position", F.row_number().over(window)) if whole else top_n(pool, ["query_id"], best_first, max(1, settings.rerank_window), "position")
    final = rerank(pool, ["query_id"], strategy, scorer, settings)
    # The pool counts every candidate, with a summary or not; without any summary its best candidate is taken.
    shape = chosen.groupBy("query_id").agg(
        F.count_distinct("kbid").alias("pool_size"), F.count_distinct("shard_id").alias("shards")
    )
    best = latest_per_key(chosen, ["query_id"], best_first).select("query_id", F.col("kbid").alias("_best"))
    winners = best.join(final.select("query_id", F.col("kbid").alias("_reranked")), "query_id", "left")
    told = winners.select("query_id", F.coalesce("_reranked", "_best").alias("kbid"), F.col("_reranked").isNull().alias("_fallback"))
    confidence = selection_confidence(
        told, best_per_doc(retrieved, ["query_id", "kbid"], "rrf_score", ["shard_id"], False), ["query_id"]
    )
    mode = (
        F.when(F.col("pool_size").isNull(), "no_winners").when(F.col("pool_size") == 1, "single_candidate")
        .when(F.col("_fallback"), "score_fallback").when(F.col("shards") == 1, "single_shard").otherwise("two_level_rerank")
    )
    selected = (
        texts.join(confidence, "query_id", "left").join(shape, "query_id", "left").join(listed, "query_id", "left")
        .join(told.select("query_id", "_fallback"), "query_id", "left")
        .withColumn("mode", mode)
        .withColumn(
            "selected_via",
            F.when(F.col("mode") == "no_winners", "none").when(F.col("mode").isin("single_candidate", "score_fallback"), "retrieval").otherwise("rerank"),
        )
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("confidence_label", F.coalesce("confidence_label", F.lit("none")))
        .withColumnRenamed("winner", "selected_kb").drop("_fallback")
    )
    return {"selected": selected, "shard_winners": shard_winners, "retrieved": retrieved}


def fetch_content(ids: DataFrame, summaries: DataFrame) -> DataFrame:
    return ids.join(summaries.select(F.col("doc_id").alias("kbid"), "summary", "content"), "kbid")


def dataset_params(agents: DataFrame) -> DataFrame:
    """Per agent: enabled datasets, the largest top_k and the smallest similarity bound.

    ``agents``: agent_id, datasets array<struct<dataset_id, rag_config struct<enabled, top_k, min_similarity>>>.
    """
    enabled = F.filter("datasets", lambda d: F.coalesce(d["rag_config"]["enabled"], F.lit(True)))
    return (
        agents.select("agent_id", F.explode(enabled).alias("d"))
        .groupBy("agent_id")
        .agg(
            F.array_sort(F.collect_set("d.dataset_id")).alias("dataset_ids"),
            F.max(F.coalesce("d.rag_config.top_k", F.lit(5))).alias("top_k"),
            F.min(F.coalesce("d.rag_config.min_similarity", F.lit(0.5))).alias("min_similarity"),
        )
    )


def similarity_search(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages of a query's datasets over its similarity bound, best first, rounded score.

    ``queries``: query_id, dataset_id (one row per dataset), embedding, top_k, min_similarity;
    ``passages``: passage_id, dataset_id, text, source, page, embedding.
    """
    near = knn_join(queries, passages, "query_id", ["passage_id"], "top_k", match=["dataset_id"])
    scored = near.withColumn("similarity", F.lit(1.0) - F.col("distance")).where(F.col("similarity") >= F.col("min_similarity"))
    best = top_n(scored.drop("rank"), ["query_id"], [F.desc("similarity"), F.asc("passage_id")], "top_k", "rank")
    return best.withColumn("score", vx.round_score("similarity"))


def evaluate(selected: DataFrame, cases: DataFrame, retrieved: DataFrame | None = None, shown: int = 5) -> dict[str, DataFrame]:
    """Compare the selected with the expected documents.

    ``cases``: query_id, query_type, expected_kb. Returns the compared rows, accuracy overall and by type, and the documents most
    often selected wrongly. With ``retrieved`` (query_id, kbid, rrf_score) there are also the distinct ids of each query with their
    place, best first, and the compared rows have ``expected_place`` (null if the expected one was not retrieved),
    ``retrieved_count`` and ``top_list``, the first ids.
    """
    compared = cases.join(selected.select("query_id", F.col("selected_kb").alias("top_kb")), "query_id", "left").withColumn(
        "match", F.coalesce(F.trim("top_kb"), F.lit("")) == F.trim("expected_kb")
    )
    out = {"stats": validation_stats(compared), "false_positives": false_positives(compared)}
    if retrieved is not None:
        ids = materialise(first_seen(retrieved, ["query_id"], "kbid", [(-F.col("rrf_score")).alias("_worse")], F.col("_worse")).drop("_worse"), "retrieved-ids")
        count = ids.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved_count"))
        top = ids.where(F.col("place") <= shown).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "kbid"))), lambda x: x["kbid"]).alias("top_list"))
        place = ids.select("query_id", F.col("kbid").alias("expected_kb"), F.col("place").alias("expected_place"))
        compared = compared.join(place, ["query_id", "expected_kb"], "left").join(count, "query_id", "left").join(top, "query_id", "left")
        compared = compared.withColumn("retrieved_count", F.coalesce("retrieved_count", F.lit(0)))
        out["retrieved_ids"] = ids
    return {"cases": compared, **out}


def validation_stats(compared: DataFrame) -> DataFrame:
    """Total, matched and accuracy in percent, per type and overall, with a verdict."""
    rolled = compared.rollup("query_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("match").alias("matched")
    )
    accuracy = vx.percentage("matched", "total", 2)
    return rolled.select(
        F.coalesce("query_type", F.lit("overall")).alias("query_type"), "total", "matched", accuracy.alias("accuracy"),
        F.when(accuracy >= 90, "excellent").when(accuracy >= 70, "good").otherwise("needs improvement").alias("verdict"),
    )


def false_positives(compared: DataFrame, n: int = 20) -> DataFrame:
    wrong = compared.where(~F.col("match") & (F.coalesce("top_kb", F.lit("")) != ""))
    return wrong.groupBy("top_kb").agg(F.count(F.lit(1)).alias("wrong")).orderBy(F.desc("wrong"), "top_kb").limit(n)
