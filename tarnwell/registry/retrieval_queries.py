"""Retrieval: nearest neighbours, full text, fusion, selection, reranking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.fulltext import search_clauses
from tarnwell.operators.textindex import build_index, cover_density_of_hits, hit_weights, match_index
from tarnwell.operators.vectorlists import VectorLists, build_lists, open_lists, search_lists
from tarnwell.plans import retrieval as rt
from tarnwell.registry import query
from tarnwell.registry.inputs import (
    KEYWORDS_SQL,
    SUMMARIES_SQL,
    UNITS_SQL,
    fts_text_sql,
    keyword_frame,
    stored_folder,
    stored_index,
    summary_frame,
    table,
    unit_frame,
    vectors_sql,
)
from tarnwell.settings import INDEX

# Twin of the vector arm: distances of every unit to every use case row, best rows per shard.
VECTOR_ARM_SQL = (
    vectors_sql("u", "units", "unit_id", "query_text")
    + ","
    + vectors_sql("k", "(SELECT DISTINCT term FROM kw WHERE kind = 'usecase')", "term", "term")
    + """,
dots AS (
  SELECT u.unit_id, k.term, sum(u.v * k.v) AS d FROM u_slot u JOIN k_slot k ON u.slot = k.slot GROUP BY ALL),
dist AS (
  SELECT c.unit_id, c.term, round(1 - coalesce(d.d, 0) / (c.un * c.kn), 9) AS distance
  FROM (SELECT ul.unit_id, kl.term, ul.n AS un, kl.n AS kn FROM u_len ul, k_len kl) c
  LEFT JOIN dots d ON d.unit_id = c.unit_id AND d.term = c.term),
near AS (
  SELECT q.unit_id, q.query_text, q.wanted, q.top_k, w.kbid, w.shard_id, w.category, w.primary_topic, w.term, t.distance,
    row_number() OVER (PARTITION BY q.unit_id, w.shard_id ORDER BY t.distance, w.kbid, w.term) AS rn
  FROM dist t JOIN kw w ON w.term = t.term AND w.kind = 'usecase' JOIN units q ON q.unit_id = t.unit_id),
flagged AS (
  SELECT *, query_text = lower(primary_topic) OR query_text = lower(trim(term)) AS ex,
    contains(query_text, lower(primary_topic)) OR contains(lower(primary_topic), query_text)
      OR contains(query_text, lower(trim(term))) OR contains(lower(trim(term)), query_text) AS ph
  FROM near WHERE rn <= top_k * 12),
boosted AS (
  SELECT *, distance * CASE lower(category) WHEN wanted THEN 0.85 WHEN 'both' THEN 0.90 ELSE 1.0 END
    * CASE WHEN ex THEN 0.65 WHEN ph THEN 0.82 ELSE 1.0 END AS bd FROM flagged),
vec AS (
  SELECT unit_id, shard_id, kbid, bd AS vector_distance, distance AS raw, ex, ph, category
  FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, shard_id, kbid ORDER BY bd, rn) AS r FROM boosted) WHERE r = 1)"""
)

KEYWORD_ARM_SQL = (
    f"""
kt AS (SELECT kbid, shard_id, category, primary_topic, kind, term, {fts_text_sql('term')} AS tt, {fts_text_sql('primary_topic')} AS pt FROM kw),
ut AS (SELECT * EXCLUDE a, {fts_text_sql('a')} AS qt FROM (SELECT *, unnest(string_split(query_text, ' or ')) AS a FROM units)),
khit AS (
  SELECT u.unit_id, k.*, u.query_text, u.wanted, u.top_k, list_distinct(string_split(u.qt, ' ')) AS terms
  FROM ut u JOIN kt k ON
    len(list_filter(list_distinct(string_split(u.qt, ' ')), lambda t: NOT contains(' ' || k.tt || ' ' || k.pt || ' ', ' ' || t || ' '))) = 0),
kdoc AS (
  SELECT unit_id, shard_id, kbid, wanted, top_k,
    max(CASE kind WHEN 'specific' THEN 1.0 ELSE 0.4 END * len(list_filter(string_split(tt, ' '), lambda t: list_contains(terms, t)))
      + 0.4 * len(list_filter(string_split(pt, ' '), lambda t: list_contains(terms, t)))) AS raw,
    max(category) AS category,
    bool_or(lower(trim(term)) = query_text OR lower(primary_topic) = query_text) AS ex,
    bool_or(contains(lower(term), query_text) OR contains(lower(primary_topic), query_text)) AS ph
  FROM khit GROUP BY ALL),
kcut AS (
  SELECT *, raw * CASE lower(category) WHEN wanted THEN 1.15 WHEN 'both' THEN 1.10 ELSE 1.0 END
      + CASE WHEN ex THEN 1.25 ELSE 0 END + CASE WHEN ph THEN 0.35 ELSE 0 END AS fts_keywords_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, shard_id ORDER BY raw DESC, kbid) AS r FROM kdoc) WHERE r <= top_k * 12),
kws AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, shard_id ORDER BY fts_keywords_rank DESC, kbid) AS r2 FROM kcut) WHERE r2 <= top_k)"""
)

SUMMARY_ARM_SQL = (
    f"""
st AS (SELECT *, {fts_text_sql('primary_intent')} AS it, {fts_text_sql('query_triggers')} AS qg, {fts_text_sql('content')} AS ct,
    {fts_text_sql('secondary_mentions')} AS mt FROM sm),
uts AS (SELECT * EXCLUDE a, {fts_text_sql('a')} AS qt FROM (SELECT *, unnest(string_split(query_text, ' or ')) AS a FROM units)),
shit AS (
  SELECT u.unit_id, s.*, u.query_text, u.top_k, list_distinct(string_split(u.qt, ' ')) AS terms
  FROM uts u JOIN st s ON
    len(list_filter(list_distinct(string_split(u.qt, ' ')), lambda t: NOT contains(' ' || s.it || ' ' || s.qg || ' ' || s.ct || ' ' || s.mt || ' ', ' ' || t || ' '))) = 0),
sdoc AS (
  SELECT unit_id, shard_id, kbid, top_k, max(raw) AS raw, bool_or(ex) AS ex, bool_or(ph) AS ph FROM (
  SELECT unit_id, shard_id, kbid, top_k,
    1.0 * len(list_filter(string_split(it, ' '), lambda t: list_contains(terms, t)))
      + 1.0 * len(list_filter(string_split(qg, ' '), lambda t: list_contains(terms, t)))
      + 0.4 * len(list_filter(string_split(ct, ' '), lambda t: list_contains(terms, t)))
      + 0.1 * len(list_filter(string_split(mt, ' '), lambda t: list_contains(terms, t))) AS raw,
    lower(trim(primary_intent)) = query_text OR lower(trim(query_triggers)) = query_text AS ex,
    contains(lower(primary_intent), query_text) OR contains(lower(query_triggers), query_text) OR contains(lower(content), query_text) AS ph
  FROM shit) GROUP BY ALL),
sms AS (
  SELECT *, raw + CASE WHEN ex THEN 0.80 ELSE 0 END + CASE WHEN ph THEN 0.25 ELSE 0 END AS fts_summaries_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, shard_id ORDER BY raw DESC, kbid) AS r FROM sdoc) WHERE r <= top_k * 6)"""
)


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return unit_frame(spark, sf)


def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The keyword rows with their vectors as a table, written by the first query that asks for them."""
    frame = keyword_frame(spark, sf)
    root = stored_folder(spark, sf, "keyword-rows", lambda at: frame.write.parquet(at))
    return spark.read.schema(frame.schema).parquet(root)


def _indexes(spark: SparkSession, sf: str) -> rt.Indexes:
    keywords = stored_index(spark, sf, "keyword", lambda root: rt.keyword_index(_keywords(spark, sf), root))
    return rt.Indexes(keywords, stored_index(spark, sf, "summary", lambda root: rt.summary_index(summary_frame(spark, sf), root)))


@query(
    "vector_search",
    f"""WITH {KEYWORDS_SQL}, {UNITS_SQL}, {VECTOR_ARM_SQL}
    SELECT unit_id, shard_id, kbid, round(vector_distance, 6) AS vector_distance, round(raw, 6) AS vector_distance_raw,
      ex AS vector_exact_match, ph AS vector_phrase_match FROM vec""",
)
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    found = rt.vector_search(_units(spark, sf), _keywords(spark, sf))
    return found.select(
        "unit_id", "shard_id", "kbid", F.round("vector_distance", 6).alias("vector_distance"),
        F.round("vector_distance_raw", 6).alias("vector_distance_raw"), "vector_exact_match", "vector_phrase_match",
    )


@query(
    "merge_vector_shards",
    f"""WITH {KEYWORDS_SQL}, {UNITS_SQL}, {VECTOR_ARM_SQL}
    SELECT unit_id, kbid, round(d, 6) AS vector_distance FROM (
      SELECT unit_id, kbid, min(vector_distance) AS d, row_number() OVER (PARTITION BY unit_id ORDER BY min(vector_distance), kbid) AS r
      FROM vec GROUP BY unit_id, kbid) WHERE r <= 8""",
)
def merge_vector_shards(spark: SparkSession, sf: str) -> DataFrame:
    best = rt.vector_search_all(_units(spark, sf), _keywords(spark, sf), 8)
    return best.select("unit_id", "kbid", F.round("vector_distance", 6).alias("vector_distance"))


@query(
    "fts_keywords",
    f"""WITH {KEYWORDS_SQL}, {UNITS_SQL}, {KEYWORD_ARM_SQL}
    SELECT unit_id, shard_id, kbid, round(raw::DOUBLE, 6) AS fts_keywords_rank_raw, round(fts_keywords_rank::DOUBLE, 6) AS fts_keywords_rank,
      ex AS fts_keywords_exact_match, ph AS fts_keywords_phrase_match FROM kws""",
)
def fts_keywords(spark: SparkSession, sf: str) -> DataFrame:
    units = unit_frame(spark, sf, False)
    found = rt.fts_keywords(units, _keywords(spark, sf), ranker="hits", index=_indexes(spark, sf).keywords)
    return found.select(
        "unit_id", "shard_id", "kbid", F.round("fts_keywords_rank_raw", 6).alias("fts_keywords_rank_raw"),
        F.round("fts_keywords_rank", 6).alias("fts_keywords_rank"), "fts_keywords_exact_match", "fts_keywords_phrase_match",
    )


@query(
    "fts_summaries",
    f"""WITH {SUMMARIES_SQL}, {UNITS_SQL}, {SUMMARY_ARM_SQL}
    SELECT unit_id, shard_id, kbid, round(raw::DOUBLE, 6) AS fts_summaries_rank_raw, round(fts_summaries_rank::DOUBLE, 6) AS fts_summaries_rank,
      ex AS fts_summaries_exact_match, ph AS fts_summaries_phrase_match FROM sms""",
)
def fts_summaries(spark: SparkSession, sf: str) -> DataFrame:
    units = unit_frame(spark, sf, False)
    found = rt.fts_summaries(units, summary_frame(spark, sf), ranker="hits", index=_indexes(spark, sf).summaries)
    return found.select(
        "unit_id", "shard_id", "kbid", F.round("fts_summaries_rank_raw", 6).alias("fts_summaries_rank_raw"),
        F.round("fts_summaries_rank", 6).alias("fts_summaries_rank"), "fts_summaries_exact_match", "fts_summaries_phrase_match",
    )


# Fused score per (unit, shard): the arms joined in full, scaled per signal, weighted, with bonuses.
FUSE_SQL = """
joined AS (
  SELECT coalesce(v.unit_id, k.unit_id, s.unit_id) AS unit_id, coalesce(v.shard_id, k.shard_id, s.shard_id) AS shard_id, coalesce(v.kbid, k.kbid, s.kbid) AS kbid,
    v.vector_distance AS vd, k.fts_keywords_rank::DOUBLE AS kr, s.fts_summaries_rank::DOUBLE AS sr,
    coalesce(v.ex, FALSE) OR coalesce(k.ex, FALSE) OR coalesce(s.ex, FALSE) AS ex, coalesce(v.ph, FALSE) OR coalesce(k.ph, FALSE) OR coalesce(s.ph, FALSE) AS ph
  FROM vec v FULL JOIN kws k ON v.unit_id = k.unit_id AND v.shard_id = k.shard_id AND v.kbid = k.kbid
  FULL JOIN sms s ON coalesce(v.unit_id, k.unit_id) = s.unit_id AND coalesce(v.shard_id, k.shard_id) = s.shard_id AND coalesce(v.kbid, k.kbid) = s.kbid),
spans AS (
  SELECT *, min(vd) OVER w AS v0, max(vd) OVER w AS v1, min(kr) OVER w AS k0, max(kr) OVER w AS k1, min(sr) OVER w AS s0, max(sr) OVER w AS s1
  FROM joined WINDOW w AS (PARTITION BY unit_id, shard_id)),
fused AS (
  SELECT *, coalesce(CASE WHEN v0 = v1 THEN 1.0 ELSE 1 - (vd - v0) / (v1 - v0) END * CASE WHEN vd IS NULL THEN 0 ELSE 1 END, 0) * 0.45
    + coalesce(CASE WHEN kr IS NULL THEN 0 WHEN k0 = k1 THEN 1.0 ELSE (kr - k0) / (k1 - k0) END, 0) * 0.25
    + coalesce(CASE WHEN sr IS NULL THEN 0 WHEN s0 = s1 THEN 1.0 ELSE (sr - s0) / (s1 - s0) END, 0) * 0.30
    + 0.15 * ((vd IS NOT NULL)::INT + (kr IS NOT NULL)::INT + (sr IS NOT NULL)::INT - 1)
    + CASE WHEN ex THEN 0.20 ELSE 0 END + CASE WHEN ph THEN 0.08 ELSE 0 END AS score FROM spans),
top AS (SELECT *, row_number() OVER (PARTITION BY unit_id, shard_id ORDER BY score DESC, kbid) AS pos FROM fused)"""

ARMS_SQL = f"{KEYWORDS_SQL}, {SUMMARIES_SQL}, {UNITS_SQL}, {VECTOR_ARM_SQL}, {KEYWORD_ARM_SQL}, {SUMMARY_ARM_SQL}, {FUSE_SQL}"


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return rt.hybrid_search(_units(spark, sf), _keywords(spark, sf), summary_frame(spark, sf), ranker="hits", indexes=_indexes(spark, sf))


@query(
    "hybrid_topk",
    f"""WITH {ARMS_SQL}
    SELECT unit_id, shard_id, kbid, round(score::DOUBLE, 6) AS rrf_score,
      concat_ws('|', CASE WHEN vd IS NOT NULL THEN 'vector' END, CASE WHEN kr IS NOT NULL THEN 'fts_keywords' END, CASE WHEN sr IS NOT NULL THEN 'fts_summaries' END) AS matched_in
    FROM top WHERE pos <= 8""",
)
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf).select(
        "unit_id", "shard_id", "kbid", F.round("rrf_score", 6).alias("rrf_score"), F.array_join("matched_in", "|").alias("matched_in")
    )


def _merged_sql(name: str, arm: str, value: str, order: str) -> str:
    """Best row of every (unit, document) over the shards, the first eight per unit, with one shard for all."""
    return f"""
{name} AS (
  SELECT unit_id, 0 AS shard_id, kbid, {value}, ex, ph FROM (
    SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY {value} {order}, kbid) AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY unit_id, kbid ORDER BY {value} {order}, shard_id) AS r3 FROM {arm}) WHERE r3 = 1) WHERE place <= 8)"""


_ALL_SQL = ", ".join([
    KEYWORDS_SQL, SUMMARIES_SQL, UNITS_SQL, VECTOR_ARM_SQL.replace("PARTITION BY q.unit_id, w.shard_id ORDER BY", "PARTITION BY q.unit_id ORDER BY"), KEYWORD_ARM_SQL, SUMMARY_ARM_SQL,
    _merged_sql("vecm", "vec", "vector_distance", "ASC"), _merged_sql("kwm", "kws", "fts_keywords_rank", "DESC"), _merged_sql("smm", "sms", "fts_summaries_rank", "DESC"),
    FUSE_SQL.replace("FROM vec v FULL JOIN kws k", "FROM vecm v FULL JOIN kwm k").replace("FULL JOIN sms s", "FULL JOIN smm s"),
])


@query(
    "hybrid_all",
    f"""WITH {_ALL_SQL}
    SELECT unit_id, kbid, round(score::DOUBLE, 6) AS rrf_score, pos AS rank FROM top WHERE pos <= 8""",
)
def hybrid_all(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of every question over all shards: eight rows a question, however many shards there are."""
    root = stored_folder(spark, sf, "keyword-lists", lambda at: rt.keyword_lists(_keywords(spark, sf), at))
    indexes = replace(_indexes(spark, sf), lists=open_lists(spark, root))
    found = rt.hybrid_search_all(_units(spark, sf), _keywords(spark, sf), summary_frame(spark, sf), ranker="hits", indexes=indexes)
    return found.select("unit_id", "kbid", F.round("rrf_score", 6).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


_BEST_SQL = f"""{ARMS_SQL},
found AS (SELECT split_part(unit_id, ':', 1)::BIGINT AS query_id, shard_id, kbid, max(score) AS score FROM top WHERE pos <= 8 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kbid, shard_id) AS pos FROM found)"""


def _found(spark: SparkSession, sf: str) -> DataFrame:
    """Best score of every document per benchmark passage."""
    hits = _hybrid(spark, sf)
    return hits.groupBy("query_id", "shard_id", "kbid").agg(F.max("rrf_score").alias("rrf_score"), F.max("signals").alias("signals"),
                                                            F.max("exact_match").alias("exact_match"), F.max("phrase_match").alias("phrase_match"))


_CANDIDATES_SQL = f"""{_BEST_SQL},
sized AS (
  SELECT *, count(*) OVER w AS n, max(CASE WHEN pos = 1 THEN score END) OVER w AS s1, coalesce(max(CASE WHEN pos = 2 THEN score END) OVER w, 0) AS s2,
    coalesce(max(CASE WHEN pos = 3 THEN score END) OVER w, 0) AS s3 FROM ranked WINDOW w AS (PARTITION BY query_id)),
kept AS (SELECT *, count(*) FILTER (score >= s1 * 0.8) OVER (PARTITION BY query_id) AS close FROM sized),
cand AS (
  SELECT * FROM kept WHERE pos <= CASE WHEN n = 1 THEN 1 WHEN n >= 3 AND s3 > 0 AND s2 >= s3 * 1.5 THEN 2 ELSE greatest(2, least(10, close)) END)"""


@query(
    "candidates",
    f"""WITH {_CANDIDATES_SQL}
    SELECT query_id, kbid, pos AS position, CASE WHEN n = 1 THEN 'direct' ELSE 'rerank' END AS mode, round(score::DOUBLE, 6) AS rrf_score FROM cand""",
)
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.fusion import select_candidates

    picked = select_candidates(_found(spark, sf), ["query_id"])
    return picked.select("query_id", "kbid", F.col("position").cast("long").alias("position"), "mode", F.round("rrf_score", 6).alias("rrf_score"))


_GAP_SQL = f"""{_BEST_SQL},
gap AS (
  SELECT query_id, max(CASE WHEN pos = 1 THEN kbid END) AS winner, max(CASE WHEN pos = 1 THEN score END)::DOUBLE AS w,
    coalesce(max(CASE WHEN pos <> 1 THEN score END), 0)::DOUBLE AS r FROM ranked GROUP BY query_id)"""


@query(
    "winner_gap",
    f"WITH {_GAP_SQL} SELECT query_id, winner, round(w, 6) AS winner_score, round(r, 6) AS runner_up_score, round(w - r, 6) AS score_gap, round((w - r) / greatest(w, 1e-6), 6) AS margin FROM gap",
)
def winner_gap(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.ranking import winner_gap as gap

    rows = gap(_found(spark, sf), ["query_id"], "kbid", "rrf_score")
    return rows.select("query_id", "winner", *[F.round(c, 6).alias(c) for c in ("winner_score", "runner_up_score", "score_gap", "margin")])


_CLAMP = "greatest(0, least(1, {x}))"
_CONFIDENCE_SQL = f"""{_BEST_SQL},
gap AS (
  SELECT query_id, max(CASE WHEN pos = 1 THEN kbid END) AS winner, max(CASE WHEN pos = 1 THEN score END)::DOUBLE AS w,
    coalesce(max(CASE WHEN pos <> 1 THEN score END), 0)::DOUBLE AS r FROM ranked GROUP BY query_id),
marks AS (
  SELECT split_part(unit_id, ':', 1)::BIGINT AS query_id, kbid, bool_or(ex) AS ex, bool_or(ph) AS ph,
    max((vd IS NOT NULL)::INT + (kr IS NOT NULL)::INT + (sr IS NOT NULL)::INT) AS signals FROM top WHERE pos <= 8 GROUP BY ALL),
conf AS (
  SELECT g.*, m.signals, greatest(0, least(1, 0.45 * {_CLAMP.format(x='w / (1 + w)')} + 0.25 * {_CLAMP.format(x='(w - r) / greatest(w, 1e-6)')}
    + 0.15 * {_CLAMP.format(x='CASE WHEN r <= 0 THEN 1.0 ELSE w / greatest(r, 1e-6) - 1 END / 1.5')} + 0.15 * {_CLAMP.format(x='m.signals / 3.0')}
    + CASE WHEN m.ex THEN 0.08 WHEN m.ph THEN 0.04 ELSE 0 END)) AS c
  FROM gap g JOIN marks m ON m.query_id = g.query_id AND m.kbid = g.winner)"""


@query(
    "confidence",
    f"""WITH {_CONFIDENCE_SQL}
    SELECT query_id, winner, round_even(c::DOUBLE, 4)::DOUBLE AS confidence, CASE WHEN c >= 0.85 THEN 'very_high' WHEN c >= 0.7 THEN 'high' WHEN c >= 0.5 THEN 'medium'
      WHEN c > 0 THEN 'low' ELSE 'none' END AS confidence_label, signals AS supporting_signals FROM conf""",
)
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    scores = _found(spark, sf)
    first = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "kbid")
    winners = scores.withColumn("r", F.row_number().over(first)).where("r = 1")
    told = rt.selection_confidence(winners, scores, ["query_id"])
    return told.select("query_id", "winner", "confidence", "confidence_label", "supporting_signals")


# --- nearest neighbours over the given vectors -------------------------------------------------

_KNN_SQL = """
pairs AS (
  SELECT q.vec_id AS query_id, q.label AS asked, v.vec_id AS row_id, v.label,
    round(1 - list_inner_product(q.e, v.e) / (q.n * v.n), 9) AS distance
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) q,
       (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) v),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM pairs)"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return (
        e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"), "embedding"),
        e.select(F.col("vec_id").alias("row_id"), "label", "embedding"),
    )


@query("knn_topk", f"WITH {_KNN_SQL} SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM knn WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.knn import knn_join

    q, v = _vectors(spark, sf)
    near = knn_join(q, v, "query_id", ["row_id"], 10)
    return near.select("query_id", "row_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    "knn_category_boost",
    f"""WITH {_KNN_SQL}, boosted AS (
      SELECT *, distance * CASE WHEN label = asked THEN 0.85 WHEN label = 0 THEN 0.90 ELSE 1.0 END AS b FROM knn WHERE rank <= 96)
    SELECT query_id, row_id, round(b::DOUBLE, 6) AS boosted, r AS place FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b, rank) AS r FROM boosted) WHERE r <= 8""",
)
def knn_category_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Over-fetch 8 x 6 x 2, boost by category, keep 8."""
    from tarnwell.functions.vectors import distance_multiplier
    from tarnwell.operators.knn import knn_join
    from tarnwell.operators.ranking import search_limit, top_n

    q, v = _vectors(spark, sf)
    name = lambda c: F.when(F.col(c) == 0, "both").otherwise(F.concat(F.lit("c"), F.col(c).cast("string")))
    asked = F.concat(F.lit("c"), F.col("asked").cast("string"))
    q = q.withColumn("fetch", search_limit(F.lit(8), asked)).withColumn("asked", F.when(F.col("asked") == 0, "c0").otherwise(asked))
    near = knn_join(q, v.withColumn("cat", name("label")), "query_id", ["row_id"], "fetch")
    same_zero = (F.col("label") == 0) & (F.col("asked") == "c0")
    boosted = near.withColumn("b", F.col("distance") * F.when(same_zero, F.lit(0.85)).otherwise(distance_multiplier("asked", "cat")))
    best = top_n(boosted, ["query_id"], [F.asc("b"), F.asc("rank")], 8, "place")
    return best.select("query_id", "row_id", F.round("b", 6).alias("boosted"), F.col("place").cast("long").alias("place"))


def _lists(spark: SparkSession, sf: str) -> VectorLists:
    """Stored lists of the embeddings, built by the first query that asks for them."""
    root = stored_folder(spark, sf, "embedding-lists", lambda at: build_lists(_vectors(spark, sf)[1], at))
    return open_lists(spark, root)


@query("ivf_knn", f"WITH {_KNN_SQL} SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM knn WHERE rank <= 10")
def ivf_knn(spark: SparkSession, sf: str) -> DataFrame:
    """All lists allowed: lists that cannot improve a result are skipped, so it is exact."""
    near = search_lists(_lists(spark, sf), _vectors(spark, sf)[0], "query_id", ["row_id"], 10)
    return near.select("query_id", "row_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("ivf_knn_probed")
def ivf_knn_probed(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest lists only, as many as the settings say."""
    near = search_lists(_lists(spark, sf), _vectors(spark, sf)[0], "query_id", ["row_id"], 10, INDEX.ivf_probes)
    return near.select("query_id", "row_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "similarity_search",
    f"""WITH {_KNN_SQL.replace('FROM pairs)', 'FROM pairs WHERE asked = label)')}
    SELECT query_id, row_id, round_even(1 - distance, 3)::DOUBLE AS score, rank FROM knn WHERE rank <= 5 AND 1 - distance >= 0.1""",
)
def similarity_search(spark: SparkSession, sf: str) -> DataFrame:
    q, v = _vectors(spark, sf)
    asked = q.select("query_id", F.col("asked").alias("dataset_id"), "embedding", F.lit(5).alias("top_k"), F.lit(0.1).alias("min_similarity"))
    passages = v.select(F.col("row_id").alias("passage_id"), F.col("label").alias("dataset_id"), "embedding")
    found = rt.similarity_search(asked, passages)
    return found.select("query_id", F.col("passage_id").alias("row_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(
    "dataset_params",
    """SELECT s_nationkey AS agent_id, max(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 9 + 1 ELSE 5 END) AS top_k,
      min(CASE WHEN s_suppkey % 3 = 0 THEN round(s_acctbal / 20000, 4) ELSE 0.5 END) AS min_similarity, count(*) AS n
    FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY s_nationkey""",
)
def dataset_params(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers stand for datasets, their nation for the agent; every fifth one is switched off."""
    k = F.col("s_suppkey")
    config = F.struct(
        (k % 5 != 0).alias("enabled"), F.when(k % 2 == 0, (k % 9 + 1).cast("int")).alias("top_k"),
        F.when(k % 3 == 0, F.round(F.col("s_acctbal") / 20000, 4)).alias("min_similarity"),
    )
    one = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("agent_id"), F.array(F.struct(F.col("s_name").alias("dataset_id"), config.alias("rag_config"))).alias("datasets")
    )
    out = rt.dataset_params(one)
    return out.select("agent_id", F.col("top_k").cast("long").alias("top_k"), "min_similarity", F.size("dataset_ids").cast("long").alias("n"))


# --- full text over whole documents ------------------------------------------------------------

_DOC_TEXT_SQL = f"dt AS (SELECT doc_id, ' ' || {fts_text_sql('text')} || ' ' AS t FROM documents)"


def _match(spark: SparkSession, sf: str, text, hits: bool = False) -> DataFrame:
    """Matches of the passages, written as queries, in the stored index of all documents; with their hits if these are ranked."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = stored_index(spark, sf, "document", lambda root: build_index(docs, root, ["doc_id"], {"text": "B"}))
    asked = table(spark, sf, "benchmark").select("item_id", text.alias("asked"))
    return match_index(index, search_clauses(asked, "item_id", "asked", exclude_only=True), "item_id", hits)


@query(
    "fts_and_match",
    f"""WITH {_DOC_TEXT_SQL}, bt AS (SELECT item_id, list_distinct(string_split({fts_text_sql('text')}, ' ')) AS q FROM benchmark)
    SELECT item_id, doc_id FROM bt JOIN dt ON len(list_filter(q, lambda x: NOT contains(t, ' ' || x || ' '))) = 0""",
)
def fts_and_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents holding every word of a benchmark passage."""
    return _match(spark, sf, F.col("text")).select("item_id", "doc_id")


@query(
    "fts_phrase",
    f"WITH {_DOC_TEXT_SQL} SELECT item_id, doc_id FROM benchmark JOIN dt ON contains(t, ' ' || {fts_text_sql('benchmark.text')} || ' ')",
)
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Documents holding a whole benchmark passage word for word."""
    return _match(spark, sf, F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit(" ")), F.lit('"'))).select("item_id", "doc_id")


_WORDS_SQL = f"bw AS (SELECT item_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS w FROM (SELECT item_id, string_split({fts_text_sql('text')}, ' ') AS a FROM benchmark))"


@query(
    "fts_not_or",
    f"""WITH {_DOC_TEXT_SQL}, {_WORDS_SQL}
    SELECT DISTINCT item_id, doc_id FROM bw JOIN dt ON (contains(t, ' ' || w[1] || ' ') AND NOT contains(t, ' ' || w[2] || ' '))
      OR (contains(t, ' ' || w[-1] || ' ') AND contains(t, ' ' || w[-2] || ' '))""",
)
def fts_not_or(spark: SparkSession, sf: str) -> DataFrame:
    """First word without the second, or the last two together."""
    from tarnwell.functions.text import search_tokens

    w = F.array_distinct(search_tokens("text"))
    text = F.concat_ws(" ", F.get(w, F.lit(0)), F.concat(F.lit("-"), F.get(w, F.lit(1))), F.lit("or"), F.element_at(w, -1), F.element_at(w, -2))
    return _match(spark, sf, text).select("item_id", "doc_id").distinct()


@query(
    "fts_weighted_topk",
    f"""WITH {_DOC_TEXT_SQL}, bt AS (SELECT item_id, list_distinct(string_split({fts_text_sql('text')}, ' ')) AS q FROM benchmark),
    hit AS (SELECT item_id, doc_id, 0.4 * len(list_filter(string_split(trim(t), ' '), lambda x: list_contains(q, x))) AS s
      FROM bt JOIN dt ON len(list_filter(q, lambda x: NOT contains(t, ' ' || x || ' '))) = 0)
    SELECT item_id, doc_id, round(s::DOUBLE, 6) AS score, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r FROM hit) WHERE r <= 10""",
)
def fts_weighted_topk(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.ranking import top_n

    hits = _match(spark, sf, F.col("text"), True).withColumn("score", F.round(hit_weights("hits"), 6))
    best = top_n(hits, ["item_id"], [F.desc("score"), F.asc("doc_id")], 10, "place")
    return best.select("item_id", "doc_id", "score", F.col("place").cast("long").alias("place"))


@query(
    "fts_exclude_only",
    f"""WITH {_DOC_TEXT_SQL}, {_WORDS_SQL}
    SELECT item_id, doc_id FROM bw JOIN dt ON NOT contains(t, ' ' || w[1] || ' ') AND NOT contains(t, ' ' || coalesce(w[2] || ' ' || w[3], w[1]) || ' ')""",
)
def fts_exclude_only(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the first word of a passage and without the next two side by side."""
    from tarnwell.functions.text import search_tokens

    w = F.array_distinct(search_tokens("text"))
    pair = F.concat(F.lit('-"'), F.get(w, F.lit(1)), F.lit(" "), F.get(w, F.lit(2)), F.lit('"'))
    return _match(spark, sf, F.concat_ws(" ", F.concat(F.lit("-"), F.get(w, F.lit(0))), pair)).select("item_id", "doc_id")


@query(
    "cover_density",
    f"""WITH {_DOC_TEXT_SQL}, bt AS (SELECT item_id, list_distinct(string_split({fts_text_sql('text')}, ' ')) AS q FROM benchmark),
    pair AS (SELECT item_id, doc_id, q, string_split(trim(t), ' ') AS a FROM bt JOIN dt ON len(list_filter(q, lambda x: NOT contains(t, ' ' || x || ' '))) = 0),
    occ AS (SELECT item_id, doc_id, len(q) AS terms, unnest(a) AS term, unnest(range(len(a))) AS pos, q FROM pair),
    hit AS (
      SELECT item_id, doc_id, terms, term, pos, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) - 1 AS i
      FROM occ WHERE list_contains(q, term)),
    recent AS (
      SELECT x.item_id, x.doc_id, x.terms, x.i, y.term, max(y.i) AS j
      FROM hit x JOIN hit y ON x.item_id = y.item_id AND x.doc_id = y.doc_id AND y.i <= x.i GROUP BY ALL),
    stretch AS (
      SELECT item_id, doc_id, min(i) AS i, j FROM (
        SELECT item_id, doc_id, i, min(j) AS j FROM recent GROUP BY item_id, doc_id, i, terms HAVING count(*) = terms) GROUP BY item_id, doc_id, j)
    SELECT s.item_id, s.doc_id, round(sum(0.4::DOUBLE / (1 + (e.pos - b.pos) - (s.i - s.j))), 6) AS score
    FROM stretch s JOIN hit b ON b.item_id = s.item_id AND b.doc_id = s.doc_id AND b.i = s.j
      JOIN hit e ON e.item_id = s.item_id AND e.doc_id = s.doc_id AND e.i = s.i GROUP BY s.item_id, s.doc_id""",
)
def cover_density(spark: SparkSession, sf: str) -> DataFrame:
    hits = _match(spark, sf, F.col("text"), True)
    return hits.select("item_id", "doc_id", F.round(cover_density_of_hits("hits", "terms"), 6).alias("score"))


@query(
    "token_index",
    f"""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(pos) AS positions FROM (
      SELECT doc_id, unnest(q) AS token, generate_subscripts(q, 1) AS pos FROM (SELECT doc_id, string_split({fts_text_sql('text')}, ' ') AS q FROM documents)) WHERE token <> '' GROUP BY token""",
)
def token_index(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.fulltext import token_index as build

    # Texts are dealt out by document, so that words are counted per document where they are; what is sent is one row a word and task.
    rows = build(table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"), ["doc_id"], {"text": "B"})
    per_doc = rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"), F.sum("positions").alias("positions"))


# --- the whole way: normalised questions to one document ----------------------------------------


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.plans.index import normalize_queries

    extracted = F.to_json(F.struct(
        F.lit("software").alias("category"),
        F.struct(
            F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)).alias("specific"),
            F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0)).alias("generic"),
        ).alias("keywords"),
        F.split(F.lower("text"), r"[.\n]+").alias("usecase"),
    ))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"), extracted.alias("extracted"))
    return normalize_queries(b)


def _embed(df: DataFrame, text: str) -> DataFrame:
    from tarnwell.plans.models import embed_terms

    return embed_terms(df, text)


def _selection(spark: SparkSession, sf: str, strategy: str) -> dict[str, DataFrame]:
    return rt.two_level_select(_questions(spark, sf), _keywords(spark, sf), summary_frame(spark, sf), _embed, strategy, indexes=_indexes(spark, sf))


@query("two_level_select")
def two_level_select(spark: SparkSession, sf: str) -> DataFrame:
    out = _selection(spark, sf, "lexical")["selected"]
    return out.select("query_id", "selected_kb", "mode", "selected_via", "confidence", "confidence_label", "shards", "pool_size", F.array_join("shard_winners", "|").alias("shard_winners"))


def _planted_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The first document that holds a benchmark passage word for word is its expected answer."""
    return fts_phrase(spark, sf).groupBy("item_id").agg(F.min("doc_id").cast("string").alias("expected_kb")).select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "generic").otherwise("specific").alias("query_type"), "expected_kb"
    )


@query("evaluate")
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    picked = _selection(spark, sf, "scorer")["selected"]
    return rt.evaluate(picked, _planted_cases(spark, sf))["stats"]


@query(
    "evaluate_places",
    f"""WITH {_BEST_SQL}, {_DOC_TEXT_SQL},
    cases AS (SELECT item_id AS query_id, CAST(min(doc_id) AS VARCHAR) AS expected_kb FROM benchmark JOIN dt ON contains(t, ' ' || {fts_text_sql('benchmark.text')} || ' ') GROUP BY item_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kbid) AS place FROM (SELECT query_id, kbid, max(score) AS score FROM found GROUP BY ALL)),
    per AS (SELECT query_id, count(*) AS n, string_agg(kbid, '|' ORDER BY place) FILTER (place <= 5) AS top_list, max(CASE WHEN place = 1 THEN kbid END) AS top_kb FROM placed GROUP BY query_id)
    SELECT c.query_id, c.expected_kb, top_kb, coalesce(top_kb, '') = c.expected_kb AS match, p.place AS expected_place, coalesce(n, 0) AS retrieved_count, top_list
    FROM cases c LEFT JOIN per USING (query_id) LEFT JOIN placed p ON p.query_id = c.query_id AND p.kbid = c.expected_kb""",
)
def evaluate_places(spark: SparkSession, sf: str) -> DataFrame:
    """Where the document that a passage was taken from stands among those retrieved for the passage."""
    from tarnwell.operators.ranking import latest_per_key
    from tarnwell.session import materialise

    found = materialise(_found(spark, sf), "found")
    best = latest_per_key(found, ["query_id"], [F.desc("rrf_score"), F.asc("kbid")]).select("query_id", F.col("kbid").alias("selected_kb"))
    rows = rt.evaluate(best, _planted_cases(spark, sf), found)["cases"]
    return rows.select(
        "query_id", "expected_kb", "top_kb", "match", F.col("expected_place").cast("long").alias("expected_place"), "retrieved_count", F.array_join("top_list", "|").alias("top_list")
    )


@query("tournament_rerank")
def tournament_rerank(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    from tarnwell.operators.fusion import select_candidates

    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))
    pool = _found(spark, sf).withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "kbid")))
    rows = rt.hydrate(pool, summary_frame(spark, sf), _keywords(spark, sf), questions)
    return rt.rerank(rows, ["query_id"], "tournament").select("query_id", "kbid", F.round("rerank_score", 6).alias("rerank_score"))


@query("lexical_rerank")
def lexical_rerank(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.fusion import select_candidates

    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))
    picked = select_candidates(_found(spark, sf), ["query_id"])
    rows = rt.hydrate(picked, summary_frame(spark, sf), _keywords(spark, sf), questions)
    return rt.rerank(rows, ["query_id"], "lexical").select("query_id", "kbid", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    "hydrate",
    f"""WITH {_CANDIDATES_SQL},
    roll AS (SELECT kbid, string_agg(DISTINCT CASE WHEN kind = 'specific' THEN nullif(trim(term), '') END, ', ' ORDER BY CASE WHEN kind = 'specific' THEN nullif(trim(term), '') END) AS names,
      max(nullif(trim(primary_topic), '')) AS topic FROM kw GROUP BY kbid)
    SELECT c.query_id, c.kbid, c.pos AS position, coalesce(md5(r.names), md5('')) AS names, coalesce(r.topic, '') AS topic, length(s.content) AS n
    FROM cand c JOIN sm s ON s.kbid = c.kbid LEFT JOIN roll r ON r.kbid = c.kbid""",
)
def hydrate(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.fusion import select_candidates

    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("raw_query"))
    picked = select_candidates(_found(spark, sf), ["query_id"])
    rows = rt.hydrate(picked, summary_frame(spark, sf), _keywords(spark, sf), questions)
    return rows.select(
        "query_id", "kbid", F.col("position").cast("long").alias("position"), F.md5(F.col("specific_keywords").cast("binary")).alias("names"),
        F.col("primary_topic").alias("topic"), F.length("content").cast("long").alias("n"),
    )


@query("fetch_content", "SELECT CAST(doc_id AS VARCHAR) AS kbid, '' AS summary, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def fetch_content(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("kbid"))
    rows = rt.fetch_content(ids, summary_frame(spark, sf))
    return rows.select("kbid", "summary", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("normalize_query")
def normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark, sf)
    lists = ("specific", "generic", "issues", "usecase", "acronyms", "search_phrases")
    return q.select("query_id", "category", "article_type", *[F.array_join(c, "|").alias(c) for c in lists])
