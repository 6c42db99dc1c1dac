"""The vector arm gives few rows to the fusion, and the fused rows are the same."""

import random

from pyspark.sql import functions as F

from tarnwell.operators.fusion import fuse_signals
from tarnwell.operators.ranking import top_n
from tarnwell.plans import retrieval as rt
from tarnwell.plans.models import embed_terms

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
ATTRIBUTES = "category string, article_type string, primary_topic string"
KEY = ["unit_id", "shard_id", "kbid"]


def _keywords(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(60):
        shard = None if doc % 20 == 7 else doc // 20
        topic = [None, "alpha beta", " Gamma "][doc % 3]
        terms = {" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) for _ in range(4)} | ({"alpha beta"} if doc % 5 == 0 else set())
        for t in sorted(terms):
            kind = "specific" if doc % 11 == 0 else "usecase"
            rows.append((str(doc), shard, [None, "Software", "Both", "hardware "][doc % 4], "How-To", topic, kind, t))
    df = embed_terms(spark.createDataFrame(rows, f"kbid string, shard_id int, {ATTRIBUTES}, kind string, term string"), "term")
    columns = [F.when(F.col("kind") == k, F.col(x)).alias(c) for k, pair in rt.KIND_COLUMNS.items() for x, c in zip(("term", "embedding"), pair)]
    return df.select("kbid", "shard_id", "category", "article_type", "primary_topic", *columns)


def _units(spark):
    texts = ["alpha beta", "Gamma", "iota  kappa zeta", "theta", "nothing here", "", None]
    rows = [(f"u{i}", i, "usecase", t, ["software", None, "both"][i % 3], 2 + i % 2) for i, t in enumerate(texts)]
    rows += [("s", 9, "specific", "alpha delta", "software", 2), (None, 10, "usecase", "alpha", None, 2)]
    units = spark.createDataFrame(rows, "unit_id string, query_id long, kind string, query_text string, category string, top_k int")
    return embed_terms(units, "query_text").withColumn("term_group", F.lit("usecase"))


def _rows(df):
    return sorted((tuple(str(round(x, 9)) if isinstance(x, float) else str(x) for x in r) for r in df.collect()))


def test_documents_are_put_together_where_they_are_found(spark):
    keywords, units = _keywords(spark), _units(spark)
    found = rt.vector_search(units, keywords)
    # Units that share an id go the way of joins and one more grouping.
    twice = units.where("unit_id = 'u0'").withColumn("unit_id", F.lit("twice"))
    want = rt.vector_search(units.unionByName(twice).unionByName(twice), keywords).where("unit_id <> 'twice'")
    assert _rows(found.select(*want.columns)) == _rows(want) != []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [unit_id" not in plan and "min_by" not in plan


def test_rows_that_cannot_be_first_stay_where_they_are(spark):
    keywords, units = _keywords(spark), _units(spark)
    ids = units.where("unit_id is not null").select("unit_id").crossJoin(keywords.select("kbid", "shard_id").distinct())
    hits = ids.where(F.pmod(F.xxhash64("unit_id", "kbid"), F.lit(9)) == 0)
    some = hits.where(F.pmod(F.xxhash64("kbid"), F.lit(2)) == 0).withColumn("fts_keywords_rank", F.length("kbid") + F.lit(0.5))
    notes = hits.where(F.pmod(F.xxhash64("kbid"), F.lit(3)) < 2).withColumn("fts_summaries_rank", F.col("kbid").cast("double"))

    def first(vector):
        fused = fuse_signals(vector, some, notes, ["unit_id", "shard_id"]).join(units.select("unit_id", "top_k"), "unit_id")
        return top_n(fused, ["unit_id", "shard_id"], [F.desc("rrf_score"), F.asc("kbid")], "top_k", "place")

    whole = rt.vector_search(units, keywords)
    few = rt.vector_search(units, keywords, beside=hits.select(*KEY))
    assert few.count() < whole.count()
    want = first(whole)
    assert _rows(first(few).select(*want.columns)) == _rows(want) != []


def test_the_nearest_over_all_shards_need_few_of_each(spark):
    keywords, units = _keywords(spark), _units(spark)
    want = rt.merge_shards(rt.vector_search(units, keywords), "vector_distance", True, 3)
    assert _rows(rt.vector_search_all(units, keywords, 3).select(*want.columns)) == _rows(want) != []
    per_shard = rt.vector_search(units, keywords, most=3).groupBy("unit_id", "shard_id").count()
    assert per_shard.agg(F.max("count")).first()[0] == 3


def test_the_winners_of_all_shards_are_told(spark):
    """Every shard with candidates has a winner, its best candidate where none has a summary; all are in the result, by shard."""
    keywords = spark.createDataFrame(
        [("a", 0, "reset token", "vpn"), ("b", 0, "reset", "vpn"), ("c", 1, "reset token now", "vpn"), ("d", 2, "reset token", "vpn"), ("e", 2, "other", "vpn")],
        "kbid string, shard_id int, usecase string, primary_topic string",
    )
    empty = {c: F.lit(None).cast("string") for c, _ in rt.KIND_COLUMNS.values() if c != "usecase"} | {v: F.lit(None).cast("array<float>") for _, v in rt.KIND_COLUMNS.values() if v != "usecase_embedding"}
    keywords = embed_terms(keywords, "usecase", name="usecase_embedding").withColumns(empty | {"category": F.lit("Software"), "article_type": F.lit("How-To")})
    blank = {c: F.lit("") for c in ("primary_intent", "query_triggers", "secondary_mentions", "summary", "content")}
    summaries = spark.createDataFrame([("a", 0, "other"), ("b", 0, "reset token"), ("c", 1, "reset")], "doc_id string, shard_id int, article_title string").withColumns(blank)
    queries = spark.createDataFrame([(1, "reset token", ["reset token"]), (2, "", [])], "query_id long, raw_query string, usecase array<string>")
    queries = queries.withColumns({c: F.array().cast("array<string>") for c in ("specific", "generic", "search_phrases", "acronyms")} | {"category": F.lit("both")})
    out = rt.two_level_select(queries, keywords, summaries, lambda df, text: embed_terms(df, text))
    by_shard = {(r["query_id"], r["shard_id"]): r["kbid"] for r in out["shard_winners"].collect()}
    got = {r["query_id"]: r["shard_winners"] for r in out["selected"].collect()}
    # No document of shard 2 has a summary.
    assert got == {1: [by_shard[1, 0], "c", "d"], 2: None} and set(by_shard) == {(1, 0), (1, 1)}
