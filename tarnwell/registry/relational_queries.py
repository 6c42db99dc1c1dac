"""Ranking, sorting, top-k and rollups over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import ranking as rk
from tarnwell.operators.inventory import cascade_delete
from tarnwell.plans import retrieval as rt
from tarnwell.registry import query
from tarnwell.registry.inputs import table


@query(
    "minmax_norm",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN hi = lo THEN 1 ELSE (l_quantity - lo) / (hi - lo) END, 6) AS up, round(CASE WHEN hi = lo THEN 1 ELSE 1 - (l_quantity - lo) / (hi - lo) END, 6) AS down
    FROM (SELECT *, min(l_quantity) OVER w AS lo, max(l_quantity) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))""",
)
def minmax_norm(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(rk.minmax_norm("l_quantity", ["l_orderkey"]), 6).alias("up"),
        F.round(rk.minmax_norm("l_quantity", ["l_orderkey"], True), 6).alias("down"),
    )


_SIGNALS_SQL = """
v AS (SELECT l_orderkey AS q, l_partkey AS kbid, min(l_quantity) AS vd FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
k AS (SELECT l_orderkey AS q, l_partkey AS kbid, max(l_extendedprice) AS kr FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL),
s AS (SELECT l_orderkey AS q, l_partkey AS kbid, max(l_tax) AS sr FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
j AS (SELECT q, kbid, max(vd) AS vd, max(kr) AS kr, max(sr) AS sr FROM (
  SELECT q, kbid, vd, NULL AS kr, NULL AS sr FROM v UNION ALL SELECT q, kbid, NULL, kr, NULL FROM k UNION ALL SELECT q, kbid, NULL, NULL, sr FROM s) GROUP BY ALL),
w AS (SELECT *, min(vd) OVER p AS v0, max(vd) OVER p AS v1, min(kr) OVER p AS k0, max(kr) OVER p AS k1, min(sr) OVER p AS s0, max(sr) OVER p AS s1 FROM j WINDOW p AS (PARTITION BY q))"""


def _signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    l = table(spark, sf, "lineitem")
    keys = [F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("kbid")]
    return (
        l.where("l_returnflag = 'A'").groupBy(*keys).agg(F.min("l_quantity").alias("vector_distance")),
        l.where("l_returnflag = 'N'").groupBy(*keys).agg(F.max("l_extendedprice").alias("fts_keywords_rank")),
        l.where("l_linestatus = 'O'").groupBy(*keys).agg(F.max("l_tax").alias("fts_summaries_rank")),
    )


@query(
    "minmax_fuse",
    f"""WITH {_SIGNALS_SQL} SELECT q, kbid, round((CASE WHEN vd IS NULL THEN 0 WHEN v0 = v1 THEN 1 ELSE 1 - (vd - v0) / (v1 - v0) END) * 0.45::DOUBLE
      + (CASE WHEN kr IS NULL THEN 0 WHEN k0 = k1 THEN 1 ELSE (kr - k0) / (k1 - k0) END) * 0.25::DOUBLE + (CASE WHEN sr IS NULL THEN 0 WHEN s0 = s1 THEN 1 ELSE (sr - s0) / (s1 - s0) END) * 0.30::DOUBLE
      + 0.15::DOUBLE * ((vd IS NOT NULL)::INT + (kr IS NOT NULL)::INT + (sr IS NOT NULL)::INT - 1) + 1e-9, 6) AS score,
      (vd IS NOT NULL)::INT + (kr IS NOT NULL)::INT + (sr IS NOT NULL)::INT AS signals FROM w""",
)
def minmax_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as three signals of an order's parts, joined in full and fused."""
    from tarnwell.operators.fusion import fuse_signals

    fused = fuse_signals(*_signals(spark, sf), ["q"])
    return fused.select("q", "kbid", F.round(F.col("rrf_score") + 1e-9, 6).alias("score"), "signals")


@query(
    "signal_outer_join",
    """SELECT q, kbid, max(vd) AS vector_distance, max(kr) AS fts_keywords_rank, max(sr) AS fts_summaries_rank FROM (
      SELECT l_orderkey AS q, l_partkey AS kbid, min(l_quantity) AS vd, NULL AS kr, NULL AS sr FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL
      UNION ALL SELECT l_orderkey, l_partkey, NULL, max(l_extendedprice), NULL FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL
      UNION ALL SELECT l_orderkey, l_partkey, NULL, NULL, max(l_tax) FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) GROUP BY ALL""",
)
def signal_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.operators.fusion import merge_signals

    return merge_signals(*_signals(spark, sf), ["q", "kbid"]).select("q", "kbid", "vector_distance", "fts_keywords_rank", "fts_summaries_rank")


@query(
    "best_per_doc",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1""",
)
def best_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    best = rk.best_per_doc(table(spark, sf, "lineitem"), ["l_partkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"], False)
    return best.select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    "best_across_groups",
    """WITH g AS (SELECT l_suppkey AS query_id, l_partkey AS kbid, l_linenumber % 5 AS grp, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kbid ORDER BY score DESC, grp) AS r FROM g) WHERE r = 1)
    SELECT query_id, kbid, grp, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(kbid AS VARCHAR)) AS k FROM b) WHERE k <= 8""",
)
def best_across_groups(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(g) for g in rt.GROUP_KINDS])
    g = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("query_id"), F.lit(0).alias("shard_id"), F.col("l_partkey").cast("string").alias("kbid"), (F.col("l_linenumber") % 5).alias("grp")
    ).agg(F.max("l_quantity").alias("rrf_score"))
    found = g.withColumn("term_group", F.get(names, F.col("grp"))).withColumn("unit_id", F.lit(""))
    best = rt.best_across_groups(found, 8)
    return best.select("query_id", F.col("kbid").cast("long").alias("kbid"), "grp", F.col("rrf_score").alias("score"))


@query(
    "adaptive_limits",
    """SELECT p_partkey, CASE WHEN p_size % 5 IN (3, 4) THEN 16 ELSE 8 END AS k, CASE WHEN p_size % 5 IN (3, 4) THEN 16 ELSE 8 END * 6 * CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 2 ELSE 1 END AS fetch FROM part""",
)
def adaptive_limits(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(g) for g in ("specific", "generic", "usecase", "search_phrases", "acronyms")])
    p = table(spark, sf, "part").withColumn("k", rk.group_top_k(F.get(names, F.col("p_size") % 5), 8))
    category = F.when(F.col("p_type") == "SMALL", "hardware").when(F.col("p_type") == "ECONOMY", "software").when(F.col("p_size") > 20, "both")
    return p.select("p_partkey", "k", rk.search_limit("k", category).alias("fetch"))


@query(
    "rank_compare",
    """SELECT l_orderkey, l_partkey, l_linenumber, a, b FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, k) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, k) AS b
      FROM (SELECT *, l_partkey * 1000000 + l_linenumber * 100000 + l_suppkey AS k FROM lineitem)) WHERE a <= 10""",
)
def rank_compare(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey"))
    rows = rk.rank_compare(l, ["l_orderkey"], "k", "l_quantity", "l_extendedprice", 10)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.col("first_rank").cast("long").alias("a"), F.col("second_rank").cast("long").alias("b"))


@query(
    "deal_groups",
    """SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % CASE WHEN n <= 10 THEN 1 ELSE ceil(n / 5.0) END AS INTEGER) AS deal_group
    FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""",
)
def deal_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rk.deal_groups(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderkey")], 5, 10).select("o_orderkey", "deal_group")


@query(
    "family_representatives",
    "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def family_representatives(spark: SparkSession, sf: str) -> DataFrame:
    reps = rk.family_representatives(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey")
    return reps.select("o_custkey", "o_orderpriority", "o_orderkey")


@query("global_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def global_topk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("multi_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS place FROM orders")
def multi_key_sort(spark: SparkSession, sf: str) -> DataFrame:
    """A global order with its positions, numbered without gathering the table in one task."""
    from tarnwell.operators.skew import ordered_positions

    o = table(spark, sf, "orders")
    rows = ordered_positions(o, [], [F.asc("o_orderdate"), F.asc("o_orderpriority"), F.asc("o_orderkey")], F.unix_seconds(F.col("o_orderdate").cast("timestamp")), "place")
    return rows.select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("restore_order", "SELECT o_orderkey, coalesce(c_nationkey, 1000000000) AS position FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'MACHINERY'")
def restore_order(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("position"))
    rows = rk.restore_order(table(spark, sf, "orders").join(c, "o_custkey", "left"), "position", "o_orderkey")
    return rows.select("o_orderkey", F.coalesce("position", F.lit(1_000_000_000)).alias("position"))


@query(
    "final_pool",
    """SELECT l_suppkey, l_partkey, s FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey) AS r FROM (
      SELECT l_suppkey, l_partkey, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL)) WHERE r <= 10""",
)
def final_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the per-shard candidates: the best score per document, the best ten per query."""
    best = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("s"))
    return rk.top_n(best, ["l_suppkey"], [F.desc("s"), F.asc("l_partkey")], 10).select("l_suppkey", "l_partkey", "s")


@query(
    "retrieved_ids",
    "SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY f, l_partkey) AS place FROM (SELECT l_suppkey, l_partkey, min(l_orderkey) AS f FROM lineitem GROUP BY ALL)",
)
def retrieved_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids in first-seen order, kept as numbered rows."""
    rows = rk.first_seen(table(spark, sf, "lineitem"), ["l_suppkey"], "l_partkey", [F.col("l_orderkey").alias("f")], F.col("f"))
    return rows.select("l_suppkey", "l_partkey", F.col("place").cast("long").alias("place"))


@query(
    "distinct_sources",
    "SELECT conv_id, count(DISTINCT role) AS n, array_to_string(list_sort(list_distinct(list(role)))[1:3], ', ') AS shown FROM conversations WHERE role <> '' GROUP BY conv_id",
)
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return rk.distinct_shown(table(spark, sf, "conversations"), ["conv_id"], "role", 3)


# Labels are expected answers: the quality says what was expected, the toxic mark what was chosen.
_CASES_SQL = "cases AS (SELECT d.doc_id, d.lang AS query_type, CAST(l.quality AS VARCHAR) AS expected_kb, CASE WHEN l.toxic = 1 THEN d.source ELSE CAST((d.n_chars > 700)::INT AS VARCHAR) END AS top_kb FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _cases(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = l.join(d, "doc_id")
    cases = rows.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("query_type"), F.col("quality").cast("string").alias("expected_kb"))
    chosen = F.when(F.col("toxic") == 1, F.col("source")).otherwise((F.col("n_chars") > 700).cast("int").cast("string"))
    return rt.evaluate(rows.select(F.col("doc_id").alias("query_id"), chosen.alias("selected_kb")), cases)


@query("expected_vs_selected", f"WITH {_CASES_SQL} SELECT doc_id AS query_id, expected_kb, top_kb, expected_kb = top_kb AS match FROM cases")
def expected_vs_selected(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf)["cases"].select("query_id", "expected_kb", "top_kb", "match")


@query(
    "validation_stats",
    f"""WITH {_CASES_SQL}, r AS (SELECT query_type, count(*) AS total, count(*) FILTER (expected_kb = top_kb) AS matched FROM cases GROUP BY query_type
      UNION ALL SELECT 'overall', count(*), count(*) FILTER (expected_kb = top_kb) FROM cases)
    SELECT query_type, total, matched, round_even(matched * 100.0::DOUBLE / total, 2)::DOUBLE AS accuracy,
      CASE WHEN matched * 100.0 / total >= 90 THEN 'excellent' WHEN matched * 100.0 / total >= 70 THEN 'good' ELSE 'needs improvement' END AS verdict FROM r""",
)
def validation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf)["stats"]


@query("false_positives", f"WITH {_CASES_SQL} SELECT top_kb, count(*) AS wrong FROM cases WHERE expected_kb <> top_kb AND top_kb <> '' GROUP BY top_kb ORDER BY wrong DESC, top_kb LIMIT 20")
def false_positives(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf)["false_positives"]


@query("cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return cascade_delete(table(spark, sf, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "hit_flags",
    """SELECT p_partkey, lower(trim(p_name)) = q OR lower(trim(p_type)) = q AS exact, contains(lower(p_name), q) OR contains(lower(p_type), q) AS phrase,
      contains(lower(p_name), q) OR contains(q, lower(p_name)) OR contains(lower(p_type), q) OR contains(q, lower(p_type)) AS either
    FROM (SELECT *, lower(CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) ELSE p_name || ' ' || p_brand END) AS q FROM part)""",
)
def hit_flags(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size") % 3
    asked = F.lower(F.when(size == 0, F.col("p_name")).when(size == 1, F.substring_index("p_name", " ", 1)).otherwise(F.concat_ws(" ", "p_name", "p_brand")))
    p = table(spark, sf, "part").withColumn("q", asked)
    _, either = rt.vector_flags("q", ["p_name", "p_type"])
    return p.select("p_partkey", rt._exact(F.col("q"), ["p_name", "p_type"]).alias("exact"), rt._contains(F.col("q"), ["p_name", "p_type"]).alias("phrase"), either.alias("either"))


@query("scope_filter", "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE source = 'src7' UNION ALL SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id // 200 = 2")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    from tarnwell.registry.inputs import summary_frame

    s = summary_frame(spark, sf)
    return rt.scope_filter(s, "src7").select("doc_id").unionByName(rt.scope_filter(s, " ", 2).select("doc_id"))


@query("has_embedding", "SELECT vec_id FROM embeddings WHERE label <> 3")
def has_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("v", F.when(F.col("label") != 3, F.col("embedding")))
    return e.where(F.col("v").isNotNull()).select("vec_id")
