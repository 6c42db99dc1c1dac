"""The registered query of each operator, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import bpe, exact_dedup, jaccard_join, mixing, packing, quality_rules, secrets, sharding, spelling, substring_dedup, topk_search, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SCORED = """
    WITH v AS (
      SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
"""


@query("op3_topk_search", _SCORED)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_inner_products(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")


_WORDS = r"[^\x20\x09-\x0D]+"


@query(
    "op5_substring_dedup",
    rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
    win AS (
      SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
    least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN least USING (k), (SELECT unnest(range(0, 13)) AS o) WHERE doc_id > d),
    pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    kept AS (
      SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY pos.p) FILTER (WHERE gone.p IS NULL) AS t
      FROM pos LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizers.path("word_bpe_49k.json"), length=2_048)


@query(
    "op7_jaccard_join",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
    link AS (
      SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.b AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), width=5, percent=80)


@query("op8_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), secrets.ALL_RULES)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.bounded_ring_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op11_mixing",
    rf"""
    WITH r AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key
      FROM documents),
    s AS (
      SELECT source, CAST(sum(size) AS HUGEINT) AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM r GROUP BY source),
    f AS (
      SELECT a.source, a.n, a.w, sum(least(b.w * 3 * a.n, 3 * b.n * a.w)) <= sum(b.n) * a.w AS is_full, sum(b.n) AS total
      FROM s a, s b GROUP BY a.source, a.n, a.w),
    rest AS (SELECT max(total) - 3 * coalesce(sum(n) FILTER (WHERE is_full), 0) AS words, coalesce(sum(w) FILTER (WHERE NOT is_full), 1) AS w FROM f),
    t AS (
      SELECT source, CAST(n AS BIGINT) AS n, CASE WHEN is_full THEN CAST(3 * n AS DOUBLE) ELSE CAST(rest.words AS DOUBLE) * f.w / CAST(rest.w AS DOUBLE) END AS target
      FROM f, rest),
    p AS (
      SELECT doc_id, source, size,
        coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r),
    b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t)
    SELECT doc_id, size, n AS source_size, target,
      CAST(CASE WHEN n = 0 THEN 0 ELSE budget // n * size + greatest(0, least(size, budget % n - before)) END AS BIGINT) AS taken
    FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1_024)
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error"
    )


@query(
    "op13_spelling",
    r"""
    WITH RECURSIVE crc AS (
      SELECT list(c ORDER BY i) AS t
      FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    runs AS (
      SELECT doc_id, run, count(*) AS times
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
      GROUP BY doc_id, run),
    hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 6),
    hashed AS (
      SELECT run, times, xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h
      FROM hexed, crc),
    w AS MATERIALIZED (
      SELECT word, CAST(sum(times) AS BIGINT) AS n
      FROM (SELECT times, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
    holes AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS hole FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
    near AS (
      SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM holes a JOIN w b ON a.hole = b.word
      UNION SELECT b.word, a.word, a.n FROM holes a JOIN w b ON a.hole = b.word),
    best AS (SELECT word, count(*) AS n_near, min({'less': -m, 'other': other}) AS best FROM near GROUP BY word),
    f AS MATERIALIZED (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.other END AS form, CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n
      FROM w LEFT JOIN best ON w.word = best.word),
    walk AS (
      SELECT word, word AS here, 0 AS steps FROM f
      UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON walk.here = f.word WHERE f.form IS NOT NULL),
    roots AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN roots ON f.word = roots.word
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
