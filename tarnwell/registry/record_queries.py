"""JSON records, score arithmetic and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import jsonops as js
from tarnwell.functions import phones as ph
from tarnwell.functions import vectors as vx
from tarnwell.plans import state as st
from tarnwell.registry import query
from tarnwell.registry.inputs import BASE_SECONDS, table

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k")


@query(
    "json_merge",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN props WHEN event_type = 'view' THEN '{"u":' || user_id || '}'
      WHEN event_type = 'click' THEN '{"k":' || user_id || '}' ELSE '{"k":' || json_extract_string(props, '$.k') || ',"u":' || user_id || '}' END AS merged FROM events""",
)
def json_merge(spark: SparkSession, sf: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    new = (
        F.when(kind == "error", F.lit(None).cast("string")).when(kind == "click", F.concat(F.lit('{"k":'), user, F.lit("}")))
        .otherwise(F.concat(F.lit('{"u":'), user, F.lit("}")))
    )
    old = F.when(kind == "view", F.lit(None).cast("string")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", js.json_merge(old, new).alias("merged"))


@query(
    "external_id",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_type = 'view' THEN NULL ELSE props END
      WHEN event_type = 'view' THEN '{"external_call_id":"call-' || event_id || '"}'
      ELSE '{"external_call_id":"call-' || event_id || '","k":' || json_extract_string(props, '$.k') || '}' END AS data FROM events""",
)
def external_id(spark: SparkSession, sf: str) -> DataFrame:
    eid = F.col("event_id").cast("string")
    ref = F.when(F.col("event_id") % 2 == 0, F.md5(eid.cast("binary"))).otherwise(F.concat(F.lit("call-"), eid))
    data = F.when(F.col("event_type") == "view", "{}").otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", js.with_external_id(ref, data).alias("data"))


@query(
    "content_text",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN t WHEN 1 THEN role || ' ' || t ELSE role || ' ' || t END AS all_text,
      CASE turn % 3 WHEN 0 THEN t WHEN 1 THEN role ELSE '' END AS text_only
    FROM (SELECT *, replace(replace(md5(text), 'a', ' '), '"', '') AS u, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS t FROM conversations)""",
)
def content_text(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("t", F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))
    typed = F.to_json(F.array(
        F.create_map(F.lit("type"), F.lit("text"), F.lit("text"), F.col("role")),
        F.create_map(F.lit("type"), F.lit("other"), F.lit("content"), F.col("t")),
    ))
    content = F.when(F.col("turn") % 3 == 0, F.col("t")).when(F.col("turn") % 3 == 1, typed).otherwise(F.to_json(F.array("role", "t")))
    return c.select("conv_id", "turn", js.content_to_text(content).alias("all_text"), js.text_parts(content).alias("text_only"))


@query(
    "safe_json",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END AS n FROM events",
)
def safe_json(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit("}"))).otherwise("[1]")
    return table(spark, sf, "events").select("event_id", F.size(js.safe_json_object(raw)).alias("n"))


@query(
    "bound_agent_name",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'cfg' || s_nationkey WHEN 2 THEN 'tgt' || s_nationkey ELSE 'own' || s_suppkey END AS agent FROM supplier""",
)
def bound_agent_name(spark: SparkSession, sf: str) -> DataFrame:
    nation, k = F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 4
    meta = (
        F.when(k == 1, F.concat(F.lit('{"config_name":"cfg'), nation, F.lit('","target_agent":"x"}')))
        .when(k == 2, F.concat(F.lit('{"config_name":"","target_agent":"tgt'), nation, F.lit('"}'))).otherwise("not json")
    )
    name = F.when(k == 0, F.col("s_name")).otherwise("")
    return table(spark, sf, "supplier").select(
        "s_suppkey", js.bound_agent_name(name, meta, F.concat(F.lit("own"), F.col("s_suppkey").cast("string"))).alias("agent")
    )


@query(
    "tool_event_text",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'Tool: view → INC' || user_id || ' seen' WHEN 'click' THEN 'Tool: click → done ' || user_id
      WHEN 'error' THEN 'Tool: error → Error: ' || substr(repeat('bad ' || user_id, 60), 1, 200) ELSE 'Tool: ' || event_type END AS line FROM events""",
)
def tool_event_text(spark: SparkSession, sf: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    result = (
        F.when(kind == "view", F.concat(F.lit('{"number":"INC'), user, F.lit('","message":"seen"}')))
        .when(kind == "click", F.concat(F.lit("done "), user)).otherwise("")
    )
    error = F.when(kind == "error", F.repeat(F.concat(F.lit("bad "), user), 60)).otherwise("")
    return table(spark, sf, "events").select("event_id", js.tool_event_text("event_type", kind != "error", result, error).alias("line"))


@query(
    "json_compatible",
    """SELECT event_id, '{"event_type":' || to_json(event_type) || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","value":' || to_json(value) || '}' AS j FROM events""",
)
def json_compatible(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", js.to_json_compatible(F.struct("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")).alias("j"))


@query(
    "numeric_totals",
    """WITH j AS (
      SELECT event_type, json_object('usage', json_object('k', CAST(props ->> '$.k' AS INTEGER), 'value', value),
        'parts', json_array(json_object('n', user_id), json_object('n', event_id)), 'flag', value > 1) AS doc FROM events),
    leaf AS (SELECT event_type, t.fullkey[3:] AS path, CAST(t.atom AS DOUBLE) AS v FROM j, json_tree(j.doc) t WHERE t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE'))
    SELECT event_type, path, round(sum(v), 2) AS total FROM leaf GROUP BY event_type, path""",
)
def numeric_totals(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct(
        F.struct(_k().cast("int").alias("k"), "value").alias("usage"),
        F.array(F.struct(F.col("user_id").alias("n")), F.struct(F.col("event_id").alias("n"))).alias("parts"),
        (F.col("value") > 1).alias("flag"),
    ))
    rows = table(spark, sf, "events").select("event_type", payload.alias("payload"))
    out = js.numeric_totals(rows, ["event_type"], "payload")
    return out.select("event_type", "path", F.round("total", 2).alias("total"))


@query(
    "parse_items",
    r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'invalid_json' ELSE 'success' END AS status,
      CASE WHEN p_partkey % 5 < 4 THEN trim(regexp_replace(p_name, '\s+', ' ', 'g')) END AS item, CASE WHEN p_partkey % 5 < 4 THEN trim(p_type) END AS purpose,
      CASE WHEN p_partkey % 5 < 4 THEN trim(p_brand) END AS method FROM part""",
)
def parse_items(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct(F.col("p_name").alias("item"), F.col("p_type").alias("purpose"), F.col("p_brand").alias("method"))
    k = F.col("p_partkey") % 5
    response = (
        F.when(k == 0, F.to_json(F.struct(F.array(one).alias("items")))).when(k == 1, F.to_json(F.array(one)))
        .when(k == 2, F.to_json(F.struct(F.array(one).alias("result")))).when(k == 3, F.to_json(one)).otherwise("not json")
    )
    rows = table(spark, sf, "part").select("p_partkey", js.parse_items(response).alias("r"))
    return rows.select("p_partkey", "r.status", F.explode_outer("r.items").alias("i")).select("p_partkey", "status", "i.item", "i.purpose", "i.method")


# --- vectors and scores -----------------------------------------------------------------------


@query(
    "cosine_distance",
    """SELECT a.vec_id, round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
      / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vx.cosine_distance("embedding", "other"), 6).alias("distance"))


@query(
    "sanitize_vector",
    """SELECT vec_id, round(list_sum(list_transform(v, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END)), 6) AS total, 64 = len(v) AS dim_ok
    FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0.2 THEN 'inf'::DOUBLE WHEN x < -0.2 THEN 'nan'::DOUBLE ELSE x END) AS v FROM embeddings)""",
)
def sanitize_vector(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.transform(
        "embedding", lambda x: F.when(x > 0.2, F.lit(float("inf"))).when(x < -0.2, F.lit(float("nan"))).otherwise(x.cast("double"))
    )
    clean = vx.sanitize_vector(broken)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), vx.has_dim("embedding", 64).alias("dim_ok")
    )


@query("unit_vector", "SELECT vec_id, 1.0::DOUBLE AS squared FROM embeddings")
def unit_vector(spark: SparkSession, sf: str) -> DataFrame:
    doubled = F.transform(vx.check_dim("embedding", 64), lambda x: x * F.lit(2.5))
    e = table(spark, sf, "embeddings").select("vec_id", vx.unit_vector(doubled).alias("u"))
    return e.select("vec_id", F.round(vx.dot("u", "u"), 6).alias("squared"))


_CAT_SQL = "CASE c_nationkey % 3 WHEN 0 THEN 'Hardware' WHEN 1 THEN 'both' ELSE 'Software' END"
_ASK_SQL = "CASE c_custkey % 3 WHEN 0 THEN 'hardware' WHEN 1 THEN 'both' END"


@query(
    "score_arithmetic",
    f"""SELECT c_custkey, round(CASE WHEN asked IS NULL OR asked = 'both' THEN 1.0 WHEN lower(cat) = asked THEN 0.85 WHEN cat = 'both' THEN 0.90 ELSE 1.0 END, 6)::DOUBLE AS distance_factor,
      round(CASE WHEN asked IS NULL OR asked = 'both' THEN 1.0 WHEN lower(cat) = asked THEN 1.15 WHEN cat = 'both' THEN 1.10 ELSE 1.0 END, 6)::DOUBLE AS rank_factor,
      round(c_acctbal / 1e4 * CASE WHEN ex THEN 0.65 WHEN ph THEN 0.82 ELSE 1.0 END, 6)::DOUBLE AS boosted,
      round(c_acctbal / 1e4 + CASE WHEN ex THEN 1.25 ELSE 0 END + CASE WHEN ph THEN 0.35 ELSE 0 END, 6)::DOUBLE AS ranked,
      round(CASE WHEN ex THEN c_acctbal ELSE 1 / (1 + greatest(c_acctbal / 1e4, 0)) END, 6)::DOUBLE AS got,
      CASE WHEN ex THEN 1 ELSE 0 END + CASE WHEN ph THEN 1 ELSE 0 END AS signals, round_even(c_acctbal / 7, 3)::DOUBLE AS rounded
    FROM (SELECT *, {_CAT_SQL} AS cat, {_ASK_SQL} AS asked, c_custkey % 5 = 0 AS ex, c_custkey % 2 = 0 AS ph FROM customer)""",
)
def score_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    nation, cust = F.col("c_nationkey") % 3, F.col("c_custkey")
    c = table(spark, sf, "customer").withColumns({
        "cat": F.when(nation == 0, "Hardware").when(nation == 1, "both").otherwise("Software"),
        "asked": F.when(cust % 3 == 0, "hardware").when(cust % 3 == 1, "both"), "ex": cust % 5 == 0, "ph": cust % 2 == 0,
        "d": F.col("c_acctbal") / 1e4,
    })
    return c.select(
        "c_custkey", F.round(vx.distance_multiplier("asked", "cat"), 6).alias("distance_factor"),
        F.round(vx.rank_multiplier("asked", "cat"), 6).alias("rank_factor"), F.round(vx.boost_distance("d", "ex", "ph"), 6).alias("boosted"),
        F.round(vx.bonus_rank("d", "ex", "ph", 1.25, 0.35), 6).alias("ranked"),
        F.round(vx.retrieval_score(F.when(F.col("ex"), F.col("c_acctbal")), "d"), 6).alias("got"),
        vx.signal_count(F.when(F.col("ex"), 1), F.when(F.col("ph"), 1)).alias("signals"), vx.round_score(F.col("c_acctbal") / 7).alias("rounded"),
    )


@query(
    "epoch_and_duration",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE epoch_us(ts) END AS us,
      round(greatest((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 1e6, 0), 6) AS seconds FROM events""",
)
def epoch_and_duration(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id", F.unix_micros(vx.epoch_default_utc(given)).alias("us"),
        F.round(vx.duration_seconds(F.lit("2024-01-15").cast("timestamp"), "ts"), 6).alias("seconds"),
    )


@query(
    "lifecycle_ts",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN {BASE_SECONDS} WHEN o_orderstatus = 'F' THEN epoch(o_orderdate)::BIGINT END AS deployed,
      CASE WHEN o_orderstatus = 'F' THEN {BASE_SECONDS} ELSE epoch(o_orderdate)::BIGINT END AS ready,
      CASE WHEN o_orderstatus = 'P' THEN {BASE_SECONDS} END AS deleted, CASE WHEN o_orderpriority = '1-URGENT' THEN {BASE_SECONDS} END AS failed FROM orders""",
)
def lifecycle_ts(spark: SparkSession, sf: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(BASE_SECONDS))
    status = F.col("o_orderstatus")
    o = table(spark, sf, "orders").withColumns({
        "deployed_at": F.when(status == "F", F.col("o_orderdate").cast("timestamp")), "ready_at": F.col("o_orderdate").cast("timestamp"),
        "deleted_at": F.lit(None).cast("timestamp"), "last_error_at": F.lit(None).cast("timestamp"),
    })
    workflow = F.when(status == "O", "applied").when(status == "F", "ready").otherwise("deleted")
    times = st.lifecycle_times(workflow, F.when(status == "F", "ready").otherwise("unknown"), F.when(F.col("o_orderpriority") == "1-URGENT", "x"), now)
    secs = {k: F.unix_seconds(v) for k, v in times.items()}
    return o.select(
        "o_orderkey", secs["deployed_at"].alias("deployed"), secs["ready_at"].alias("ready"), secs["deleted_at"].alias("deleted"), secs["last_error_at"].alias("failed")
    )


# --- predicates --------------------------------------------------------------------------------


@query(
    "enabled_datasets",
    """SELECT s_suppkey, concat_ws('|', CASE WHEN s_suppkey % 3 <> 0 THEN 'a' END, CASE WHEN s_nationkey % 2 = 0 THEN 'b' END) AS datasets FROM supplier""",
)
def enabled_datasets(spark: SparkSession, sf: str) -> DataFrame:
    first = F.struct(F.lit("a").alias("id"), F.struct((F.col("s_suppkey") % 3 != 0).alias("enabled")).alias("rag_config"))
    second = F.struct(F.lit("b").alias("id"), F.struct(F.when(F.col("s_nationkey") % 2 == 1, False).alias("enabled")).alias("rag_config"))
    kept = F.filter(F.array(first, second), lambda d: F.coalesce(d["rag_config"]["enabled"], F.lit(True)))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(F.transform(kept, lambda d: d["id"]), "|").alias("datasets"))


@query(
    "missing_fields",
    """SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'kind' END, CASE WHEN user_id % 4 = 0 THEN 'user' END, 'note') AS missing,
      CASE WHEN TRUE THEN 'needs_input' END AS status FROM events""",
)
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.create_map(
        F.lit("kind"), F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")),
        F.lit("user"), F.when(F.col("user_id") % 4 != 0, F.col("user_id").cast("string")),
    )
    missing = js.missing_required(payload, F.array(F.lit("kind"), F.lit("user"), F.lit("note")))
    return table(spark, sf, "events").select(
        "event_id", F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) > 0, "needs_input").otherwise("ready").alias("status")
    )


@query(
    "call_predicates",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN '+1' || conv_id END AS caller,
      CASE WHEN turn = 2 THEN 'transferred' ELSE 'ended' END AS status FROM conversations""",
)
def call_predicates(spark: SparkSession, sf: str) -> DataFrame:
    channel = F.when(F.col("role") == "user", "sip").otherwise("webrtc")
    reason = F.when(F.col("turn") == 2, "assistant-forwarded-call").otherwise("bye")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", ph.phone_if_sip(channel, F.concat(F.lit("+1"), F.col("conv_id").cast("string"))).alias("caller"), ph.call_end_status(reason).alias("status")
    )


@query(
    "runtime_health",
    """SELECT l_orderkey, l_linenumber, l_partkey, r AS runtime, CASE r WHEN 'ready' THEN 'healthy' WHEN 'not_found' THEN 'unhealthy' ELSE 'unknown' END AS health,
      CASE r WHEN 'ready' THEN 'ready' WHEN 'not_found' THEN 'deleted' ELSE 'reconciling' END AS workflow
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'not_found' WHEN l_quantity >= greatest(1, l_linenumber * 10) THEN 'ready'
      WHEN l_linenumber > 3 THEN 'progressing' ELSE 'unknown' END AS r FROM lineitem)""",
)
def runtime_health(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    r = st.runtime_status(F.col("l_returnflag") != "R", F.col("l_linenumber") - 3, F.col("l_quantity"), F.col("l_linenumber") * 10)
    rows = l.select("l_orderkey", "l_linenumber", "l_partkey", r.alias("runtime"))
    return rows.select("*", st.health_status(F.col("runtime")).alias("health"), st.workflow_status(F.col("runtime")).alias("workflow"))


@query(
    "rate_limited",
    """SELECT event_id, event_type = 'error' OR user_id % 10 = 0 OR (contains(m, '429') AND contains(m, 'limit')) OR contains(m, 'rate limit') AS limited
    FROM (SELECT *, lower(CASE user_id % 3 WHEN 0 THEN 'HTTP 429 Limit' WHEN 1 THEN 'Rate Limit hit' ELSE 'fine' END) AS m FROM events)""",
)
def rate_limited(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id") % 3
    message = F.when(user == 0, "HTTP 429 Limit").when(user == 1, "Rate Limit hit").otherwise("fine")
    return table(spark, sf, "events").select(
        "event_id", js.rate_limited(F.when(F.col("event_type") == "error", 429).otherwise(500), F.when(F.col("user_id") % 10 == 0, "429"), message).alias("limited")
    )


@query(
    "compact_fields",
    """SELECT event_id, concat_ws(',', CASE WHEN value > 20 THEN 'big' END, 'kind') AS names FROM events""",
)
def compact_fields(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("big"), F.when(F.col("value") > 20, F.col("value").cast("string")), F.lit("none"), F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(js.compact_map(m))), ",").alias("names"))
