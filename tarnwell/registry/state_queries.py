"""State tables: calls, events, sessions, deployments, bindings, trunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.operators import inventory, sessions
from tarnwell.operators.ranking import latest_per_key
from tarnwell.plans import state as st
from tarnwell.registry import query
from tarnwell.registry.inputs import BASE_SECONDS, table
from tarnwell.sources.readers import agent_configs

def _now():
    return F.timestamp_seconds(F.lit(BASE_SECONDS))


def _s(c: str):
    return F.unix_seconds(F.col(c)).alias(c)


# --- calls: orders stand for calls, events for the updates of their users ------------------------

# Known calls: one per customer; even ones have a UUID id, odd ones an interaction id or an outside id.
_CALLS_SQL = f"""
calls AS (
  SELECT md5('c' || c_custkey) AS id, {BASE_SECONDS} + c_custkey AS created_s, CASE WHEN c_custkey % 3 = 1 THEN 'int-' || c_custkey END AS interaction_id,
    CASE WHEN c_custkey % 3 = 2 THEN '{{"external_call_id":"ext-' || c_custkey || '"}}' END AS call_data, c_custkey, c_mktsegment AS caller FROM customer)"""


def call_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, sf, "customer").select(
        F.md5(F.concat(F.lit("c"), key.cast("string")).cast("binary")).alias("id"), F.timestamp_seconds(F.lit(BASE_SECONDS) + key).alias("created_at"),
        F.when(key % 3 == 1, F.concat(F.lit("int-"), key.cast("string"))).alias("interaction_id"),
        F.when(key % 3 == 2, F.concat(F.lit('{"external_call_id":"ext-'), key.cast("string"), F.lit('"}'))).alias("call_data"),
        F.col("c_mktsegment").alias("caller"),
    )
    return schemas.align(c.withColumn("updated_at", F.col("created_at")), schemas.CALLS)


_REF_SQL = "CASE {k} % 3 WHEN 0 THEN md5('c' || {k}) WHEN 1 THEN 'int-' || {k} ELSE 'ext-' || {k} END"


def _ref(key):
    text = key.cast("string")
    return F.when(key % 3 == 0, F.md5(F.concat(F.lit("c"), text).cast("binary"))).when(key % 3 == 1, F.concat(F.lit("int-"), text)).otherwise(F.concat(F.lit("ext-"), text))


@query(
    "resolve_call",
    f"""WITH {_CALLS_SQL}, refs AS (SELECT DISTINCT {_REF_SQL.format(k='(o_custkey * 2)')} AS call_ref FROM orders)
    SELECT r.call_ref, c.id AS resolved_id FROM refs r LEFT JOIN calls c ON c.id = r.call_ref OR c.interaction_id = r.call_ref OR json_extract_string(c.call_data, '$.external_call_id') = r.call_ref""",
)
def resolve_call(spark: SparkSession, sf: str) -> DataFrame:
    """References of twice the customer range: about half of them are unknown."""
    refs = table(spark, sf, "orders").select(_ref(F.col("o_custkey") * 2).alias("call_ref"))
    return st.resolve_calls(refs, call_rows(spark, sf))


def call_updates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        _ref(F.col("o_custkey") * 2).alias("call_ref"), F.col("o_orderkey").alias("arrived"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent")).alias("ended_reason"),
        F.concat(F.lit('{"n":'), F.col("o_orderkey").cast("string"), F.lit("}")).alias("call_data"),
    )


_FOLD_SQL = f"""{_CALLS_SQL},
ups AS (SELECT {_REF_SQL.format(k='(o_custkey * 2)')} AS call_ref, o_orderkey AS arrived, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS ended_reason FROM orders),
fold AS (SELECT call_ref, arg_max(status, arrived) FILTER (status IS NOT NULL) AS status, max(ended_reason) AS ended_reason, max(arrived) AS n FROM ups GROUP BY call_ref),
res AS (SELECT f.*, c.id FROM fold f LEFT JOIN calls c ON c.id = f.call_ref OR c.interaction_id = f.call_ref OR json_extract_string(c.call_data, '$.external_call_id') = f.call_ref),
nxt AS (
  SELECT c.id, c.caller, r.status, r.ended_reason, c.interaction_id, r.n FROM calls c LEFT JOIN res r ON r.id = c.id
  UNION ALL SELECT CASE WHEN length(call_ref) = 32 THEN call_ref ELSE md5(call_ref) END, NULL, status, ended_reason, CASE WHEN length(call_ref) <> 32 THEN call_ref END, n FROM res WHERE id IS NULL)"""


@query("upsert_calls", f"WITH {_FOLD_SQL} SELECT id, caller, status, ended_reason, interaction_id, CAST(n AS VARCHAR) AS n FROM nxt")
def upsert_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.upsert_calls(call_rows(spark, sf), call_updates(spark, sf), _now())
    return rows.select("id", "caller", "status", "ended_reason", "interaction_id", F.get_json_object("call_data", "$.n").alias("n"))


@query("patch_rejects", f"WITH {_FOLD_SQL} SELECT u.call_ref, u.arrived, 'unknown call' AS reject_reason FROM ups u JOIN res r ON r.call_ref = u.call_ref WHERE r.id IS NULL")
def patch_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return st.patch_calls(call_rows(spark, sf), call_updates(spark, sf), _now())[1]


_CALL_EVENTS_SQL = """
ev AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN user_id % 7 + event_id % 90 END AS given, ts FROM events),
counted AS (SELECT *, count(*) FILTER (WHERE given IS NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM ev),
raised AS (SELECT *, max(given - c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS d FROM counted),
base AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id)"""


@query(
    "next_sequence",
    f"WITH {_CALL_EVENTS_SQL} SELECT event_id, CAST(coalesce(given, greatest(coalesce(m, 0), d) + c) AS BIGINT) AS sequence_number FROM raised LEFT JOIN base ON base.conv_id = raised.user_id",
)
def next_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Events are numbered on from the conversation of the same number."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), "event_id", F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", F.col("user_id") % 7 + F.col("event_id") % 90).alias("sequence_number"),
    )
    old = table(spark, sf, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("sequence_number"))
    return st.next_sequence(e, old).select("event_id", "sequence_number")


@query(
    "append_call_events",
    f"""WITH {_CALLS_SQL}, e AS (SELECT event_id, ts, c.id FROM (SELECT *, {_REF_SQL.format(k='user_id')} AS call_ref FROM events) e JOIN calls c
      ON c.id = e.call_ref OR c.interaction_id = e.call_ref OR json_extract_string(c.call_data, '$.external_call_id') = e.call_ref)
    SELECT event_id, id AS call_id, CAST(coalesce(m, 0) + row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS BIGINT) AS sequence_number
      FROM e LEFT JOIN (SELECT md5('c' || conv_id) AS id, max(turn) AS m FROM conversations GROUP BY 1) USING (id)""",
)
def append_call_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        _ref(F.col("user_id")).alias("call_ref"), "event_id", F.col("ts").alias("created_at"), F.lit(None).cast("int").alias("sequence_number")
    )
    conv = F.md5(F.concat(F.lit("c"), F.col("conv_id").cast("string")).cast("binary"))
    already = table(spark, sf, "conversations").select(conv.alias("call_id"), F.col("turn").alias("sequence_number"))
    done, _ = st.append_call_events(e, call_rows(spark, sf), already)
    return done.select("event_id", "call_id", "sequence_number")


@query(
    "call_record_rows",
    """SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS call_ref, CASE WHEN turn % 2 = 0 THEN '+1' || conv_id END AS caller, CASE WHEN turn % 2 = 0 THEN 'sip' ELSE 'webrtc' END AS channel, 'started' AS status FROM conversations
    UNION ALL SELECT CAST(conv_id AS VARCHAR) || '-' || turn, CASE WHEN turn % 2 = 0 THEN '+1' || conv_id END, CASE WHEN turn % 2 = 0 THEN 'sip' ELSE 'webrtc' END,
      CASE WHEN role = 'user' THEN 'transferred' ELSE 'ended' END FROM conversations""",
)
def call_record_rows(spark: SparkSession, sf: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    s = table(spark, sf, "conversations").select(
        F.concat_ws("-", conv, F.col("turn").cast("string")).alias("call_id"), F.concat(F.lit("+1"), conv).alias("phone_number"),
        F.when(F.col("turn") % 2 == 0, "sip").otherwise("webrtc").alias("channel"), F.col("role").alias("session_type"), F.lit("r").alias("room_name"),
        F.lit("a").alias("agent_name"), F.when(F.col("role") == "user", "assistant-forwarded-call").otherwise("bye").alias("disconnect_reason"),
    )
    cols = ["call_ref", "caller", "channel", "status"]
    return st.call_start(s, _now()).select(*cols).unionByName(st.call_end(s, _now()).select(*cols))


# --- sessions ---------------------------------------------------------------------------------------


@query("turn_counts", "SELECT conv_id, count(*) FILTER (role = 'user') AS user_turn_count, count(*) FILTER (role = 'assistant') AS assistant_turn_count FROM conversations GROUP BY conv_id")
def turn_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.turn_counts(table(spark, sf, "conversations"), "conv_id")


_METRICS_SQL = "CASE event_type WHEN 'view' THEN 'e2e_latency' WHEN 'click' THEN 'llm_node_ttft' WHEN 'signup' THEN 'tts_node_ttfb' ELSE 'transcription_delay' END"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "view", "e2e_latency").when(kind == "click", "llm_node_ttft").when(kind == "signup", "tts_node_ttfb").otherwise("transcription_delay")
    metrics = F.create_map(name, F.when(kind == "error", "n/a").otherwise(F.col("value").cast("string")), F.lit("other"), F.lit("1"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), "ts", "event_id", F.when(kind == "view", "user").otherwise("assistant").alias("role"), metrics.alias("metrics"), "value"
    )


@query(
    "session_rollup",
    f"""SELECT user_id AS call_id, {_METRICS_SQL} AS metric, count(*) AS count, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min
    FROM events WHERE event_type <> 'error' GROUP BY ALL""",
)
def session_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions.latency_summary(_items(spark, sf))
    return rows.select("call_id", "metric", "count", F.round("avg", 6).alias("avg"), "max", "min")


@query(
    "session_summary",
    """SELECT user_id AS call_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS duration_seconds, count(*) FILTER (event_type = 'view') AS user_turn_count,
      round(avg(value) FILTER (event_type = 'view'), 6) AS avg_e2e_latency_seconds, max(value) FILTER (event_type = 'view') AS max_e2e_latency_seconds,
      round(avg(value) FILTER (event_type = 'click'), 6) AS avg_llm_ttft_seconds FROM events GROUP BY user_id""",
)
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    spans = items.groupBy("call_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    rows = sessions.session_summary(items, spans)
    rounded = [F.round(c, 6).alias(c) for c in ("duration_seconds", "avg_e2e_latency_seconds", "avg_llm_ttft_seconds")]
    return rows.select("call_id", *rounded, "user_turn_count", "max_e2e_latency_seconds")


# A usage record of an event: two model entries, one of them repeated, kinds told or to be guessed.
_USAGE_SQL = """
u AS (SELECT user_id AS call_id, ts, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY call_id) AS n FROM u) WHERE r = 1)"""


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    blank = F.lit(None)
    entry = lambda kind, model, inp, chars: F.struct(
        kind.cast("string").alias("type"), F.lit("p").alias("provider"), F.lit(model).alias("model"), inp.cast("long").alias("input_tokens"), chars.cast("double").alias("characters_count")
    )
    entries = F.array(
        entry(F.lit("llm_usage"), "m1", k, blank), entry(blank, "m1", k + 1, blank), entry(blank, "v1", blank, F.col("value")), entry(F.lit("stt"), "s1", blank, blank)
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), "ts", F.col("event_id").alias("seq"), F.to_json(F.struct(entries.alias("model_usage"))).alias("usage")
    )


@query("usage_snapshot", f"WITH {_USAGE_SQL} SELECT call_id, k, n AS usage_update_count FROM snap")
def usage_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    rows = sessions.usage_snapshot(_usage(spark, sf))
    return rows.select("call_id", F.get_json_object("usage", "$.model_usage[0].input_tokens").cast("long").alias("k"), "usage_update_count")


@query("token_usage_by_model", f"WITH {_USAGE_SQL} SELECT call_id, 'p:m1' AS model_key, CAST(k + 1 AS DOUBLE) AS input_tokens FROM snap")
def token_usage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    entries = sessions.usage_entries(sessions.usage_snapshot(_usage(spark, sf)))
    return sessions.usage_by_model(entries, "llm").select("call_id", "model_key", "input_tokens")


@query(
    "token_usage_totals",
    f"WITH {_USAGE_SQL} SELECT call_id, 'llm' AS kind, CAST(2 * k + 1 AS DOUBLE) AS input_tokens, NULL::DOUBLE AS characters FROM snap UNION ALL SELECT call_id, 'tts', NULL, value FROM snap",
)
def token_usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    entries = sessions.usage_entries(sessions.usage_snapshot(_usage(spark, sf)))
    parts = [
        sessions.usage_totals(entries, kind).select("call_id", F.lit(kind).alias("kind"), "input_tokens", F.col("characters_count").alias("characters"))
        for kind in ("llm", "tts")
    ]
    return parts[0].unionByName(parts[1])


@query("transcript_views", "SELECT conv_id, turn, role, length(text) AS n FROM conversations WHERE role = 'user'")
def transcript_views(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return sessions.transcript_views(c, "user", "conv_id", "turn").select("conv_id", "turn", "role", F.length("content").cast("long").alias("n"))


@query(
    "upsert_observability",
    """WITH nw AS (SELECT user_id, arg_max(event_type, event_id) AS reason, max(event_id) AS last FROM events GROUP BY user_id)
    SELECT CAST(coalesce(c.conv_id, nw.user_id) AS VARCHAR) AS call_id, CASE WHEN nw.user_id IS NOT NULL THEN nw.reason ELSE 'old' END AS disconnect_reason,
      CASE WHEN nw.user_id IS NOT NULL THEN 0 ELSE c.n END AS user_turn_count FROM (SELECT conv_id, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id) c FULL JOIN nw ON nw.user_id = c.conv_id""",
)
def upsert_observability(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("call_id")).agg(F.count(F.lit(1)).alias("user_turn_count")).withColumn("disconnect_reason", F.lit("old"))
    new = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("call_id"), F.col("event_type").alias("disconnect_reason"), "event_id")
    current = schemas.align(old, schemas.SESSION_RECORDS)
    updates = new.select(
        *[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.SESSION_RECORDS], "event_id"
    )
    rows = st.replace_rows(current, updates, ["call_id"], [F.desc("event_id")], ["user_turn_count", "assistant_turn_count", "usage_update_count"])
    return rows.select("call_id", "disconnect_reason", "user_turn_count")


# --- agents and deployments -----------------------------------------------------------------------------


@query("latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_user(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest_per_key(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.select("user_id", "event_id", "event_type")


@query(
    "upsert_agents",
    """SELECT phone_number, name FROM (SELECT '+1' || c_nationkey AS phone_number, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1
    UNION ALL SELECT '+2' || s_suppkey, s_name FROM supplier""",
)
def upsert_agents(spark: SparkSession, sf: str) -> DataFrame:
    old_a = table(spark, sf, "supplier").select(F.concat(F.lit("+2"), F.col("s_suppkey").cast("string")).alias("phone_number"), F.col("s_name").alias("name"))
    old_b = table(spark, sf, "nation").select(F.concat(F.lit("+1"), F.col("n_nationkey").cast("string")).alias("phone_number"), F.col("n_name").alias("name"))
    new = table(spark, sf, "customer").select(F.concat(F.lit("+1"), F.col("c_nationkey").cast("string")).alias("phone_number"), F.col("c_name").alias("name"), "c_custkey")
    return st.replace_rows(old_a.unionByName(old_b), new, ["phone_number"], [F.desc("c_custkey")])


@query(
    "agent_rows",
    f"""WITH old AS (SELECT 'n' || n_nationkey AS id, '+1' || n_nationkey AS phone_number, n_name AS name, 'org' AS org_id FROM nation),
    new AS (SELECT '+1' || (c_nationkey * 2) AS phone_number, arg_max(c_name, c_custkey) AS name, arg_max(c_mktsegment, c_custkey) AS agent_type FROM customer GROUP BY 1)
    SELECT coalesce(o.id, md5(n.phone_number)) AS id, coalesce(o.phone_number, n.phone_number) AS phone_number, CASE WHEN n.phone_number IS NULL THEN o.name ELSE n.name END AS name,
      n.agent_type, o.org_id, CASE WHEN o.id IS NULL THEN {BASE_SECONDS} ELSE 1 END AS created FROM old o FULL JOIN new n ON o.phone_number = n.phone_number""",
)
def agent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Known agents keep id, organisation and creation time, new ones get theirs."""
    old = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("+1"), F.col("n_nationkey").cast("string")).alias("phone_number"),
        F.col("n_name").alias("name"), F.lit("org").alias("org_id"), F.timestamp_seconds(F.lit(1)).alias("created_at"),
    )
    new = table(spark, sf, "customer").select(
        F.concat(F.lit("+1"), (F.col("c_nationkey") * 2).cast("string")).alias("phone_number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("agent_type"),
        F.lit("{}").alias("config"), "c_custkey",
    )
    rows = st.upsert_agents(schemas.align(old, schemas.AGENTS), new, [F.desc("c_custkey")], F.timestamp_seconds(F.lit(BASE_SECONDS)))
    return rows.select("id", "phone_number", "name", "agent_type", "org_id", F.unix_seconds("created_at").alias("created"))


@query(
    "agent_configs",
    "SELECT c_custkey, c_nationkey AS top_k FROM customer WHERE c_mktsegment = 'MACHINERY'",
)
def agents_of_type(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("agent_type"), F.timestamp_seconds("c_custkey").alias("created_at"),
        F.to_json(F.struct(F.col("c_nationkey").alias("top_k"))).alias("config"),
    )
    return agent_configs(a, "MACHINERY", "top_k int").select("c_custkey", "config.top_k")


_STATUS = {"F": "pending", "O": "reconciling", "P": "ready"}
_DEP_SQL = f"""
dep AS (SELECT 'd' || o_orderkey AS id, 'a' || o_custkey AS agent_name, lower(o_orderpriority[3:]) AS namespace, CASE o_orderstatus WHEN 'F' THEN 'pending' WHEN 'O' THEN 'reconciling' ELSE 'ready' END AS workflow_status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'deployed' ELSE 'deleted' END AS desired_state, {BASE_SECONDS} + o_orderkey % 1000 AS updated_s, o_orderkey FROM orders)"""


def _deployments(spark: SparkSession, sf: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    at = F.timestamp_seconds(F.lit(BASE_SECONDS) + key % 1000)
    d = table(spark, sf, "orders").select(
        F.concat(F.lit("d"), key.cast("string")).alias("id"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("agent_name"),
        F.lower(F.substring("o_orderpriority", 3, 100)).alias("namespace"), F.lit("main").alias("deployment_name"),
        F.when(status == "F", "pending").when(status == "O", "reconciling").otherwise("ready").alias("workflow_status"),
        F.when(key % 2 == 0, "deployed").otherwise("deleted").alias("desired_state"), at.alias("updated_at"), at.alias("created_at"),
    )
    return schemas.align(d, schemas.DEPLOYMENTS)


@query(
    "claim_fifo",
    f"""WITH {_DEP_SQL} SELECT id, CASE WHEN desired_state = 'deleted' THEN 'deleting' ELSE 'applying' END AS workflow_status, '{{"worker_id":"w1"}}' AS status_details FROM (
      SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY updated_s, id) AS r FROM dep WHERE workflow_status = 'pending') WHERE r = 1""",
)
def claim_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return st.claim_fifo(_deployments(spark, sf), ["agent_name"], F.lit("w1"), _now()).select("id", "workflow_status", "status_details")


@query("work_lists", f"WITH {_DEP_SQL} SELECT id, 'claimable' AS list FROM dep WHERE workflow_status = 'pending' UNION ALL SELECT id, 'reconcilable' FROM dep WHERE workflow_status = 'reconciling'")
def work_lists(spark: SparkSession, sf: str) -> DataFrame:
    d = _deployments(spark, sf)
    return st.claimable(d).select("id", F.lit("claimable").alias("list")).unionByName(st.reconcilable(d).select("id", F.lit("reconcilable").alias("list")))


# The latest deployment per key receives one request per customer.
_REQ_SQL = f"""{_DEP_SQL},
lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_name, namespace ORDER BY updated_s DESC, id DESC) AS r FROM dep) WHERE r = 1),
req AS (SELECT 'a' || c_custkey AS agent_name, 'urgent' AS namespace, CASE WHEN c_custkey % 2 = 0 THEN 'deployed' ELSE 'deleted' END AS desired_state, c_custkey FROM customer),
jud AS (SELECT q.*, l.id, CASE WHEN l.id IS NOT NULL AND l.desired_state = q.desired_state AND l.workflow_status IN ('pending', 'reconciling') THEN 'request_deduplicated' ELSE 'request_enqueued' END AS event_type
  FROM req q LEFT JOIN lat l ON l.agent_name = q.agent_name AND l.namespace = q.namespace)"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("a"), key.cast("string")).alias("agent_name"), F.lit("urgent").alias("namespace"), F.lit("main").alias("deployment_name"),
        F.when(key % 2 == 0, "deployed").otherwise("deleted").alias("desired_state"), F.lit("me").alias("requested_by"), F.lit("img:1").alias("image"), key.alias("arrived"),
    )


@query(
    "enqueue_requests",
    f"""WITH {_REQ_SQL} SELECT d.id, CASE WHEN j.id IS NOT NULL THEN j.desired_state ELSE d.desired_state END AS desired_state, CASE WHEN j.id IS NOT NULL THEN 'pending' ELSE d.workflow_status END AS workflow_status
    FROM dep d LEFT JOIN jud j ON j.id = d.id AND j.event_type = 'request_enqueued'
    UNION ALL SELECT md5(agent_name || '/urgent/main'), desired_state, 'pending' FROM jud WHERE id IS NULL""",
)
def enqueue_requests(spark: SparkSession, sf: str) -> DataFrame:
    nxt, _ = st.enqueue_requests(_deployments(spark, sf), _requests(spark, sf), _now())
    return nxt.select("id", "desired_state", "workflow_status")


@query("request_events", f"WITH {_REQ_SQL} SELECT coalesce(id, md5(agent_name || '/urgent/main')) AS deployment_id, event_type FROM jud")
def request_events(spark: SparkSession, sf: str) -> DataFrame:
    _, events = st.enqueue_requests(_deployments(spark, sf), _requests(spark, sf), _now())
    return events.select("deployment_id", "event_type")


_CHAIN_KEY = "CASE WHEN {k} % 3 = 0 THEN 'a1' ELSE 'a' || ({k} % 40) END"


@query(
    "request_chain",
    f"""WITH {_DEP_SQL},
    lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_name, namespace ORDER BY updated_s DESC, id DESC) AS r FROM dep) WHERE r = 1),
    req AS (SELECT o_orderkey, {_CHAIN_KEY.format(k='o_custkey')} AS agent_name, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'deployed' END AS desired_state FROM orders),
    told AS (
      SELECT q.*, coalesce(l.id, md5(q.agent_name || '/urgent/main')) AS deployment_id, CASE WHEN row_number() OVER w = 1
        THEN CASE WHEN l.workflow_status IN ('pending', 'applying', 'deleting', 'reconciling') THEN l.desired_state END ELSE lag(q.desired_state) OVER w END AS under_way
      FROM req q LEFT JOIN lat l ON l.agent_name = q.agent_name AND l.namespace = 'urgent' WINDOW w AS (PARTITION BY q.agent_name ORDER BY q.o_orderkey))
    SELECT deployment_id, count(*) FILTER (under_way IS DISTINCT FROM desired_state) AS enqueued, count(*) FILTER (under_way = desired_state) AS repeated,
      arg_max(desired_state, o_orderkey) AS desired_state FROM told GROUP BY deployment_id""",
)
def request_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Very many requests of few deployments, one of which has a third of them."""
    key = F.col("o_custkey")
    requests = table(spark, sf, "orders").select(
        F.when(key % 3 == 0, "a1").otherwise(F.concat(F.lit("a"), (key % 40).cast("string"))).alias("agent_name"), F.lit("urgent").alias("namespace"), F.lit("main").alias("deployment_name"),
        F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("deployed").alias("desired_state"), F.lit("me").alias("requested_by"), F.lit("img:1").alias("image"), F.col("o_orderkey").alias("arrived"),
    )
    nxt, events = st.enqueue_requests(_deployments(spark, sf), requests, _now(), buckets=16)
    counts = events.groupBy("deployment_id").agg(
        F.count_if(F.col("event_type") == "request_enqueued").alias("enqueued"), F.count_if(F.col("event_type") == "request_deduplicated").alias("repeated")
    )
    return counts.join(nxt.select(F.col("id").alias("deployment_id"), "desired_state"), "deployment_id")


@query(
    "deployment_status",
    f"""WITH {_DEP_SQL}, lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_name, namespace ORDER BY updated_s DESC, id DESC) AS r FROM dep) WHERE r = 1),
    up AS (SELECT 'a' || c_custkey AS agent_name, 'urgent' AS namespace, CASE WHEN c_custkey % 3 = 0 THEN 'ready' WHEN c_custkey % 3 = 1 THEN 'deleted' ELSE 'reconciling' END AS w FROM customer),
    hit AS (SELECT u.*, l.id FROM up u LEFT JOIN lat l ON l.agent_name = u.agent_name AND l.namespace = u.namespace)
    SELECT d.id, coalesce(h.w, d.workflow_status) AS workflow_status, CASE WHEN h.w = 'ready' THEN {BASE_SECONDS} END AS deployed_at, CASE WHEN h.w = 'deleted' THEN {BASE_SECONDS} END AS deleted_at FROM dep d LEFT JOIN hit h ON h.id = d.id
    UNION ALL SELECT md5(agent_name || '/urgent/main'), w, CASE WHEN w = 'ready' THEN {BASE_SECONDS} END, CASE WHEN w = 'deleted' THEN {BASE_SECONDS} END FROM hit WHERE id IS NULL""",
)
def deployment_status(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    ups = _requests(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("arrived"), "c_custkey"), "arrived").select(
        "agent_name", "namespace", "deployment_name", "arrived",
        F.when(key == 0, "ready").when(key == 1, "deleted").otherwise("reconciling").alias("workflow_status"), F.lit("unknown").alias("runtime_status"),
        F.lit("unknown").alias("health_status"), F.lit(None).cast("string").alias("last_error"), F.lit("status").alias("event_type"),
        F.lit("m").alias("event_message"), F.lit("{}").alias("status_details"),
    )
    nxt, _ = st.save_deployment_status(_deployments(spark, sf), ups, _now())
    return nxt.select("id", "workflow_status", _s("deployed_at"), _s("deleted_at"))


# --- bindings and trunks ----------------------------------------------------------------------------

_BIND_SQL = f"""
bind AS (SELECT 'b' || s_suppkey AS id, 'a' || s_suppkey AS agent_name, '+' || (1000 + s_suppkey) AS phone_number, s_nationkey % 2 = 0 AS is_active, {BASE_SECONDS} + s_suppkey AS updated_s, s_suppkey FROM supplier)"""


def _bindings(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    at = F.timestamp_seconds(F.lit(BASE_SECONDS) + key)
    b = table(spark, sf, "supplier").select(
        F.concat(F.lit("b"), key.cast("string")).alias("id"), F.concat(F.lit("a"), key.cast("string")).alias("agent_name"),
        F.concat(F.lit("+"), (key + 1000).cast("string")).alias("phone_number"), (F.col("s_nationkey") % 2 == 0).alias("is_active"),
        at.alias("created_at"), at.alias("updated_at"), F.concat(F.lit("t"), key.cast("string")).alias("trunk_id"),
        F.concat(F.lit("r"), (key % 50).cast("string")).alias("dispatch_rule_id"), F.col("s_name").alias("trunk_name"), F.lit("rule").alias("dispatch_rule_name"),
    )
    return schemas.align(b, schemas.BINDINGS)


@query("active_bindings", f"WITH {_BIND_SQL} SELECT id, agent_name FROM bind WHERE is_active")
def active_bindings(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.active_bindings(_bindings(spark, sf)).select("id", "agent_name")


@query(
    "binding_conflicts",
    f"""WITH {_BIND_SQL}, q AS (SELECT p_partkey, 'a' || (p_partkey % 150) AS agent_name, '+' || (1000 + p_size) AS phone_number FROM part)
    SELECT p_partkey, 'number has another agent' AS conflict FROM q WHERE EXISTS (SELECT 1 FROM bind b WHERE b.is_active AND b.phone_number = q.phone_number AND b.agent_name <> q.agent_name)
    UNION ALL SELECT p_partkey, 'agent has another number' FROM q WHERE EXISTS (SELECT 1 FROM bind b WHERE b.is_active AND b.agent_name = q.agent_name AND b.phone_number <> q.phone_number)""",
)
def binding_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("a"), (F.col("p_partkey") % 150).cast("string")).alias("agent_name"), F.concat(F.lit("+"), (F.col("p_size") + 1000).cast("string")).alias("phone_number")
    )
    return inventory.binding_conflicts(q, _bindings(spark, sf)).select("p_partkey", "conflict")


@query(
    "binding_status",
    f"""WITH {_BIND_SQL}, up AS (SELECT 'a' || (n_nationkey * 7) AS agent_name, '+' || (1000 + n_nationkey * 7) AS phone_number, n_nationkey FROM nation),
    hit AS (SELECT u.*, b.id FROM up u LEFT JOIN bind b ON b.agent_name = u.agent_name OR b.phone_number = u.phone_number)
    SELECT b.id, CASE WHEN h.id IS NOT NULL THEN h.n_nationkey % 2 = 1 ELSE b.is_active END AS is_active, CASE WHEN h.id IS NOT NULL THEN {BASE_SECONDS} END AS provisioned_at FROM bind b LEFT JOIN hit h ON h.id = b.id
    UNION ALL SELECT md5(agent_name), TRUE, {BASE_SECONDS} FROM hit WHERE id IS NULL""",
)
def binding_status(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    ups = table(spark, sf, "nation").select(
        F.concat(F.lit("a"), (key * 7).cast("string")).alias("agent_name"), F.concat(F.lit("+"), (key * 7 + 1000).cast("string")).alias("phone_number"), key.alias("arrived"),
        F.when(key % 2 == 0, "deleted").otherwise("bound").alias("desired_state"), F.lit("provisioned").alias("workflow_status"), F.lit("healthy").alias("health_status"),
        F.lit(None).cast("string").alias("last_error"), F.lit("status").alias("event_type"), F.lit("m").alias("event_message"), F.lit("{}").alias("status_details"),
    )
    nxt, _ = st.save_binding_status(_bindings(spark, sf), ups, _now())
    return nxt.select("id", "is_active", _s("provisioned_at"))


# Suppliers are inbound trunks, nations outbound ones (ids overlap), parts are dispatch rules.
def _trunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    trunk = lambda k, n: (F.concat(F.lit("t"), F.col(k).cast("string")).alias("sip_trunk_id"), F.col(n).alias("name"), F.array(F.lit("+1"), F.concat(F.lit("+"), F.col(k).cast("string"))).alias("numbers"))
    return table(spark, sf, "supplier").select(*trunk("s_suppkey", "s_name")), table(spark, sf, "nation").select(*trunk("n_nationkey", "n_name"))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    ids = F.when(size % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit("t"), (size * 3).cast("string")), F.concat(F.lit("t"), (size * 3 + 1).cast("string"))))
    return table(spark, sf, "part").select(
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("sip_dispatch_rule_id"), F.col("p_name").alias("name"), ids.alias("trunk_ids"),
        F.lit("room").alias("room_prefix"), F.array(F.col("p_brand"), F.lit(" ")).alias("agent_names"), F.lit(False).alias("hide_phone_number"),
        F.col("p_brand").alias("agent_name"), F.lit("").alias("metadata"),
    )


_TRUNK_SQL = """
tr AS (SELECT coalesce(n_id, s_id) AS trunk_id, CASE WHEN n_id IS NOT NULL THEN n_name ELSE s_name END AS trunk_name, CASE WHEN n_id IS NOT NULL THEN 'outbound' ELSE 'inbound' END AS trunk_kind
  FROM (SELECT 't' || s_suppkey AS s_id, s_name FROM supplier) FULL JOIN (SELECT 't' || n_nationkey AS n_id, n_name FROM nation) ON s_id = n_id),
ru AS (SELECT 'r' || p_partkey AS rule_id, p_name AS rule_name, p_brand, unnest(CASE WHEN p_size % 5 = 0 THEN [NULL] ELSE ['t' || (p_size * 3), 't' || (p_size * 3 + 1)] END) AS trunk_id FROM part)"""


@query(
    "trunk_inventory",
    f"""WITH {_TRUNK_SQL} SELECT coalesce(t.trunk_id, r.trunk_id, '') AS trunk_id, t.trunk_name, t.trunk_kind, CASE WHEN t.trunk_id IS NULL THEN '' ELSE '+1, +' || t.trunk_id[2:] END AS phone_numbers,
      coalesce(r.rule_id, '') AS dispatch_rule_id, coalesce(r.p_brand, '') AS agent_names FROM tr t FULL JOIN ru r ON r.trunk_id = t.trunk_id""",
)
def trunk_inventory(spark: SparkSession, sf: str) -> DataFrame:
    inbound, outbound = _trunks(spark, sf)
    rows = inventory.trunk_inventory(inbound, outbound, _rules(spark, sf))
    return rows.select("trunk_id", "trunk_name", "trunk_kind", "phone_numbers", "dispatch_rule_id", "agent_names")


@query(
    "bound_trunks",
    f"""WITH {_TRUNK_SQL}, {_BIND_SQL}, b AS (SELECT *, 't' || s_suppkey AS trunk_id, 'r' || (s_suppkey % 50) AS rule_id FROM bind WHERE is_active),
    br AS (SELECT rule_id, arg_min(agent_name, updated_s) AS agent FROM b GROUP BY rule_id)
    SELECT 't' || s.s_suppkey AS trunk_id, s.s_name AS trunk_name, '+1, +' || s.s_suppkey AS phone_numbers,
      CASE WHEN r.rule_id IS NOT NULL THEN r.rule_name ELSE CASE WHEN b.id IS NULL THEN '-' ELSE 'rule' END END AS dispatch_rule,
      CASE WHEN r.rule_id IS NOT NULL THEN coalesce(br.agent, r.p_brand) ELSE coalesce(b.agent_name, '-') END AS agent_name
    FROM supplier s LEFT JOIN b ON b.trunk_id = 't' || s.s_suppkey LEFT JOIN ru r ON r.trunk_id = 't' || s.s_suppkey LEFT JOIN br ON br.rule_id = r.rule_id""",
)
def bound_trunks(spark: SparkSession, sf: str) -> DataFrame:
    inbound, _ = _trunks(spark, sf)
    return inventory.bound_trunks(inbound, _rules(spark, sf), _bindings(spark, sf))
