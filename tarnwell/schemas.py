"""Schemas of the tables, as fixed constants; ``align`` brings a frame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def schema_of(fields: str) -> T.StructType:
    """Schema of ``name type, name type, ...``; unlike DDL parsing it needs no session."""
    pairs = (f.strip().split(" ") for f in fields.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SOURCE_DOCUMENTS = schema_of(
    "id string, number string, updated_at timestamp, content string, name string, is_deleted boolean, "
    "knowledgebase_collection_id string, org_id string"
)
KB_KEYWORDS = schema_of(
    "kbid string, kb_collection_id string, shard_id int, category string, article_type string, primary_topic string, "
    "specific_keyword string, generic_keyword string, usecase string, secondary_entity string, acronym string, "
    "specific_keyword_embedding array<float>, generic_keyword_embedding array<float>, usecase_embedding array<float>, "
    "secondary_entity_embedding array<float>, acronym_embedding array<float>, created_at timestamp, updated_at timestamp"
)
KB_SUMMARIES = schema_of(
    "doc_id string, kb_collection_id string, shard_id int, article_title string, primary_intent string, query_triggers string, "
    "secondary_mentions string, summary string, content string, created_at timestamp, updated_at timestamp"
)
SHARD_REGISTRY = schema_of("kb_collection_id string, shard_id int, doc_count int, max_shard_size int, created_at timestamp")
CATALOGUE = schema_of("kb_collection_id string, shard_id int, data string, updated_at timestamp")
TRACE = schema_of("kbid string, status string, timestamp timestamp, reason string, details string")
CALLS = schema_of(
    "id string, created_at timestamp, updated_at timestamp, caller string, channel string, status string, ended_reason string, "
    "details_url string, ended_at timestamp, called_at timestamp, recording_url string, interaction_id string, "
    "voice_virtual_agent_id string, call_data string"
)
CALL_EVENTS = schema_of(
    "id string, created_at timestamp, call_id string, sequence_number int, event_type string, speaker string, content_text string, "
    "content_json string, metadata string"
)
SESSION_RECORDS = schema_of(
    "call_id string, room_name string, agent_name string, started_at timestamp, ended_at timestamp, duration_seconds double, "
    "disconnect_reason string, user_turn_count int, assistant_turn_count int, usage_update_count int, "
    "avg_e2e_latency_seconds double, max_e2e_latency_seconds double, avg_llm_ttft_seconds double, avg_tts_ttfb_seconds double, "
    "usage_summary string, llm_token_count string, tts_token_count string, latency_summary string, numeric_usage_totals string, metrics_json string"
)
AGENTS = schema_of(
    "id string, created_at timestamp, org_id string, phone_number string, config string, name string, kb_id string, "
    "agent_type string, agent_id string, agent_prompt string"
)
DEPLOYMENTS = schema_of(
    "id string, created_at timestamp, updated_at timestamp, agent_name string, agent_type string, agent_version string, namespace string, "
    "deployment_name string, service_name string, image string, image_tag string, desired_state string, workflow_status string, "
    "runtime_status string, health_status string, desired_replicas int, ready_replicas int, available_replicas int, restart_count int, "
    "generation int, observed_generation int, requested_by string, last_error string, status_reason string, status_details string, "
    "last_observed_at timestamp, last_error_at timestamp, deployed_at timestamp, ready_at timestamp, deleted_at timestamp"
)
BINDINGS = schema_of(
    "id string, created_at timestamp, updated_at timestamp, provider string, agent_name string, agent_version string, phone_number string, "
    "trunk_id string, trunk_name string, dispatch_rule_id string, dispatch_rule_name string, room_prefix string, desired_state string, "
    "workflow_status string, health_status string, is_active boolean, provisioned_at timestamp, last_error string, last_error_at timestamp, "
    "status_reason string, status_details string"
)
JOBS = schema_of(
    "job_id string, skill_name string, status string, payload map<string,string>, required_input array<string>, "
    "progress_message string, created_at timestamp, updated_at timestamp"
)


def align(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of the schema in its order: missing ones with their default, present ones cast."""
    given = defaults or {}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(given.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def first_column(df: DataFrame, candidates: list[str], default: str | None = None):
    """Column of the first candidate the frame has; a typed null when it has none."""
    found = next((c for c in candidates if c in df.columns), None)
    return F.col(found) if found else F.lit(default).cast("string")


def existing_columns(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Projection of the candidates that exist."""
    return df.select(*[c for c in candidates if c in df.columns])
