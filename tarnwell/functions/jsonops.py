"""JSON payloads as Column expressions over variants and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.phones import is_uuid
from tarnwell.functions.text import ColumnLike, bind, collapse_spaces, col
from tarnwell.session import materialise

_MAP = "map<string,variant>"


def is_json(text: ColumnLike) -> Column:
    """True for exactly one complete JSON value; the parsers alone accept trailing rubbish."""
    # A second element after it makes both a missing and an extra bracket change the count.
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), col(text), F.lit(",0]"))) == 2, F.lit(False))


def safe_json_object(text: ColumnLike) -> Column:
    """The parsed object, or an empty map for blank, broken or non-object text."""
    parsed = F.try_parse_json(F.when(is_json(text), col(text)))
    as_map = F.try_variant_get(parsed, "$", _MAP)
    return F.coalesce(as_map, F.create_map().cast(_MAP))


def map_to_json(m: Column) -> Column:
    """JSON text of a map with its keys in order; null values are kept out."""
    return bind(
        m,
        lambda x: F.to_json(
            F.map_from_entries(F.transform(F.array_sort(F.map_keys(x)), lambda k: F.struct(k, F.element_at(x, k))))
        ),
    )


def json_merge(old: ColumnLike, new: ColumnLike) -> Column:
    """Shallow merge of two JSON objects, right side wins; a null side yields the other."""
    merged = bind(
        F.struct(safe_json_object(old).alias("l"), safe_json_object(new).alias("r")),
        lambda s: F.map_concat(F.map_filter(s["l"], lambda k, v: ~F.map_contains_key(s["r"], k)), s["r"]),
    )
    return F.when(col(new).isNull(), col(old)).when(col(old).isNull(), col(new)).otherwise(map_to_json(merged))


def json_object(**values: ColumnLike) -> Column:
    """JSON object of the non-null values."""
    return F.to_json(F.struct(*[col(v).alias(k) for k, v in values.items()]))


def with_external_id(call_id: ColumnLike, data: ColumnLike) -> Column:
    """Call data with the outside identifier added when the id is not a UUID; blank becomes null."""
    given = F.when(F.trim(col(data)).rlike(r"^\{\s*\S") & ~F.trim(col(data)).rlike(r"^\{\s*\}$"), col(data))
    own = F.to_json(F.struct(col(call_id).alias("external_call_id")))
    return F.when(is_uuid(call_id), given).otherwise(json_merge(own, given))


def json_list(value: Column, *paths: str) -> Column:
    """List of strings under the first path that has one; a single string is a list of one."""
    tries = []
    for path in paths:
        tries.append(F.try_variant_get(value, path, "array<string>"))
        single = F.try_variant_get(value, path, "string")
        tries.append(F.when(single.isNotNull() & ~F.startswith(single, F.lit("[")) & ~F.startswith(single, F.lit("{")), F.array(single)))
    return F.coalesce(*tries, F.array().cast("array<string>"))


def json_text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def content_to_text(content: ColumnLike) -> Column:
    """Conversation content: text as it is; parts joined by a blank, from text or content."""
    parsed = F.try_parse_json(F.when(F.startswith(F.trim(col(content)), F.lit("[")), col(content)))
    parts = F.try_variant_get(parsed, "$", "array<variant>")
    texts = F.transform(
        parts,
        lambda p: F.coalesce(
            F.nullif(F.try_variant_get(p, "$.text", "string"), F.lit("")),
            F.nullif(F.try_variant_get(p, "$.content", "string"), F.lit("")),
            F.when(~F.startswith(F.to_json(p), F.lit("{")), F.try_variant_get(p, "$", "string")),
        ),
    )
    kept = F.filter(texts, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.trim(F.array_join(F.transform(kept, lambda t: F.trim(t)), " ")), col(content), F.lit(""))


def text_parts(content: ColumnLike) -> Column:
    """Only the parts of type text, joined with nothing between them."""
    parsed = F.try_parse_json(F.when(F.startswith(F.trim(col(content)), F.lit("[")), col(content)))
    parts = F.try_variant_get(parsed, "$", "array<struct<type:string,text:string>>")
    kept = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.coalesce(F.array_join(kept, ""), F.when(~F.startswith(F.trim(col(content)), F.lit("[")), col(content)), F.lit(""))


def to_json_compatible(value: ColumnLike) -> Column:
    """JSON text of any nested value with ISO timestamps."""
    return F.to_json(col(value), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})


def compact_map(m: ColumnLike) -> Column:
    return F.map_filter(col(m), lambda k, v: v.isNotNull())


def missing_required(payload: ColumnLike, required: ColumnLike) -> Column:
    """Required names whose payload value is absent or blank, in order."""
    return F.filter(
        col(required), lambda f: F.coalesce(F.trim(F.try_element_at(col(payload), f)), F.lit("")) == ""
    )


def rate_limited(status: ColumnLike, code: ColumnLike, message: ColumnLike) -> Column:
    msg = F.lower(F.coalesce(col(message), F.lit("")))
    return (
        F.coalesce(col(status) == 429, F.lit(False))
        | F.coalesce(col(code).isin("429", "rate_limit_exceeded", "RateLimitError"), F.lit(False))
        | msg.rlike("too many requests|rate limit|ratelimit")
        | (F.contains(msg, F.lit("429")) & msg.rlike("rate|limit|too many"))
    )


def bound_agent_name(binding_name: ColumnLike, metadata: ColumnLike, agent_name: ColumnLike) -> Column:
    """Name of a binding, else the target named in the agent metadata, else the agent's own name."""
    meta = F.try_parse_json(col(metadata))
    options = [col(binding_name), json_text(meta, "$.config_name"), json_text(meta, "$.target_agent"), col(agent_name)]
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def parse_items(response: ColumnLike) -> Column:
    """Struct (status, items) of an extraction response.

    Items come from a list, from ``items`` and ``result``, or from the object itself; each is
    (item, purpose, method) and blank names are dropped.
    """
    item = "struct<item:string,name:string,purpose:string,method:string>"
    parsed = F.try_parse_json(F.when(is_json(response), col(response)))
    head = F.substring(F.ltrim(col(response)), 1, 1)

    def listed(path: str) -> Column:
        raw = F.try_variant_get(parsed, path, "array<variant>")
        objects = F.filter(raw, lambda v: F.startswith(F.to_json(v), F.lit("{")))
        return F.coalesce(
            F.transform(objects, lambda v: F.try_variant_get(v, "$", item)), F.array().cast(f"array<{item}>")
        )

    own = F.try_variant_get(parsed, "$", item)
    is_item = own["item"].isNotNull() | own["name"].isNotNull()
    raw = F.when(head == "[", listed("$")).otherwise(
        F.concat(
            listed("$.items"), listed("$.result"),
            F.when(is_item, F.array(own)).otherwise(F.array().cast(f"array<{item}>")),
        )
    )
    named = F.transform(
        raw,
        lambda x: F.struct(
            collapse_spaces(F.coalesce(F.nullif(x["item"], F.lit("")), x["name"], F.lit(""))).alias("item"),
            F.trim(F.coalesce(x["purpose"], F.lit(""))).alias("purpose"),
            F.trim(F.coalesce(x["method"], F.lit(""))).alias("method"),
        ),
    )
    status = F.when(parsed.isNull(), "invalid_json").when(head.isin("[", "{"), "success").otherwise("invalid_schema")
    items = F.when(status == "success", F.filter(named, lambda x: x["item"] != ""))
    return F.struct(
        status.alias("status"),
        F.coalesce(items, F.array().cast("array<struct<item:string,purpose:string,method:string>>")).alias("items"),
    )


def tool_event_text(tool: ColumnLike, ok: ColumnLike, result: ColumnLike, error: ColumnLike, label: str = "Tool") -> Column:
    """One line that tells what a tool call returned."""
    parsed = F.try_parse_json(col(result))
    number = F.coalesce(F.nullif(json_text(parsed, "$.number"), F.lit("")), json_text(parsed, "$.task_effective_number"), F.lit(""))
    note = F.coalesce(F.nullif(json_text(parsed, "$.short_description"), F.lit("")), json_text(parsed, "$.message"), F.lit(""))
    is_object = F.startswith(F.ltrim(col(result)), F.lit("{"))
    head = F.concat(F.lit(f"{label}: "), col(tool))
    arrow = F.concat(head, F.lit(" → "))
    return (
        F.when(col(ok) & is_object, F.trim(F.concat(arrow, number, F.lit(" "), note)))
        .when(col(ok) & (col(result) != ""), F.concat(arrow, F.substring(col(result), 1, 200)))
        .when(col(error) != "", F.concat(arrow, F.lit("Error: "), F.substring(col(error), 1, 200)))
        .otherwise(head)
    )


def numeric_leaves(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Rows (keys, path, value) of every number in nested JSON, under paths like ``a.b[0]``; booleans, texts and nulls are skipped.

    A walk over the rows that still hold containers: each step writes the children of the containers that the step before has
    written, until none is left. So the input is read once, whatever the depth, and no depth is assumed.
    """
    kind = F.schema_of_variant("node")
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("node", "$", "double"))
    container = F.when(kind.rlike("^(OBJECT|ARRAY)"), F.col("node"))

    def written(rows: DataFrame) -> DataFrame:
        return materialise(rows.select(*keys, "path", number.alias("value"), container.alias("node")).where("value IS NOT NULL OR node IS NOT NULL"), "json-walk")

    level = written(df.select(*keys, F.lit("").alias("path"), F.try_parse_json(payload).alias("node")))
    found = []
    while True:
        found.append(level.where(F.col("value").isNotNull()).select(*keys, F.when(F.col("path") == "", "value").otherwise(F.col("path")).alias("path"), "value"))
        open_ = level.where(F.col("node").isNotNull())
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        children = open_.drop("value").lateralJoin(
            df.sparkSession.tvf.variant_explode(F.col("node").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_child"))
        )
        step = F.when(F.col("_key").isNull(), F.concat(F.col("path"), F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(
            F.when(F.col("path") == "", F.col("_key")).otherwise(F.concat(F.col("path"), F.lit("."), F.col("_key")))
        )
        level = written(children.select(*keys, step.alias("path"), F.col("_child").alias("node")))


def numeric_totals(df: DataFrame, keys: list[str], payload: str) -> DataFrame:
    return numeric_leaves(df, keys, payload).groupBy(*keys, "path").agg(F.sum("value").alias("total"))
