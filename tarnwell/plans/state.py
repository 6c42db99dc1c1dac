"""State tables: calls, call events, session records, agents, deployments, bindings.

Every job takes the current table and a batch of updates and returns the next table (and the
events it causes). ``now`` is given by the caller, so a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarnwell import schemas
from tarnwell.functions.jsonops import json_merge, json_object, safe_json_object, with_external_id
from tarnwell.functions.phones import call_end_status, is_uuid, phone_if_sip
from tarnwell.operators.ranking import latest_per_key
from tarnwell.operators.skew import bucketed, dealt_evenly, same_keys
from tarnwell.session import materialise
from tarnwell.sources.store import Affected, Change, Store, TableSpec

CALL_FIELDS = [
    "caller", "channel", "status", "ended_reason", "details_url", "ended_at", "called_at",
    "recording_url", "interaction_id", "voice_virtual_agent_id",
]
# Workflow states.
BUSY_STATES = ["pending", "applying", "deleting", "reconciling"]
ACTIVE_STATES = ["applying", "applied", "deployed", "deleting", "reconciling"]
DEPLOYED_STATES = ["applied", "deployed", "ready"]


def resolve_calls(wanted: DataFrame, calls: DataFrame, identifier: str = "call_ref") -> DataFrame:
    """Internal id of every call reference; null when nothing matches.

    A reference is a UUID id, an interaction id or an outside id kept in the call data.
    Three equi-joins are stacked: one OR condition would compare every pair.
    """
    refs = wanted.select(identifier).distinct()
    known = calls.select("id", "created_at", "interaction_id", F.get_json_object("call_data", "$.external_call_id").alias("external_id"))
    by_id = refs.where(is_uuid(identifier)).join(known, F.col(identifier) == F.col("id"))
    by_interaction = refs.join(known.where(F.coalesce("interaction_id", F.lit("")) != ""), F.col(identifier) == F.col("interaction_id"))
    by_external = refs.join(known.where(F.coalesce("external_id", F.lit("")) != ""), F.col(identifier) == F.col("external_id"))
    found = by_id.unionByName(by_interaction).unionByName(by_external)
    newest = latest_per_key(found, [identifier], [F.desc("created_at"), F.desc("id")])
    return refs.join(newest.select(identifier, F.col("id").alias("resolved_id")), identifier, "left")


def fold_json(updates: DataFrame, keys: Sequence[str], order: str, field: str) -> DataFrame:
    """(keys, field): the JSON objects of a key merged in order, later values win.

    A shallow merge is a last value per (key, JSON name), so it is an aggregate over the
    exploded entries: a key with very many updates is combined before the shuffle.
    """
    entries = updates.select(*keys, order, F.explode(F.map_entries(safe_json_object(field))).alias("_e"))
    last = entries.groupBy(*keys, F.col("_e.key").alias("_name")).agg(
        F.max_by(F.coalesce(F.to_json("_e.value"), F.lit("null")), F.col(order)).alias("_value")
    )
    pairs = F.array_sort(F.collect_list(F.struct("_name", "_value")))
    rebuilt = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["_name"], F.try_parse_json(p["_value"]))))
    return last.groupBy(*keys).agg(F.to_json(rebuilt).alias(field))


def fold_updates(updates: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], json_field: str | None = None) -> DataFrame:
    """One row per key: the last non-null value of every field, JSON payloads merged in order."""
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    folded = updates.groupBy(*keys).agg(*last)
    if json_field is None:
        return folded
    return folded.join(fold_json(updates, keys, order, json_field), list(keys), "left")


def upsert_calls(calls: DataFrame, updates: DataFrame, now: Column, order: str = "arrived") -> DataFrame:
    """Next calls table: known calls take the non-null fields, unknown ones are inserted.

    ``updates``: call_ref, ``order`` and any of the call fields and call_data.
    """
    shaped = updates.select(
        "call_ref", order,
        *[(F.col(f) if f in updates.columns else F.lit(None).cast(calls.schema[f].dataType)).alias(f) for f in CALL_FIELDS],
        with_external_id("call_ref", "call_data").alias("call_data"),
    )
    resolved = shaped.join(resolve_calls(shaped, calls), "call_ref")
    # References of one unknown call are one insert; references of one known call one update. An unknown call has two
    # references when one update gives its id and names the other reference as interaction or external id.
    named = resolved.where(F.col("resolved_id").isNull() & is_uuid("call_ref"))
    other = F.explode(F.array(F.col("interaction_id"), F.get_json_object("call_data", "$.external_call_id"))).alias("_other")
    aliases = named.select("call_ref", other).where(F.col("_other").isNotNull()).groupBy("_other").agg(F.min("call_ref").alias("_id"))
    told = resolved.join(aliases, F.col("call_ref") == F.col("_other"), "left")
    keyed = told.withColumn("_key", F.coalesce("resolved_id", "_id", "call_ref")).drop("_other", "_id")
    folded = fold_updates(keyed, ["_key"], order, [*CALL_FIELDS, "resolved_id"], "call_data")
    new = folded.select("_key", "resolved_id", F.col("_key").alias("call_ref"), *[F.col(f).alias(f"_n_{f}") for f in [*CALL_FIELDS, "call_data"]])

    known = new.where(F.col("resolved_id").isNotNull()).drop("call_ref", "_key")
    updated = calls.join(known, F.col("id") == F.col("resolved_id"), "left")
    touched = F.col("resolved_id").isNotNull()
    kept = updated.select(
        "id", "created_at", F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
        *[F.coalesce(f"_n_{f}", f).alias(f) for f in CALL_FIELDS],
        json_merge("call_data", "_n_call_data").alias("call_data"),
    )
    inserted = new.where(F.col("resolved_id").isNull()).select(
        F.when(is_uuid("call_ref"), F.col("call_ref")).otherwise(F.md5(F.col("call_ref").cast("binary"))).alias("id"),
        now.alias("created_at"), now.alias("updated_at"),
        *[
            (F.coalesce(f"_n_{f}", F.when(~is_uuid("call_ref"), F.col("call_ref"))) if f == "interaction_id" else F.col(f"_n_{f}")).alias(f)
            for f in CALL_FIELDS
        ],
        F.col("_n_call_data").alias("call_data"),
    )
    return kept.unionByName(inserted)


#: Calls, and every reference by which a call may be named; a reference may name several calls.
CALL_TABLES = {
    "calls": TableSpec(schemas.CALLS, ("id",)),
    "call_refs": TableSpec(schemas.schema_of("ref string, id string"), ("ref", "id"), dealt_by=("ref",)),
}


def call_references(calls: DataFrame) -> DataFrame:
    """(ref, id): the id, the interaction id and the outside id of every call."""
    refs = F.array("id", "interaction_id", F.get_json_object("call_data", "$.external_call_id"))
    return calls.select(F.explode(refs).alias("ref"), "id").where(F.coalesce("ref", F.lit("")) != "").distinct()


def commit_call_updates(store: Store, updates: DataFrame, now: Column, order: str = "arrived", note: str | None = None) -> dict[str, Affected]:
    """``upsert_calls`` on a store of ``CALL_TABLES``: the calls that the updates name are found by their references, and only they are written."""
    before = store.snapshot()
    updates = materialise(updates, "call-updates")
    named = [F.col("call_ref")] + [F.col(c) for c in ("interaction_id",) if c in updates.columns] + [F.get_json_object(with_external_id("call_ref", "call_data"), "$.external_call_id")]
    wanted = updates.select(F.explode(F.array(*named)).alias("ref")).where(F.coalesce("ref", F.lit("")) != "")
    ids = before.rows_of("call_refs", wanted).select("id").distinct()
    nxt = materialise(upsert_calls(before.rows_of("calls", ids), updates, now, order), "next-calls")
    return store.commit({"calls": Change(nxt), "call_refs": Change(call_references(nxt))}, before, note)


def patch_calls(calls: DataFrame, patches: DataFrame, now: Column, order: str = "arrived") -> tuple[DataFrame, DataFrame]:
    """(next calls, rejects): like an upsert, but unknown calls and empty patches are rejected."""
    fields = [f for f in CALL_FIELDS if f in patches.columns]
    empty = F.coalesce(*[F.col(f).cast("string") for f in fields], with_external_id("call_ref", "call_data")).isNull()
    resolved = patches.join(resolve_calls(patches, calls), "call_ref")
    reason = F.when(empty, "empty").when(F.col("resolved_id").isNull(), "unknown call")
    judged = resolved.withColumn("reject_reason", reason)
    rejects = judged.where(F.col("reject_reason").isNotNull()).select("call_ref", order, "reject_reason")
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason", "resolved_id")
    return upsert_calls(calls, good, now, order), rejects


def next_sequence(
    events: DataFrame, existing: DataFrame, call: str = "call_id", ts: str = "created_at", event_id: str = "event_id", buckets: int | None = None
) -> DataFrame:
    """Number new events in their order: a given number stays, a missing one is the call's largest so far plus one.

    With c missing numbers up to a row, the largest number is c plus the maximum of the stored one and of
    (given number - missing numbers before it). Both are folded inside buckets of a call; a bucket takes over from the earlier
    ones how many were missing, o, and the maximum of their (largest given - missing) less their own o.
    """
    base = existing.groupBy(F.col(call).alias("_call")).agg(F.max("sequence_number").cast("long").alias("_base"))
    rows, several = bucketed(events, F.unix_micros(F.col(ts).cast("timestamp")).cast("double"), buckets)
    given = F.col("sequence_number").cast("long")
    span = W.partitionBy(call, "_bucket").orderBy(F.col(ts), F.col(event_id)).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_missing", F.sum(given.isNull().cast("long")).over(span)).withColumn("_raised", F.max(given - F.col("_missing")).over(span))
    if several:
        totals = rows.groupBy(call, "_bucket").agg(F.max("_missing").alias("_m"), F.max("_raised").alias("_r"))
        before = W.partitionBy(call).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
        named, same = same_keys([call])
        shifted = totals.withColumn("_o", F.coalesce(F.sum("_m").over(before), F.lit(0))).withColumn("_x", F.max(F.col("_r") - F.col("_o")).over(before))
        rows = rows.join(shifted.select(*named, "_o", "_x"), same)
    else:
        rows = rows.withColumn("_o", F.lit(0).cast("long")).withColumn("_x", F.lit(None).cast("long"))
    told = rows.join(base, rows[call].eqNullSafe(F.col("_call")), "left")
    raised = F.greatest(F.coalesce("_base", F.lit(0)), F.col("_x"), F.col("_raised") - F.col("_o"))
    number = F.coalesce(given, raised + F.col("_o") + F.col("_missing"))
    return told.withColumn("sequence_number", number).select(*events.columns)


def append_call_events(events: DataFrame, calls: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered events with the internal call id, rejects of unknown calls)."""
    resolved = events.join(resolve_calls(events, calls), "call_ref")
    good = resolved.where(F.col("resolved_id").isNotNull()).withColumnRenamed("resolved_id", "call_id")
    return next_sequence(good, existing), resolved.where(F.col("resolved_id").isNull()).drop("resolved_id")


def replace_rows(
    current: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column], counts: Sequence[str] = (), stored_too: bool = False
) -> DataFrame:
    """Last update per key replaces the row, nulls included; missing counts become 0.

    ``stored_too``: the table holds the order columns, and a stored row that comes later than the update stays.
    """
    fresh = latest_per_key(updates, keys, order).select(*current.columns)
    fresh = fresh.na.fill(0, list(counts)) if counts else fresh
    if stored_too:
        return latest_per_key(current.unionByName(fresh), keys, order)
    return current.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def upsert_agents(agents: DataFrame, updates: DataFrame, order: Sequence[Column], now: Column) -> DataFrame:
    """Next agents table: an agent is named by its phone number; a known one takes config, name and type and keeps all else.

    Id and creation time of a known agent stay. A new one gets an id from its number and the time given. Of several updates for a
    number the first in ``order`` counts; updates without a number are left out.
    """
    taken = ["config", "name", "agent_type"]
    fresh = latest_per_key(updates.where(F.col("phone_number").isNotNull()), ["phone_number"], order)
    fresh = fresh.select(F.col("phone_number").alias("_phone"), *[F.col(c).alias(f"_n_{c}") for c in taken])
    joined = agents.join(fresh, F.col("phone_number") == F.col("_phone"), "full_outer")
    hit = F.col("_phone").isNotNull()
    values = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in taken}
    values |= {
        "phone_number": F.coalesce("phone_number", "_phone"), "id": F.coalesce("id", F.md5(F.col("_phone").cast("binary"))),
        "created_at": F.when(F.col("id").isNull() & hit, now).otherwise(F.col("created_at")),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in agents.columns])


def upsert_keep_created(current: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[Column], now: Column) -> DataFrame:
    """Insert or replace per key; the creation time of a replaced row is kept."""
    fresh = latest_per_key(updates, keys, order).drop("created_at", "updated_at")
    old = current.select(*keys, F.col("created_at").alias("_created"))
    stamped = (
        fresh.join(old, list(keys), "left")
        .withColumn("created_at", F.coalesce("_created", now)).withColumn("updated_at", now).drop("_created")
    )
    return current.join(fresh.select(*keys), list(keys), "left_anti").unionByName(stamped.select(*current.columns))


def call_start(sessions: DataFrame, now: Column) -> DataFrame:
    """Start row of a session: started, caller only for telephone sessions."""
    phone = phone_if_sip("channel", "phone_number")
    return sessions.where(F.coalesce("call_id", F.lit("")) != "").select(
        F.col("call_id").alias("call_ref"), phone.alias("caller"), "channel", F.lit("started").alias("status"), now.alias("called_at"),
        json_object(room_name="room_name", channel="channel", session_type="session_type", phone_number=phone, agent_name="agent_name").alias("call_data"),
    )


def call_end(sessions: DataFrame, now: Column) -> DataFrame:
    phone = phone_if_sip("channel", "phone_number")
    return sessions.where(F.coalesce("call_id", F.lit("")) != "").select(
        F.col("call_id").alias("call_ref"), phone.alias("caller"), "channel",
        call_end_status("disconnect_reason").alias("status"), F.col("disconnect_reason").alias("ended_reason"), now.alias("ended_at"),
        json_object(channel="channel", phone_number=phone).alias("call_data"),
    )


def runtime_status(found: Column, running: Column, ready: Column, desired: Column) -> Column:
    return (
        F.when(~found, "not_found").when(ready >= F.greatest(F.lit(1), desired), "ready")
        .when(running > 0, "progressing").otherwise("unknown")
    )


def health_status(runtime: Column) -> Column:
    return F.when(runtime == "ready", "healthy").when(runtime.isin("progressing", "unknown"), "unknown").otherwise("unhealthy")


def workflow_status(runtime: Column) -> Column:
    return F.when(runtime == "ready", "ready").when(runtime == "not_found", "deleted").otherwise("reconciling")


def lifecycle_times(workflow: Column, runtime: Column, error: Column, now: Column) -> dict[str, Column]:
    """Next lifecycle times from the old ones: deployment first wins, the others last win."""
    return {
        "deployed_at": F.coalesce(F.col("deployed_at"), F.when(workflow.isin(DEPLOYED_STATES), now)),
        "ready_at": F.when(runtime == "ready", now).otherwise(F.col("ready_at")),
        "deleted_at": F.when(workflow == "deleted", now).otherwise(F.col("deleted_at")),
        "last_error_at": F.when(error.isNotNull(), now).otherwise(F.col("last_error_at")),
    }


DEPLOYMENT_KEY = ["agent_name", "namespace", "deployment_name"]


def newest_first() -> list[Column]:
    return [F.desc("updated_at"), F.desc("created_at"), F.desc("id")]


def claimable(deployments: DataFrame) -> DataFrame:
    return deployments.where(F.col("workflow_status") == "pending").orderBy("updated_at", "created_at", "id")


def reconcilable(deployments: DataFrame) -> DataFrame:
    return deployments.where(F.col("workflow_status").isin(ACTIVE_STATES)).orderBy("updated_at", "created_at", "id")


def claim_fifo(deployments: DataFrame, keys: Sequence[str], worker: Column, now: Column) -> DataFrame:
    """Oldest pending request per key, claimed by a worker."""
    pending = deployments.where(F.col("workflow_status") == "pending")
    first = latest_per_key(pending, keys, [F.asc("updated_at"), F.asc("created_at"), F.asc("id")])
    claim = F.when(F.col("desired_state") == "deleted", "deleting").otherwise("applying")
    details = json_merge(F.coalesce("status_details", F.lit("{}")), F.to_json(F.struct(worker.alias("worker_id"))))
    return (
        first.withColumn("workflow_status", claim).withColumn("status_details", details)
        .withColumn("status_reason", F.lit("claimed")).withColumn("updated_at", now)
    )


def state_event(rows: DataFrame, parent: str, event_type: Column, message: Column, payload: Column) -> DataFrame:
    """Append-only event rows next to a state change."""
    runtime = F.col("runtime_status") if "runtime_status" in rows.columns else F.lit(None).cast("string")
    health = F.col("health_status") if "health_status" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("id").alias(parent), event_type.alias("event_type"), "workflow_status",
        runtime.alias("runtime_status"), health.alias("health_status"), message.alias("message"), payload.alias("payload"),
    )


def _judge_requests(told: DataFrame, order: str, buckets: int | None) -> DataFrame:
    """Event type of every request, its turn, and whether it or one before it changed its key (``_changed``).

    A key is a machine whose state is the desired state under way: after a request it is that of the request. The requests of a
    bucket are one function of the state that they meet: the first is a duplicate of it or not, the others and the state left
    behind are fixed. These functions are composed along the buckets of a key, and each bucket is told the state that it meets.
    """
    rows, several = bucketed(told, F.col(order).cast("double"), buckets)
    if several:
        n = told.count()
        rows = dealt_evenly(rows, DEPLOYMENT_KEY, n)
    turn = W.partitionBy(*DEPLOYMENT_KEY, "_bucket").orderBy(F.col(order), F.col("desired_state"), F.col("requested_by"))
    rows = rows.withColumn("_place", F.row_number().over(turn)).withColumn("_lag", F.lag("desired_state").over(turn))
    inner = (F.col("_place") > 1) & ~(F.col("_lag").isNotNull() & (F.col("_lag").eqNullSafe(F.col("desired_state"))))
    rows = rows.withColumn("_inner", F.max(inner.cast("int")).over(turn.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # After the first request of a key the row holds its state, pending, whether it was enqueued or a duplicate.
    stored = F.when(F.col("_workflow").isin(BUSY_STATES), F.col("_desired"))
    if several:
        steps = rows.groupBy(*DEPLOYMENT_KEY, "_bucket").agg(
            F.min_by(F.struct("desired_state"), "_place").alias("_first"), F.max_by(F.struct("desired_state"), "_place").alias("_last"), F.max("_inner").alias("_i"),
            F.count(F.lit(1)).alias("_n"), F.max(F.struct(stored.alias("s"))).alias("_stored"),
        )
        along = W.partitionBy(*DEPLOYMENT_KEY).orderBy("_bucket")
        earlier = along.rowsBetween(W.unboundedPreceding, -1)
        met = F.when(F.row_number().over(along) == 1, F.col("_stored.s")).otherwise(F.lag("_last").over(along)["desired_state"])
        steps = steps.withColumn("_met", met)
        moved = F.greatest(F.coalesce("_i", F.lit(0)), (~_under_way("_met", "_first.desired_state")).cast("int"))
        named, same = same_keys(DEPLOYMENT_KEY)
        steps = steps.withColumn("_moved", moved).select(
            *named, "_met", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_turns"), F.coalesce(F.max("_moved").over(earlier), F.lit(0)).alias("_before")
        )
        rows = dealt_evenly(rows.join(steps, same), DEPLOYMENT_KEY, n)
    else:
        rows = rows.withColumn("_met", stored).withColumn("_turns", F.lit(0)).withColumn("_before", F.lit(0))
    under_way = F.when(F.col("_place") == 1, F.col("_met")).otherwise(F.col("_lag"))
    first = W.partitionBy(*DEPLOYMENT_KEY, "_bucket").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_same", _under_way(under_way, "desired_state"))
    opened = F.max(F.when(F.col("_place") == 1, (~F.col("_same")).cast("int")).otherwise(0)).over(first)
    return rows.select(
        *told.columns, F.when(F.col("_same"), "request_deduplicated").otherwise("request_enqueued").alias("event_type"),
        (F.greatest(opened, "_inner", "_before") == 1).alias("_changed"), (F.col("_turns") + F.col("_place")).alias("_turn"),
    )


def _under_way(state: Column | str, desired: str) -> Column:
    state = F.col(state) if isinstance(state, str) else state
    return F.coalesce(state.eqNullSafe(F.col(desired)) & state.isNotNull(), F.lit(False))


def enqueue_requests(
    deployments: DataFrame, requests: DataFrame, now: Column, order: str = "arrived", buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(next deployments, events) of a batch of desired-state requests.

    Requests of a key follow each other by ``order``. One for the state that is already under way, by the stored row
    or by the request before it, is a duplicate and only leaves an event; every other one resets the latest row of
    its key to pending, or inserts it. What the last of them sets is what stays.
    """
    latest = latest_per_key(deployments, DEPLOYMENT_KEY, newest_first()).select(
        *DEPLOYMENT_KEY, F.col("id").alias("_id"), F.col("desired_state").alias("_desired"), F.col("workflow_status").alias("_workflow"),
        F.col("runtime_status").alias("_runtime"), F.col("health_status").alias("_health"),
    )
    told = requests.join(latest, DEPLOYMENT_KEY, "left")
    judged = _judge_requests(told, order, buckets).withColumn(
        "deployment_id", F.coalesce("_id", F.md5(F.concat_ws("/", *DEPLOYMENT_KEY).cast("binary")))
    )
    payload = F.when(
        F.col("event_type") == "request_enqueued", F.to_json(F.struct("requested_by", "desired_state"))
    ).otherwise(F.to_json(F.struct("requested_by")))
    message = F.when(
        F.col("event_type") == "request_enqueued",
        F.concat(F.col("desired_state"), F.lit(" request enqueued for "), F.col("agent_name"), F.lit(".")),
    ).otherwise(F.concat(F.lit("Duplicate "), F.col("desired_state"), F.lit(" request deduplicated.")))
    # A request that changed its row, or follows one that did, finds it pending, with runtime and health not known yet.
    told_events = judged.withColumn("workflow_status", F.when(F.col("_changed"), "pending").otherwise(F.coalesce("_workflow", F.lit("pending"))))
    for c in ("runtime", "health"):
        told_events = told_events.withColumn(f"{c}_status", F.when(F.col("_changed"), "unknown").otherwise(F.col(f"_{c}")))
    events = state_event(told_events.withColumn("id", F.col("deployment_id")), "deployment_id", F.col("event_type"), message, payload)
    enqueued = judged.where(F.col("event_type") == "request_enqueued").withColumn("_payload", payload)
    # The last one sets the row; a requester that it leaves out is the one before it.
    by = enqueued.groupBy(*DEPLOYMENT_KEY).agg(F.max_by("requested_by", F.when(F.col("requested_by").isNotNull(), F.col("_turn"))).alias("_by"))
    accepted = latest_per_key(enqueued, DEPLOYMENT_KEY, [F.desc("_turn")]).join(by, DEPLOYMENT_KEY).withColumn("requested_by", F.col("_by"))
    change = accepted.select(
        F.col("deployment_id").alias("_rid"), F.col("desired_state").alias("_r_desired"), F.col("requested_by").alias("_r_by"),
        F.col("image").alias("_r_image"), F.col("_payload"),
    )
    hit = F.col("_rid").isNotNull()
    kept = deployments.join(change, F.col("id") == F.col("_rid"), "left")
    reset = {
        "updated_at": now, "desired_state": F.col("_r_desired"), "workflow_status": F.lit("pending"), "runtime_status": F.lit("unknown"),
        "health_status": F.lit("unknown"), "requested_by": F.coalesce("_r_by", "requested_by"), "image": F.col("_r_image"),
        "last_error": F.lit(None).cast("string"), "status_reason": F.lit("request_enqueued"), "status_details": F.col("_payload"),
    }
    kept = kept.select(*[F.when(hit, reset[c]).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in deployments.columns])
    fresh = accepted.where(F.col("_id").isNull())
    given = {
        **{c: F.col(c) for c in (*DEPLOYMENT_KEY, "desired_state", "requested_by", "image")},
        "id": F.col("deployment_id"), "created_at": now, "updated_at": now, "workflow_status": F.lit("pending"),
        "runtime_status": F.lit("unknown"), "health_status": F.lit("unknown"), "status_reason": F.lit("request_enqueued"),
        "status_details": F.col("_payload"), "desired_replicas": F.lit(1), "ready_replicas": F.lit(0),
        "available_replicas": F.lit(0), "restart_count": F.lit(0),
    }
    inserted = fresh.select(
        *[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in deployments.schema.fields]
    )
    return kept.unionByName(inserted), events


def save_deployment_status(deployments: DataFrame, updates: DataFrame, now: Column, order: str = "arrived") -> tuple[DataFrame, DataFrame]:
    """(next deployments, events): the latest row per key takes the last status of the batch."""
    last = latest_per_key(updates, DEPLOYMENT_KEY, [F.desc(order)])
    ids = latest_per_key(deployments, DEPLOYMENT_KEY, [F.desc("created_at"), F.desc("id")]).select(*DEPLOYMENT_KEY, F.col("id").alias("_id"))
    told = last.join(ids, DEPLOYMENT_KEY, "left").withColumn(
        "_target", F.coalesce("_id", F.md5(F.concat_ws("/", *DEPLOYMENT_KEY).cast("binary")))
    )
    given = [c for c in updates.columns if c in deployments.columns and c not in (*DEPLOYMENT_KEY, "id", "created_at", "updated_at")]
    change = told.select("_target", F.col("_id"), *[F.col(k).alias(f"_k_{k}") for k in DEPLOYMENT_KEY], *[F.col(c).alias(f"_n_{c}") for c in given])
    joined = deployments.join(change, F.col("id") == F.col("_target"), "full_outer")
    hit = F.col("_target").isNotNull()
    times = lifecycle_times(F.col("_n_workflow_status"), F.col("_n_runtime_status"), F.col("_n_last_error"), now)
    values = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in given}
    values |= {c: F.when(hit, v).otherwise(F.col(c)) for c, v in times.items()}
    values |= {k: F.coalesce(F.col(k), F.col(f"_k_{k}")) for k in DEPLOYMENT_KEY}
    values |= {
        "id": F.coalesce("id", "_target"), "created_at": F.coalesce("created_at", now),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    nxt = joined.select(*[values.get(c, F.col(c)).alias(c) for c in deployments.columns])
    events = told.where(F.col("event_type").isNotNull()).select(
        F.col("_target").alias("deployment_id"), "event_type", "workflow_status", "runtime_status", "health_status",
        F.col("event_message").alias("message"), F.coalesce("status_details", F.lit("{}")).alias("payload"),
    )
    return nxt, events


def save_binding_status(bindings: DataFrame, updates: DataFrame, now: Column, order: str = "arrived") -> tuple[DataFrame, DataFrame]:
    """(next bindings, events): the newest binding of the agent or of the number is updated."""
    last = latest_per_key(updates, ["agent_name"], [F.desc(order)])
    known = bindings.select("id", "updated_at", "created_at", F.col("agent_name").alias("_agent"), F.col("phone_number").alias("_phone"))
    by_agent = last.select("agent_name").join(known, F.col("agent_name") == F.col("_agent"))
    by_phone = last.select("agent_name", "phone_number").join(known, F.col("phone_number") == F.col("_phone")).drop("phone_number")
    found = latest_per_key(by_agent.unionByName(by_phone), ["agent_name"], newest_first()).select("agent_name", F.col("id").alias("_id"))
    told = last.join(found, "agent_name", "left").withColumn("_target", F.coalesce("_id", F.md5(F.col("agent_name").cast("binary"))))
    # Two agents of one batch can meet on one binding: the later update wins.
    told = latest_per_key(told, ["_target"], [F.desc(order)])
    given = [c for c in updates.columns if c in bindings.columns and c not in ("id", "created_at", "updated_at", "agent_name")]
    change = told.select("_target", F.col("agent_name").alias("_k_agent"), *[F.col(c).alias(f"_n_{c}") for c in given])
    joined = bindings.join(change, F.col("id") == F.col("_target"), "full_outer")
    hit, fresh = F.col("_target").isNotNull(), F.col("id").isNull()
    values = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in given}
    values |= {
        "id": F.coalesce("id", "_target"), "agent_name": F.coalesce("agent_name", "_k_agent"),
        "created_at": F.coalesce("created_at", now), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        "is_active": F.when(hit, fresh | (F.col("_n_desired_state") != "deleted")).otherwise(F.col("is_active")),
        "provisioned_at": F.coalesce(F.col("provisioned_at"), F.when(F.col("_n_workflow_status") == "provisioned", now)),
        "last_error_at": F.when(F.col("_n_last_error").isNotNull(), now).otherwise(F.col("last_error_at")),
    }
    nxt = joined.select(*[values.get(c, F.col(c)).alias(c) for c in bindings.columns])
    events = told.where(F.col("event_type").isNotNull()).select(
        F.col("_target").alias("sip_binding_id"), "event_type", "workflow_status", "health_status",
        F.col("event_message").alias("message"), F.coalesce("status_details", F.lit("{}")).alias("payload"),
    )
    return nxt, events
