"""Stateful stream operators whose state ends: numbered turns, sessions, and a request queue with leases.

Each keeps a bounded record per key and sets a timer that clears or closes it, so what a stream holds follows the keys that are
alive, not all keys ever seen. Rows of a key are taken in a fixed order inside a micro-batch, so a replay gives the same output.
Sessions and queues have few rows a key, so what a key costs decides: they work on rows, not on a pandas frame a key, and
ask the state store for as little as they can.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnwell.functions.jsonops import content_to_text
from tarnwell.operators.sessions import LATENCY_METRICS, token_usage
from tarnwell.schemas import schema_of

DAY_MS = 24 * 3600 * 1000


def _frame(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


def _due(handle: StatefulProcessorHandle, at: int) -> None:
    """The only timer of the key is at ``at``."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


def _moved(handle: StatefulProcessorHandle, record: dict | None, at: int | None) -> None:
    """As ``_due`` (no timer if ``at`` is None) for a key whose ``record`` says where its timer is: the store is not asked for it."""
    old = record.get("due") if record else None
    if old == at:
        return
    if old is not None:
        handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


def _in_order(rows: Iterator[Row], *order: str) -> list[Row]:
    """The rows of a key by the columns ``order``, nulls last."""
    return sorted(rows, key=lambda r: [(r[c] is None, r[c] or 0) for c in order])


# --- numbered turns --------------------------------------------------------------------------

TURNS_OUT = schema_of("call_id string, sequence_number long, event_type string, speaker string, content_text string, item_id string")


class _TimedNumbering(StatefulProcessor):
    """Running number of the turns of a call. What was seen is forgotten ``seen_ms`` after its time, the number ``numbers_ms`` after the last turn."""

    def __init__(self, seen_ms: int, numbers_ms: int):
        self._seen_ms, self._numbers_ms = seen_ms, numbers_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", schema_of("n long, at long"))
        self._seen = handle.getMapState("seen", schema_of("item_id string"), schema_of("at long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _frame(rows, ["turn", "item_id"])
        n, at = self._last.get() if self._last.exists() else (0, 0)
        kept, numbers = [], []
        for item, ms in zip(batch["item_id"], batch["ms"], strict=True):
            fresh = not self._seen.containsKey((item,))
            kept.append(fresh)
            if fresh:
                n, at = n + 1, max(at, int(ms))
                numbers.append(n)
                self._seen.updateValue((item,), (int(ms),))
        self._last.update((n, at))
        self._next_timer(at)
        out = batch[kept].assign(sequence_number=numbers, event_type="message")
        yield out[TURNS_OUT.names]

    def _next_timer(self, at: int) -> None:
        times = [int(v[0]) for v in self._seen.values()]
        _due(self._handle, min(times) + self._seen_ms if times else at + self._numbers_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for (item,), (ms,) in list(self._seen.iterator()):
            if ms + self._seen_ms <= now:
                self._seen.removeKey((item,))
        if self._last.exists():
            at = int(self._last.get()[1])
            if self._seen.exists() or at + self._numbers_ms > now:
                self._next_timer(at)
            else:
                self._last.clear()
        yield pd.DataFrame({f.name: pd.Series([], dtype="int64" if f.name == "sequence_number" else "object") for f in TURNS_OUT})

    def close(self) -> None:
        pass


def timed_transcript_stream(items: DataFrame, lateness: str = "1 hour", seen_ms: int = DAY_MS, numbers_ms: int = 30 * DAY_MS) -> DataFrame:
    """Sequenced message events of user and assistant turns, with state that ends by event time.

    ``items``: call_id, item_id, turn, role, content, ts. A turn later than the watermark is dropped. A repeat of a turn is dropped
    as long as it is remembered, ``seen_ms`` after its time; numbers go on for ``numbers_ms`` after the last turn of
    a call and then start anew.
    """
    timed = items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    turns = timed.where(F.col("role").isin("user", "assistant")).select(
        F.col("call_id").cast("string"), F.col("item_id").cast("string"), F.col("turn").cast("long"), F.col("role").alias("speaker"),
        content_to_text("content").alias("content_text"), "ts", F.unix_millis("ts").alias("ms"),
    )
    return turns.groupBy("call_id").transformWithStateInPandas(
        statefulProcessor=_TimedNumbering(seen_ms, numbers_ms), outputStructType=TURNS_OUT, outputMode="Append", timeMode="EventTime"
    )


# --- sessions ----------------------------------------------------------------------------------

_FIGURES = [f"{m}_{k}" for m in LATENCY_METRICS for k in ("count", "avg", "max", "min")]
# The figures are one array in the order of _FIGURES: a key gives a batch of its own, and that costs by the columns.
_SESSION = schema_of(
    "call_id string, session_id long, status string, end_reason string, version long, started_us long, ended_us long, "
    "user_turn_count long, assistant_turn_count long, usage_update_count long, usage string"
).add("figures", T.ArrayType(T.DoubleType()))
_SESSION_ROW = Row(*_SESSION.names)


class _Sessions(StatefulProcessor):
    """One open session per call, as JSON: counts, sums of the latencies, the last usage record."""

    def __init__(self, gap_us: int):
        self._gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", schema_of("session string"))

    @staticmethod
    def _new(us: int) -> dict:
        return {"id": us, "start": us, "last": us, "user": 0, "assistant": 0, "usage_n": 0, "usage": None, "usage_at": None, "version": 0, "figures": {}, "due": None}

    @staticmethod
    def _add(s: dict, row) -> None:
        s["start"], s["last"], s["version"] = min(s["start"], row.us), max(s["last"], row.us), s["version"] + 1
        if row.role in ("user", "assistant"):
            s[row.role] += 1
        if isinstance(row.usage, str):
            s["usage_n"] += 1
            at = [row.us, math.nan if row.seq is None else row.seq]
            if s["usage_at"] is None or at >= s["usage_at"]:
                s["usage"], s["usage_at"] = row.usage, at
        for name, value in (json.loads(row.metrics) if isinstance(row.metrics, str) else {}).items():
            n, total, top, low = s["figures"].get(name, (0, 0.0, value, value))
            s["figures"][name] = (n + 1, total + value, max(top, value), min(low, value))

    @staticmethod
    def _row(key, s: dict, status: str, reason: str | None) -> Row:
        figures = []
        for m in LATENCY_METRICS:
            n, total, top, low = s["figures"].get(m, (0, 0.0, None, None))
            mean = total / n if n else None
            figures += [float(n), None if mean is None or math.isnan(mean) else mean, top, low]
        return _SESSION_ROW(key[0], s["id"], status, reason, s["version"], s["start"], s["last"], s["user"], s["assistant"], s["usage_n"], s["usage"], figures)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._open.get()
        s = was = json.loads(held[0]) if held else None
        done = []
        for row in _in_order(rows, "us", "seq"):
            if s is not None and row.us >= s["last"] + self._gap:
                done.append(self._row(key, s, "ended", "gap"))
                s = None
            if s is not None and row.us + self._gap <= s["start"]:  # older than the open session by more than a gap
                alone = self._new(row.us)
                self._add(alone, row)
                done.append(self._row(key, alone, "ended", "gap"))
                continue
            s = s or self._new(row.us)
            self._add(s, row)
            if row.role == "end":
                done.append(self._row(key, s, "ended", "event"))
                s = None
        due = None if s is None else (s["last"] + self._gap) // 1000
        _moved(self._handle, was, due)
        if s is not None:
            done.append(self._row(key, s, "open", None))
            self._open.update((json.dumps(s | {"due": due}),))
        elif was is not None:
            self._open.clear()
        return iter(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._open.get()
        if held:
            self._open.clear()
            yield self._row(key, json.loads(held[0]), "ended", "gap")

    def close(self) -> None:
        pass


def session_stream(items: DataFrame, gap_seconds: int = 1800, lateness: str = "1 hour") -> DataFrame:
    """Every change of a session: open sessions as they stand after a micro-batch, and ended ones once with the reason.

    ``items``: call_id, ts, seq, role, metrics (map of text or numbers), usage (JSON text or null). A session ends with an item of the
    role ``end``, with an item at least the gap after its last one, or when the watermark is the gap past its last item;
    then its state is cleared. Items later than the watermark are dropped. Of the rows of a (call_id, session_id) the one with the largest
    ``version`` counts, an ended one before an open one: see ``last_state``.
    """
    timed = items.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    wanted = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(m) for m in LATENCY_METRICS]), F.array(*[F.try_element_at("metrics", F.lit(m)).try_cast("double") for m in LATENCY_METRICS])
        ),
        lambda k, v: v.isNotNull() & ~F.isnan(v),
    )
    rows = timed.select(
        F.col("call_id").cast("string").alias("call_id"), "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "role",
        F.to_json(F.coalesce(wanted, F.create_map().cast("map<string,double>"))).alias("metrics"), F.col("usage").cast("string").alias("usage"),
    )
    out = rows.groupBy("call_id").transformWithState(
        statefulProcessor=_Sessions(gap_seconds * 1_000_000), outputStructType=_SESSION, outputMode="Append", timeMode="EventTime"
    )
    figures = [F.get("figures", F.lit(i)).cast("long" if f.endswith("_count") else "double").alias(f) for i, f in enumerate(_FIGURES)]
    return out.select(
        "call_id", "session_id", "status", "end_reason", "version", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("ended_us").alias("ended_at"),
        "user_turn_count", "assistant_turn_count", "usage_update_count", "usage", *figures,
        token_usage("usage", "llm").alias("llm_token_count"), token_usage("usage", "tts").alias("tts_token_count"),
    )


def last_state(changes: DataFrame) -> DataFrame:
    """One row per session of what ``session_stream`` has written: open sessions as they stand, ended ones as they ended."""
    rest = [c for c in changes.columns if c not in ("call_id", "session_id")]
    newest = F.max_by(F.struct(*rest), F.struct("version", (F.col("status") == "ended").cast("int")))
    return changes.groupBy("call_id", "session_id").agg(newest.alias("_s")).select("call_id", "session_id", *[f"_s.{c}" for c in rest])


# --- request queue -------------------------------------------------------------------------------

QUEUE_OUT = schema_of("key string, at_ms long, kind string, request_id string, worker string, lease_until_ms long, desired string")
_QUEUE_ROW = Row(*QUEUE_OUT.names)


class _Queue(StatefulProcessor):
    """Requests of a key wait in line; a claim leases the first to a worker until its lease ends or it reports done."""

    def __init__(self, lease_ms: int, keep_ms: int):
        self._lease, self._keep = lease_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("queue", schema_of("queue string"))

    def _load(self) -> dict:
        held = self._state.get()
        return json.loads(held[0]) if held else {"waiting": [], "leased": None, "last": 0, "desired": None, "due": None}

    def _store(self, q: dict) -> None:
        due = q["leased"]["until"] if q["leased"] else q["last"] + self._keep
        _moved(self._handle, q, due)
        self._state.update((json.dumps(q | {"due": due}),))

    @staticmethod
    def _event(key, at: int, kind: str, request: dict | None, worker: str | None = None, until: int | None = None) -> Row:
        r = request or {}
        return _QUEUE_ROW(key[0], at, kind, r.get("id"), worker, until, r.get("desired"))

    def _expire(self, key, q: dict, now: int, out: list[Row]) -> None:
        """A lease that has ended by ``now`` gives its request back to the front of the line."""
        held = q["leased"]
        if held and held["until"] <= now:
            out.append(self._event(key, held["until"], "lease_expired", held["request"], held["worker"]))
            q["waiting"].insert(0, held["request"])
            q["leased"] = None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        q, out = self._load(), []
        for row in _in_order(rows, "ms", "seq"):
            at = int(row.ms)
            self._expire(key, q, at, out)
            q["last"] = max(q["last"], at)
            held = q["leased"]
            if row.kind == "request":
                request = {"id": row.request_id, "desired": row.desired}
                # The state under way is that of the request before it, as long as one waits or is worked on.
                busy = bool(q["waiting"] or held)
                if busy and q["desired"] == row.desired:
                    out.append(self._event(key, at, "request_deduplicated", request))
                else:
                    q["waiting"].append(request)
                    q["desired"] = row.desired
                    out.append(self._event(key, at, "request_enqueued", request))
            elif row.kind == "claim":
                if held is None and q["waiting"]:
                    request = q["waiting"].pop(0)
                    q["leased"] = {"request": request, "worker": row.worker, "until": at + self._lease}
                    out.append(self._event(key, at, "claimed", request, row.worker, at + self._lease))
                else:
                    out.append(self._event(key, at, "nothing_to_claim", None, row.worker))
            elif row.kind in ("renew", "done"):
                if held is None or held["worker"] != row.worker:
                    out.append(self._event(key, at, "lease_lost", held["request"] if held else None, row.worker))
                elif row.kind == "renew":
                    held["until"] = at + self._lease
                    out.append(self._event(key, at, "renewed", held["request"], row.worker, held["until"]))
                else:
                    out.append(self._event(key, at, "done", held["request"], row.worker))
                    q["leased"] = None
        self._store(q)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        q, out, now = self._load(), [], timerValues.getCurrentWatermarkInMs()
        q["due"] = None  # it has just gone off
        self._expire(key, q, now, out)
        if q["leased"] or q["waiting"] or q["last"] + self._keep > now:
            if q["waiting"] and not q["leased"] and q["last"] + self._keep <= now:
                q["last"] = now  # a request that waits is kept, however long
            self._store(q)
        else:
            self._state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def request_queue(events: DataFrame, lease_ms: int = 60_000, lateness: str = "10 minutes", keep_ms: int = DAY_MS) -> DataFrame:
    """What happens to the requests of each key, in order: enqueued, deduplicated, claimed, renewed, done, expired.

    ``events``: key, ts, seq, kind (request, claim, renew, done), request_id, desired, worker. Rows of a key are taken by ``ts`` and
    ``seq``. A request for the state that is under way already is a duplicate. A claim takes the first that waits, unless one is leased;
    a lease that is neither renewed nor done gives its request back to the front of the line, at the next event of the key or when the
    watermark passes its end. A worker whose lease is over has lost it. Events later than the watermark are dropped. A key
    without a waiting or leased request is forgotten ``keep_ms`` after its last event.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rows = timed.select(
        F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("ms"), F.col("seq").cast("long").alias("seq"), "kind",
        *[F.col(c).cast("string").alias(c) for c in ("request_id", "desired", "worker")],
    )
    return rows.groupBy("key").transformWithState(
        statefulProcessor=_Queue(lease_ms, keep_ms), outputStructType=QUEUE_OUT, outputMode="Append", timeMode="EventTime"
    )
