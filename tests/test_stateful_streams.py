"""State that ends, over many micro-batches: numbered turns, sessions, leases."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwell.schemas import schema_of
from tarnwell.streaming import jobs, stateful

HOUR = 3600
BASE = 1_700_000_000  # a stream starts with the watermark at time 0


@pytest.fixture
def run(spark, tmp_path):
    """Write batches of rows as files one after another, run the stream to the end of each, give its output and state sizes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)

    def go(schema, make, batches):
        src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
        sizes = []
        for rows in batches:
            spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("s") + BASE)).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
            query = jobs.event_sink(make(stream), out, progress).trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) if query.lastProgress else None)
        return spark.read.parquet(out), sizes

    return go


TURNS = schema_of("call_id string, item_id string, turn long, role string, content string, s long")


def test_turn_state_ends_and_numbers_go_on(run):
    def make(items):
        return stateful.timed_transcript_stream(items, "1 hour", 2 * HOUR * 1000, 40 * HOUR * 1000)

    first = [("c", "i1", 1, "user", "hi", 0), ("c", "i2", 2, "assistant", "yo", 60), ("c", "x", 3, "system", "no", 60)]
    batches = [first, [("c", "i2", 2, "assistant", "again", 120), ("c", "i3", 3, "user", "more", 180)]]
    batches += [[(f"d{k}", f"j{k}", 1, "user", "t", (5 + 5 * k) * HOUR)] for k in range(8)]  # other calls move the watermark
    batches += [[("c", "late", 9, "user", "late", HOUR), ("c", "i4", 4, "user", "back", 42 * HOUR)], [("e", "k", 1, "user", "t", 200 * HOUR)], [("f", "k", 1, "user", "t", 201 * HOUR)]]
    got, sizes = run(TURNS, make, batches)
    rows = sorted((r.call_id, r.sequence_number, r.item_id) for r in got.collect())
    assert [r for r in rows if r[0] == "c"] == [("c", 1, "i1"), ("c", 2, "i2"), ("c", 3, "i3"), ("c", 4, "i4")]  # the late one is dropped
    assert len([r for r in rows if r[0].startswith("d")]) == 8
    assert sizes[-1] < max(s for s in sizes if s)  # what ended is gone


ITEMS = schema_of("call_id string, seq long, role string, metrics map<string,string>, usage string, s long")


def usage(n):
    return json.dumps({"model_usage": [{"type": "llm", "provider": "p", "model": "m", "input_tokens": 1}, {"type": "llm", "provider": "p", "model": "m", "input_tokens": n}, {"type": "tts", "model": "v", "characters_count": 2 * n}]})


def test_sessions_end_by_event_gap_and_watermark(run):
    def make(items):
        return stateful.session_stream(items, HOUR, "1 hour")

    batches = [
        [("a", 1, "user", {"e2e_latency": "0.5"}, None, 0), ("a", 2, "assistant", {"e2e_latency": "1.5", "other": "9"}, usage(5), 60), ("b", 1, "user", {"e2e_latency": "x"}, None, 30)],
        [("a", 3, "user", {}, usage(7), 600), ("b", 2, "end", None, None, 700)],
        [("a", 4, "user", {}, None, 600 + HOUR), ("c", 1, "user", {}, None, 2 * HOUR)],  # a gap later: another session
        [("d", 1, "user", {}, None, 30 * HOUR)],
        [("d", 2, "user", {}, None, 30 * HOUR + 10), ("a", 9, "user", {}, None, 100)],  # too late: dropped
    ]
    got, _ = run(ITEMS, make, batches)
    last = {(r.call_id, r.session_id): r for r in stateful.last_state(got).collect()}
    a = last["a", BASE * 1_000_000]
    assert (a.status, a.end_reason, a.user_turn_count, a.assistant_turn_count, a.usage_update_count) == ("ended", "gap", 2, 1, 2)
    assert (a.e2e_latency_count, a.e2e_latency_avg, a.e2e_latency_max, a.e2e_latency_min) == (2, 1.0, 1.5, 0.5)
    assert a.llm_token_count["p:m"].input_tokens == 7 and a.tts_token_count["unknown:v"].characters_count == 14
    b = last["b", (BASE + 30) * 1_000_000]
    assert (b.status, b.end_reason, b.user_turn_count, b.e2e_latency_count, b.usage) == ("ended", "event", 1, 0, None)
    assert last["a", (BASE + 600 + HOUR) * 1_000_000].end_reason == "gap" and last["c", (BASE + 2 * HOUR) * 1_000_000].end_reason == "gap"
    d = last["d", (BASE + 30 * HOUR) * 1_000_000]
    assert (d.status, d.user_turn_count, d.version) == ("open", 2, 2)
    assert len(last) == 5
    ended = got.where("status = 'ended'").groupBy("call_id", "session_id").count()
    assert ended.where("count > 1").isEmpty()


EVENTS = schema_of("key string, seq long, kind string, request_id string, desired string, worker string, s long")


def model(rows, lease):
    """The queue, event by event, in plain Python."""
    out, state = [], {}
    for key, _, kind, rid, desired, worker, s in sorted(rows, key=lambda r: (r[6], r[1])):
        q = state.setdefault(key, {"wait": [], "held": None, "desired": None})
        if q["held"] and q["held"][2] <= s:
            out.append((key, "lease_expired", q["held"][0][0], q["held"][1]))
            q["wait"].insert(0, q["held"][0])
            q["held"] = None
        if kind == "request":
            duplicate = (q["wait"] or q["held"]) and q["desired"] == desired
            if not duplicate:
                q["wait"].append((rid, desired))
                q["desired"] = desired
            out.append((key, "request_deduplicated" if duplicate else "request_enqueued", rid, None))
        elif kind == "claim":
            if q["wait"] and not q["held"]:
                q["held"] = [q["wait"].pop(0), worker, s + lease]
                out.append((key, "claimed", q["held"][0][0], worker))
            else:
                out.append((key, "nothing_to_claim", None, worker))
        elif not q["held"] or q["held"][1] != worker:
            out.append((key, "lease_lost", q["held"][0][0] if q["held"] else None, worker))
        elif kind == "renew":
            q["held"][2] = s + lease
            out.append((key, "renewed", q["held"][0][0], worker))
        else:
            out.append((key, "done", q["held"][0][0], worker))
            q["held"] = None
    return out


def test_leases_over_batches(run):
    batches = [
        [("k", 1, "request", "r1", "on", None, 0), ("k", 2, "request", "r2", "on", None, 1), ("k", 3, "request", "r3", "off", None, 2), ("k", 4, "claim", None, None, "w1", 3), ("m", 1, "claim", None, None, "w1", 3)],
        [("k", 5, "claim", None, None, "w2", 10), ("k", 6, "renew", None, None, "w1", 50)],
        [("k", 7, "claim", None, None, "w2", 115), ("k", 8, "done", None, None, "w1", 116), ("k", 9, "done", None, None, "w2", 120)],
        [("k", 10, "claim", None, None, "w1", 130), ("k", 11, "done", None, None, "w1", 131), ("k", 12, "request", "r4", "off", None, 140)],
        [("k", 13, "claim", None, None, "w3", 150)],
        [("z", 1, "request", "r9", "on", None, 9000)], [("z", 2, "request", "r9b", "off", None, 9001)],  # the watermark passes w3's lease
        [("k", 14, "claim", None, None, "w4", 9002), ("k", 15, "done", None, None, "w4", 9003)],
    ]
    got, _ = run(EVENTS, lambda e: stateful.request_queue(e, 60_000, "10 minutes"), batches)
    log = got.collect()
    want = model([r for b in batches for r in b], 60)
    assert sorted((r.key, r.kind, r.request_id or "", r.worker or "") for r in log) == sorted((k, e, i or "", w or "") for k, e, i, w in want)
    by = {(r.request_id, r.kind, r.worker) for r in log if r.key == "k"}
    assert ("r1", "lease_expired", "w1") in by and ("r1", "done", "w2") in by and ("r4", "lease_expired", "w3") in by and ("r4", "done", "w4") in by
    assert sum(r.kind == "done" for r in log) == 3
