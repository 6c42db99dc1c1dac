"""What a key of a stateful stream costs: requests to the state store, without Spark."""

import json
import math

from pyspark.sql import Row

from tarnwell.streaming import stateful

HOUR_US = 3600 * 1_000_000


class Handle:
    """State and timers of one key; every request is noted."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


Item = Row("us", "seq", "role", "metrics", "usage")


def test_a_batch_of_a_session_is_four_requests():
    handle, work = Handle(), stateful._Sessions(HOUR_US)
    work.init(handle)
    rows = [Item(k * 1000, k, "user", '{"e2e_latency":0.5}', "{}") for k in range(50)]
    out = list(work.handleInputRows(("c",), iter(rows[::-1]), None))
    assert [(r.status, r.version, r.user_turn_count) for r in out] == [("open", 50, 50)]
    assert out[0].figures[:4] == [50.0, 0.5, 0.5, 0.5]
    handle.calls.clear()
    ended = list(work.handleInputRows(("c",), iter([Item(9 * HOUR_US, 99, "assistant", "{}", None)]), None))
    assert [(r.status, r.end_reason, r.version) for r in ended] == [("ended", "gap", 50), ("open", None, 1)]
    assert sorted(handle.calls) == ["delete", "get", "register", "update"]
    assert handle.timers == {10 * HOUR_US // 1000}
    assert [(r.status, r.end_reason) for r in work.handleExpiredTimer(("c",), None, None)] == [("ended", "gap")] and handle.value is None


def test_a_session_that_ends_leaves_no_timer_and_null_sequences_come_last():
    handle, work = Handle(), stateful._Sessions(HOUR_US)
    work.init(handle)
    list(work.handleInputRows(("c",), iter([Item(5, None, "user", "{}", "late"), Item(5, 3, "user", "{}", "kept")]), None))
    s = json.loads(handle.value[0])
    assert s["usage"] == "kept" and s["usage_n"] == 2 and len(handle.timers) == 1 and not math.isnan(s["usage_at"][1])
    list(work.handleInputRows(("c",), iter([Item(6, 4, "end", "{}", None)]), None))
    assert handle.value is None and not handle.timers


Event = Row("ms", "seq", "kind", "request_id", "desired", "worker")


def test_a_batch_of_a_queue_is_four_requests():
    handle, work = Handle(), stateful._Queue(1000, 60_000)
    work.init(handle)
    list(work.handleInputRows(("k",), iter([Event(k, k, "request", f"r{k}", f"d{k}", None) for k in range(20)]), None))
    handle.calls.clear()
    out = list(work.handleInputRows(("k",), iter([Event(30, 31, "claim", None, None, "w")]), None))
    assert [(r.kind, r.request_id, r.lease_until_ms) for r in out] == [("claimed", "r0", 1030)]
    assert sorted(handle.calls) == ["delete", "get", "register", "update"] and handle.timers == {1030}
    handle.timers.clear()  # it goes off; Spark takes it away itself
    late = list(work.handleExpiredTimer(("k",), Watermark(2000), None))
    assert [(r.kind, r.request_id, r.worker) for r in late] == [("lease_expired", "r0", "w")]
    assert handle.timers == {30 + 60_000} and json.loads(handle.value[0])["waiting"][0]["id"] == "r0"


def test_a_large_part_of_a_stream_is_many_files_in_one_micro_batch(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnwell.registry import stream_queries

    monkeypatch.setattr(stream_queries, "FILE_ROWS", 50)
    rows = spark.range(1200).select("id", F.col("id").cast("double").alias("_order"))
    stream = stream_queries._in_parts(spark, rows, "_order", "parts-test", 3)
    seen = []
    note = lambda batch, _: seen.append([batch.count(), batch.agg(F.max("id")).first()[0], batch.select(F.input_file_name().alias("f")).distinct().count()])
    stream.writeStream.foreachBatch(note).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sum(n for n, _, _ in seen) == 1200
    assert [m for _, m, _ in seen] == sorted(m for _, m, _ in seen) and all(f == 8 for _, _, f in seen)  # two before


def test_a_given_number_of_buckets_is_the_least(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnwell.operators import skew

    monkeypatch.setattr(skew, "BUCKET_ROWS", 10)
    rows = spark.range(400).select(F.when(F.col("id") > 3, F.col("id")).alias("id"))
    dealt, several = skew.bucketed(rows, F.col("id"), 2)
    sizes = {r["_bucket"]: r["n"] for r in dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert several and max(sizes.values()) < 40 and sizes[-1] == 4  # two buckets of 200 before
    bounds = [3.0, 7.0, 7.5, 100.0]
    got = spark.createDataFrame([(v,) for v in (2.0, 3.0, 3.5, 7.2, 100.0, 101.0, float("nan"))], "v double").select("v", skew._bounds_below("v", bounds).alias("b")).collect()
    assert [r["b"] for r in got] == [0, 0, 1, 2, 3, 4, 4]


def test_requests_of_one_key_are_dealt_into_tasks_of_bounded_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnwell import schemas
    from tarnwell.operators import skew
    from tarnwell.plans import state as st

    monkeypatch.setattr(skew, "BUCKET_ROWS", 500)
    n = 20_000
    wanted = F.when(F.col("id") % 7 == 0, "deleted").otherwise("deployed")
    told = spark.range(n).select(
        F.lit("a").alias("agent_name"), F.lit("x").alias("namespace"), F.lit("main").alias("deployment_name"), wanted.alias("desired_state"),
        F.lit("me").alias("requested_by"), F.lit("img").alias("image"), F.col("id").alias("arrived"),
    )
    stored = spark.createDataFrame([], schemas.DEPLOYMENTS)
    nxt, events = st.enqueue_requests(stored, told, F.lit("2024-01-01").cast("timestamp"), buckets=2)
    states = ["deleted" if i % 7 == 0 else "deployed" for i in range(n)]
    want = 1 + sum(a != b for a, b in zip(states, states[1:]))
    assert events.where("event_type = 'request_enqueued'").count() == want and events.count() == n
    assert [r["desired_state"] for r in nxt.collect()] == [states[-1]]
    judged = st._judge_requests(told.withColumn("_workflow", F.lit(None).cast("string")).withColumn("_desired", F.lit(None).cast("string")), "arrived", 2)
    sizes = [r["n"] for r in judged.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) < n // 4  # half of the rows in one task before
