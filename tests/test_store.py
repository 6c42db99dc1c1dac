"""Copy-on-write tables under one manifest, and syncs that write them."""

import pytest
from pyspark.sql import functions as F

from tarnwell.plans import index as ix
from tarnwell.schemas import schema_of
from tarnwell.sources.store import Affected, Change, Store, TableSpec

SPEC = TableSpec(schema_of("owner string, v int"), ("owner",), 4)


def content(store, name="t"):
    return sorted((r.owner, r.v) for r in store.snapshot().read(name).collect())


def frame(spark, rows_):
    return spark.createDataFrame(rows_, SPEC.schema)


def test_commits_touch_only_their_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": SPEC, "u": SPEC})
    assert content(store) == [] and store.snapshot().version == 0
    done = store.commit({"t": Change(frame(spark, [(f"o{i}", i) for i in range(20)] + [("o1", 99), (None, 7)])), "u": Change(frame(spark, [("x", 1)]))})
    assert done == {"t": Affected(21, 0, 0, 0, 22), "u": Affected(1, 0, 0, 0, 1)}
    first = store.snapshot()
    done = store.commit({"t": Change(frame(spark, [("o1", 5), ("new", 6)]), frame(spark, [("o1", 0), ("o2", 0), ("absent", 0)]).select("owner"))})
    assert done == {"t": Affected(1, 1, 1, 3, 2)}
    want = sorted([(f"o{i}", i) for i in range(20) if i not in (1, 2)] + [("o1", 5), ("new", 6)])
    assert sorted((a or "", b) for a, b in [(r.owner, r.v) for r in store.snapshot().read("t").collect()]) == sorted([*want, ("", 7)])
    before, after = first.folders("t"), store.snapshot().folders("t")
    touched = {r.b for r in frame(spark, [("o1", 0), ("o2", 0), ("new", 0), ("absent", 0)]).select(F.pmod(F.xxhash64("owner"), F.lit(4)).alias("b")).collect()}
    assert {b for b in before if before[b] != after.get(b)} == touched & set(before)
    assert first.read("t").count() == 22  # a reader of the snapshot before still sees it whole
    gone = store.clean()
    assert all(not any(f.startswith(g) for f in after.values()) for g in gone) and store.snapshot().read("u").count() == 1
    assert store.clean() == []


def test_a_failed_commit_is_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"t": SPEC, "u": SPEC})
    store.commit({"t": Change(frame(spark, [("a", 1)]))})
    broken = frame(spark, [("b", 2)]).withColumn("v", F.when(F.col("v") > 0, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"t": Change(frame(spark, [("c", 3)])), "u": Change(broken)})
    assert content(store) == [("a", 1)] and content(store, "u") == []
    store.clean()
    stale = store.snapshot()
    store.commit({"t": Change(gone=frame(spark, [("a", 0)]).select("owner"))})
    assert content(store) == []
    with pytest.raises(RuntimeError):
        store.commit({"t": Change(frame(spark, [("d", 4)]))}, on=stale)


BODY = "Printer Setup needs the Network Driver to be installed first."
@pytest.fixture(scope="module")
def now(spark):
    return F.lit("2024-05-01").cast("timestamp")


def articles(spark, rows_):
    made = spark.createDataFrame(rows_, "id string, number string, content string, knowledgebase_collection_id string, s int, is_deleted boolean")
    return made.select("*", F.lit("plain").alias("name"), F.timestamp_seconds("s").alias("updated_at"), F.lit("o").alias("org_id"))


def held(store, table, key):
    return sorted({(r.kb_collection_id, r[key]) for r in store.snapshot().read(table).collect()})


def slots(store):
    return {(r.kb_collection_id, r.shard_id): r.doc_count for r in store.snapshot().read("registry").collect()}


def test_syncs_in_a_row(spark, tmp_path, now):
    store = Store(spark, str(tmp_path / "kb"), ix.INDEX_TABLES)
    first = [(str(i), f"KB{i}", f"{BODY} Step {i}.", "c1" if i % 2 else "c2", 1, False) for i in range(8)]
    report = ix.run_sync(store, articles(spark, [*first, ("99", "KB0", "", "c1", 1, False)]), now)
    assert report.affected["summaries"] == Affected(8, 0, 0, 0, 8)
    assert held(store, "summaries", "doc_id") == held(store, "keywords", "kbid") == sorted((r[3], r[1]) for r in first)
    assert slots(store) == {("c1", 0): 4, ("c2", 0): 4}
    assert {r.outcome: r.n for r in report.outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()} == {"inserted": 8, "failed": 1}
    version = store.snapshot()

    # One is updated, one deleted, one new; the others keep their files.
    second = [(r[0], r[1], r[2] + " Restart Windows Server.", r[3], 2, False) if r[0] == "2" else r for r in first if r[0] != "3"] + [("20", "KB20", BODY, "c1", 2, False)]
    report = ix.run_sync(store, articles(spark, second), now)
    assert report.affected["summaries"] == Affected(1, 1, 1, 2, 2)
    assert held(store, "summaries", "doc_id") == held(store, "keywords", "kbid") == sorted((r[3], r[1]) for r in second)
    assert slots(store) == {("c1", 0): 4, ("c2", 0): 4}
    before, after = version.folders("summaries"), store.snapshot().folders("summaries")
    assert sum(before.get(b) == after.get(b) for b in before) >= 5
    assert version.read("summaries").count() == 8

    # A failure inside leaves everything as it was.
    def broken(df):
        return df.withColumn("x", F.raise_error(F.lit("extractor lost")))

    with pytest.raises(Exception):  # noqa: B017
        ix.run_sync(store, articles(spark, [*second, ("30", "KB30", BODY, "c3", 3, False)]), now, extract=broken)
    assert held(store, "summaries", "doc_id") == sorted((r[3], r[1]) for r in second) and store.snapshot().version == 2

    # Nothing to do; then a feed of changes alone, with a deletion; then a deletion by key.
    assert ix.run_sync(store, articles(spark, second), now).affected["summaries"] == Affected()
    feed = [("2", "KB2", BODY + " Again.", "c2", 5, False), ("4", "KB4", BODY, "c2", 5, True), ("40", "KB40", BODY, "c2", 5, False)]
    report = ix.run_sync(store, articles(spark, feed), now, partial=True)
    assert report.affected["summaries"] == Affected(1, 1, 1, 2, 2)
    keys = spark.createDataFrame([("c2", "KB40"), ("c2", "KB6"), ("c1", "none")], "kb_collection_id string, doc_key string")
    done = ix.delete_articles(store, keys)
    assert done["summaries"] == Affected(0, 0, 2, 2, 0) and done["keywords"].deleted == 2 and done["keywords"].rows_out > 2
    assert held(store, "keywords", "kbid") == held(store, "summaries", "doc_id") == [("c1", "KB1"), ("c1", "KB20"), ("c1", "KB5"), ("c1", "KB7"), ("c2", "KB0"), ("c2", "KB2")]
    assert slots(store) == {("c1", 0): 4, ("c2", 0): 2}
    store.clean()
    assert len(held(store, "summaries", "doc_id")) == 6


def test_call_updates_touch_named_calls_and_replays_do_nothing(spark, tmp_path, now):
    from tarnwell import schemas
    from tarnwell.plans import state as st
    from tarnwell.streaming import jobs

    store = Store(spark, str(tmp_path / "calls"), st.CALL_TABLES)
    ids = [f"00000000-0000-0000-0000-{i:012d}" for i in range(6)]
    known = schemas.align(spark.createDataFrame([(ids[0], "int-0", None), (ids[1], None, '{"external_call_id":"ext-1"}'), (ids[2], "int-2", None)], "id string, interaction_id string, call_data string"), schemas.CALLS)
    store.commit({"calls": Change(known), "call_refs": Change(st.call_references(known))})
    shape = schema_of("call_ref string, arrived int, status string, interaction_id string, call_data string")
    batches = [
        [("int-0", 1, "started", None, None), ("ext-1", 2, "started", None, '{"a":1}'), (ids[4], 3, "started", "int-4", None)],
        [("int-4", 4, "ended", None, '{"b":2}'), ("ext-1", 5, None, None, '{"c":3}'), ("new-ref", 6, "started", None, None)],
        [("new-ref", 7, "ended", None, None)],
    ]
    src, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    for batch in batches:
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(shape).parquet(src)
        jobs.run_available(jobs.call_update_stream(stream, store, now, progress))
    got = {r.interaction_id or r.id: r for r in store.snapshot().read("calls").collect()}
    assert {k: r.status for k, r in got.items()} == {"int-0": "started", ids[1]: "started", "int-2": None, "int-4": "ended", "new-ref": "ended"}
    assert '"a":1' in got[ids[1]].call_data and '"c":3' in got[ids[1]].call_data and got["int-4"].id == ids[4]
    version = store.snapshot()
    assert version.folders("calls") and len({f.split("/")[0] for f in version.folders("calls").values()}) > 1  # calls that were not named kept their files
    # The last batch again, as after a failure between the tables and the checkpoint.
    for f in [*(tmp_path / "progress" / "commits").glob("2"), *(tmp_path / "progress" / "commits").glob(".2.crc")]:
        f.unlink()
    jobs.run_available(jobs.call_update_stream(spark.readStream.schema(shape).parquet(src), store, now, progress))
    assert store.snapshot().version == version.version
