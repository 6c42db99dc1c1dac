"""Versioned tables, file sinks and streams."""

import json

from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.operators.ranking import latest_per_key
from tarnwell.schemas import schema_of
from tarnwell.sources import readers, sinks
from tarnwell.streaming import jobs

SMALL = schema_of("k string, v int")


def test_replace_table_switches_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert sinks.read_current(spark, root, SMALL).count() == 0
    sinks.replace_table(spark.createDataFrame([("a", 1)], SMALL), root)
    first = sinks.current_version(spark, root)
    held = sinks.read_current(spark, root, SMALL)
    sinks.replace_table(held.unionByName(spark.createDataFrame([("b", 2)], SMALL)), root)
    assert sinks.current_version(spark, root) != first
    assert sinks.read_current(spark, root, SMALL).count() == 2


def test_stream_batch_is_not_applied_twice(spark, tmp_path):
    root, src = str(tmp_path / "t"), str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2)], SMALL).coalesce(1).write.parquet(src)
    seen = []

    def step(current, batch):
        seen.append(1)
        return current.unionByName(batch)

    def run(progress):
        stream = spark.readStream.schema(SMALL).parquet(src)
        jobs.run_available(jobs.table_stream(stream, root, SMALL, step, str(tmp_path / progress)))

    run("p1")
    assert len(seen) == 1 and sinks.read_current(spark, root, SMALL).count() == 2
    # The last batch again, as after a failure between the table and the checkpoint.
    commits = tmp_path / "p1" / "commits"
    for f in [*commits.glob("0"), *commits.glob(".0.crc")]:
        f.unlink()
    run("p1")
    assert len(seen) == 1 and sinks.read_current(spark, root, SMALL).count() == 2
    run("p2")  # another run counts its batches from 0 again; its rows must not be lost
    assert len(seen) == 2 and sinks.read_current(spark, root, SMALL).count() == 4


def test_transcript_stream_drops_repeats_and_numbers_on(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    src, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = schema_of("call_id string, item_id string, turn long, role string, content string")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        items = spark.readStream.schema(schema).parquet(src)
        jobs.run_available(jobs.event_sink(jobs.transcript_stream(items), out, progress))

    arrive([("c", "i1", 1, "user", "hi"), ("c", "i2", 2, "assistant", '["a ","b"]'), ("c", "i0", 0, "system", "x")])
    arrive([("c", "i2", 2, "assistant", "again"), ("c", "i3", 3, "user", "bye")])
    got = spark.read.parquet(out).orderBy("sequence_number").collect()
    assert [(r["sequence_number"], r["item_id"], r["content_text"]) for r in got] == [(1, "i1", "hi"), (2, "i2", "a b"), (3, "i3", "bye")]


def test_json_sources(spark, tmp_path):
    docs = tmp_path / "kb_docs.json"
    docs.write_text(json.dumps([{"KB_number": "KB1", "name": "n", "processed_content": " a  b "}, {"KB_number": " ", "processed_content": "x"}, {"KB_number": "KB2", "processed_content": " "}]))
    assert [tuple(r) for r in readers.read_kb_docs(spark, str(docs)).collect()] == [("KB1", "n", "a b")]
    labelled = tmp_path / "q.json"
    labelled.write_text(json.dumps([{"KB_number": "KB1", "name": None, "generic_queries": ["g"], "specific_queries": ["s1", "s2"]}]))
    got = readers.read_labelled_queries(spark, str(labelled)).collect()
    assert sorted((r["query_type"], r["query"], r["kb_name"]) for r in got) == [("generic", "g", "KB_KB1"), ("specific", "s1", "KB_KB1"), ("specific", "s2", "KB_KB1")]
    folder = tmp_path / "configs"
    folder.mkdir()
    for name in ("b", "a"):
        (folder / f"{name}.json").write_text(json.dumps({"name": name}))
    assert [r["file_name"] for r in readers.read_config_dir(spark, str(folder), "name string").collect()] == ["a.json", "b.json"]
    (folder / "job.json").write_text(json.dumps({"job_id": "j", "payload": {"a": "1"}, "required_input": ["b"]}))
    assert readers.read_job_states(spark, str(folder)).where("job_id = 'j'").first()["payload"] == {"a": "1"}


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>a</p>\n<p>b</p>")
    assert readers.read_pages(spark, str(tmp_path / "p.html")).first()["html"] == "<p>a</p>\n<p>b</p>"


def test_sinks_write(spark, tmp_path):
    rows = spark.createDataFrame([("KB1", "c", 0, "term", [0.5] * 4)], "kbid string, kb_collection_id string, shard_id int, usecase string, usecase_embedding array<float>")
    path = str(tmp_path / "kw")
    sinks.append_keyword_rows(rows, path, dim=4)
    sinks.append_keyword_rows(rows, path, shard_id=3, dim=4)
    assert spark.read.parquet(path).where("shard_id = 3").count() == 1
    outcomes = spark.createDataFrame([("KB1", "inserted", None, "completed")], "doc_key string, outcome string, reason string, stage string")
    sinks.append_trace(outcomes, str(tmp_path / "trace"), F.lit("2024-01-01").cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "trace")).first()["status"] == "success"
    report = spark.createDataFrame([("d", "success", True, "r")], "doc_id string, status string, json_valid boolean, response string")
    sinks.write_text_report(report, str(tmp_path / "report"))
    sinks.write_json_results(report, str(tmp_path / "json"), ["doc_id"])
    sinks.append_state_events(report, str(tmp_path / "events"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_align_and_latest(spark):
    df = schemas.align(spark.createDataFrame([(1,)], "job_id int"), schemas.JOBS, {"status": "new"})
    assert df.columns == schemas.JOBS.names and df.first()["status"] == "new"
    two = spark.createDataFrame([("a", 1), ("a", 2)], SMALL)
    assert latest_per_key(two, ["k"], [F.desc("v")]).first()["v"] == 2
