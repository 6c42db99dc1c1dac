"""The stored full-text index against brute force, over appends, removals and merges."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import fulltext, textindex

ASKED = [
    "quick fox", '"quick fox" or wifi', "fox -quick", "wi-fi", '"the fox"', "missing", "-fox", "the", 'setup "wi fi" or "brown fox"', "-missing", '-"the quick" or setup',
    "-the -wifi", "fox -missing", "!!", "", 'the "fox the" or -"brown fox"', "-the or missing",
]


def norm(s):
    return " ".join("".join(c if c.isalnum() else " " for c in (s or "").lower()).split())


def matches(text, doc):
    """Any alternative of which all positive items stand in the document and no negative one does."""
    body = f" {norm(doc)} "
    for alternative in re.split(r'\s+or\s+(?=(?:[^"]*"[^"]*")*[^"]*$)', text):
        items = re.findall(r'-?"[^"]*"|\S+', alternative)
        wanted = [norm(i) for i in items if not i.startswith("-") and norm(i)]
        unwanted = [norm(i) for i in items if i.startswith("-") and norm(i)]
        if (wanted or unwanted) and all(f" {p} " in body for p in wanted) and not any(f" {n} " in body for n in unwanted):
            return True
    return False


def bodies(seed, n):
    rng = random.Random(seed)
    words = ["the", "quick", "brown", "fox", "wi fi", "wi-fi", "wifi", "setup", "Ünit"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "q int, text string")


def frame(spark, docs, first=0):
    return spark.createDataFrame([(first + i, b, f"s{i % 3}") for i, b in enumerate(docs)], "doc_id int, body string, source string").repartition(3)


def found(index, asked):
    clauses = fulltext.search_clauses(asked, "q", "text", exclude_only=True)
    return sorted({(r.q, r.doc_id) for r in textindex.match_index(index, clauses, "q").collect()})


def brute(docs):
    return sorted((q, i) for q, a in enumerate(ASKED) for i, b in docs.items() if matches(a, b))


def test_build_append_remove_merge(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_DOCS", 8)
    monkeypatch.setattr(textindex, "FILE_ROWS", 3)
    root = str(tmp_path / "index")
    docs = dict(enumerate([*bodies(1, 60), None, ""]))
    index = textindex.build_index(frame(spark, list(docs.values())), root, ["doc_id"], {"body": "B"}, ["source"], buckets=4)
    assert found(index, asked) == brute(docs)

    new = dict(enumerate(bodies(2, 30), start=50))  # replaces some, adds others
    index = textindex.append_documents(index, frame(spark, list(new.values()), 50))
    docs |= new
    assert found(index, asked) == brute(docs)

    gone = spark.createDataFrame([(i,) for i in range(0, 80, 7)], "doc_id int")
    index = textindex.remove_documents(index, gone)
    docs = {i: b for i, b in docs.items() if i % 7 or i >= 80}
    assert found(textindex.open_index(spark, root), asked) == brute(docs)

    before = index.postings().count()
    index = textindex.merge_segments(index)
    assert len(index.manifest["segments"]) == 1 and index.postings().count() < before
    assert found(index, asked) == brute(docs)
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "index").iterdir() if not p.name.startswith((".", "CURRENT"))) == ["documents", "frequency", "postings"]
    assert {r.source for r in index.documents().collect()} == {"s0", "s1", "s2"}


def test_a_failed_append_leaves_the_index(spark, asked, tmp_path):
    root = str(tmp_path / "index")
    docs = dict(enumerate(bodies(3, 20)))
    index = textindex.build_index(frame(spark, list(docs.values())), root, ["doc_id"], {"body": "B"}, buckets=4)
    broken = frame(spark, bodies(4, 5), 10).withColumn("body", F.when(F.col("doc_id") < 99, F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        textindex.append_documents(index, broken)
    assert found(textindex.open_index(spark, root), asked) == brute(docs)


def test_only_wanted_buckets_are_read_and_positions_are_delta_coded(spark, asked, tmp_path):
    root = str(tmp_path / "index")
    index = textindex.build_index(frame(spark, bodies(5, 40)), root, ["doc_id"], {"body": "B"}, buckets=8)
    rows = index.postings([3])
    assert "PartitionFilters: [bucket" in rows._jdf.queryExecution().toString().replace("isnotnull(bucket", "bucket")
    folder = index.manifest["segments"][0]["postings"]
    file = next((tmp_path / "index" / folder).rglob("*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    coded = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    assert all("DELTA_BINARY_PACKED" in coded[c] for c in ("doc", "positions.list.element"))
    tokens = pq.read_table(file, partitioning=None).column("token").to_pylist()
    assert tokens == sorted(tokens)


def test_empty_index_and_no_queries(spark, asked, tmp_path):
    index = textindex.build_index(frame(spark, []), str(tmp_path / "none"), ["doc_id"], {"body": "B"}, buckets=4)
    assert found(index, asked) == []
    index = textindex.append_documents(index, frame(spark, ["the fox"]))
    assert found(index, asked) == brute({0: "the fox"}) and found(index, asked.limit(0)) == []
    with pytest.raises(ValueError):
        textindex.build_index(frame(spark, []), str(tmp_path / "none"), ["doc_id"], {"body": "B"}, buckets=4)


def test_ranks_same_as_the_walk_over_tokens(spark, tmp_path):
    rng = random.Random(6)
    words = ["a", "b", "c", "d"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id int, title string, body string")
    q = spark.createDataFrame(list(enumerate(["a", "a b", "c a b", '"b c" d', "d d a"])), "q int, text string")
    clauses = fulltext.search_clauses(q, "q", "text")
    index = textindex.build_index(d, str(tmp_path / "ranks"), ["doc_id"], {"title": "A", "body": "D"}, buckets=4)
    got = textindex.match_index(index, clauses, "q").select(
        "q", "doc_id", textindex.hit_weights("hits").alias("h"), textindex.cover_density_of_hits("hits", "terms").alias("c")
    ).collect()
    walked = fulltext.fts_match(clauses, fulltext.search_document(d, {"title": "A", "body": "D"}), "q", ["doc_id"])
    want = walked.select("q", "doc_id", fulltext.weighted_hits("fts_fields", "terms").alias("h"), fulltext.cover_density_rank("fts_fields", "terms").alias("c")).collect()
    assert len(got) == len(want) > 30
    by = {(r.q, r.doc_id): r for r in got}
    for r in want:
        assert by[r.q, r.doc_id].h == pytest.approx(r.h) and by[r.q, r.doc_id].c == pytest.approx(r.c)


def test_words_are_intersected_in_blocks_and_slices_and_query_ids_may_repeat(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_DOCS", 16)
    monkeypatch.setattr(textindex, "SLICE_CLAUSES", 5)
    monkeypatch.setattr(textindex, "GROUPED_BYTES", 40)
    docs = dict(enumerate([*bodies(7, 50), None]))
    index = textindex.build_index(frame(spark, list(docs.values())), str(tmp_path / "blocks"), ["doc_id"], {"body": "B"}, buckets=4)
    twice = spark.createDataFrame([(i, a) for i, a in enumerate(ASKED)] + [(0, ASKED[0]), (7, ASKED[7])], "q int, text string")
    clauses = fulltext.search_clauses(twice, "q", "text", exclude_only=True)
    want = set(brute(docs))
    for hits in (True, False):
        rows = textindex.match_index(index, clauses, "q", hits)
        assert ("hits" in rows.columns) == hits
        got = [(r.q, r.doc_id) for r in rows.select("q", "doc_id").collect()]
        assert set(got) == want and got.count((7, min(d for q, d in want if q == 7))) == 2


def test_positions_of_wanted_words_alone_are_sent(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"quick fox w{i} v{i}") for i in range(40)], "id int, body string")
    index = textindex.build_index(docs, str(tmp_path / "i"), ["id"], {"body": "B"}, buckets=1)
    asked = spark.createDataFrame([(1, "quick w7"), (2, '"fox w9"')], "q int, text string")
    plans, write = {}, textindex.materialise
    monkeypatch.setattr(textindex, "materialise", lambda df, name, *a: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name, *a))
    found = textindex.match_index(index, fulltext.search_clauses(asked, "q", "text"), "q")
    assert sorted((r["q"], r["id"]) for r in found.collect()) == [(1, 7), (2, 9)]
    assert "Join LeftSemi" in plans["fts-evidence"]


def test_occurrences_by_label_are_counted_without_positions(spark, tmp_path, monkeypatch):
    """The weights are those of all hits, phrases and excluded words included; positions are read for phrases alone."""
    monkeypatch.setattr(textindex, "BLOCK_DOCS", 16)
    monkeypatch.setattr(textindex, "SLICE_CLAUSES", 6)
    titles, texts = bodies(8, 50), bodies(9, 50)
    docs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(titles, texts))], "doc_id int, title string, body string")
    index = textindex.build_index(docs, str(tmp_path / "counts"), ["doc_id"], {"title": "A", "body": "D"}, buckets=4)
    asked = [(i, a) for i, a in enumerate(ASKED)] + [(0, ASKED[0])]
    clauses = fulltext.search_clauses(spark.createDataFrame(asked, "q int, text string"), "q", "text", exclude_only=True)
    told = ["q", "alternative", "doc_id"]
    want = textindex.match_index(index, clauses, "q").select(*told, textindex.hit_weights("hits").alias("w"))
    got = textindex.match_index(index, clauses, "q", counts=True).select(*told, textindex.hit_weights_of_counts().alias("w"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plans, write = {}, textindex.materialise
    monkeypatch.setattr(textindex, "materialise", lambda df, name, *a: plans.update({name: df}) or write(df, name, *a))
    plain = fulltext.search_clauses(spark.createDataFrame([(1, "quick fox"), (2, "the -wifi")], "q int, text string"), "q", "text")
    assert textindex.match_index(index, plain, "q", counts=True).count() > 0
    assert plans["fts-evidence"].isEmpty()
