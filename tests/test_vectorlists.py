"""Stored inverted lists: exact with all lists, recall with few, lists that one vector fills."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import vectorlists as vl
from tarnwell.operators.knn import knn_join
from tarnwell.settings import INDEX


def made(seed, n=900, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    v = centres[rng.integers(0, 25, n)] + 0.35 * rng.normal(size=(n, dim))
    v[: n // 3] = v[0]  # a third of all rows is one vector
    return v


def frame(spark, v, extra=()):
    rows = [(i, f"k{i % 2}", [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame([*rows, *extra], "row_id int, kind string, embedding array<double>")


def brute(v, q, kinds, k):
    out = []
    for i, a in enumerate(q):
        d = np.round(1 - v @ a / np.linalg.norm(v, axis=1) / np.linalg.norm(a), 9)
        fits = [j for j in range(len(v)) if kinds is None or kinds[i] == f"k{j % 2}"]
        out += [(i, j, r + 1) for r, j in enumerate(sorted(fits, key=lambda j: (d[j], j))[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.row_id, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    v = made(1)
    odd = [(5000, "k0", None), (5001, "k1", [0.0] * 12)]
    root = str(tmp_path_factory.mktemp("lists"))
    vl.build_lists(frame(spark, v, odd), root)
    return v, vl.open_lists(spark, root)


def queries(spark, v, step=9):
    picked = np.concatenate([v[::step], made(2, 30)])
    rows = [(i, f"k{i % 2}", [float(x) for x in r], 3 + i % 5) for i, r in enumerate(picked)]
    return picked, spark.createDataFrame(rows, "query_id int, kind string, embedding array<double>, lim int")


def test_all_lists_give_the_exact_result(spark, index):
    v, lists = index
    q, frame_ = queries(spark, v)
    assert got(vl.search_lists(lists, frame_.drop("kind"), "query_id", ["row_id"], 7)) == brute(v, q, None, 7)
    by_kind = vl.search_lists(lists, frame_, "query_id", ["row_id"], 7, match=["kind"])
    assert got(by_kind) == brute(v, q, [f"k{i % 2}" for i in range(len(q))], 7)
    each = vl.search_lists(lists, frame_.drop("kind"), "query_id", ["row_id"], "lim")
    assert got(each) == sorted(x for i, a in enumerate(q) for x in [(i, j, r) for _, j, r in brute(v, [a], None, 3 + i % 5)])


def test_few_probes_find_nearly_all(spark, index):
    v, lists = index
    q, frame_ = queries(spark, v)
    want = brute(v, q, None, 10)
    near = vl.search_lists(lists, frame_.drop("kind"), "query_id", ["row_id"], 10, INDEX.ivf_probes)
    rows = {(a, b) for a, b, _ in got(near)}
    assert len(rows & {(a, b) for a, b, _ in want}) >= 0.9 * len(want)


def test_large_lists_are_split_and_radii_hold(spark, tmp_path):
    rng = np.random.default_rng(4)
    tight = rng.normal(size=12) + 0.2 * rng.normal(size=(1200, 12))  # one cloud that the first clustering leaves in few lists
    spread = rng.normal(size=(40, 12)) * 5
    v = np.concatenate([spread, tight])
    lists = vl.build_lists(frame(spark, v), str(tmp_path / "l"), lists=6)
    assert len(lists.centroids) > 6
    for r in lists.rows().collect():
        a = np.array(r.embedding) / np.linalg.norm(r.embedding)
        assert np.arccos(np.clip(a @ lists.centroids[r.list_id], -1, 1)) <= lists.radii[r.list_id] + 1e-9
    q, frame_ = queries(spark, v, 200)
    assert got(vl.search_lists(lists, frame_.drop("kind"), "query_id", ["row_id"], 4)) == brute(v, q, None, 4)


def test_only_wanted_folders_are_read(spark, index):
    _, lists = index
    some = spark.createDataFrame([(0,), (1,)], "list_id int")
    assert lists.rows(some).select(F.col("part")).distinct().count() <= 2
    assert "PartitionFilters: [part" in lists.rows(some)._jdf.queryExecution().toString().replace("isnotnull(part", "part")


def test_nothing_to_search(spark, tmp_path, index):
    empty = vl.build_lists(frame(spark, []), str(tmp_path / "e"))
    _, frame_ = queries(spark, made(1)[:3], 1)
    assert vl.search_lists(empty, frame_.drop("kind"), "query_id", ["row_id"], 3).collect() == []
    assert vl.search_lists(index[1], frame_.drop("kind").limit(0), "query_id", ["row_id"], 3).collect() == []


def test_blocks_are_sized_by_the_queries_of_one_list(spark):
    """A query that looks into many lists is one query of each, so that the vectors of a list are not repeated for the others."""
    vectors = spark.createDataFrame([(i, i % 3, [float(i + 1), 1.0]) for i in range(12)], "row_id long, list_id int, embedding array<double>")
    asked = spark.createDataFrame([(q, l, [float(q), 1.0]) for q in range(4) for l in range(3)], "query_id long, list_id int, embedding array<double>")
    near = knn_join(asked, vectors, "query_id", ["row_id"], 1, match=["list_id"], block_queries=4)
    assert near._jdf.queryExecution().analyzed().toString().count("sequence(0, 0,") == 2
    assert sorted((r.query_id, r.list_id) for r in near.collect()) == [(q, l) for q in range(4) for l in range(3)]


def test_probes_leave_a_task_in_bounded_batches(spark, index, monkeypatch):
    """Open lists of very many queries are not put together at once; queries in pieces find the same."""
    v, lists = index
    q, frame_ = queries(spark, v)
    monkeypatch.setattr(vl, "PROBE_PAIRS", 2 * len(lists.centroids))
    made, map_in_arrow = [], type(frame_).mapInArrow
    monkeypatch.setattr(type(frame_), "mapInArrow", lambda df, run, schema: made.append(run) or map_in_arrow(df, run, schema))
    found = vl.search_lists(lists, frame_.drop("kind"), "query_id", ["row_id"], 7)
    assert got(found) == brute(v, q, None, 7)
    n = len(q)
    asked = pa.record_batch({"query_id": range(n), "embedding": [list(map(float, x)) for x in q], "lim": [7] * n, "_wanted": [7] * n, "_kth": pa.array([None] * n, pa.float64())})
    sizes = [b.num_rows for b in made[-1](iter([asked]))]
    assert sum(sizes) == n * (len(lists.centroids) - 1) and max(sizes) <= 2 * len(lists.centroids)
