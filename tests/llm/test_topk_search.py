import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tarnwell.llm import topk_search as tk

SHAPE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("shard", T.StringType())])


def brute(rows, k, every):
    fine = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in set(fine):
        if q % every == 0:
            others = list(fine)
            others.remove((q, v))  # its own row, once
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in others if len(v) == len(w))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "s") for i, v in data], SHAPE)


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_against_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(tk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(tk, "BLOCK_ROWS", max(4, shard_rows // 20))
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.normal(0, 0.1, 6)]) for i in range(400)]
    data += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, -1.0]) for i in range(150)]  # ties
    data += [(2000, None), (2001, []), (2050, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2050 + 50, [float("nan")] * 6), (2200, [1.0, 2.0]), (2250, [float("inf")] * 6), (None, [0.1] * 6)]
    assert rows(tk.top_inner_products(frame(spark, data), 5, 50)) == brute(data, 5, 50)


def test_few_rows_empty_table_repeated_rows(spark):
    data = [(0, [1.0, 1.0]), (50, [0.5, -0.5]), (7, [2.0, 0.1])]
    assert rows(tk.top_inner_products(frame(spark, data))) == brute(data, 5, 50)
    assert rows(tk.top_inner_products(frame(spark, [*data, *data]))) == brute([*data, *data], 5, 50)
    several = [(0, [1.0, 1.0]), (7, [2.0, 0.1]), (7, [2.0, 0.1]), (8, [0.1, 0.1])]
    assert [r[2] for r in rows(tk.top_inner_products(frame(spark, several)))] == [7, 7, 8]
    many = [*data, *[(7, [2.0, 0.1])] * 30]
    assert rows(tk.top_inner_products(frame(spark, many))) == brute(many, 5, 50)
    assert tk.top_inner_products(frame(spark, [])).count() == 0


def test_large_numbers_are_exact_and_nodes_are_skipped():
    rng = np.random.default_rng(8)
    centres = rng.integers(-1000, 1000, (10, 8)) * 40
    points = np.concatenate([c + rng.integers(-30, 30, (50, 8)) for c in centres])
    ids = np.arange(len(points))
    for factor in (1, 1 << 14):
        v = points * factor
        got = tk.search(ids[:20], v[:20], np.full(20, -np.inf), ids, v, 3, False, leaf_rows=16)
        scores = v[:20] @ v.T
        for q in range(20):
            want = sorted((-int(s), int(i)) for i, s in enumerate(scores[q]) if i != q)[:3]
            assert sorted((-int(s), int(i)) for r, i, s in zip(*got) if r == q) == want
    tree = tk.BallTree(points.astype(float), 16)
    kth = np.sort(points[:20] @ points.T, axis=1)[:, -4].astype(float)
    bounds = tree.bounds(points[:20].astype(float), np.sqrt((points[:20] ** 2).sum(axis=1)), kth)
    assert (bounds == -np.inf).mean() > 0.5


def test_top_tree_bounds_hold_and_skip_shards():
    rng = np.random.default_rng(9)
    centres = rng.integers(-400, 400, (12, 8)).astype(float)
    points = np.concatenate([c + rng.integers(-20, 20, (200, 8)) for c in centres])
    tree = tk.TopTree(points[rng.permutation(len(points))[:512]], 16)
    shard, distance = tree.shards_of(points)
    radii = np.array([distance[shard == s].max(initial=-1.0) for s in range(len(tree.centres))])
    bounds = tree.bounds(points[::50], radii)
    scores = points[::50] @ points.T
    for s in range(len(radii)):
        assert (scores[:, shard == s] <= bounds[:, s][:, None]).all()
    kth = np.sort(scores, axis=1)[:, -6]
    assert (bounds < kth[:, None]).mean() > 0.3
