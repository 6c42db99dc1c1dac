import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from tarnwell.llm import queries, whitening

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    # names that the operator uses inside
    T.StructField("vector", T.StringType()), T.StructField("n", T.StringType()), T.StructField("whitened", T.StringType()),
])


@pytest.fixture(scope="module")
def make(spark):
    def frame(pairs):
        rows = [Row(vec_id=i, embedding=None if v is None else [None if x is None else float(x) for x in v], label=1, vector="v", n="n", whitened="w") for i, v in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return frame


def integer_vectors(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]


def scatter_of(x):
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    return s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def check(rows, vectors, ids, components):
    """Against numpy on centred integers, with the offset that the operator leaves out."""
    x = integer_vectors(vectors)
    n, d = len(x), len(x[0])
    s, m = scatter_of(x)
    v = np.array([[float(Fraction(e, n * n)) for e in row] for row in m])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    centred = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    k = len(rows[0].whitened)
    assert k == min(components, int((e > 1e-9 * e[0]).sum()))
    by_id = {r.vec_id: r for r in rows}
    assert sorted(by_id) == sorted(ids) and len(rows) == n
    got = np.array([by_id[i].whitened for i in ids])
    want = centred @ axes[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        gaps = np.abs(np.delete(e, c) - e[c]).min() / e[0]
        if gaps > 1e-6:  # either sign
            assert min(np.abs(got[:, c] - want[:, c]).max(), np.abs(got[:, c] + want[:, c]).max()) < 1e-8 / gaps
    for i, r in zip(ids, x, strict=True):
        assert by_id[i].n == n and int(by_id[i].deviation) == sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))
        np.testing.assert_allclose(by_id[i].explained, e[:k] / np.trace(v), rtol=1e-9)
        assert by_id[i].identity_error < 1e-9
    np.testing.assert_allclose(np.cov(got.T, bias=True).reshape(k, k), np.eye(k), atol=1e-9)


def test_same_as_numpy(make):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 12)) * np.linspace(0.05, 2, 12)
    check(whitening.whiten(make(list(enumerate(vectors)))).collect(), vectors, list(range(200)), 8)


def test_nulls_and_odd_rows_take_no_part(make):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 5))
    odd = [(900, None), (901, []), (902, [1, None, 1, 1, 1]), (903, [float("nan")] * 5), (904, [float("inf")] + [0] * 4), (905, [1, 2, 3])]
    pairs = [*enumerate(vectors), *odd]
    rows = whitening.whiten(make(pairs)).collect()
    check(rows, vectors, list(range(40)), 8)
    assert len(rows[0].whitened) == 5


def test_null_ids_and_repeated_rows_count(make):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(10, 3))
    rows = whitening.whiten(make([*enumerate(vectors), *enumerate(vectors), (None, vectors[0])])).collect()
    assert len(rows) == 21 and {r.n for r in rows} == {21} and sum(r.vec_id is None for r in rows) == 1
    assert rows[0].identity_error < 1e-9


def test_equal_eigenvalues_and_missing_rank(make):
    corners = [[a, b, 0.5, a, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)]  # three equal spreads, one doubled, one constant
    rows = whitening.whiten(make(list(enumerate(corners)))).collect()
    assert len(rows[0].whitened) == 3
    got = np.array([r.whitened for r in rows])
    np.testing.assert_allclose(np.cov(got.T, bias=True), np.eye(3), atol=1e-9)
    assert rows[0].explained == pytest.approx([0.5, 0.25, 0.25])


def test_nothing_to_whiten(make):
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, None)])).collect() == []
    assert whitening.whiten(make([(1, [1, 2]), (2, [1, 2])])).collect() == []


def test_large_entries_are_exact(make):
    vectors = [[1e9 * i, 3e8 * i * i] for i in range(7)]
    check(whitening.whiten(make(list(enumerate(vectors)))).collect(), vectors, list(range(7)), 8)


def determinant(m):
    """Over fractions."""
    m, out = [[Fraction(x) for x in r] for r in m], Fraction(1)
    for k in range(len(m)):
        p = next((r for r in range(k, len(m)) if m[r][k]), None)
        if p is None:
            return Fraction(0)
        if p != k:
            m[k], m[p], out = m[p], m[k], -out
        out *= m[k][k]
        for r in range(k + 1, len(m)):
            f = m[r][k] / m[k][k]
            m[r] = [a - f * b for a, b in zip(m[r], m[k], strict=True)]
    return out


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(6)
    for d, n in ((1, 4), (2, 5), (6, 9), (6, 3)):
        _, m = scatter_of(rng.integers(-900, 900, (n, d)).tolist())
        e = whitening.symmetric_functions(spark, m)
        for at in (-3, 0, 1, 10**6):
            value = sum((-1) ** k * v * at ** (d - k) for k, v in enumerate(e))
            assert value == determinant([[(at if i == j else 0) - m[i][j] for j in range(d)] for i in range(d)])


def test_roots_are_counted_and_isolated():
    roots = [7, 7, 5, 2, 0, 0]
    e = [1]
    for r in roots:
        e = [a + r * b for a, b in zip([*e, 0], [0, *e], strict=True)]
    assert [whitening.roots_above(e, a) for a in (-1, 0, 1, 2, 4, 5, 6, 7)] == [6, 4, 4, 3, 3, 2, 2, 0]
    found = whitening.largest_roots(e, 8)
    assert len(found) == 4 and all(abs(f - r) <= Fraction(1, 2**100) for f, r in zip(found, roots, strict=False))


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op12_whitening"](spark, sf).collect()
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert len(rows) == 8 * len(data) and {r.component for r in rows} == set(range(1, 9))
    x = np.array(integer_vectors([r.embedding for r in data]), float)
    e, _ = np.linalg.eigh(np.cov(x.T, bias=True))
    share = {r.component: r.explained for r in rows}
    np.testing.assert_allclose([share[c] for c in range(1, 9)], e[::-1][:8] / e.sum(), rtol=1e-8)
    assert rows[0].identity_error < 1e-8
