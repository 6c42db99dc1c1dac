"""The two scorers: accuracy on held-out rows, brute-force checks of their parts, hard rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import quality_rules as qr
from tarnwell.llm import queries
from tarnwell.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    return ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()


@pytest.mark.parametrize(("name", "label", "modulus", "held", "least"), [("op2_quality_rules", "quality", 3, 1, 0.97), ("op4_toxicity", "toxic", 5, 0, 0.75)])
def test_held_out_rows(spark, name, label, modulus, held, least):
    rows = queries.QUERIES[name](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs == len({r.doc_id for r in rows})
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in known])
    assert auc(np.array([r.score for r in known]), y) >= least
    assert np.mean([r.predicted == v for r, v in zip(known, y)]) >= 0.9


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in tx.toxicity_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("score", [qr.quality_scores, tx.toxicity_scores])
def test_hard_rows(spark, make_docs, hard_pairs, score):
    docs = make_docs(hard_pairs)
    shape = "doc_id long, quality int, toxic int, extra string"
    none = spark.createDataFrame([], shape)
    some = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(17)] + [(None, 1, 1, "x"), (3, None, None, "x"), (6, 0, 0, "x")], shape)
    for labels in (none, some):
        got = score(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in hard_pairs)
        assert all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, None)}) <= 3
    assert {r.score for r in score(docs, none).collect()} == {0.5}
    assert score(make_docs([]), some).count() == 0


def test_keep_good_keeps_columns_and_rows(spark, make_docs, hard_pairs):
    docs = make_docs(hard_pairs)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = qr.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(hard_pairs)  # a score of 0.5 is good


def test_statistics_of_a_text():
    got = dict(zip(qr.STATISTICS, qr.text_statistics(pa.array(["AB cd cd. x1\n\nAB cd", None]))[0]))
    assert np.isclose(got["log_words"], np.log1p(6)) and np.isclose(got["upper_share"], 4 / 11) and np.isclose(got["digit_share"], 1 / 19)
    assert np.isclose(got["distinct_words"], 4 / 6) and np.isclose(got["upper_words"], 2 / 6) and got["distinct_lines"] == 1.0
    assert not qr.text_statistics(pa.array(["", None])).any()


def test_rules_are_compiled_to_columns(spark):
    paths = qr.tree_paths("Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 1 > 2.0)\n      Predict: 1.0\n     Else (feature 1 <= 2.0)\n      Predict: 0.0\n    Else (feature 2 > 0.5)\n     Predict: 0.0\n")
    assert paths == [((2, False, 0.5),), ((2, False, 0.5), (1, True, 2.0)), ((2, False, 0.5), (1, False, 2.0)), ((2, True, 0.5),)]
    model = qr.RuleModel((qr.Rule(paths[1], 1.5), qr.Rule(paths[3], -2.0)), 0.25)
    data = [(0.0, 3.0, 0.1), (0.0, 1.0, 0.1), (0.0, 3.0, 0.9)]
    got = [r[0] for r in spark.createDataFrame(data, "a double, b double, c double").select(model.score([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-x)) for x in (1.75, 0.25, -1.75)])


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(9)
    n, terms, queries_ = 300, 40, 60

    def sparse(m):
        dense = rng.random((m, terms)) * (rng.random((m, terms)) < 0.1)
        dense[0] = 0
        dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
        rows, cols = np.nonzero(dense)
        return dense, rows, cols, dense[rows, cols]

    examples, r, t, w = sparse(n)
    index = tx.BlockMaxIndex.build(np.arange(n), rng.integers(0, 2, n), r, t, w, terms)
    asked, r, t, w = sparse(queries_)
    without = rng.integers(0, n, queries_)
    for hide in (None, without):
        sims, best = index.nearest(r, t, w, queries_, 7, hide)
        full = asked @ examples[index.ids].T
        if hide is not None:
            full[np.arange(queries_), hide] = 0
        for q in range(queries_):
            want = [x for x in np.sort(full[q])[::-1][:7] if x > 1e-15]
            assert np.allclose(sims[q][: len(want)], want) and (best[q][len(want) :] == -1).all()
            assert np.allclose(full[q, best[q][: len(want)]], want)


def test_calibration_rises():
    x, y = tx._steps(np.array([0.1, 0.2, 0.3, 0.9, 0.8]), np.array([0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and np.isclose(y[-1], 1)


def test_terms_are_words_and_stems():
    rows, terms, counts = tx.term_counts(pa.array(["Loweischaft, loweiig! a", "b", None]))
    assert rows.tolist().count(0) == 4 and rows.tolist().count(1) == 1 and sorted(counts.tolist()) == [1, 1, 1, 1, 2]


def test_frequent_terms_held_by_blocks_change_nothing():
    rng = np.random.default_rng(4)
    n, terms = 500, 60
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < rng.random(terms))
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    r, t = np.nonzero(dense)
    for frequent in (1, 200, n + 1):
        index = tx.BlockMaxIndex.build(np.arange(n), np.zeros(n, int), r, t, dense[r, t], terms, frequent)
        sims, best = index.nearest(r, t, dense[r, t], n, 7)
        full = np.round(dense @ dense[index.ids].T, 12)
        assert np.allclose(sims, -np.sort(-full, axis=1)[:, :7], atol=1e-11) and np.allclose(np.take_along_axis(full, best, 1), sims, atol=1e-11)


def test_whole_query_is_brute_force_cosine_over_all_terms(spark):
    """Words that do not depend on the label, rare ones and words of no example count, and no example is left without a neighbour."""
    rng = np.random.default_rng(11)
    common, rare = [f"w{i}" for i in range(40)], [f"seldom{i}" for i in range(300)]
    texts = [" ".join([*rng.choice(common, 12), *rng.choice(rare, 3), *(["fresh%d" % (i % 9)] * (i % 3) if i % 5 == 1 else [])]) for i in range(150)] + ["", "nothingelse"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    marks = {i: int(i % 4 == 0) for i in range(150) if i % 5 != 1}
    labels = spark.createDataFrame([(i, y) for i, y in marks.items()], "doc_id long, toxic int")
    bags = []
    for t in texts:
        bag = {}
        for word in t.split():
            for term in [word, *(["/" + word[:5]] if len(word) > 5 else [])]:
                bag[term] = bag.get(term, 0) + 1
        bags.append(bag)
    df = {}
    for bag in bags:
        for term in bag:
            df[term] = df.get(term, 0) + 1
    vectors = [{term: (1 + np.log(c)) * max(np.log((len(texts) + 1) / (df[term] + 0.5)), 1e-6) for term, c in bag.items()} for bag in bags]
    norms = [np.sqrt(sum(w * w for w in v.values())) for v in vectors]
    chosen = [i for i in marks if zlib.crc32(str(i).encode()) % 5 != 0]
    got = {r.doc_id: r.evidence for r in tx.toxicity_scores(docs, labels).collect()}
    assert len(got) == len(texts)
    for i, v in enumerate(vectors):
        full = {j: sum(w * vectors[j].get(term, 0) for term, w in v.items()) / max(norms[i] * norms[j], 1e-12) for j in chosen}
        want = sorted((s for s in full.values() if s > 0), reverse=True)[:15]
        assert np.allclose([e.similarity for e in got[i]], want) and all(np.isclose(full[e.doc_id], e.similarity) and e.label == marks[e.doc_id] for e in got[i])
