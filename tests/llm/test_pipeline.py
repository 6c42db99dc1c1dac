import random
from collections import Counter

import corpus_pipeline
import numpy as np
import plain
import public_tokenizers as P
import pytest
from test_packing import check
from test_secrets import EXTRA
from tokenizers import Tokenizer

from tarnwell.llm import quality_rules, queries
from tarnwell.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), "stage")
        assert out.columns == columns and 0 < out.count() <= before, name
        if name != "secret scans":
            assert out.exceptAll(docs).isEmpty(), name
        docs, before = out, out.count()
    from tarnwell.llm import exact_dedup, jaccard_join, secrets

    assert exact_dedup.exact_duplicates(docs).where("not kept").isEmpty()
    assert jaccard_join.linked_components(docs).where("component_id < doc_id").isEmpty()
    assert secrets.find_secrets(docs).where("size(spans) > 0").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_hard_rows(spark, make_docs, hard_pairs):
    docs = make_docs(hard_pairs)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "stage")
    assert docs.count() > 0


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, make_docs, k):
    out = corpus_pipeline.STAGES[k][1](spark, make_docs([]), SF)
    assert out.count() == 0


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with the small documents and planted rows: copies, near copies, secrets, long, empty and null texts, rows without doc_id."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng, rows = random.Random(4), [r.asDict() for r in docs.collect()]
    good = [r for r in rows if 400 < len(r["text"] or "") < 4000][:40]

    def add(doc_id, text):
        rows.append({"doc_id": doc_id, "text": text, "lang": "en", "source": None, "n_chars": len(text) if text is not None else None})

    for k, r in enumerate(good):
        words = r["text"].split(" ")
        if k % 4 == 0:  # exact copies, one of them without doc_id
            for c in range(k % 3 + 1):
                add(20_000 + 10 * k + c, r["text"])
            add(None, r["text"])
        elif k % 4 == 1:  # one word of the text is another
            words[rng.randrange(len(words))] = "changed"
            add(20_000 + 10 * k, " ".join(words))
        elif k % 4 == 2:
            words.insert(rng.randrange(len(words)), EXTRA[k % len(EXTRA)])
            words.insert(rng.randrange(len(words)), "password = abcdefghijkl0123")
            add(20_000 + 10 * k, " ".join(words))
        else:
            add(20_000 + 10 * k, " ".join(x["text"] for x in rng.sample(good, 12)))
    for i, t in ((30_000, None), (30_001, ""), (30_002, " \n"), (None, None), (30_003, "a"), (30_003, "a")):
        add(i, t)
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def bag(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def test_every_stage_and_the_whole_run_are_as_in_plain_python(spark, planted):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_rules.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    steps = [
        lambda rs: [r for r in rs if plain.score(model, r["text"]) >= 0.5],
        plain.without_exact_copies,
        plain.without_near_copies,
        lambda rs: [r | {"text": plain.redacted(r["text"]), "n_chars": r["n_chars"] if r["text"] is None else len(plain.redacted(r["text"]))} for r in rs],
    ]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps, strict=False):
        want = step(rows)
        docs = materialise(stage(spark, docs, folder), "stage")
        got = [r.asDict() for r in docs.collect()]
        if name == "exact dedup":  # of rows that repeat doc_id and text any stays: they differ in nothing here
            assert len(got) == len(want)
        assert bag(got) == bag(want), name
        assert 0 < len(want) < len(rows) or name == "secret scans"
        rows = got
    assert any("<assign>" in (r["text"] or "") for r in rows)
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))

    def ids(text):
        return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")

    pairs = [(r["doc_id"], r["text"]) for r in rows]
    check(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), pairs, ids, 2_048)
    check(corpus_pipeline.run(spark, folder).collect(), pairs, ids, 2_048)


def test_quality_scores_of_whole_texts_are_those_of_the_rules(spark, planted):
    folder, rows = planted
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.fit_on(docs, labels)
    assert model.rules
    got = sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in queries.QUERIES["op2_quality_rules"](spark, folder).collect())
    scores = [(str(r["doc_id"]), plain.score(model, r["text"])) for r in rows]
    assert got == sorted((i, round(s, 9), int(s >= 0.5)) for i, s in scores)
