"""Operators against brute force on small fixtures."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell import schemas
from tarnwell.operators import dedup, fulltext, fusion, knn, layout, shards, skew, sync
from tarnwell.plans import catalogue as cat
from tarnwell.plans import index as ix
from tarnwell.plans import retrieval as rt
from tarnwell.plans import state as st
from tarnwell.plans.models import hash_embedder, pandas_extractor
from tarnwell.settings import RETRIEVAL


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_knn_in_slices_and_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(130, 8)), rng.normal(size=(37, 8))
    v[40:60] = v[0]  # exact copies tie by id
    vf = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "row_id long, embedding array<double>")
    qf = spark.createDataFrame([(i, [float(x) for x in r], 5 + i % 3) for i, r in enumerate(q)], "query_id long, embedding array<double>, lim int")
    got = knn.knn_join(qf, vf, "query_id", ["row_id"], "lim", slice_rows=20, block_queries=10)
    want = []
    for i, a in enumerate(q):
        d = np.round(1 - v @ a / np.linalg.norm(v, axis=1) / np.linalg.norm(a), 9)
        want += [(i, j, r + 1) for r, j in enumerate(sorted(range(130), key=lambda j: (d[j], j))[: 5 + i % 3])]
    assert rows(got, "query_id", "row_id", "rank") == sorted(want)


def test_knn_per_cell_ranks_inside_each_cell(spark):
    vf = spark.createDataFrame([(i, i % 3, [float(i), 1.0]) for i in range(12)], "row_id long, cell int, embedding array<double>")
    qf = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<double>")
    got = knn.knn_join(qf, vf, "query_id", ["row_id"], 2, cell="cell", slice_rows=4)
    assert rows(got, "cell", "row_id", "rank") == [(0, 0, 1), (0, 3, 2), (1, 1, 1), (1, 4, 2), (2, 2, 1), (2, 5, 2)]


DOCS = ["the quick brown fox", "quick the fox", "Wi-Fi setup guide", "wifi or not", "fox fox brown the", "guide to setup the wi fi"]


def _matches(text, doc):
    def norm(s):
        return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())

    body = f" {norm(doc)} "
    import re

    for alt in re.split(r"\s+or\s+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", text):
        items = re.findall(r'-?"[^"]*"|\S+', alt)
        pos = [norm(i) for i in items if not i.startswith("-") and norm(i)]
        neg = [norm(i) for i in items if i.startswith("-") and norm(i)]
        if pos and all(f" {p} " in body for p in pos) and not any(f" {n} " in body for n in neg):
            return True
    return False


def test_full_text_equals_brute_force(spark):
    asked = ["quick fox", '"quick fox" or wifi', "fox -quick", "wi-fi", '"the fox"', "missing", "-fox", "the", 'setup "wi fi" or "brown fox"']
    q = spark.createDataFrame(list(enumerate(asked)), "q int, text string")
    d = spark.createDataFrame(list(enumerate(DOCS)), "doc int, body string")
    got = fulltext.fts_match(fulltext.search_clauses(q, "q", "text"), fulltext.search_document(d, {"body": "A"}), "q", ["doc"], salts=3)
    want = [(i, j) for i, a in enumerate(asked) for j, b in enumerate(DOCS) if _matches(a, b)]
    assert sorted(set(rows(got, "q", "doc"))) == want


def test_phrase_may_cross_fields_and_labels_weigh(spark):
    d = spark.createDataFrame([(1, "alpha beta", "gamma beta")], "doc int, a string, b string")
    q = spark.createDataFrame([(1, '"beta gamma"')], "q int, text string")
    m = fulltext.fts_match(fulltext.search_clauses(q, "q", "text"), fulltext.search_document(d, {"a": "A", "b": "D"}), "q", ["doc"])
    got = m.select(fulltext.weighted_hits("fts_fields", "terms").alias("h"), fulltext.cover_density_rank("fts_fields", "terms").alias("c")).first()
    assert got["h"] == pytest.approx(1.0 + 0.1 + 0.1)
    assert got["c"] == pytest.approx(2 * (2 / (1 / 1.0 + 1 / 0.1)) / 2 + 2 / (1 / 0.1 + 1 / 0.1))


def test_cover_density_counts_minimal_stretches():
    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randint(1, 3)
        places = sorted(rnd.sample(range(30), rnd.randint(1, 9)))
        hits = [(p, rnd.randrange(n), rnd.choice([1.0, 0.4, 0.1])) for p in places]
        covers = [
            (i, j) for i in range(len(hits)) for j in range(i, len(hits)) if {h[1] for h in hits[i : j + 1]} == set(range(n))
        ]
        minimal = [c for c in covers if not any(o != c and o[0] >= c[0] and o[1] <= c[1] for o in covers)]
        want = 0.0
        for i, j in minimal:
            inside = hits[i : j + 1]
            want += len(inside) / sum(1 / h[2] for h in inside) / (1 + (hits[j][0] - hits[i][0]) - (len(inside) - 1))
        assert fulltext.cover_density(hits, n) == pytest.approx(want)


def _scores(spark, values):
    return spark.createDataFrame([(1, f"d{i:02d}", float(s)) for i, s in enumerate(values)], "query_id int, kbid string, rrf_score double")


@pytest.mark.parametrize(
    "values, want, mode",
    [([0.4], 1, "direct"), ([0.9, 0.1], 2, "rerank"), ([0.9, 0.6, 0.4], 2, "rerank"), ([0.9, 0.5, 0.4], 2, "rerank"), ([1, 0.9, 0.85, 0.2], 3, "rerank"), ([1] * 14, 10, "rerank")],
)
def test_select_candidates(spark, values, want, mode):
    got = fusion.select_candidates(_scores(spark, values), ["query_id"]).collect()
    assert len(got) == want and {r["mode"] for r in got} == {mode}


def test_fusion_ignores_row_order_and_handles_one_row_signals(spark):
    v = spark.createDataFrame([(1, "a", 0.2, True), (1, "b", 0.6, False)], "q int, kbid string, vector_distance double, vector_exact_match boolean")
    k = spark.createDataFrame([(1, "b", 2.0)], "q int, kbid string, fts_keywords_rank double")
    s = spark.createDataFrame([(1, "b", 1.0), (1, "c", 3.0)], "q int, kbid string, fts_summaries_rank double")
    got = {r["kbid"]: r["rrf_score"] for r in fusion.fuse_signals(v, k, s, ["q"]).collect()}
    assert got["a"] == pytest.approx(0.45 + 0.20)
    assert got["b"] == pytest.approx(0.0 + 0.25 + 0.0 + 0.30)
    assert got["c"] == pytest.approx(0.30)
    again = {r["kbid"]: r["rrf_score"] for r in fusion.fuse_signals(v.orderBy("kbid"), k, s.orderBy(F.desc("kbid")), ["q"]).collect()}
    assert got == again


def _candidates(spark, data):
    names = "query_id int, kbid string, rrf_score double, position int, article_title string, primary_topic string, summary string"
    df = spark.createDataFrame(data, names)
    blank = F.lit("")
    return df.withColumns({c: blank for c in ("primary_intent", "query_triggers", "snippet", "acronyms", "secondary_entities")}).withColumn("raw_query", F.lit("reset vpn token"))


def test_scorer_rerank_settles_ties_by_family(spark):
    data = [
        (1, "a", 0.9, 1, "reset vpn", "vpn", ""), (1, "b", 0.8, 2, "reset vpn token", "vpn", ""), (1, "c", 0.7, 3, "reset vpn token", "mail", ""),
        (2, "x", 0.9, 1, "reset vpn token now", "one", ""), (2, "y", 0.8, 2, "unrelated", "two", ""),
    ]
    got = dict(rows(rt.rerank(_candidates(spark, data), ["query_id"], "scorer"), "query_id", "kbid"))
    # Query 1: b and c tie; representatives are a (vpn) and c (mail), c scores higher.
    assert got == {1: "c", 2: "x"}


def test_lexical_rerank_falls_back_for_unknown_strategy(spark):
    data = [(1, "a", 0.5, 1, "other", "", ""), (1, "b", 0.5, 2, "reset vpn token", "", "")]
    assert rows(rt.rerank(_candidates(spark, data), ["query_id"], "nothing"), "kbid") == [("b",)]


def test_tournament_deals_large_pools(spark):
    data = [(1, f"k{i:02d}", 1 - i / 100, i + 1, "reset vpn token" if i == 11 else "reset", "", "") for i in range(13)]
    assert rows(rt.rerank(_candidates(spark, data), ["query_id"], "tournament"), "kbid") == [("k11",)]


def test_salted_join_and_positions_with_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    small = big.select("key").distinct().withColumn("v", F.length("key"))
    assert skew.salted_join(small, big, ["key"], ["id"], 7).count() == 3000
    placed = skew.ordered_positions(big, ["key"], [F.asc("id")], F.col("id"), "p", buckets=8)
    want = {}
    expect = []
    for r in sorted(big.collect(), key=lambda r: r["id"]):
        want[r["key"]] = want.get(r["key"], 0) + 1
        expect.append((r["key"], r["id"], want[r["key"]]))
    assert rows(placed, "key", "id", "p") == sorted(expect)


def test_join_to_copies_splits_hot_contents(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_ROWS", 100)
    monkeypatch.setattr(dedup, "HOT_SHARE", 0.1)
    df = spark.range(1000).select("id", F.when(F.col("id") < 400, "same").otherwise(F.col("id").cast("string")).alias("text"))
    done = dedup.dedup_apply(df, "text", lambda u: u.select("content_hash", F.upper("text").alias("up")), ["id"])
    assert done.where("upper(text) = up").count() == 1000
    assert dedup.occurrences(df, "text", ["id"]).where("is_first").count() == 601


def _sequential(free, docs, last, size):
    out, shard = [], dict(free)
    for _ in range(docs):
        s = next((k for k in sorted(shard) if shard[k] > 0), None)
        if s is None:
            last += 1
            shard[last] = size
            s = last
        shard[s] -= 1
        out.append(s)
    return out


@pytest.mark.parametrize("registry", [[], [(0, 5, 5)], [(0, 5, 5), (2, 3, 5), (5, 4, 5)]])
def test_assign_shards_equals_one_by_one(spark, registry):
    reg = spark.createDataFrame([("c", s, n, m) for s, n, m in registry], "kb_collection_id string, shard_id int, doc_count int, max_shard_size int")
    docs = spark.createDataFrame([("c", i) for i in range(17)], "kb_collection_id string, doc_id long")
    got = [r[1] for r in rows(shards.assign_shards(docs, reg, max_size=5), "doc_id", "shard_id")]
    assert got == _sequential({s: m - n for s, n, m in registry}, 17, max([s for s, _, _ in registry], default=-1), 5)
    counts = shards.update_registry(reg, shards.assign_shards(docs, reg, max_size=5), 5)
    assert counts.where("doc_count > max_shard_size").count() == 0


def test_snapshot_diff_and_guard(spark):
    src = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-01-01"), ("n", None), ("c", "2024-01-01")], "doc_key string, updated_at string")
    idx = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), ("d", "2024-01-01"), ("c", None)], "doc_key string, updated_at string")
    diff = sync.snapshot_diff(src, idx)
    assert rows(diff, "doc_key", "label") == [("a", "updated"), ("b", "unchanged"), ("c", "updated"), ("d", "deleted"), ("n", "new")]
    assert sync.purge_guard(diff, idx).count() == 5
    emptied = sync.snapshot_diff(src.limit(0), idx)
    assert sync.purge_guard(emptied, idx).count() == 0


def test_merge_layout_breaks_on_wide_gaps(spark):
    data = [(1, 0.0, 0.0, "a", False), (1, 10.0, 0.0, "b", False), (1, 12.0, 5.0, "[pic]", True), (1, 60.0, 0.0, "c", False), (2, 1.0, 0.0, " ", False), (2, 2.0, 0.0, "only", False)]
    df = spark.createDataFrame(data, "doc int, y double, x double, content string, is_image boolean")
    # Document 1: text gaps 10 and 50, mean 30, so more than 45 breaks.
    assert rows(layout.merge_layout(df, ["doc"]), "doc", "content") == [(1, "a b [pic]\n\nc"), (2, "only")]


def test_consolidate_items_folds(spark):
    items = spark.createDataFrame(
        [(1, "Okta", "sso", "", 1), (1, "okta", "single sign", "abc", 2), (1, "OKTA", "other sign ", "abd", 3), (1, "Jamf", None, None, 4)],
        "shard_id int, item string, purpose string, method string, ord int",
    )
    got = rows(cat.consolidate_items(items, ["shard_id"]), "item_key", "item", "purpose", "method")
    assert got == [("jamf", "Jamf", "", ""), ("okta", "Okta", "single sign", "abc")]


def test_normalize_queries_fallback_and_moves(spark):
    q = spark.createDataFrame(
        [(1, "VPN help please", '{"keywords":{"specific":["printer","EndNote 21"],"generic":"setup"},"category":"Software"}'), (2, "", None), (3, "vpn token", "broken {")],
        "query_id int, raw_query string, extracted string",
    )
    got = {r["query_id"]: r for r in ix.normalize_queries(q).collect()}
    assert got[1]["specific"] == ["EndNote 21"] and got[1]["generic"] == ["printer", "setup"] and got[1]["acronyms"] == ["VPN"]
    assert got[1]["category"] == "software" and got[1]["usecase"] == ["vpn help please"]
    assert got[2]["usecase"] == [] and got[2]["generic"] == []
    assert got[3]["search_phrases"] == ["vpn token"]


def test_enrichment_keeps_failures(spark):
    docs = spark.createDataFrame([("k1", "T", "body")], "doc_key string, title string, content string")

    def broken(batch):
        raise RuntimeError("no model")

    got = ix.enrich_documents(docs, pandas_extractor(broken)).first()
    assert got["stage"] == "extraction" and got["error"] == "no model"


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def _calls(spark):
    uid = "123e4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame(
        [(uid, "int-1", "old", '{"a":1}', "2024-01-01"), ("i2", None, "old", '{"external_call_id":"ext-2"}', "2024-01-02")],
        "id string, interaction_id string, status string, call_data string, created_at string",
    )
    return schemas.align(df, schemas.CALLS), uid


def test_upsert_calls_folds_in_order_and_is_repeatable(spark):
    calls, uid = _calls(spark)
    ups = spark.createDataFrame(
        [("int-1", 1, "ringing", '{"b":1}'), (uid, 2, None, '{"b":2,"c":null}'), ("ext-2", 3, "ended", None), ("new-9", 4, "started", None)],
        "call_ref string, arrived int, status string, call_data string",
    )
    nxt = st.upsert_calls(calls, ups, now())
    got = {r["id"]: r for r in nxt.collect()}
    assert len(got) == 3
    assert got[uid]["status"] == "ringing" and '"b":2' in got[uid]["call_data"] and '"a":1' in got[uid]["call_data"]
    assert got["i2"]["status"] == "ended"
    fresh = next(r for i, r in got.items() if i not in (uid, "i2"))
    assert fresh["interaction_id"] == "new-9" and fresh["status"] == "started"
    again = st.upsert_calls(nxt, ups, now())
    cols = ["id", "status", "interaction_id"]
    assert rows(again, *cols) == rows(nxt, *cols)


def test_patch_rejects(spark):
    calls, uid = _calls(spark)
    ups = spark.createDataFrame([(uid, 1, "x", None), ("nobody", 2, "x", None), (uid, 3, None, None)], "call_ref string, arrived int, status string, call_data string")
    _, rejects = st.patch_calls(calls, ups, now())
    assert rows(rejects, "arrived", "reject_reason") == [(2, "unknown call"), (3, "empty")]


def test_next_sequence_mixes_given_and_missing(spark):
    ev = spark.createDataFrame([("c", 1, "2024-01-01 00:00:02", None), ("c", 2, "2024-01-01 00:00:01", 40), ("d", 3, "2024-01-01 00:00:00", None)], "call_id string, event_id int, created_at string, sequence_number int")
    old = spark.createDataFrame([("c", 7)], "call_id string, sequence_number int")
    assert rows(st.next_sequence(ev, old), "event_id", "sequence_number") == [(1, 41), (2, 40), (3, 1)]


def test_hash_embedder_is_a_word_count():
    m = hash_embedder(16)(["a b a", "", "B a a"])
    assert m[0].sum() == 3 and m[1].sum() == 0 and (m[0] == m[2]).all()


def test_defaults_sum_to_one():
    assert math.isclose(RETRIEVAL.vector_weight + RETRIEVAL.keyword_weight + RETRIEVAL.summary_weight, 1.0)


def test_snippets_are_the_best_passages(spark):
    from tarnwell.functions.fuzzy import ratio
    from tarnwell.plans.retrieval import best_snippets

    long = " ".join(f"w{i}" for i in range(400))
    cases = [
        ("one two three\n\n  red green blue  \n\n\nfour", "green blue"), (long + "\n\nlast words here", "w390 w391"), ("", "x y"), (None, "x y"), ("abc def", None),
        ("same text\n\nsame text", "same text"), ("a\n\nb", "!!"), (" \n\n ", "ab cd"),
    ]
    got = {r["k"]: r["snippet"] for r in best_snippets(spark.createDataFrame([(i, b, q) for i, (b, q) in enumerate(cases)], "k int, b string, q string"), "b", "q", 50).collect()}

    def words(text):
        return {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 1}

    for i, (body, asked) in enumerate(cases):
        body, asked = (body or "").strip(), (asked or "").strip()
        parts = [p.strip() for p in re.split("\n{2,}", body)]
        parts = [x for p in parts if p for x in ([p[k : k + 600] for k in range(0, len(p), 350)] if len(p) > 600 else [p])]
        scored = [(0.7 * (len(words(p) & words(asked)) / len(words(p) | words(asked)) if words(p) else 0) + 0.3 * ratio(asked, p[:300]), -k) for k, p in enumerate(parts)]
        assert got[i] == (parts[-max(scored)[1]] if scored and words(asked) else body)[:50], i


def test_a_passage_is_split_into_words_once(spark):
    from tarnwell.plans.retrieval import best_snippets

    rows = best_snippets(spark.createDataFrame([(1, "one two", "two")], "k int, b string, q string"), "b", "q")
    # Once for the passages and once for the question.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+") == 2


def test_lines_do_not_drift(spark):
    from tarnwell.operators import layout

    steps = spark.createDataFrame([("p", float(i), 4.0 * i, f"w{i}") for i in range(6)], "page string, x double, y double, text string")
    assert sorted(r["content"] for r in layout.words_to_lines(steps, ["page"]).collect()) == ["w0 w1", "w2 w3", "w4 w5"]


def test_a_line_costs_its_own_words_only(spark):
    import time

    from pyspark.sql import functions as F
    from tarnwell.operators import layout

    n = 20_000
    page = spark.range(0, n, 1, 1).select(F.lit("p").alias("page"), F.lit(0.0).alias("x"), (F.col("id") * 10.0).alias("y"), F.concat(F.lit("w"), "id").alias("text"))
    layout.words_to_lines(page.limit(10), ["page"]).collect()
    start = time.perf_counter()
    got = layout.words_to_lines(page, ["page"]).collect()
    # Words that carry and search all lines of their page took several times as long.
    assert time.perf_counter() - start < 12
    assert sorted((r["y"], r["x"], r["content"]) for r in got) == [(i * 10.0, 0.0, f"w{i}") for i in range(n)]


def test_lines_of_words_without_a_place_and_of_equal_places(spark):
    from tarnwell.operators import layout

    nan, inf = math.nan, math.inf
    rows = [
        (None, 1.0, None, "c"), (None, None, None, "b"), (None, 2.0, None, None), (None, 3.0, 7.9, "e"), (None, 3.0, 11.9, "d"), (None, 3.0, 7.9, "d"), (None, None, 12.0, "f"),
        ("a", nan, 1.0, "z"), ("a", 2.0, 1.0, "y"), ("a", 1.0, nan, "n"), ("a", 0.0, inf, "i"), ("a", 5.0, -inf, "j"), ("a", 4.0, -0.0, "q"), ("b", None, None, None),
    ]
    got = layout.words_to_lines(spark.createDataFrame(rows, "page string, x double, y double, text string"), ["page"]).collect()
    want = [
        (None, None, 1.0, "b c"), (None, 9.233333, 3.0, "d e d"), (None, 12.0, None, "f"), ("a", -inf, 5.0, "j"), ("a", 0.333333 * 2, 2.0, "y q z"), ("a", inf, 0.0, "i"),
        ("a", nan, 1.0, "n"), ("b", None, None, ""),
    ]
    assert sorted(str((r["page"], r["y"] if r["y"] is None else round(r["y"], 5), r["x"], r["content"])) for r in got) == sorted(str((p, y if y is None else round(y, 5), x, c)) for p, y, x, c in want)


def test_numbers_at_any_depth_and_null_keys(spark):
    from tarnwell.functions import jsonops as js
    from tarnwell.operators import skew

    deep = '{"a":' * 9 + '{"n": 4, "s": "}{[\\"]"}' + "}" * 9
    got = js.numeric_totals(spark.createDataFrame([("k", deep), ("k", '{"n": 1}'), ("k", None)], "k string, j string"), ["k"], "j").collect()
    assert {(r["path"], r["total"]) for r in got} == {(".".join(["a"] * 9 + ["n"]), 4.0), ("n", 1.0)}
    rows_ = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "k string, v int")
    placed = skew.ordered_positions(rows_, ["k"], [F.asc("v")], F.col("v"))
    assert sorted((str(r["k"]), r["v"], r["position"]) for r in placed.collect()) == [("None", 1, 1), ("None", 3, 2), ("a", 2, 1)]


def test_numbers_after_a_given_one(spark):
    ev = spark.createDataFrame([("c", 1, "2024-01-01 00:00:00", 3), ("c", 2, "2024-01-01 00:00:01", None), ("c", 3, "2024-01-01 00:00:02", None), (None, 4, "2024-01-01 00:00:02", None)], "call_id string, event_id int, created_at string, sequence_number int")
    old = spark.createDataFrame([], "call_id string, sequence_number int")
    assert rows(st.next_sequence(ev, old), "event_id", "sequence_number") == [(1, 3), (2, 4), (3, 5), (4, 1)]


def test_requests_of_a_key_follow_each_other(spark):
    from tarnwell import schemas
    from tarnwell.schemas import align

    stored = align(spark.createDataFrame([("d1", "a", "n", "main", "pending", "deployed")], "id string, agent_name string, namespace string, deployment_name string, workflow_status string, desired_state string"), schemas.DEPLOYMENTS)
    asked = [(1, "a", "deployed", "u1"), (2, "a", "deleted", "u2"), (3, "a", "deleted", "u3"), (4, "a", "deployed", None), (5, "b", "deployed", "u5"), (6, "b", "deployed", "u6")]
    req = spark.createDataFrame([(i, a, "n", "main", s, by, "img") for i, a, s, by in asked], "arrived int, agent_name string, namespace string, deployment_name string, desired_state string, requested_by string, image string")
    nxt, events = st.enqueue_requests(stored, req, F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r["agent_name"], r["desired_state"], r["workflow_status"], r["requested_by"]) for r in nxt.collect()) == [("a", "deployed", "pending", "u2"), ("b", "deployed", "pending", "u5")]
    kinds = [r["event_type"] for r in events.collect()]
    assert kinds.count("request_enqueued") == 3 and kinds.count("request_deduplicated") == 3


@pytest.mark.parametrize("buckets", [1, 5])
def test_requests_over_buckets_equal_one_after_another(spark, buckets):
    from tarnwell import schemas
    from tarnwell.schemas import align

    rnd = random.Random(buckets)
    keys = ["hot", "hot", "hot", "a", "b", "c"]
    stored = align(spark.createDataFrame([("d1", "hot", "n", "m", "pending", "on", "ready", "healthy"), ("d2", "a", "n", "m", "ready", "on", "ready", "healthy")], "id string, agent_name string, namespace string, deployment_name string, workflow_status string, desired_state string, runtime_status string, health_status string"), schemas.DEPLOYMENTS)
    asked = [(i // 2, rnd.choice(keys), rnd.choice(["on", "on", "off"]), rnd.choice(["u1", "u2", None])) for i in range(300)]
    req = spark.createDataFrame([(i, a, "n", "m", s, by, "img") for i, a, s, by in asked], "arrived int, agent_name string, namespace string, deployment_name string, desired_state string, requested_by string, image string")
    nxt, events = st.enqueue_requests(stored, req, F.lit("2024-01-01").cast("timestamp"), buckets=buckets)
    state, changed, by, want = {"hot": "on"}, set(), {}, []
    for i, a, s, who in sorted(asked, key=lambda r: (r[0], r[2], r[3] is not None, r[3] or "")):
        same = state.get(a) == s
        state[a] = s
        if not same:
            changed.add(a)
            by[a] = who or by.get(a)
        before = {"hot": ("pending", "ready", "healthy"), "a": ("ready", "ready", "healthy")}.get(a, ("pending", None, None))
        want.append((a, "request_deduplicated" if same else "request_enqueued", *(("pending", "unknown", "unknown") if a in changed else before)))
    names = {"d1": "hot", "d2": "a"} | {r["id"]: r["agent_name"] for r in nxt.collect() if r["agent_name"] not in ("hot", "a")}
    got = [(names[r["deployment_id"]], r["event_type"], r["workflow_status"], r["runtime_status"], r["health_status"]) for r in events.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r["agent_name"]: (r["desired_state"], r["requested_by"]) for r in nxt.collect()} == {a: (state[a], by.get(a)) for a in state}


@pytest.mark.parametrize("buckets", [1, 6])
def test_numbers_over_buckets_equal_one_after_another(spark, buckets):
    rnd = random.Random(buckets)
    ev = [(rnd.choice(["hot", "hot", "b", None]), i, f"2024-01-01 00:{rnd.randrange(60):02d}:00", rnd.choice([None, None, rnd.randrange(80)])) for i in range(200)]
    frame = spark.createDataFrame(ev, "call_id string, event_id int, created_at string, sequence_number int")
    old = spark.createDataFrame([("hot", 7), ("hot", 3), (None, 2)], "call_id string, sequence_number int")
    last, want = {"hot": 7, None: 2}, []
    for c, i, _, n in sorted(ev, key=lambda r: (r[2], r[1])):
        number = n if n is not None else last.get(c, 0) + 1
        last[c] = max(last.get(c, 0), number)
        want.append((i, number))
    assert rows(st.next_sequence(frame, old, buckets=buckets), "event_id", "sequence_number") == sorted(want)


def test_two_references_of_one_unknown_call_are_one_insert(spark):
    from tarnwell import schemas
    from tarnwell.schemas import align

    calls = align(spark.createDataFrame([], "id string"), schemas.CALLS)
    u = "0f8fad5b-d9cb-469f-a165-70867728950e"
    up = spark.createDataFrame([(u, 1, "int-1", None), ("int-1", 2, None, "ended")], "call_ref string, arrived int, interaction_id string, status string").withColumn("call_data", F.lit(None).cast("string"))
    got = st.upsert_calls(calls, up, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["id"], r["interaction_id"], r["status"]) for r in got] == [(u, "int-1", "ended")]


def test_stored_rows_that_are_newer_stay(spark):
    now, new = (spark.createDataFrame(x, "k string, v string, seen int") for x in ([("a", "old", 9), ("b", "old", 1)], [("a", "new", 1), ("b", "new", 2)]))
    got = st.replace_rows(now, new, ["k"], [F.desc("seen")], stored_too=True).collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", "old"), ("b", "new")]


def test_collections_may_use_the_same_keys(spark):
    def articles(rows_):
        made = spark.createDataFrame(rows_, "id string, number string, content string, knowledgebase_collection_id string, s int")
        return made.select("*", F.lit("plain").alias("name"), F.timestamp_seconds("s").alias("updated_at"), F.lit(False).alias("is_deleted"), F.lit("o").alias("org_id"))

    none = [spark.createDataFrame([], s) for s in (schemas.KB_KEYWORDS, schemas.KB_SUMMARIES)]
    registry = spark.createDataFrame([], "kb_collection_id string, shard_id int, doc_count int, max_shard_size int")
    body = "Printer Setup needs the Network Driver to be installed first."
    first = ix.sync_job(articles([("1", "KB1", body, "c1", 1), ("2", "KB1", body + " Twice.", "c2", 1), ("3", "KB2", body, None, 1)]), *none, registry)
    assert rows(first.summaries, "kb_collection_id", "doc_id") == [("", "KB2"), ("c1", "KB1"), ("c2", "KB1")]
    assert rows(first.outcomes, "kb_collection_id", "outcome") == [("", "inserted"), ("c1", "inserted"), ("c2", "inserted")]
    again = ix.sync_job(articles([("1", "KB1", body, "c1", 1), ("3", "KB2", body, None, 2)]), first.keywords, first.summaries, first.registry)
    assert rows(again.summaries, "kb_collection_id", "doc_id") == [("", "KB2"), ("c1", "KB1")]
    assert rows(again.diff, "kb_collection_id", "label") == [("", "updated"), ("c1", "unchanged"), ("c2", "deleted")]
    assert {r["kb_collection_id"] for r in again.keywords.select("kb_collection_id").distinct().collect()} == {"", "c1"}


def test_a_sync_makes_all_rows_of_its_tables(spark):
    """The next tables are made by the sync itself, not left to who reads them; rows that go are not in them."""
    def articles(*keys):
        at = spark.createDataFrame([(k, k, f"Printer {k} needs the Network Driver to be installed first.") for k in keys], "id string, number string, content string")
        return at.select("*", F.lit("c1").alias("knowledgebase_collection_id"), F.lit("plain").alias("name"), F.timestamp_seconds(F.lit(1)).alias("updated_at"), F.lit(False).alias("is_deleted"), F.lit("o").alias("org_id"))

    held = [spark.createDataFrame([("c1", "KB9")], f"kb_collection_id string, {key} string") for key in ("kbid", "doc_id")]
    state = [schemas.align(held[0], schemas.KB_KEYWORDS), schemas.align(held[1].withColumn("shard_id", F.lit(0)), schemas.KB_SUMMARIES)]
    registry = spark.createDataFrame([("c1", 0, 1, 200)], "kb_collection_id string, shard_id int, doc_count int, max_shard_size int")
    done = ix.sync_job(articles("KB1", "KB2"), *state, registry)
    for table in (done.keywords, done.summaries, done.registry):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and "Join" not in plan
    assert rows(done.summaries, "doc_id") == [("KB1",), ("KB2",)] and {r["kbid"] for r in done.keywords.collect()} == {"KB1", "KB2"}
    assert rows(done.registry, "doc_count") == [(2,)]


def test_free_slots_are_ranges(spark):
    """A registry with room for very many documents is not told slot by slot."""
    registry = spark.createDataFrame([("c", i, i % 3, 40_000) for i in range(200)] + [("d", 7, 0, 3)], "kb_collection_id string, shard_id int, doc_count int, max_shard_size int")
    docs = spark.createDataFrame([("c", i) for i in range(1, 50_001)] + [("d", i) for i in range(1, 9)], "kb_collection_id string, doc_id long")
    placed = shards.assign_shards(docs, registry, max_size=4)
    assert rows(placed.where("kb_collection_id = 'd'"), "doc_id", "shard_id") == [(i, 7 if i <= 3 else 8 if i <= 7 else 9) for i in range(1, 9)]
    assert rows(placed.where("kb_collection_id = 'c'").groupBy("shard_id").count(), "shard_id", "count") == [(0, 40_000), (1, 10_000)]
    ranges = shards.assign_shards(docs, registry, max_size=200)
    assert rows(ranges, "kb_collection_id", "doc_id") == rows(docs, "kb_collection_id", "doc_id")
    room = registry.withColumn("free", F.col("max_shard_size") - F.col("doc_count"))
    assert shards._slot_ranges(room, 40_000).count() <= 2 * registry.count()


def test_a_word_of_a_batch_is_hashed_once(monkeypatch):
    from tarnwell.plans import models

    asked = []
    real = models.hashlib.md5
    monkeypatch.setattr(models.hashlib, "md5", lambda b: asked.append(b) or real(b))
    found = hash_embedder(16)(["one two one", "", "two", "ONE"])
    assert sorted(asked) == [b"one", b"two"] and found.sum(axis=1).tolist() == [3, 0, 1, 1] and found.dtype == np.float32
    assert hash_embedder(16)([]).shape == (0, 16)
