import hashlib
from collections import defaultdict

import numpy as np

from tarnwell.llm import exact_dedup as xd


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    for bits in (0, 6):
        space = 1 << (64 - bits)
        parts = [np.unique(rng.integers(0, space, n, dtype=np.uint64) & np.uint64(space - 1)) for n in (0, 1, 50, 3000)]
        parts.append(parts[-1][::2])
        counts = [rng.integers(1, 9, len(p)).astype(np.uint64) for p in parts]
        lead = np.uint64(5 << (64 - bits) if bits else 0)
        blobs = [xd.encode_filter(p | lead, c, bits) for p, c in zip(parts, counts)]
        got, n = xd.merge_filters(blobs, 5 if bits else 0, bits)
        want = defaultdict(int)
        for p, c in zip(parts, counts):
            for x, y in zip(p, c):
                want[int(x | lead)] += int(y)
        assert dict(zip(got.tolist(), n.tolist())) == want and (np.diff(got.astype(object)) > 0).all()


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = []
    for i, t in pairs:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_hard_rows(make_docs, hard_pairs):
    got = xd.exact_duplicates(make_docs(hard_pairs)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == brute(hard_pairs)


def test_hot_group_is_salted(make_docs, monkeypatch):
    from tarnwell.llm import common

    monkeypatch.setattr(xd, "salts_of", lambda c, k, n, rows: common.salts_of(c, k, n, rows, least=10))
    pairs = [(i, "same" if i % 3 == 0 else f"text {i // 2}") for i in range(600)]
    got = xd.exact_duplicates(make_docs(pairs)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == brute(pairs)


def test_empty_table_and_keep_one(make_docs, hard_pairs):
    assert xd.exact_duplicates(make_docs([])).count() == 0
    docs = make_docs(hard_pairs)
    kept = xd.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(str((i, t)) for (i, t), row in zip(hard_pairs, [x for p in hard_pairs for x in brute_of(hard_pairs, p)]) if row)
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want


def brute_of(pairs, pair):
    own = [i for i, t in pairs if (t or "") == (pair[1] or "")]
    keep = max((x for x in own if x is not None), default=None)
    return [pair[0] == keep]


def test_stage_keeps_one_row_of_each_text(spark, make_docs, hard_pairs):
    import corpus_pipeline

    pairs = [*hard_pairs, *[(None, "nameless")] * 40, (50, "nameless too"), *[(51, "twice")] * 40, (None, None)]
    docs = make_docs(pairs)
    out = corpus_pipeline.exact_copies(spark, docs, "")
    assert out.columns == docs.columns
    best = {}
    for i, t in pairs:
        best[t or ""] = max((x for x in (i, best.get(t or "")) if x is not None), default=None)
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted(((i, t) for t, i in best.items()), key=str)
