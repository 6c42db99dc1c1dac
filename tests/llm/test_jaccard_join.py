import re
from collections import defaultdict

import numpy as np

from tarnwell.llm import jaccard_join as jj

WORDS = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(pairs, width, percent):
    sets = []
    for _, t in pairs:
        w = WORDS.findall((t or "").translate(UPPER))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            x, y = pairs[a][0], pairs[b][0]
            if x is None or y is None or not sets[a] or not sets[b]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                rx, ry = root(x), root(y)
                parent[max(rx, ry)] = min(rx, ry)
    return sorted([(i, len(s), None if i is None else (root(i) if s else i)) for (i, _), s in zip(pairs, sets)], key=str)


def rows(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


def test_hard_rows(make_docs, hard_pairs):
    assert rows(jj.linked_components(make_docs(hard_pairs))) == brute(hard_pairs, 5, 80)


def near_copies(seed, groups=6, members=14):
    rng = np.random.default_rng(seed)
    pairs, i = [], 0
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(int(rng.integers(12, 90)))]
        for _ in range(members):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[k] = f"x{rng.integers(0, 50)}"
            pairs.append((int(i), " ".join(w) + " common line at the end of all texts"))
            i += 1
    return pairs


def test_groups_of_near_copies(make_docs, monkeypatch):
    pairs = near_copies(5)
    want = brute(pairs, 5, 80)
    assert len({c for _, _, c in want}) > 8
    assert rows(jj.linked_components(make_docs(pairs))) == want
    monkeypatch.setattr(jj, "BLOCK_ROWS", 3)  # blocks that are cut into parts
    monkeypatch.setattr(jj, "FANOUT", 2)
    assert rows(jj.linked_components(make_docs(pairs), percent=70)) == brute(pairs, 5, 70)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    limit = jj.Threshold(80)
    base = [rng.integers(0, 1 << 62, int(n), dtype=np.uint64) for n in rng.integers(5, 200, 12)]
    sets = []
    for b in base:
        for _ in range(12):
            keep = b[rng.random(len(b)) > rng.random() * 0.2]
            if len(keep):
                sets.append(np.unique(np.append(keep, rng.integers(0, 1 << 62, 2, dtype=np.uint64))))
    points = jj.folded(np.stack([jj.count_vector(s) for s in sets]))
    n = np.array([len(s) for s in sets])
    tree = jj.RTree(points, n, fanout=3)
    pruned = 0
    for i, s in enumerate(sets):
        found = set(tree.survivors(points[i], len(s), limit).tolist())
        pruned += len(sets) - len(found)
        for j, t in enumerate(sets):
            if limit.links(len(np.intersect1d(s, t)), len(s), len(t)):
                assert j in found
    assert pruned > len(sets) ** 2 / 2


def test_prefix_and_threshold_are_exact():
    for percent in (50, 80, 100):
        t = jj.Threshold(percent)
        for n in range(1, 60):
            assert t.prefix(n) == n - -(-percent * n // 100) + 1
    assert jj.Threshold(80).links(8, 9, 9) and not jj.Threshold(80).links(7, 8, 8)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in jj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_empty_table_and_stage(make_docs, hard_pairs):
    assert jj.linked_components(make_docs([])).count() == 0
    docs = make_docs(hard_pairs)
    kept = jj.keep_smallest(docs)
    assert kept.columns == docs.columns
    gone = {i for i, _, c in brute(hard_pairs, 5, 80) if i is not None and c < i}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in hard_pairs if i not in gone)


def test_purpose_made_words_do_not_collide(make_docs):
    word = "a"
    for _ in range(10):  # polynomials modulo 2^64 with an odd base cannot tell this word and its complement apart
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(4))
    pairs = [(1, word), (2, other), (3, f"{word} {rest}"), (4, f"{other} {rest}"), (5, f"{word} {rest}"), (6, word.upper())]
    assert rows(jj.linked_components(make_docs(pairs))) == brute(pairs, 5, 80)
