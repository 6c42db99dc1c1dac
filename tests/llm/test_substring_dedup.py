import re
from collections import defaultdict

import numpy as np

from tarnwell.llm import common
from tarnwell.llm import substring_dedup as sd

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(pairs, width):
    least = {}
    for i, t in pairs:
        if i is not None:
            w = WORDS.findall(t or "")
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in pairs:
        w = WORDS.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()], key=str)


def test_hard_rows(make_docs, hard_pairs):
    for width in (1, 4, 13):
        got = sd.remove_repeated_windows(make_docs(hard_pairs), width)
        assert rows(got) == brute(hard_pairs, width)


def test_many_chunks_and_a_passage_in_every_document(make_docs, monkeypatch):
    from tarnwell.llm import census

    monkeypatch.setattr(census, "CHUNK_BYTES", 500)
    monkeypatch.setattr(census.Layout.__init__, "__defaults__", (500,))
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(20))
    pairs = [(int(i), " ".join([*(f"w{x}" for x in rng.integers(0, 9, 15)), passage if i % 2 else "", *(f"v{x}" for x in rng.integers(0, 40, 15))])) for i in range(120)]
    got = sd.remove_repeated_windows(make_docs(pairs), 5)
    assert rows(got) == brute(pairs, 5)
    for r in got.collect():
        assert r.n_removed == sum(s["after"] - s["first"] for s in r.spans)
        assert all(a["after"] < b["first"] for a, b in zip(r.spans, r.spans[1:]))


def test_empty_table(make_docs):
    assert sd.remove_repeated_windows(make_docs([])).count() == 0


def test_window_hashes_are_those_of_the_words_alone():
    import pyarrow as pa

    raw, bounds = common.text_bytes(pa.array(["a bb  ccc\nd a", " bb ccc d a", None, "", "é bb"]))
    first, h, other = common.word_digests(raw, bounds)
    assert len(set(other.tolist())) == 5
    assert first.tolist() == [0, 5, 9, 9, 9, 11]
    assert h[1] == h[5] and h[0] == h[4] == h[8] and len(set(h.tolist())) == 5
    for width in range(1, 12):
        got = common.window_hashes(h, width, common.WINDOW_BASES[0])
        assert len(got) == max(0, len(h) - width + 1)
    w4 = common.window_hashes(h, 4, common.WINDOW_BASES[0])
    assert w4[1] == w4[5] and w4[0] == w4[4] and len(set(w4.tolist())) == len(w4) - 2


def colliding_words():
    """A word of 1,024 bytes and its complement, which polynomials modulo 2^64 with an odd base cannot tell apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_purpose_made_words_do_not_collide(make_docs):
    one, other = colliding_words()
    rest = " ".join(f"w{i}" for i in range(12))
    pairs = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{one} {rest}")]
    got = sd.remove_repeated_windows(make_docs(pairs), 13)
    assert rows(got) == brute(pairs, 13)
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 0, 3: 13}
    swapped = [one if bin(i).count("1") % 2 else other for i in range(8)]  # the same pattern over words
    pairs = [(1, " ".join(swapped)), (2, " ".join(other if w == one else one for w in swapped))]
    assert rows(sd.remove_repeated_windows(make_docs(pairs), 8)) == brute(pairs, 8)
