import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tarnwell.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(pairs, slip=199):
    counts = Counter()
    for i, t in pairs:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def apart(a, b):
    """Exactly one insertion, deletion or replacement, by trying all."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = defaultdict(list)
    names = sorted(words)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def got(df):
    rows = df.collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def invented(seed, size, letters="abcdeé", length=(6, 9)):
    """Words few letters apart, with chains of ever more frequent ones."""
    rng = random.Random(seed)
    words = {}
    while len(words) < size:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*length)))
        n = rng.choice([5, 6, 30, 200])
        for _ in range(rng.randint(1, 6)):
            words.setdefault(w, n)
            n *= rng.choice([1, 3, 5, 6])
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :]])
    return words


@pytest.mark.parametrize(("part_words", "groups"), [(20_000, 16), (15, 16), (4, 3), (1, 2), (30, 1)])
def test_forms_same_as_brute_force(spark, monkeypatch, part_words, groups):
    monkeypatch.setattr(spelling, "PART_WORDS", part_words)  # parts by more counts, then by halves of words
    words = invented(part_words, 350)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(spelling.spelling_forms(frame, groups=groups)) == brute(words)


def test_ties_and_long_chains(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaaac": 25, "aaaabc": 125, "aaabbc": 625, "aabbbc": 3125, "abbbbc": 15625, "zzzzzz": 7, "bbbbbbb": 6, "bbbbbb": 6}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = got(spelling.spelling_forms(frame))
    assert found == brute(words)
    by = {f[0]: f for f in found}
    assert by["aaaaaa"][1] == "aaaaab" and by["aaaaac"][2] == "abbbbc" and by["bbbbbb"][1] is None


def test_whole_texts(make_docs, hard_pairs):
    rng = random.Random(3)
    names = list(invented(8, 60, "abcdeéÀ"))
    texts = [(i, " ".join(rng.choice(names).title() if rng.random() < 0.2 else rng.choice(names) for _ in range(150)) + ", x2y_z-words") for i in range(60)]
    pairs = [*hard_pairs, *texts, (None, texts[0][1]), (3, texts[1][1])]
    assert got(spelling.spelling_variants(make_docs(pairs))) == brute(words_of(pairs))
    slipped = words_of(pairs, 7)
    assert got(spelling.spelling_variants(make_docs(pairs), slip=7)) == brute(slipped) and slipped != words_of(pairs)


def test_empty(make_docs, spark):
    assert got(spelling.spelling_variants(make_docs([]))) == set()
    assert got(spelling.spelling_variants(make_docs([(1, None), (2, ""), (3, "short only")]))) == set()
    assert got(spelling.spelling_forms(spark.createDataFrame([("alone1", 9)], "word string, n long"))) == {("alone1", None, "alone1", 9, 0, None)}
    with pytest.raises(ValueError):
        spelling.spelling_forms(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_each_pair_is_met_once(spark):
    words = invented(5, 200, "abc", (6, 7))
    frame = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_words(frame).collect()]
    assert len(pairs) == len(set(pairs))
    names = sorted(words)
    assert set(pairs) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if apart(a, b)}
