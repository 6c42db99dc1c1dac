import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from tarnwell.llm import mixing, ordered

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows):
        schema = "doc_id long, text string, source string, size string, key string, before string, no_source string"
        return spark.createDataFrame([Row(doc_id=i, text=t, source=s, size="s", key="k", before="b", no_source="n") for i, t, s in rows], schema).repartition(3)

    return make


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """Share, cap, share the rest again, until nobody is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] >= epochs * sizes[s] * total}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(epochs * sizes[s])
            left -= epochs * sizes[s]
        open_ -= full
    return out


def key_of(i, t):
    return int(hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)


def brute(rows):
    n = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), k in zip(rows, n, strict=True):
        sizes[s] += k
    goal, out = targets(dict(sizes)), []
    for s in sizes:
        own = sorted((key_of(i, t), -1 if i is None else i, k, i) for (i, t, x), k in zip(rows, n, strict=True) if x == s)
        whole, rest = divmod(int(goal[s] + 0.5), sizes[s]) if sizes[s] else (0, 0)
        before = 0
        for _, _, k, i in own:
            out.append((i, s, k, sizes[s], round(goal[s], 6), before, whole * k + max(0, min(k, rest - before))))
            before += k
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.before, r.taken) for r in df.collect())


HARD = [
    (1, None, "b"), (2, "", "b"), (3, " \n", None), (4, "one two", None), (5, "one two", "a"), (5, "one two", "a"), (None, "x y z", "a"), (None, None, None),
    (6, "w " * 3000, "ü"), (7, "päss\x0bwörd 文字\x00x", "ü"), (8, "small", "empty?"), (9, "", "only empty"), (10, "v " * 40, ""),
]


def test_same_as_brute_force(frame):
    assert got(mixing.mix_sources(frame(HARD))) == brute(HARD)
    many = [(i, "w " * (i * 7 % 50), f"s{i % 11 if i % 3 else 0:02d}") for i in range(1500)]
    want = brute(many)
    assert got(mixing.mix_sources(frame(many))) == want
    by_source = defaultdict(lambda: [0, 0.0])
    for (_, s, _, _, target, _, taken), times in want.items():
        by_source[s][0] += taken * times
        by_source[s][1] = target
    assert all(abs(a - b) <= 0.5 for a, b in by_source.values())


def test_parts_and_hot_groups(frame, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 10)
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 7)
    rows = [*HARD, *[(77, "same text here", "a")] * 100, *[(i, f"t {i}", f"src{i % 40}") for i in range(200)]]
    assert got(mixing.mix_sources(frame(rows))) == brute(rows)


def test_reruns_agree_whatever_the_partitions(frame):
    rows = [(i, "w " * (i % 9), f"s{i % 4}") for i in range(300)]
    assert got(mixing.mix_sources(frame(rows))) == got(mixing.mix_sources(frame(rows[::-1]).repartition(5)))


def test_targets_stop_at_epochs(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (True, "", 0), (False, "c", 90)], "no_source boolean, source_name string, source_size long")
    found = {(r.no_source, r.source_name): r.target for r in mixing.source_targets(sizes).collect()}
    want = targets({"a": 10, "b": 1000, "c": 90, None: 0})
    assert {(k is None, k or ""): v for k, v in want.items()} == pytest.approx(found)
    assert found[False, "a"] == 30
    with pytest.raises(ValueError):
        mixing.source_targets(sizes, weights=(1, 0))


def test_texts_of_the_mix(frame):
    rows = [*HARD, *[(50, "u v w", "a")] * 5, *[(100 + i, f"k{i} l m n", "b") for i in range(30)]]
    taken = Counter()
    for (i, s, size, _, _, _, t), times in brute(rows).items():
        taken[i, s, size] += t * times
    texts = mixing.mixed_texts(frame(rows)).collect()
    words = Counter()
    for r in texts:
        own = WORD.findall(r.text)
        words[r.doc_id, r.source, len(own)] += r.times * len(own)
        if r.part is not None:
            cut = r.part.split(" ")
            assert cut == own[: len(cut)] and len(cut) < len(own)
            words[r.doc_id, r.source, len(own)] += len(cut)
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_empty_and_no_python(frame):
    assert mixing.mix_sources(frame([])).collect() == [] and mixing.mixed_texts(frame([])).collect() == []
    for made in (mixing.mix_sources(frame(HARD)), mixing.mixed_texts(frame(HARD))):
        plan = made._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
