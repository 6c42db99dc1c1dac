import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tarnwell.llm import packing

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(FILE)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, pairs, reference, length):
    want = Counter()
    for i, t in pairs:
        ids = reference(t)
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= length
    return sequences


def test_hard_rows(make_docs, hard_pairs, reference):
    pairs = [*hard_pairs, (30, "Σίσυφος İstanbul é ﬁ ½ 가힣 가"), (31, "it's WE'LL 'tis 'S ''s 12 3½ <|endoftext|>"), (32, "x" * 9000)]
    for length in (64, 2048):
        check(packing.packed_documents(make_docs(pairs), FILE, length).collect(), pairs, reference, length)


def test_strings_of_special_tokens_are_as_the_tokenizer_has_them(make_docs, reference):
    texts = ["hello <|endoftext|> world", "x <|EndOfText|> y", "a<|startoftext|>b <|endoftext|>", "<| endoftext |>", "<|endoftext|>" * 700, "plain text", None]
    pairs = list(enumerate(texts))
    assert 49407 in reference(texts[0])
    check(packing.packed_documents(make_docs(pairs), FILE, 64).collect(), pairs, reference, 64)


def test_empty_table(make_docs):
    assert packing.packed_documents(make_docs([]), FILE, 2048).count() == 0


def best_possible(counts, length):
    return -(-sum(n * c for n, c in counts.items()) // length)


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(4)
    for top in (20, 200, 2048):
        counts = Counter(int(min(top, 1 + x)) for x in rng.exponential(top / 3, 4000))
        patterns = packing.plan(counts, top)
        used = Counter()
        for lengths, times in patterns:
            assert sum(lengths) <= top and times > 0
            for x, n in Counter(lengths).items():
                used[x] += n * times
        assert used == counts
        assert sum(t for _, t in patterns) <= 1.01 * best_possible(counts, top) + 1


def test_exact_complements_are_found():
    counts = {70: 5, 30: 2, 20: 4, 10: 6}  # 70+30 twice, then 70+20+10 thrice, then 20+10+10+10
    patterns = packing.plan(counts, 100)
    assert patterns[:2] == [((70, 30), 2), ((70, 20, 10), 3)]
    index = packing.SumIndex(np.bincount([3, 5, 5, 9], minlength=31))
    assert index.exact(10, Counter()) == (5, 5) and index.exact(10, Counter({5: 1})) is None
    assert sorted(index.exact(17, Counter())) == [3, 5, 9]
    assert sorted(index.exact(19, Counter())) == [5, 5, 9] and index.exact(27, Counter()) is None


def test_plan_at_a_hundred_million_pieces_is_a_small_sum():
    counts = {n: 100_000 + n for n in range(1, 1025)}
    patterns = packing.plan(counts, 1024)
    assert len(patterns) < 4096 and sum(t for _, t in patterns) <= 1.001 * best_possible(counts, 1024)
    assert sum(len(v) for v in packing.places(patterns).values()) < 20_000


def test_plain_points_are_cut_as_the_tokenizer_does():
    t = packing.WordTokenizer(FILE)
    rng = np.random.default_rng(7)
    plain = np.flatnonzero(t.plain)
    texts = ["".join(map(chr, rng.choice(np.append(plain, [39, 39, 32, 115, 116] * 300), 40))) for _ in range(2000)]
    assert all(np.array_equal(a, b) for a, b in zip(t.encode(texts), t.whole(texts)))
