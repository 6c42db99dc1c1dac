import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tarnwell.llm import bpe, pieces

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def own():
    b, m = bpe.Bpe(bpe.read_ranks(FILE)), pieces.Memory(1000)
    return lambda texts: [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts, b, m)]


def test_random_texts(reference, own):
    rng = random.Random(1)
    alphabet = "'stremvld  \n\t\r\x0b\x1c\x85\xa0 aZé1²٣!?…中文한 हि́İΣσ<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["'s't're've'm'll'd", "x's y't '''s", "", "a", "<|endoftext|>", "\n \n" * 300]
    assert own(texts) == [reference(t) for t in texts]


def test_long_pieces(reference, own):
    rng = random.Random(2)
    texts = ["a" * 3000, "ab" * 2000, " " * 2500, "é" * 1500, "中" * 900, "".join(rng.choice("etaoinshr") for _ in range(6000)), "!?" * 2000]
    assert own(texts) == [reference(t) for t in texts]


def test_every_kind_of_character(reference, own):
    points = [p for p in range(0, 0x110000, 7) if not 0xD800 <= p < 0xE000]
    texts = [f"x{chr(p)}1{chr(p)} {chr(p)}{chr(p)}y" for p in points]
    assert own(texts) == [reference(t) for t in texts]


def test_join_is_associative_and_has_a_unit():
    b, rng = bpe.Bpe(bpe.read_ranks(FILE)), random.Random(3)
    for _ in range(300):
        x, y, z = ("".join(rng.choice("thequickbrown") for _ in range(rng.randrange(1, 12))).encode() for _ in range(3))
        ex, ey, ez = map(b.encode_part, (x, y, z))
        assert b.join(b.join(ex, ey), ez) == b.join(ex, b.join(ey, ez)) == b.merged(x + y + z)
        assert b.join((), ex) == ex == b.join(ex, ())


def test_round_trip_of_hard_rows(make_docs, hard_pairs, reference):
    got = bpe.decode(bpe.encode(make_docs(hard_pairs), FILE), FILE).collect()
    want = sorted(str((i, reference(t or ""), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in hard_pairs)
    assert sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), hashlib.sha256(r.decoded).hexdigest())) for r in got) == want
    assert bpe.encode(make_docs([]), FILE).count() == 0


def test_missing_bytes_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe({b"a": 0})
