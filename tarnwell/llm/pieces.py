"""Cut texts into the pieces of a tokenizer's pattern, many texts at once.

The patterns of byte-pair encoders cut where the kind of a character changes: letter, number, white space, other.
Kinds come from a table over code points, cuts are found on arrays, and every distinct piece of a batch is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from tarnwell.llm.common import _piece_hashes, mixed, worker_cache

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters that are cut at once; one longer text is cut whole.
BATCH_CHARS = 1 << 20
#: Pieces that a worker remembers in each of two generations.
REMEMBERED = 200_000
#: Endings that a single apostrophe starts (fixed values of the pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _make_kinds() -> np.ndarray:
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        found = regex.compile(pattern)
        for low in range(0, 0x110000, 0x10000):
            points = [p for p in range(low, low + 0x10000) if not 0xD800 <= p < 0xE000]
            skip = 0xE000 - 0xD800 if low == 0 else 0
            for m in found.finditer("".join(map(chr, points))):
                for a in range(m.start(), m.end()):
                    point = low + a
                    kinds[point + skip if skip and point >= 0xD800 else point] = kind
    return kinds


def kinds() -> np.ndarray:
    return worker_cache("kinds", _make_kinds)


def _mix() -> np.ndarray:
    return worker_cache("point_mix", lambda: mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one, its code points, and where each begins (one bound more than texts)."""
    whole = "".join(texts)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return whole, np.frombuffer(whole.encode("utf-32-le"), np.uint32), bounds


def _contractions(points: np.ndarray, alone: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes that stand alone: where one starts a contraction, and how many letters that takes."""
    at, taken = [], []
    padded = np.append(points, np.zeros(3, np.uint32))
    new = np.append(first, np.ones(3, bool))
    open_ = alone
    for ending in CONTRACTIONS:
        fits = np.ones(len(open_), bool)
        for k, letter in enumerate(ending, 1):
            fits &= (padded[open_ + k] == ord(letter)) & ~new[open_ + k]
        at.append(open_[fits])
        taken.append(np.full(int(fits.sum()), len(ending)))
        open_ = open_[~fits]
    return np.concatenate(at), np.concatenate(taken)


def cut(points: np.ndarray, bounds: np.ndarray, leading_space: bool, single_numbers: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin, and the kind of character at each.

    ``leading_space``: one space goes with what follows it, and other white space is a piece too; else white space
    is skipped (its pieces are given with kind SPACE). ``single_numbers``: each number character is a piece.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    kind = kinds()[points]
    first = np.zeros(n + 1, bool)
    first[bounds[bounds <= n]] = True
    first[n] = True
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    run = change | first[:-1]
    begin = run.copy()
    if single_numbers:
        begin |= kind == NUMBER
    ends = np.append(run[1:], True)
    attached = np.zeros(n, bool)
    if leading_space:
        # The last white space before something else stands apart; a plain space goes with what follows.
        last = (kind == SPACE) & ends & ~first[1:]
        begin |= last
        attached[1:] = (last & (points == 0x20))[:-1]
        begin &= ~attached
    alone = np.flatnonzero((points == 0x27) & run & ends & ~attached)
    alone = alone[alone + 1 < n]
    at, taken = _contractions(points, alone, first[:-1])
    if len(at):
        begin[at + 1] = False
        after = at + 1 + taken
        inside = after[after < n]
        begin[inside[(kind[inside] == LETTER)]] = True
    starts = np.flatnonzero(begin)
    return starts, kind[starts]


class Memory:
    """What a worker has encoded so far: two generations of bounded size, the older one dropped when the newer is full."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.new, self.old = size, {}, {}

    def get(self, piece):
        found = self.new.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is not None:
                self.put(piece, found)
        return found

    def put(self, piece, ids) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[piece] = ids


def encode_pieces(whole: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, memory: Memory, encode: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and how many each piece has. ``encode`` gets distinct unknown pieces."""
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = mixed(_piece_hashes(points, starts, np.uint64(0x9E3779B97F4A7C15), mix=_mix())) ^ (ends - starts).astype(np.uint64)
    _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
    texts = [whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    found = [memory.get(t) for t in texts]
    missing = [i for i, f in enumerate(found) if f is None]
    for i, ids in zip(missing, encode([texts[i] for i in missing]), strict=True):
        found[i] = ids
        memory.put(texts[i], ids)
    flat = np.frombuffer(b"".join(found), "<u4")
    lengths = np.array([len(f) >> 2 for f in found], np.int64)
    return gather(flat, np.cumsum(lengths) - lengths, lengths, which)


def gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the stretches ``which`` of ``flat`` one after another."""
    n = lengths[which]
    after = np.cumsum(n)
    index = np.arange(int(after[-1]) if len(after) else 0) + np.repeat(offsets[which] - after + n, n)
    return flat[index], n


def portions(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` characters each, one text at least."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)
