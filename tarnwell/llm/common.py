"""What several operators of this subpackage share: sizes, hashing of words, skew-free ranks, worker caches."""

from __future__ import annotations

import hashlib
import math
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import materialise  # noqa: F401  the operators import it from here

#: A key counts as hot above this share of all rows, so there are at most a thousand hot keys.
HOT_SHARE = 1_000

_rng = np.random.Generator(np.random.PCG64(20240101))
#: One random odd multiplier per byte value; 0 for white space, so that it adds nothing to a word.
BYTE_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
BYTE_MIX[IS_SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text of a row; a null text counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def sizes(df: DataFrame, text: Column) -> tuple[int, int]:
    """Rows, and bytes of all texts."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def worker_cache(name: str, make):
    """One object per Python worker process, kept between the tasks that the process runs."""
    holder = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


# --- words as numbers ------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and where each row begins (one bound more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def portions_of(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in the string column ``name``, one row at least: arrays over bytes stay small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(raw: np.ndarray, starts: np.ndarray, base: np.uint64, mix: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A polynomial hash of each stretch from one start to the next; ``mix`` has what each symbol adds. Worked off in blocks."""
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(raw))
    lo = 0
    powers = np.ones(64, np.uint64)
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + block, side="right")))
        at, to = int(starts[lo]), int(ends[hi - 1])
        inside = np.arange(at, to) - np.repeat(starts[lo:hi], ends[lo:hi] - starts[lo:hi])
        longest = int(inside.max()) + 1
        if longest > len(powers):
            powers = np.ones(longest, np.uint64)
        powers[1:] = base
        np.multiply.accumulate(powers, out=powers)
        out[lo:hi] = np.add.reduceat(mix[raw[at:to]] * powers[inside], starts[lo:hi] - at)
        lo = hi
    return out


def words(
    raw: np.ndarray, bounds: np.ndarray, kinds: int = 1, gaps: np.ndarray = IS_SPACE, mix: np.ndarray = BYTE_MIX
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words are maximal runs without white space (or other ``gaps``, for which ``mix`` has zeros) inside one row.

    Gives the first word of each row (one bound more than rows) and, for each of ``kinds`` independent
    bases, a 64-bit hash of every word.
    """
    if not len(raw):
        return np.zeros(len(bounds), np.int64), [np.zeros(0, np.uint64) for _ in range(kinds)]
    space = gaps[raw]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    begins[1:] = space[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[inner] = True
    starts = np.flatnonzero(begins & ~space)
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return first, [np.zeros(0, np.uint64) for _ in range(kinds)]
    # A row's leading white space belongs to no word: stretches run from one word start to the next and space adds nothing.
    return first, [mixed(_piece_hashes(raw, starts, BASES[k], mix)) for k in range(kinds)]


def word_digests(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each row (one bound more than rows), and two independent hashes of every word, modulo 2^61 - 1.

    Words are as in ``words``. Different words are told apart by their bytes; each gets the halves of a BLAKE2 digest, so
    that no purpose-made words collide either.
    """
    if not len(raw):
        return np.zeros(len(bounds), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    inside = ~IS_SPACE[raw]
    begins = inside & np.append(True, ~inside[:-1])
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, bounds)
    upto = np.append(np.int64(0), np.cumsum(inside))
    offsets = np.append(upto[starts], upto[-1]) if len(starts) else np.zeros(1, np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[inside])])
    coded = array.dictionary_encode()
    digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.to_pylist())
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2) % MERSENNE
    which = coded.indices.to_numpy(zero_copy_only=False)
    return first, halves[which, 0], halves[which, 1]


#: The prime 2^61 - 1, modulo which windows are hashed, and a base for each of two hashes.
MERSENNE = np.uint64(2**61 - 1)
WINDOW_BASES = (0x0C3A6E1F52B98D47, 0x15D7F90A4E8B6321)


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo 2^61 - 1, of numbers below it, in halves of 32 bits."""
    low, half, few = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(29)
    a, b = np.uint64(factor >> 32), np.uint64(factor & 0xFFFFFFFF)
    high_x, low_x = x >> half, x & low
    middle = high_x * b + low_x * a
    last = low_x * b
    total = (high_x * a << np.uint64(3)) + (middle >> few) + ((middle & np.uint64((1 << 29) - 1)) << half) + (last >> np.uint64(61)) + (last & MERSENNE)
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & MERSENNE)
    return np.where(x >= MERSENNE, x - MERSENNE, x)


def window_hashes(word_hash: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of the ``width`` words from each word on, modulo 2^61 - 1; shorter at the end by width - 1.

    Two windows whose words have different hashes share a hash for at most ``width`` of the 2^61 bases. Bits are mixed at the end.
    """
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prime = int(MERSENNE)
    out, done, stretch, step, left = None, 0, word_hash, 1, width
    while left:
        if left & 1:
            if out is None:
                out, done = stretch, step
            else:  # the stretch of `step` words follows the `done` words already hashed
                m = len(word_hash) - done - step + 1
                out = _reduced(_times(out[:m], pow(base, step, prime)) + stretch[done : done + m])
                done += step
        left >>= 1
        if left:
            stretch = _reduced(_times(stretch[: len(stretch) - step], pow(base, step, prime)) + stretch[step:])
            step *= 2
    return mixed(out[:n])


# --- ranks and hot keys ----------------------------------------------------------------------


def dense_ranks(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each key from 0 without bringing a key into one task.

    ``bucket`` is a whole number that rises with the order wanted and splits a key into parts of bounded size;
    rows are numbered inside (key, bucket), and the rows of the buckets before are added.
    """
    b, before, inside, n = (free_name(df, x) for x in ("rank_bucket", "rank_before", "rank_inside", "rank_n"))
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    earlier = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    numbered = df.withColumn(inside, F.row_number().over(W.partitionBy(*keys, b).orderBy(*order)) - 1)
    right = offsets.select(*[F.col(k).alias(f"right_{i}_{before}") for i, k in enumerate((*keys, b))], before)
    cond = F.lit(True)
    for i, k in enumerate((*keys, b)):
        cond = cond & F.col(k).eqNullSafe(F.col(f"right_{i}_{before}"))
    joined = numbered.join(right, cond)
    return joined.select(*[c for c in numbered.columns if c not in (b, inside)], (F.col(before) + F.col(inside)).cast("long").alias(name))


def salts_of(counts: DataFrame, key: list[str], count: str, rows: int, least: int = 10_000) -> DataFrame:
    """(key, salts) of the hot keys: those that hold over a thousandth of ``rows``, so at most a thousand of them."""
    limit = max(least, rows // HOT_SHARE)
    return counts.where(F.col(count) > limit).select(*key, F.ceil(F.col(count) / limit).cast("int").alias("salts"))


def log2_up(x: float) -> int:
    return max(0, math.ceil(math.log2(max(1.0, x))))
