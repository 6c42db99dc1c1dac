"""Whitening of embeddings by an exact characteristic polynomial.

Vectors become whole numbers, so their scatter matrix M = n * sum(x x') - S S' (n squared times the covariance) is one of whole
numbers, added up exactly by Spark. Its characteristic polynomial is found modulo many primes, a prime at a time on the tasks of a
job: a similarity transform brings M to Hessenberg form, whose polynomial follows by recurrence. Chinese remaindering gives the
whole coefficients; as M is positive semidefinite, they alternate in sign and have a known bound, which says how many primes it takes.

All roots are real, so by Descartes' rule the number of roots above a is exactly the number of sign changes of the polynomial
shifted by a. Bisection on that count isolates the largest roots, multiplicities included, to any precision. Inverse iteration on
M - root, in decimals of many digits, gives the null space of each; roots that no double can tell apart share one.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import materialise

#: Primes are below 2 to this power; products of two residues, and sums of a hundred of them, fit 64 bits.
PRIME_BITS = 28
#: Primes that one task works on.
PRIMES_AT_ONCE = 8
#: Roots are isolated to this many bits below the trace; roots closer than CLOSE bits below it count as one.
ROOT_BITS, CLOSE_BITS = 160, 100
DIGITS = 110


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, their sums, unit components by falling eigenvalue of the covariance, and shares of the trace."""

    n: int
    sums: list[int]
    components: list[list[float]]
    roots: list[Fraction]  # eigenvalues of the integer scatter matrix, which is n * n times the covariance
    explained: list[float]

    @property
    def eigenvalues(self) -> list[float]:
        return [float(r / (self.n * self.n)) for r in self.roots]


# --- the polynomial ------------------------------------------------------------------------


def primes_below(limit: int, count: int) -> list[int]:
    """The largest ``count`` primes below ``limit``."""
    root = math.isqrt(limit) + 1
    small = np.ones(root + 1, bool)
    small[:2] = False
    for i in range(2, math.isqrt(root) + 1):
        if small[i]:
            small[i * i :: i] = False
    divisors = np.flatnonzero(small)
    found, at = [], limit - 1
    while len(found) < count and at > root:
        if (at % divisors).all():
            found.append(at)
        at -= 1
    if len(found) < count:
        raise ValueError("the matrix needs more primes than there are of this size")
    return found


def _power(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, base, exponent = np.ones_like(base), base % p, exponent.copy()
    while exponent.any():
        out = np.where(exponent & 1, out * base % p, out)
        base = base * base % p
        exponent >>= 1
    return out


def polynomial_mod(h: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients of det(x - H), from the highest power down, of the matrices ``h[k]`` modulo ``primes[k]``."""
    h, d, p1 = h.copy(), h.shape[1], primes
    p2, p3 = p1[:, None], p1[:, None, None]
    each = np.arange(len(p1))
    for k in range(d - 2):
        pivot = np.argmax(h[:, k + 1 :, k] != 0, axis=1) + k + 1  # the row itself if all are zero
        rows = h[each, pivot].copy()
        h[each, pivot] = h[:, k + 1]
        h[:, k + 1] = rows
        columns = h[each, :, pivot].copy()
        h[each, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = columns
        inverse = _power(h[:, k + 1, k], p1 - 2, p1)  # 0 where there is no pivot, and nothing to clear
        u = h[:, k + 2 :, k] * inverse[:, None] % p2
        h[:, k + 2 :] = (h[:, k + 2 :] - u[:, :, None] * h[:, None, k + 1]) % p3
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * u[:, None, :] % p3).sum(axis=2)) % p2
    # polynomials of the leading blocks, lowest power first
    leading = [np.zeros((len(p1), d + 1), np.int64)]
    leading[0][:, 0] = 1
    for k in range(d):
        nxt = np.roll(leading[k], 1, axis=1)
        nxt = (nxt - h[:, k, k, None] * leading[k]) % p2
        below = np.ones(len(p1), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p1
            nxt = (nxt - (h[:, i, k] * below % p1)[:, None] * leading[i]) % p2
        leading.append(nxt)
    return leading[d][:, ::-1]


def symmetric_functions(spark, matrix: list[list[int]]) -> list[int]:
    """Elementary symmetric functions e_0 .. e_d of the eigenvalues of a positive semidefinite matrix of whole numbers, exactly."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return [1] + [0] * d
    # Maclaurin: e_k is at most C(d, k) (trace / d)^k.
    bound = max(Fraction(trace, d) ** k * math.comb(d, k) for k in range(d + 1))
    count = (math.ceil(bound).bit_length() + 1) // (PRIME_BITS - 1) + 1
    primes = primes_below(1 << PRIME_BITS, count)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix, object).reshape(d, d)
        for batch in batches:
            for lo in range(0, batch.num_rows, PRIMES_AT_ONCE):
                p = batch.column("p").to_numpy()[lo : lo + PRIMES_AT_ONCE]
                h = np.stack([(whole % int(q)).astype(np.int64) for q in p])
                c = polynomial_mod(h, p)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    parts = max(1, math.ceil(count / PRIMES_AT_ONCE))
    table = spark.createDataFrame([(i, p) for i, p in enumerate(primes)], "i int, p long")
    dealt = table.repartitionByRange(parts, "i").select("p")
    found = {r["p"]: r["c"] for r in dealt.mapInArrow(residues, "p long, c array<long>").collect()}
    values, product = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(product, -1, p) if product > 1 else 1
        for k in range(d + 1):
            signed = found[p][k] if k % 2 == 0 else -found[p][k]
            values[k] += product * ((signed - values[k]) * inverse % p)
        product *= p
    if values[0] != 1 or values[1] != trace:
        raise ArithmeticError("the characteristic polynomial does not have the trace of the matrix")
    return values


# --- roots and components --------------------------------------------------------------------


def roots_above(e: list[int], at: int) -> int:
    """How many roots, counted with multiplicity, of sum((-1)^k e_k x^(d-k)) are above a whole number."""
    c = [-v if k % 2 else v for k, v in enumerate(e)]
    d = len(c) - 1
    for stop in range(d, 0, -1):  # shift by repeated synthetic division
        for k in range(1, stop + 1):
            c[k] += at * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(e: list[int], count: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The ``count`` largest positive roots with multiplicity, from above, each at most 2^-bits of the trace too small; fewer if there are fewer."""
    rank = max(k for k, v in enumerate(e) if v)
    if not rank:
        return []
    shift = max(0, bits - e[1].bit_length())
    scaled = [v << (shift * k) for k, v in enumerate(e[: rank + 1])]  # zero roots are divided out
    known: dict[int, int] = {0: rank, (e[1] << shift) + 1: 0}
    out = []
    for k in range(1, min(count, rank) + 1):
        low = max(a for a, n in known.items() if n >= k)
        high = min(a for a, n in known.items() if n < k)
        while high - low > 1:
            middle = (low + high) // 2
            if known[low] == k and known[high] == k - 1:  # a single root is left: the sign at the middle tells its side
                value = 0
                for j, v in enumerate(scaled):
                    value = value * middle + (-v if j % 2 else v)
                known[middle] = k - (value == 0 or (value > 0) == (k % 2 == 1))
            else:
                known[middle] = roots_above(scaled, middle)
            if known[middle] >= k:
                low = middle
            else:
                high = middle
        out.append(Fraction(low, 1 << shift))
    return out


def _solve(lower: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    d = len(b)
    x = b[order].copy()
    for i in range(1, d):
        x[i] -= lower[i, :i] @ x[:i]
    for i in range(d - 1, -1, -1):
        if i + 1 < d:
            x[i] -= lower[i, i + 1 :] @ x[i + 1 :]
        x[i] /= lower[i, i]
    return x


def _factored(a: np.ndarray, tiny: Decimal) -> tuple[np.ndarray, list[int]]:
    """Both triangles of a row-pivoted factorisation in one matrix; a pivot of zero becomes ``tiny``."""
    a, d = a.copy(), len(a)
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda r: abs(a[r, k]))
        a[[k, best]] = a[[best, k]]
        order[k], order[best] = order[best], order[k]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        for r in range(k + 1, d):
            if a[r, k]:
                a[r, k] /= a[k, k]
                a[r, k + 1 :] -= a[r, k] * a[k, k + 1 :]
    return a, order


def _orthonormal(vectors: list[np.ndarray], against: list[np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in vectors:
        for _ in range(2):
            for u in (*against, *out):
                v = v - (u @ v) * u
        out.append(v / (v @ v).sqrt())
    return out


def null_spaces(matrix: list[list[int]], roots: list[Fraction], rounds: int = 4) -> list[list[float]]:
    """Unit eigenvectors of the roots by inverse iteration, each with its largest entry positive; roots that are close share a space."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    found: list[np.ndarray] = []
    with decimal.localcontext() as context:
        context.prec = DIGITS
        whole = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
        rng = np.random.Generator(np.random.PCG64(7))
        at = 0
        while at < len(roots):
            to = at + 1
            while to < len(roots) and (roots[to - 1] - roots[to]) * 2**CLOSE_BITS < trace:
                to += 1
            root = Decimal(roots[at].numerator) / Decimal(roots[at].denominator)
            shifted = whole.copy()
            shifted[np.arange(d), np.arange(d)] -= root
            factors, order = _factored(shifted, Decimal(trace) / Decimal(2) ** (2 * ROOT_BITS))
            vectors = [np.array([Decimal(int(x)) for x in rng.integers(-(10**6), 10**6, d)], object) for _ in range(to - at)]
            for _ in range(rounds):
                vectors = _orthonormal([_solve(factors, order, v) for v in vectors], found[:0])
            for v, own in zip(vectors, roots[at:to], strict=True):
                miss = whole @ v - Decimal(own.numerator) / Decimal(own.denominator) * v
                if (miss @ miss).sqrt() > Decimal(trace) / Decimal(10) ** 25:
                    raise ArithmeticError("inverse iteration has not found the null space")
            found += vectors
            at = to
        return [[float(x) for x in (v if v[max(range(d), key=lambda i: (abs(v[i]), -i))] > 0 else -v)] for v in found]


# --- over the rows ---------------------------------------------------------------------------


def _whole_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector as doubles) of the rows that take part, and the number of dimensions."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    dims = common["dims"] if common else 0
    return rows.where(F.size("vector") == dims), dims


def _integers(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    """floor(scale * c) of every entry; 64-bit numbers, or Python's where they are too large for that."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if not len(values) or np.abs(values).max() * scale < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    return np.array([[math.floor(Fraction(c) * scale) for c in row] for row in values.tolist()], object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def scatter(vectors: DataFrame, dims: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and the matrix n * sum(x x') - S S' of the whole-number vectors, exactly. Tasks send one number per pair of dimensions.

    An offset that is the same for all rows changes neither this matrix nor n * x - S, so the vectors are taken without one.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            x = _integers(batch, dims, scale)
            if not len(x):
                continue
            n += len(x)
            sums += x.astype(object).sum(axis=0) if _largest(x) * len(x) >= 2**62 else x.sum(axis=0).astype(object)
            square = max(1, _largest(x)) ** 2
            if square * 64 > 2**53:
                products += x.T.astype(object) @ x.astype(object)
                continue
            step = 2**53 // square  # products and their sums are whole numbers that doubles hold exactly
            for lo in range(0, len(x), step):
                part = x[lo : lo + step].astype(float)
                products += (part.T @ part).astype(np.int64).astype(object)
        if n:
            i, j = np.triu_indices(dims)
            entries = [n, *sums.tolist(), *products[i, j].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1] * (dims + 1) + i.tolist(), pa.int32()), pa.array([-1, *range(dims), *j.tolist()], pa.int32()),
                    pa.array([Decimal(v) for v in entries], pa.decimal128(38, 0)),
                ],
                ["i", "j", "value"],
            )

    parts = vectors.select("vector").mapInArrow(moments, "i int, j int, value decimal(38,0)")
    cells = {(r["i"], r["j"]): int(r["value"]) for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    n = cells.get((-1, -1), 0)
    s = [cells.get((-1, j), 0) for j in range(dims)]
    return n, s, [[n * cells.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(dims)] for i in range(dims)]


def fit_whitening(embeddings: DataFrame, components: int = 8, scale: int = 1_024) -> Whitening:
    """The whitening of all rows that take part (see ``whiten``); the driver holds squares of the dimension, never rows."""
    vectors, dims = _whole_vectors(embeddings)
    return _fit(vectors, dims, components, scale)


def _fit(vectors: DataFrame, dims: int, components: int, scale: int) -> Whitening:
    n, sums, matrix = scatter(vectors, dims, scale) if dims else (0, [], [])
    trace = sum(matrix[i][i] for i in range(dims))
    if not trace:
        return Whitening(n, sums, [], [], [])
    roots = largest_roots(symmetric_functions(vectors.sparkSession, matrix), components)
    return Whitening(n, sums, null_spaces(matrix, roots), roots, [float(r / trace) for r in roots])


def whiten(embeddings: DataFrame, components: int = 8, scale: int = 1_024) -> DataFrame:
    """Whitened coordinates of every vector.

    Entries c become floor(scale * c). Covariances have divisor n; components are unit eigenvectors by falling eigenvalue, the
    largest entry positive; a whitened value is the centred vector's projection over the root of the eigenvalue. Gives
    ``vec_id``, ``n``, ``deviation`` (sum of (n*x - S)^2, decimal), ``whitened`` (array of doubles), ``explained`` (array: shares of
    the trace), ``identity_error`` (largest entry of the whitened covariance minus the identity).

    Vectors that are null, empty or hold a null or non-finite entry take no part, and neither do vectors of another length than
    the most frequent one (of equally frequent ones the longest). Repeated rows count each; a null vec_id stays. Equal
    eigenvalues span a space of which some orthonormal basis is taken, the same for all rows. There are at most as many
    components as eigenvalues above zero, so a table without any spread, or an empty one, gives no rows. Squares of deviations
    must fit 38 digits. Other columns are not read.
    """
    vectors, dims = _whole_vectors(embeddings)
    fit = _fit(vectors, dims, components, scale)
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    k = len(fit.components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, roots = np.array(fit.components).reshape(k, dims), np.array([math.sqrt(r) for r in fit.roots])
        for batch in batches:
            x = _integers(batch, dims, scale)
            wide = fit.n * _largest(x) + max(map(abs, fit.sums)) >= 2**62
            z = (x.astype(object) if wide else x) * fit.n - np.array(fit.sums, object if wide else np.int64)
            square = (z.astype(object) if _largest(z) ** 2 * dims >= 2**62 else z) ** 2
            w = (z.astype(float) @ axes.T) / roots
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), pa.array([Decimal(int(v)) for v in square.sum(axis=1)], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), pa.int32()), pa.array(w.reshape(-1))),
                ],
                ["vec_id", "deviation", "whitened"],
            )

    shape = f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>"
    if not k:
        rows = embeddings.sparkSession.createDataFrame([], shape)
        return rows.select("vec_id", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    rows = materialise(vectors.mapInArrow(project, shape), "whitened")
    value = [F.element_at("whitened", i + 1) for i in range(k)]
    means = rows.agg(*[F.avg(v).alias(str(i)) for i, v in enumerate(value)]).first()
    centred = [v - F.lit(means[i]) for i, v in enumerate(value)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    error = max(abs(covariance[f"{i}_{j}"] - (i == j)) for i, j in pairs)
    return rows.select(
        "vec_id", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(x) for x in fit.explained]).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
