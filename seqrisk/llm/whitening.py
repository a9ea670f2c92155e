"""Whitening of embeddings along principal components found by exact integer arithmetic.

The vectors are rounded to a grid of whole numbers, so that their scatter matrix is one of integers, the same however
the rows are dealt. Its characteristic polynomial is computed modulo many primes (Hessenberg form), put together by
Chinese remaindering, and its largest roots are isolated with certainty. Components are the null vectors belonging to them.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrisk.llm.common import tidy
from seqrisk.llm.registry import query, table
from seqrisk.plans.joins import stored

LEVELS = 1024
COMPONENTS = 8
#: Longest vectors: the driver holds a matrix of as many rows and columns.
MOST_DIMENSIONS = 1024
#: Roots are known to so many bits of the trace; roots nearer than that are one root of higher multiplicity.
BITS = 200
DIGITS = 110
#: Bits of a limb when sums of integers of any size go through long columns.
LIMB, LIMBS = 40, 4


class Fit(NamedTuple):
    """Sums over the grid vectors and the leading components, by falling eigenvalue."""

    n: int
    sums: list[int]
    scatter: list[list[int]]  # n² times the covariance
    eigenvalues: list[Fraction]  # of the covariance
    components: np.ndarray  # one unit vector a row
    explained: list[float]


def finite(vector: Column) -> Column:
    """Not NULL, and every entry is a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _grid(column: pa.Array, levels: int) -> np.ndarray:
    """Rows of floor(levels * entry); shorter vectors go on with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * levels)
    if len(flat) and not np.abs(flat).max() < 2.0**62:
        raise ValueError("an entry is too large for the grid of whole numbers")
    out = np.zeros((len(column), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat.astype(np.int64)
    return out


def _products(y: np.ndarray) -> np.ndarray:
    """Exact yᵀy."""
    bound = len(y) * int(np.abs(y).max(initial=0)) ** 2
    if bound < 1 << 53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    if bound < 1 << 62:
        return y.T @ y
    return y.T.astype(object) @ y.astype(object)


def moments(vectors: DataFrame, levels: int = LEVELS) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and sums of products of the grid vectors of ``vectors`` (one column, ``vector``).

    Each task adds up exactly and sends one row per cell of the upper triangle, as limbs that long
    sums cannot overflow; the driver gets the cells' totals, as many as the dimensions squared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 1), object)
        for batch in batches:
            y = _grid(batch.column(0), levels)
            cells = _products(np.concatenate([np.ones((len(y), 1), np.int64), y], axis=1))
            if len(cells) > len(total):
                grown = np.zeros(cells.shape, object)
                grown[: len(total), : len(total)] = total
                total = grown
            total[: len(cells), : len(cells)] += cells.astype(object)
        i, j = np.triu_indices(len(total))
        values = total[i, j]
        limbs = [(values >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)] + [values >> (LIMB * (LIMBS - 1))]
        columns = [pa.array(c.astype(np.int64)) for c in (i, j, *limbs)]
        for at in range(0, len(i), 10_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 10_000) for c in columns], names)

    names = ["i", "j"] + [f"l{k}" for k in range(LIMBS)]
    cells = vectors.select("vector").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))
    sums = cells.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    found = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in sums.toLocalIterator()}
    d = max((j for _, j in found), default=0)
    n = found.get((0, 0), 0)
    return n, [found[0, j] for j in range(1, d + 1)], [[found[min(i, j), max(i, j)] for j in range(1, d + 1)] for i in range(1, d + 1)]


# ---------------------------------------------------------------- characteristic polynomial


def primes(count: int) -> list[int]:
    """The largest primes below 2^31."""
    found, n = [], (1 << 31) - 1
    while len(found) < count:
        if all(n % p for p in (3, 5, 7, 11, 13)) and all(_strong(n, base) for base in (2, 3, 5, 7)):
            found.append(n)
        n -= 2
    return found


def _strong(n: int, base: int) -> bool:
    """n passes the strong test for a base; four small bases are proof up to 3 215 031 750."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, n)
    if x in (1, n - 1):
        return True
    return any((x := x * x % n) == n - 1 for _ in range(twos - 1))


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo ``p``, constant first, of a matrix of residues, by its Hessenberg form."""
    h, n = matrix.copy(), len(matrix)
    for m in range(1, n - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        at = m + int(pivots[0])
        if at != m:
            h[[m, at]] = h[[at, m]]
            h[:, [m, at]] = h[:, [at, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :, m - 1 :] = (h[m + 1 :, m - 1 :] - u[:, None] * h[m, m - 1 :] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    found = np.zeros((n + 1, n + 1), np.int64)
    found[0, 0] = 1
    for k in range(1, n + 1):
        row = -(int(h[k - 1, k - 1]) * found[k - 1] % p)
        row[1:] += found[k - 1, :-1]
        weights, below = np.zeros(k - 1, np.int64), 1
        for i in range(k - 2, -1, -1):
            below = below * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k - 1]) * below % p
        found[k] = (row - (weights[:, None] * found[: k - 1] % p).sum(axis=0)) % p
    return found[n]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of a positive semidefinite integer matrix, one task for some primes.

    No coefficient is above (1 + trace / d)^d, which says how many primes are enough.
    """
    d = len(matrix)
    bound = 2 * (2 + sum(matrix[i][i] for i in range(d)) // d) ** d
    use = primes(bound.bit_length() // 30 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix, object)
        for batch in batches:
            for n in batch.column(0).to_pylist():
                got = polynomial_mod((whole % use[n]).astype(np.int64), use[n])
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([got.tolist()])], ["n", "c"])

    parts = min(len(use), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(len(use), numPartitions=parts).mapInArrow(run, "n long, c array<long>")
    modulus = 1
    for p in use:
        modulus *= p
    out = [0] * (d + 1)
    for r in rows.toLocalIterator():
        rest = modulus // use[r["n"]]
        part = rest * pow(rest, -1, use[r["n"]])
        out = [x + c * part for x, c in zip(out, r["c"])]
    return [x - modulus if x > modulus // 2 else x for x in (y % modulus for y in out)]


# ---------------------------------------------------------------- real roots


def roots_above(poly: list[int], at: int, scale: int) -> int:
    """Roots above ``at / 2^scale``, with multiplicity.

    The changes of sign among the coefficients about that point (Descartes); exact, because all roots are real.
    """
    while scale and not at & 1:
        at, scale = at >> 1, scale - 1
    d = len(poly) - 1
    c = [x << (scale * (d - k)) for k, x in enumerate(poly)]
    if at:
        for i in range(d):
            for k in range(d - 1, i - 1, -1):
                c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: list[int], at: int, scale: int) -> int:
    value = 0
    for k in range(len(poly) - 1, -1, -1):
        value = value * at + (poly[k] << (scale * (len(poly) - 1 - k)))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """``(numerator, scale, multiplicity)`` of the largest positive roots, falling, ``most`` in all at least if there are.

    ``poly`` has only real roots, none negative. Intervals are halved until they hold one root, then
    by the sign of the value until they are 2^-BITS of the sum of all roots; where several
    roots are left in such an interval they count as one.
    """
    trace = -poly[-2]
    if trace <= 0:
        return []
    scale = max(0, BITS - trace.bit_length())
    top = (trace + 1) << scale
    stack = [(0, top, roots_above(poly, 0, 0), 0)]
    out: list[tuple[int, int, int]] = []
    while stack and sum(m for _, _, m in out) < most:
        low, high, above_low, above_high = stack.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if inside == 1:
            while high - low > 1:
                mid = (low + high) // 2
                sign = sign_at(poly, mid, scale)
                if not sign:
                    low = high = mid
                elif sign == (-1) ** above_high:
                    high = mid
                else:
                    low = mid
        if high - low <= 1:
            out.append((high, scale, inside))
            continue
        mid = (low + high) // 2
        above_mid = roots_above(poly, mid, scale)
        stack += [(low, mid, above_low, above_mid), (mid, high, above_mid, above_high)]
    return out


# ---------------------------------------------------------------- null vectors


def null_vectors(matrix: list[list[int]], root: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal vectors that ``matrix - root`` sends to (almost) zero, by inverse iteration in decimals.

    The largest entry of each is positive.
    """
    d, rng = len(matrix), random.Random(0)
    with localcontext(prec=DIGITS):
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        rows = [[Decimal(x) - (shift if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)]
        size = max(abs(Decimal(matrix[i][i])) for i in range(d))
        least = size.scaleb(-DIGITS)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[best], order[k], order[best] = rows[best], rows[k], order[best], order[k]
            own = rows[k]
            if abs(own[k]) < least:
                own[k] = least
            for i in range(k + 1, d):
                if rows[i][k]:
                    part = rows[i][k] / own[k]
                    rows[i] = rows[i][: k] + [part] + [a - part * b for a, b in zip(rows[i][k + 1 :], own[k + 1 :])]

        def solved(b: list[Decimal]) -> list[Decimal]:
            x = [b[i] for i in order]
            for i in range(d):
                x[i] -= sum((a * c for a, c in zip(rows[i][:i], x)), Decimal(0))
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - sum((a * c for a, c in zip(rows[i][i + 1 :], x[i + 1 :])), Decimal(0))) / rows[i][i]
            return x

        def dot(a: list[Decimal], b: list[Decimal]) -> Decimal:
            return sum((x * y for x, y in zip(a, b)), Decimal(0))

        found = [[Decimal(rng.randrange(-(10**6), 10**6) | 1) for _ in range(d)] for _ in range(count)]
        for _ in range(6):
            fresh: list[list[Decimal]] = []
            for v in found:
                v = solved(v)
                long = dot(v, v).sqrt()
                v = [x / long for x in v]
                for _ in range(2):
                    for w in fresh:
                        along = dot(v, w)
                        v = [x - along * y for x, y in zip(v, w)]
                    long = dot(v, v).sqrt()
                    v = [x / long for x in v]
                fresh.append(v)
            found = fresh
            off = max(
                abs(dot([Decimal(x) for x in row], v) - shift * v[i]) for v in found for i, row in enumerate(matrix)
            )
            if off < size.scaleb(-40):
                break
        else:
            raise ValueError("inverse iteration has not come to rest")
        heads = [max(range(d), key=lambda i: abs(v[i])) for v in found]
        return np.array([[float(x if v[at] > 0 else -x) for x in v] for v, at in zip(found, heads)])


def fit(vectors: DataFrame, components: int = COMPONENTS, levels: int = LEVELS) -> Fit:
    """The leading components of ``vectors`` (column ``vector``, all finite); fewer where the rank is lower."""
    spark = vectors.sparkSession
    n, sums, products = moments(vectors, levels)
    d = len(sums)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; {MOST_DIMENSIONS} are supported")
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return Fit(n, sums, scatter, [], np.zeros((0, d)), [])
    roots = largest_roots(characteristic_polynomial(spark, scatter), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                at, scale, many = roots[k]
                got = null_vectors(scatter, Fraction(at, 1 << scale), many)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([got.tolist()])], ["k", "v"])

    rows = spark.range(len(roots), numPartitions=len(roots)).mapInArrow(run, "k long, v array<array<double>>")
    found = {r["k"]: r["v"] for r in rows.collect()}
    values = [Fraction(at, 1 << scale) for at, scale, many in roots for _ in range(many)][:components]
    axes = np.array([v for k in range(len(roots)) for v in found[k]])[: len(values)]
    return Fit(n, sums, scatter, [e / n**2 for e in values], axes, [float(e / trace) for e in values])


def _root(x: Fraction) -> float:
    """Square root to double precision."""
    return isqrt((x.numerator << 256) // x.denominator) / 2**128


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, levels: int = LEVELS) -> tuple[DataFrame, Fit]:
    """``vec_id, deviation, whitened`` per row of ``vectors`` (vec_id, embedding) that holds finite numbers only, and the fit.

    Entries are counted as floor(levels * entry); an offset added to all of them changes nothing here.
    ``deviation`` is the exact squared distance, times n², from the mean; ``whitened`` has a number per component,
    none where all vectors are equal. Shorter vectors go on with zeros; NULL vectors and those with NULL,
    NaN or infinite entries are left out; repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    rows = vectors.where(finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    fitted = fit(rows, components, levels)
    n, d = fitted.n, len(fitted.sums)
    to_white = fitted.components.T / np.array([_root(e) for e in fitted.eigenvalues]) if fitted.eigenvalues else np.zeros((d, 0))
    sums = fitted.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = max(map(abs, sums), default=0)
        for batch in batches:
            y = _grid(batch.column(1), levels)
            y = np.concatenate([y, np.zeros((len(y), d - y.shape[1]), np.int64)], axis=1)
            most = n * int(np.abs(y).max(initial=0)) + large
            kind = np.int64 if most < 1 << 62 else object
            off = y.astype(kind) * n - np.array(sums, kind)
            square = off if most * most * max(d, 1) < 1 << 62 else off.astype(object)
            far = (square * square).sum(axis=1) if d else np.zeros(len(y), np.int64)
            far = pa.array([Decimal(int(x)) for x in far], pa.decimal128(38, 0))
            white = (off.astype(np.float64) / n) @ to_white
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), far, lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(tidy(run), "vec_id long, deviation decimal(38,0), whitened array<double>"), fitted


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity; one aggregate over the rows."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    if not pairs:
        return 0.0
    cells = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cell - (i == j)) for cell, (i, j) in zip(cells, pairs))


@query("op13_exact_whitening")
def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white, fitted = whitened_vectors(table(spark, sf_dir, "embeddings"))
    white = stored(white)
    error = identity_error(white, len(fitted.eigenvalues))
    explained = F.array(*map(F.lit, fitted.explained)) if fitted.explained else F.array().cast("array<double>")
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
