from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrisk.llm import whitening as W
from seqrisk.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component int, vector string, whitened int"


def table_of(spark, vectors, ids=None):
    rows = [(n if ids is None else ids[n], v, None, None, None, None, None) for n, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def grid(vectors):
    """Grid rows by the contract, of the vectors that stay; floats as the table holds them."""
    stays = [v for v in vectors if v is not None and all(c is not None and isfinite(c) for c in v)]
    long = max(map(len, stays), default=0)
    return [[floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (long - len(v)) for v in stays]


def slow_polynomial(m):
    """Characteristic polynomial, constant first, by traces of powers in fractions."""
    d = len(m)
    out, b = [Fraction(1)], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        mb = [[sum(m[i][x] * b[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(mb[i][i] for i in range(d)) / k
        out.append(c)
        b = [[mb[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(x) for x in reversed(out)]


def agree(spark, vectors, components=W.COMPONENTS):
    x = grid(vectors)
    white, fitted = W.whitened_vectors(table_of(spark, vectors), components)
    rows = sorted(white.collect())
    n, sums = len(x), [sum(c) for c in zip(*x)]
    assert fitted.n == n == len(rows)
    assert sorted(int(r["deviation"]) for r in rows) == sorted(sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    v = centred.T @ centred / n
    for e, axis, share in zip(fitted.eigenvalues, fitted.components, fitted.explained):
        assert np.abs(v @ axis - float(e) * axis).max() <= 1e-12 * np.trace(v)
        assert share == pytest.approx(float(e) / np.trace(v), rel=1e-12)
    assert np.abs(fitted.components @ fitted.components.T - np.eye(len(fitted.components))).max() < 1e-13 if len(fitted.components) else True
    want = np.linalg.eigvalsh(v)[::-1][: len(fitted.eigenvalues)]
    assert np.allclose([float(e) for e in fitted.eigenvalues], want, rtol=1e-9, atol=1e-9 * np.trace(v))
    assert W.identity_error(white, len(fitted.eigenvalues)) < 1e-9
    scaled = centred @ (fitted.components.T / np.sqrt([float(e) for e in fitted.eigenvalues])) if len(fitted.eigenvalues) else np.zeros((n, 0))
    assert np.allclose(np.sort([r["whitened"] for r in rows], axis=0), np.sort(scaled, axis=0), atol=1e-9)
    return fitted


def test_random_vectors_with_null_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12)) * 0.1).tolist()
    vectors += [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [0.0] * 12, vectors[0], vectors[0]]
    assert len(agree(spark, vectors).eigenvalues) == 8


def test_equal_eigenvalues_and_low_rank(spark):
    spikes = [[s * float(i == j) for j in range(5)] for i in range(5) for s in (1, -1)]
    fitted = agree(spark, spikes)
    assert len(set(fitted.eigenvalues)) == 1 and len(fitted.eigenvalues) == 5
    flat = [[float(a), 2.0 * a, 0.5, float(b)] for a in range(4) for b in range(3)]
    assert len(agree(spark, flat).eigenvalues) == 2


def test_vectors_of_several_lengths_go_on_with_zeros(spark):
    assert len(agree(spark, [[1.0], [0.5, 2.0], [], [0.1, -0.3, 0.7], [2.0, 1.0, 0.0]]).eigenvalues) == 3


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[0.5, 0.25]], [[0.5, 0.25]] * 4])
def test_nothing_to_whiten(spark, vectors):
    white, fitted = W.whitened_vectors(table_of(spark, vectors))
    assert fitted.eigenvalues == [] and all(r["whitened"] == [] and r["deviation"] == 0 for r in white.collect())


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(1)
    agree(spark, (rng.normal(size=(40, 3)) * 1e7).tolist())
    x, _ = W.whitened_vectors(table_of(spark, [[1e12, 1.0], [-3e12, 5.0], [7.0, 1e11]])), None
    got = sorted(int(r["deviation"]) for r in x[0].collect())
    rows = grid([[1e12, 1.0], [-3e12, 5.0], [7.0, 1e11]])
    sums = [sum(c) for c in zip(*rows)]
    assert got == sorted(sum((3 * c - s) ** 2 for c, s in zip(row, sums)) for row in rows)
    with pytest.raises(Exception, match="too large for the grid"):
        W.whitened_vectors(table_of(spark, [[3e38]]))


def test_polynomial_and_roots_of_close_eigenvalues(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(-40, 40, (9, 7))
    m = (a.T @ a).tolist()
    poly = W.characteristic_polynomial(spark, m)
    assert poly == slow_polynomial(m)
    roots = W.largest_roots(poly, 7)
    assert np.allclose([at / 2**scale for at, scale, _ in roots], np.linalg.eigvalsh(m)[::-1])
    big = 10**14  # eigenvalues big + 1, big, big, 1
    close = [[big, 0, 0, 0], [0, big + 1, 0, 0], [0, 0, big, 0], [0, 0, 0, 1]]
    poly = W.characteristic_polynomial(spark, close)
    assert poly == slow_polynomial(close)
    roots = W.largest_roots(poly, 4)
    assert [(Fraction(at, 1 << scale), many) for at, scale, many in roots] == [(big + 1, 1), (big, 2), (1, 1)]
    one = W.null_vectors(close, Fraction(big + 1), 1)
    assert np.abs(one - [[0, 1, 0, 0]]).max() < 1e-30
    two = W.null_vectors(close, Fraction(big), 2)
    assert np.abs(two @ two.T - np.eye(2)).max() < 1e-15 and np.abs(two[:, [1, 3]]).max() < 1e-30


def test_primes_are_prime():
    found = W.primes(5)
    assert found == [2147483647, 2147483629, 2147483587, 2147483579, 2147483563]


def test_query_over_its_table(spark):
    path = "/root/testdata/sf0.01"
    got = QUERIES["op13_exact_whitening"](spark, path)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = spark.read.parquet(f"{path}/embeddings.parquet")
    frame = got.toPandas()
    n = vectors.count()
    assert len(frame) == 8 * n and (frame.n == n).all() and frame.identity_error.max() < 1e-9
    assert dict(got.dtypes)["deviation"] == "bigint" and set(frame.component) == set(range(1, 9))
    data = dict(vectors.select("vec_id", F.col("embedding")).collect())
    x = np.array([[floor(1024 * c) + 100_000 for c in data[k]] for k in sorted(data)], object)
    off = x * n - x.sum(axis=0)
    want = dict(zip(sorted(data), (off * off).sum(axis=1)))
    assert all(want[k] == v for k, v in zip(frame.vec_id, frame.deviation))
    centred = off.astype(float) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    for k in range(8):
        own = frame[frame.component == k + 1].sort_values("vec_id").whitened.to_numpy()
        direct = centred @ axes[:, -1 - k] / np.sqrt(e[-1 - k])
        assert min(np.abs(own - direct).max(), np.abs(own + direct).max()) < 1e-8
        assert frame[frame.component == k + 1].explained.iloc[0] == pytest.approx(e[-1 - k] / e.sum(), rel=1e-10)
