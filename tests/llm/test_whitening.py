import math
from fractions import Fraction

import numpy as np
import pytest

from segue.llm import whitening


def check(got, rows, most=32):
    """Rows of a whitening against the definition, in exact arithmetic where it is exact."""
    good = [(v, e) for v, e in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in e] for _, e in good], object)
    n, d = x.shape
    sums = x.sum(axis=0)
    centred = x * n - sums
    cov = np.array([[float(Fraction(int(sum(centred[:, i] * centred[:, j])), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum()))
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == n * k and set(by_id) == {v for v, _ in good}
    deviation = {v: int(sum(c * c)) for (v, _), c in zip(good, centred, strict=True)}
    y = np.array([[by_id[v][c].whitened for c in range(1, k + 1)] for v, _ in good])
    for v, parts in by_id.items():
        for c, r in parts.items():
            assert r.n == n and r.deviation == deviation[v]
            assert math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9)
            assert r.identity_error < 1e-4
    want = (centred / n).astype(float) @ (vectors[:, :k] / np.sqrt(values[:k]))
    apart = [c for c in range(k) if all(abs(values[c] - values[o]) > 1e-6 * values[0] for o in range(d) if o != c)]
    for c in apart:
        sign = np.sign((y[:, c] * want[:, c]).sum())
        assert np.allclose(y[:, c], sign * want[:, c], atol=1e-6)
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-4


def run(spark, rows, tasks=3, **options):
    df = spark.createDataFrame([(v, e, 1) for v, e in rows], "vec_id long, embedding array<double>, n int").repartition(tasks)
    return whitening.whiten(df, **options).collect()


def test_against_definition(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, [3, 1, 0.5, 0.2, 4, 1], (80, 6)) @ rng.normal(0, 1, (6, 6))
    rows = [(k, e) for k, e in enumerate(x.tolist())]
    rows += [(100, None), (101, []), (102, [None] * 6), (103, [math.nan] * 6), (104, [math.inf] + [0.0] * 5), (105, [1.0, 2.0])]
    valid = [r for r in rows if r[0] != 105]
    check(run(spark, rows), valid)
    check(run(spark, rows, tasks=1, components=4), valid, 4)


def test_dependent_dimensions_and_far_mean(spark):
    """Dimensions that repeat others are no components; a mean far off costs nothing."""
    rng = np.random.default_rng(1)
    x = rng.normal(500_000, 2, (60, 3))
    x = np.concatenate([x, x[:, :1], np.full((60, 1), 7.0)], axis=1)
    got = run(spark, [(k, e) for k, e in enumerate(x.tolist())])
    check(got, [(k, e) for k, e in enumerate(x.tolist())])
    assert max(r.component for r in got) == 3


def test_same_rows_whatever_the_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [(k // 2, e) for k, e in enumerate(rng.normal(0, 1, (50, 5)).tolist())]
    a, b = run(spark, rows, 1), run(spark, rows, 7)
    key = lambda r: (r.vec_id, r.component, r.whitened)
    assert [key(r) for r in sorted(a, key=key)] == [key(r) for r in sorted(b, key=key)]


def test_few_equal_and_huge(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, [(k, [1.0, 2.0]) for k in range(5)]) == []
    got = run(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (None, [0.0, 5.0])])
    assert len(got) == 3 and all(r.deviation is None for r in got if r.vec_id is not None)


@pytest.mark.parametrize("d", [1, 2, 7, 30])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    a = rng.normal(0, 1, (d, d)) * np.logspace(0, -6, d)
    a = a @ a.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, rtol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-15)
    small = whitening.jacobi(np.diag([1.0, 1e-12]) + 1e-13 * np.array([[0, 1], [1, 0.0]]))[0]
    assert math.isclose(sorted(small)[0], 1e-12, rel_tol=1e-12)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(whitening.op12_embedding_whitening(spark, "/root/testdata/sf0.001").collect(), rows)
