import math

import numpy as np
import pytest

from segue.llm import topk


def by_hand(rows, k=20):
    good = [(v, [math.floor(64 * x) for x in e], i) for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for v, e, i in good:
        if v % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), w) for w, f, j in good if j != i and len(f) == len(e))
            out += [(v, r, w, -x) for r, (x, w) in enumerate(s[:k], 1)]
    return sorted(out)


def run(spark, rows, k=20):
    df = spark.createDataFrame([(v, e, 1) for v, e in rows], "vec_id long, embedding array<double>, rank int")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, k=k).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.15, (700, 16))
    x[::7] = np.round(x[::7])  # ties
    x[100:140] = x[100]
    rows = [(k, e) for k, e in enumerate(x.tolist())]
    rows += [(800, None), (820, [None] * 16), (840, [math.nan] * 16), (860, [math.inf] + [0.0] * 15), (880, []), (900, [1.0, 2.0]), (None, [1.0] * 16), (40, [0.5] * 16), (40, [0.5] * 16), (920, [1e9] * 16)]
    assert run(spark, rows) == by_hand(rows)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0])]) == []
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.1]), (20, [-1.0, 2.0])]
    assert run(spark, rows, k=5) == by_hand(rows, 5)
    assert run(spark, []) == []


def test_lists_stop_early():
    """On lists that fall off, queries stop before the end, with the right rows."""
    rng = np.random.default_rng(2)
    x = (rng.pareto(1.2, (3000, 4)) * 10).astype(np.int64)
    q = rng.integers(1, 5, (30, 4))
    best, read = topk.best_of_block(q, np.arange(-30, 0), x, np.arange(3000), np.arange(3000), 10, np.full(30, -(1 << 62)))
    assert (read < 1).sum() >= 20
    for i, (at, s) in enumerate(best):
        want = np.lexsort([np.arange(3000), -(x @ q[i])])[:10]
        assert at.tolist() == want.tolist() and s.tolist() == (x @ q[i])[want].tolist()


def test_small_blocks_are_read_too():
    """A block of fewer rows than are resolved at once is still narrowed by its lists."""
    rng = np.random.default_rng(6)
    x, q = rng.integers(-50, 50, (60, 8)), rng.integers(-50, 50, (10, 8))
    best, read = topk.best_of_block(q, np.arange(-10, 0), x, np.arange(60), np.arange(60), 20, np.full(10, topk.LEAST))
    assert (read > topk.DEPTHS[1]).all()
    for i, (at, s) in enumerate(best):
        want = np.lexsort([np.arange(60), -(x @ q[i])])[:20]
        assert at.tolist() == want.tolist() and s.tolist() == (x @ q[i])[want].tolist()


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 29])
def test_numbers_of_any_size(top):
    rng = np.random.default_rng(4)
    x, q = rng.integers(-top, top, (500, 8)), rng.integers(-top, top, (20, 8))
    q[:5] = x[:5]
    best, _ = topk.best_of_block(q, np.arange(20), x, np.arange(500), np.arange(500), 7, np.full(20, topk.LEAST))
    for i, (at, s) in enumerate(best):
        scores = x @ q[i]
        want = [j for j in np.lexsort([np.arange(500), -scores]).tolist() if j != i][:7]
        assert at.tolist() == want and s.tolist() == scores[want].tolist()


def test_cells_in_waves(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_IN_CELL", 40)
    monkeypatch.setattr(topk, "QUERIES_IN_BLOCK", 7)
    monkeypatch.setattr(topk, "WAVE", 2)
    rng = np.random.default_rng(3)
    rows = [(k // 2, e) for k, e in enumerate(rng.normal(0, 0.2, (600, 6)).tolist())]
    assert run(spark, rows, 5) == by_hand(rows, 5)


def test_lists_stop_before_the_end_on_the_vectors_given(spark):
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect() if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)])
    x = np.floor(64 * x).astype(np.int64)
    q = np.arange(0, len(x), 20)
    best, read = topk.best_of_block(x[q], q, x, np.arange(len(x)), np.arange(len(x)), 20, np.full(len(q), topk.LEAST))
    assert (read < 1).mean() > 0.8
    floor = np.array([s[-1] for _, s in best])
    again, sooner = topk.best_of_block(x[q], q, x, np.arange(len(x)), np.arange(len(x)), 20, floor)
    assert sooner.mean() < read.mean() and all(np.array_equal(a, b) for (_, a), (_, b) in zip(best, again, strict=True))


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = topk.op10_exact_topk(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == by_hand(rows)
