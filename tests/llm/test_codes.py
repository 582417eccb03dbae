import hashlib
import math

import numpy as np
import pytest

from segue.llm import codes


def by_hand(rows, parts=16, entries=64, rounds=2):
    """Rows (id, code, error, label error, hash) by comparing every part with every entry."""
    good = [(v, label, [math.floor(256 * x) for x in e]) for v, e, label in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(good[0][2]) // parts
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for _, _, x in good]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min(range(len(book)), key=lambda k: (gap(part, book[k]), k))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [nearest(c[p], book) for c in cut]
            for k in range(len(book)):
                own = [c[p] for c, m in zip(cut, mine, strict=True) if m == k]
                if own:
                    book[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(gap(c[p], books[p][f[p]]) for p in range(parts)) for c, f in zip(cut, found, strict=True)]
    total = {}
    for (_, label, _), e in zip(good, errors, strict=True):
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted(((v, "".join(f"{k:02x}" for k in f), e, total[label], sha) for (v, label, _), f, e in zip(good, found, errors, strict=True)), key=str)


def run(spark, rows, tasks=3, **options):
    df = spark.createDataFrame([(v, e, label, "x") for v, e, label in rows], "vec_id long, embedding array<double>, label int, code string").repartition(tasks)
    return sorted((tuple(r) for r in codes.compress(df, **options).collect()), key=str)


BAD = [(900, None, 1), (901, [], 2), (902, [None] * 32, 1), (903, [math.nan] * 32, 1), (904, [math.inf] + [0.0] * 31, 1), (905, [1.0, 2.0], 1)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, (300, 32))
    x[::5] = np.round(x[::5] * 16) / 16  # ties
    x[40:60] = x[40]
    rows = [(k, e, int(k) % 3 or None) for k, e in zip(rng.permutation(300).tolist(), x.tolist(), strict=True)]
    rows += [(None, rows[3][1], 7), (5, rows[4][1], 1)]
    want = by_hand(rows)
    assert run(spark, rows + BAD) == want
    assert run(spark, rows + BAD, tasks=1) == want


@pytest.mark.parametrize("n", [1, 5, 70])
def test_few_rows_and_equal_ones(spark, n):
    rng = np.random.default_rng(n)
    x = rng.integers(-2, 3, (n, 16)) / 128
    rows = [(k, e, 1) for k, e in enumerate(x.tolist())]
    assert run(spark, rows) == by_hand(rows)
    rows = [(k, [0.5] * 16, None) for k in range(n)]
    assert run(spark, rows) == by_hand(rows)


def test_other_sizes_and_none(spark):
    rng = np.random.default_rng(3)
    rows = [(k, e, 1) for k, e in enumerate(rng.normal(0, 300, (80, 12)).tolist())]
    assert run(spark, rows, parts=4, entries=7, rounds=3) == by_hand(rows, 4, 7, 3)
    assert run(spark, []) == [] and run(spark, BAD[:5]) == []
    padded = run(spark, [(k, e[:10], 1) for k, e, _ in rows], parts=4, entries=5)
    assert padded == by_hand([(k, e[:10] + [0.0, 0.0], 1) for k, e, _ in rows], 4, 5)
    with pytest.raises(ValueError, match="digits"):
        run(spark, rows, entries=257)


def test_huge_components(spark):
    rows = [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [0.0] * 16, 1)]
    clipped = [(v, [max(min(c, 65536.0), -65536.0) for c in e], label) for v, e, label in rows]
    assert run(spark, rows) == by_hand(clipped)


@pytest.mark.parametrize("spread", [3, 40, 1 << 20])
def test_search_is_exact_and_skips(spread):
    rng = np.random.default_rng(spread)
    book = codes.Book(rng.integers(-spread, spread, (64, 4)))
    x = book.entries[rng.integers(0, 64, 3000)] + rng.integers(-max(1, spread // 10), max(2, spread // 10), (3000, 4))
    gaps = ((x[:, None] - book.entries[None]) ** 2).sum(axis=2)
    for before in (book.start(x), rng.integers(0, 64, 3000), gaps.argmin(axis=1)):
        best, least, taken = book.nearest(x, before)
        assert np.array_equal(best, gaps.argmin(axis=1)) and np.array_equal(least, gaps.min(axis=1))
    if spread > 3:
        assert taken < 3000 * 16


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in codes.op13_vector_codes(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == by_hand(rows)
