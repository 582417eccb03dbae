import hashlib
import random
import re

import numpy as np
import pytest

from segue.llm import substrings
from segue.llm._text import mix64

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, width=50):
    """(words, removed, kept) for each row."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def compare(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, keys int, tkey string")
    got = substrings.dedup(df, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == by_hand(rows, options.get("width", 50))
    left = {(r.doc_id, r.text) for r in substrings.stripped(df, **options).collect()}
    assert all(d is None or t is None or t != "" or ("" in [x for y, x in rows if y == d]) for d, t in left)
    assert substrings.stripped(df, **options).columns == df.columns


def passages(seed, alphabet, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(alphabet, k=rng.randint(1, 3)))
    shared = [[word() for _ in range(rng.choice([49, 50, 51, 60, 150]))] for _ in range(6)]
    rows = []
    for d in rng.sample(range(1000), n):
        parts = [[word() for _ in range(rng.randint(0, 80))]]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), [word() for _ in range(rng.randint(0, 20))]]
        if rng.random() < 0.2:
            parts.append([word()] * rng.randint(40, 130))
        if rng.random() < 0.2:
            parts.append([word(), word()] * rng.randint(20, 70))
        rows.append((d, rng.choice([" ", "  ", "\n"]).join(x for p in parts for x in p)))
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "äöé中"])
def test_against_brute_force(spark, alphabet):
    rows = passages(3, alphabet)
    rows += [(2000, rows[0][1]), (2000, rows[1][1]), (2000, rows[1][1]), (None, rows[0][1]), (2001, None), (2002, ""), (2003, " \n ")]
    compare(spark, rows)


def test_runs_and_one_copy_group(spark):
    text = "one two three four five " * 30
    rows = [(k, text + (f" x{k}" if k % 3 else "")) for k in range(40)] + [(100 + k, "a " * (45 + k)) for k in range(12)]
    compare(spark, rows)
    compare(spark, rows, width=20)


def test_long_text_and_empty(spark):
    long = " ".join(str(k) for k in range(120_000))
    compare(spark, [(5, long), (9, "intro " + long[200_000:260_000] + " end"), (7, long[:300])])
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("width", [1, 3, 10, 44, 100])
def test_other_widths(spark, width):
    compare(spark, passages(5, "abcdefgh", 40), width=width)


def test_width_of_nothing_is_refused(spark):
    with pytest.raises(ValueError, match="word"):
        substrings.dedup(spark.createDataFrame([], "doc_id long, text string"), width=0)


@pytest.mark.parametrize("letters", [1, 2, 3, 20, 5000])
def test_symbols_depend_on_their_spans_alone(letters):
    rng = np.random.default_rng(letters)
    names = mix64(np.arange(1, letters + 1, dtype=np.uint64))
    codes = np.concatenate([names[rng.integers(0, letters, 3000)], np.tile(names[: min(letters, 3)], 200)])
    whole, _ = substrings.parse(codes, np.array([0]), 50)
    seen = lambda symbols, a, b: {(int(n), int(x) - a, int(lo) - a, int(hi) - a) for n, x, lo, hi in zip(symbols.name, symbols.at, symbols.lo, symbols.hi, strict=True) if lo >= a and hi <= b}
    for at in rng.integers(0, len(codes) - 50, 60):
        part, _ = substrings.parse(codes[at : at + 50].copy(), np.array([0]), 50)
        for all_, some in zip(whole, part, strict=True):
            assert (np.diff(all_.lo) >= 0).all() and (np.diff(all_.hi) >= 0).all()
            assert seen(some, 0, 50) == seen(all_, at, at + 50)


def test_long_symbols_carry_long_repeats():
    rng = np.random.default_rng(1)
    names = mix64(np.arange(1, 20_001, dtype=np.uint64))
    shared = rng.integers(0, 20_000, 4000)
    found = []
    for _ in range(2):
        codes = names[np.concatenate([rng.integers(0, 20_000, int(rng.integers(50, 90))), shared, rng.integers(0, 20_000, 70)])]
        found.append(substrings.parse(codes, np.array([0]), 50)[1])
    (a, begin, end), (b, _, _) = found
    covered = np.zeros(len(codes) + 200, bool)
    for x, y in zip(begin[np.isin(a, b)], end[np.isin(a, b)], strict=True):
        assert y - x >= 50
        covered[x:y] = True
    assert covered.sum() > 3800


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = substrings.op9_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == by_hand(rows)
