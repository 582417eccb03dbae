import random
import re

import pytest

from segue.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def compare(spark, rows):
    df = spark.createDataFrame([(d, t, "n", 1.0) for d, t in rows], "doc_id long, text string, fp string, slot double")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_join(df).collect())
    assert got == by_hand(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    want = {d for d, _, c in by_hand(rows) if d == c}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz") * rng.randint(1, 2)
    rows, d = [], 0
    common = [word() for _ in range(40)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 9, 30, 80, 200]))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append((d := d + rng.randint(1, 3), rng.choice([" ", "\n", " \t"]).join(w if rng.random() < 0.8 else [x.upper() for x in w])))
    rng.shuffle(rows)
    rows += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "one"), (5004, "ONE"), (5005, "one two three four"), rows[0], rows[1]]
    compare(spark, rows)


def test_chain_of_near_copies(spark):
    """Each links with the next only; one component through all."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[: 100 - 3 * k] + [f"v{j}" for j in range(3 * k)])) for k in range(25)]
    rows += [(100 + k, " ".join(base + [f"z{k}"])) for k in range(60)]
    compare(spark, rows)


def test_edges(spark):
    assert jaccard.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    compare(spark, [(3, "x " * 200_000), (1, "x " * 100_000), (2, " ".join(map(str, range(50_000))))])
    out = jaccard.ngram_join(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")).collect()
    assert all(r.component_id is None for r in out) and len(out) == 2


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = jaccard.op1_ngram_jaccard(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_hand(rows)
