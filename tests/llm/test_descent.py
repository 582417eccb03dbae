import math

import numpy as np

from segue.llm import descent


def by_hand(rows, threshold=0.93):
    good = [i for i, (_, lab, e) in enumerate(rows) if lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = {i: np.array(rows[i][2]) / np.linalg.norm(rows[i][2]) for i in good}
    for i in good:
        for j in good:
            if j < i and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label long, embedding array<double>, nid int")
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in descent.near_copies(df).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(descent, "TILE", 32)  # groups of many tiles
    rng = np.random.default_rng(4)
    rows = []
    for label in (1, 2, None):
        x = list(rng.normal(size=(150, 24)))
        for size in (2, 2, 3, 10, 120):
            centre = rng.normal(size=24)
            x += [centre + rng.normal(0, 0.16, 24) for _ in range(size)]
        x += [x[0]] * 3
        rows += [[len(rows) + k, label, e.tolist()] for k, e in enumerate(x)]
    ids = rng.permutation(5000)
    rows = [(int(ids[k]), r[1], r[2]) for k, r in enumerate(rows)]
    rows += [(6000, 1, None), (6001, 1, [0.0] * 24), (6002, 1, [None] * 24), (6003, 1, [math.nan] * 24), (6004, 1, []), (6005, 1, [1.0, 2.0]), rows[0], (6006, 2, [1e200 * x for x in rows[200][2]])]
    assert run(spark, rows) == by_hand(rows)


def test_few_and_none(spark):
    assert run(spark, []) == []
    rows = [(5, 1, [1.0, 0.0]), (3, 1, [1.0, 0.01]), (4, 2, [1.0, 0.0])]
    assert run(spark, rows) == by_hand(rows)


def test_query_by_brute_force(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = descent.op2_embedding_dedup(spark, "/root/testdata/sf0.01").collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == by_hand(rows)


def test_bridged_full_groups(spark):
    """Two dense groups whose cross pairs reach the threshold, each larger than a full list."""
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
    rows = []
    for centre in (a, 0.96 * a + 0.28 * b):  # far closer within than hyperplanes part
        rows += [(len(rows) + k, 1, (centre + rng.normal(0, 1e-5, 24)).tolist()) for k in range(45)]
    want = by_hand(rows)
    assert want[0][1] > 44 and want[60][2] == 0
    assert run(spark, rows) == want


def test_a_hot_group_hides_no_lost_pairs(spark, monkeypatch):
    """With cells too fine for pairs, the audit sees what is lost beside a hot group."""
    for name, value in (("CELL", 1e-9), ("TURNS", 0), ("ROUNDS", 1)):
        monkeypatch.setattr(descent, name, value)
    rng = np.random.default_rng(9)
    hot, rows = rng.normal(size=24), []
    rows += [(k, 1, (hot + rng.normal(0, 0.001, 24)).tolist()) for k in range(200)]
    for _ in range(60):
        centre = rng.normal(size=24)
        rows += [(len(rows) + k, 1, (centre + rng.normal(0, 0.16, 24)).tolist()) for k in range(2)]
    assert run(spark, rows) == by_hand(rows)


def test_recall_that_cannot_be_seen_goes_the_exact_way(spark, monkeypatch):
    """Two near copies among many vectors, none of which is audited, and lists that would miss them."""
    monkeypatch.setattr(descent, "AUDIT", 2)
    monkeypatch.setattr(descent, "MORE", 2)
    monkeypatch.setattr(descent, "_codes", lambda turn: lambda batches: iter(()))
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 12))
    x[200] = x[10] + 0.05 * rng.normal(size=12)
    rows = [(k, k % 2, e) for k, e in enumerate(x.tolist())]
    want = by_hand(rows)
    assert want[200][2] == 10
    assert run(spark, rows) == want
