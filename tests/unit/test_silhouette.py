"""The silhouette against its definition, in memory and out of it; seeds and draws of repeated rows."""

from threading import Barrier

import numpy as np
from pyspark.sql import functions as F

from segue.ml import clustering as M


def by_hand(x, labels):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(labels):
        mates = (labels == own) & (np.arange(len(x)) != i)
        if not mates.any():
            out.append(0.0)
            continue
        a, b = gaps[i, mates].mean(), min(gaps[i, labels == k].mean() for k in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouettes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(4, 1, (40, 3)), [[50.0, 50.0, 50.0]]])
    x = np.concatenate([x, x[:10], x[:5]])
    models = [np.array([[0.0] * 3, [4.0] * 3, [50.0] * 3]), np.array([[0.0] * 3, [9.0] * 3]), np.array([[1.0] * 3, [500.0] * 3, [600.0] * 3])]
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    want = [by_hand(x, M.distances(x, m).argmin(axis=1)) for m in models[:2]] + [-1.0]
    with M.Points(rows, "x") as points:
        low, high = M.silhouettes(points, models)
        assert low == high and np.allclose(low, want, atol=1e-6)
    monkeypatch.setattr(M, "IN_MEMORY", 10)
    monkeypatch.setattr(M, "CELLS", (4, 16))
    monkeypatch.setattr(M, "REFINED", 30)
    with M.Points(rows, "x") as points:
        assert points.local is None
        for asks in range(1, 9):  # bounds narrow with every step, down to the scores themselves
            asked = []
            low, high = M.silhouettes(points, models, lambda low, high, asked=asked, asks=asks: asked.append(1) or len(asked) >= asks)
            assert all(a <= w + 1e-9 and w <= b + 1e-9 for a, b, w in zip(low, high, want, strict=True))
        assert np.allclose(low, want, atol=1e-6) and np.allclose(high, want, atol=1e-6)


def test_number_of_clusters_beyond_memory_is_that_of_all_rows(spark, monkeypatch):
    """Three blobs, none, and two that touch: the choice is that of all rows against all."""
    rng = np.random.default_rng(3)
    spots = [rng.normal(0, 1, (1500, 2)) + np.repeat([[0, 0], [9, 0], [0, 9]], 500, axis=0), rng.uniform(0, 1, (1200, 2)), rng.normal(0, 1, (1500, 2)) + np.repeat([[0, 0], [3.2, 0], [0, 9.0]], 500, axis=0)]
    for x in spots:
        rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3).persist()
        monkeypatch.setattr(M, "IN_MEMORY", 1 << 16)
        near, _ = M.choose_k(rows, len(x), most=5, restarts=2)
        monkeypatch.setattr(M, "IN_MEMORY", 100)
        far, models = M.choose_k(rows, len(x), most=5, restarts=2)
        assert near == far and len(models) == 4


def test_seeds_of_repeated_rows(spark, monkeypatch):
    """Three values of 6,000 rows each, whatever is held in memory."""
    rows = spark.range(18_000).select(F.array((F.col("id") % 3 * 10).cast("double")).alias("x"))
    for held in (1 << 16, 2):
        monkeypatch.setattr(M, "IN_MEMORY", held)
        model = M.fit(rows, [3], restarts=3)[3]
        assert sorted(model.centers.ravel().tolist()) == [0, 10, 20] and model.inertia < 1e-6


def test_a_million_rows_of_fifty_values(spark):
    value = F.col("id") % 50
    rows = spark.range(1_000_000).select(F.array((value % 5 * 100 + value / 50).cast("double"), (value % 2 * 0.1).cast("double")).alias("x"))
    model = M.fit(rows, [5], restarts=2)[5]
    assert sorted(round(c / 100) for c in model.centers[:, 0]) == [0, 1, 2, 3, 4]
    assert model.inertia < 1_000_000


def test_fewer_values_than_clusters(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0],), ([2.0],)], "x array<double>")
    assert sorted(set(M.fit(rows, [3], restarts=1)[3].centers.ravel().tolist())) == [1.0, 2.0]


def test_equal_rows_are_drawn_each_for_itself(spark):
    """Draws of a group of equal rows vary as so many rows' draws do."""
    x = np.arange(3.0)[:, None]
    w = np.array([1, 900, 200_000])
    counts = M.row_draws(x, w, 2000, 5)
    assert np.allclose(counts.mean(axis=0), w, rtol=0.05)
    assert np.allclose(counts.var(axis=0), w, rtol=0.12)
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (50, len(M.SPACE))) @ rng.normal(0, 1, (len(M.SPACE),) * 2)
    widths = [M.pca_weights(spark.createDataFrame([(r.tolist(),) for r in np.repeat(base, n, axis=0)], "z array<double>"), boots=60)[1] for n in (1, 40)]
    assert widths[1] < widths[0] / 3


def test_a_round_beyond_memory_is_one_stage(spark, monkeypatch):
    """Rounds over blocks move no rows: each is a job of one stage, and gives what a matrix in memory does."""
    x = np.random.default_rng(2).normal(0, 1, (500, 3))
    rows = spark.createDataFrame([(r.tolist(),) for r in np.concatenate([x, x[:50]])], "x array<double>").repartition(4)
    work = lambda x, w: np.concatenate([[w.sum()], w @ x])
    with M.Points(rows, "x") as near:
        want = [p.sums(work, 4) for p in (near, near.times(np.array([1.0, -2.0, 0.5])))]
    monkeypatch.setattr(M, "IN_MEMORY", 10)
    sc = spark.sparkContext
    with M.Points(rows, "x") as far:
        assert far.local is None
        far.sums(work, 4)
        sc.setJobGroup("rounds", "rounds")
        got = [p.sums(work, 4) for p in (far, far.times(np.array([1.0, -2.0, 0.5])))]
        jobs = sc.statusTracker().getJobIdsForGroup("rounds")
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert np.allclose(got, want)
        told = sc.statusTracker()
        ran = [i for i in (told.getStageInfo(s) for j in jobs for s in told.getJobInfo(j).stageIds) if i is not None and i.numCompletedTasks]
        assert len(jobs) == 2 and len(ran) == 2  # those that gave the rows are skipped
        monkeypatch.setattr(M, "MOST_SUMS", 3)  # more sums than are sent whole meet in a shuffle
        assert np.allclose(far.sums(work, 4), want[0])
        again = M.silhouettes(far, [np.zeros((1, 3)), np.array([[1.0] * 3, [-1.0] * 3])])
        assert again[0][0] == -1.0


def test_a_clustering_beyond_memory_groups_its_rows_once(spark, monkeypatch):
    """Weights, fit and refinement pass over the same vectors."""
    rng = np.random.default_rng(4)
    at = np.repeat(rng.normal(0, 5, (3, len(M.SPACE))), 100, axis=0) + rng.normal(0, 1, (300, len(M.SPACE)))
    known = spark.createDataFrame([(k, 60.0, *r.tolist()) for k, r in enumerate(at)], f"pos long, duration double, {', '.join(f'{c} double' for c in M.SPACE)}")
    made, plain = [], M.Points.__init__
    monkeypatch.setattr(M.Points, "__init__", lambda self, *a: made.append(a[1]) or plain(self, *a))
    led = {}
    for held in (1 << 16, 50):
        monkeypatch.setattr(M, "IN_MEMORY", held)
        made.clear()
        out = M.cluster(known, k=3, restarts=3, dedup="keep").labelled.select("pos", "cluster_id").collect()
        assert made == ["z"]
        groups = {}
        for r in out:
            groups.setdefault(r.cluster_id, set()).add(r.pos)
        led[held] = sorted(map(sorted, groups.values()))
    assert led[50] == led[1 << 16] and [len(g) for g in led[50]] == [100, 100, 100]


def test_genres_are_clustered_at_the_same_time(spark, monkeypatch):
    """Beyond memory, every genre's clustering waits until the others' have begun; what comes out is what each gives alone."""
    monkeypatch.setattr(M, "IN_MEMORY", 10)

    def spots(j, k):
        return (F.pmod(F.xxhash64("pos", F.lit(j)), F.lit(1000)) / 1000.0 + k * (F.col("pos") % 3)).alias(M.SPACE[j])

    genre = F.element_at(F.array(*map(F.lit, ("dnb", "house", "techno"))), (F.col("pos") % 7 % 3 + 1).cast("int"))
    known = spark.range(600).withColumnRenamed("id", "pos").select("pos", F.lit(200.0).alias("duration"), genre.alias("resolved"), *[spots(j, 5.0) for j in range(len(M.SPACE))])
    want = {(r.pos, f"{g}_{r.cluster_id}") for g in ("dnb", "house", "techno") for r in M.cluster(known.where(F.col("resolved") == g), genre=g, k=3, restarts=2).labelled.collect()}
    gate, cluster = Barrier(3, timeout=30), M.cluster
    monkeypatch.setattr(M, "cluster", lambda *a, **k: gate.wait() is not None and cluster(*a, **k))
    assert {(r.pos, r.cluster_id) for r in M.per_genre(known, k=3, restarts=2).collect()} == want


def test_a_light_pass_has_no_more_tasks_than_full_blocks(spark, monkeypatch):
    """A round over few rows is one task, whatever the partitions; its sums are those of all rows."""
    monkeypatch.setattr(M, "IN_MEMORY", 10)
    rows = spark.range(500).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x")).repartition(6)
    with M.Points(rows, "x") as points:
        whole = points.sums(lambda x, w: w @ x, 2)
        assert points.blocks.getNumPartitions() > 1
        assert points.each_block(lambda blocks: [1], light=True).count() == 1
        assert np.array_equal(points.sums(lambda x, w: w @ x, 2, light=True), whole) and whole.tolist() == [500 * 499 / 2, 500.0]
